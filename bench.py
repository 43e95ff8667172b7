"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_RUNS the
timed runs per query (the median counts). Every run builds all its layers from
the raw files again; ``score_batch`` times scoring with a model fitted before. The
model's fits and what reads the whole model are timed once, as a fit takes minutes.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moundworks.operators import attribution, enrich, gold, model, report, rolling  # noqa: E402
from moundworks.plans import layers  # noqa: E402
from moundworks.plans.queries import FIRST_RUN, QUERIES  # noqa: E402
from moundworks.sources.store import durable  # noqa: E402

HEADLINE = ["pitches_clean", "pitcher_game_summary", "rolling_30d", "batter_game_summary", "pitch_mix",
            "pitcher_game_fanout", "leaderboard", "anomaly_z"]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("moundworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run, runs: int) -> float:
    run()  # warm-up: code generation and JIT
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def once(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def insights_of(t):
    return enrich.insight_rows(rolling.last_n(t.narratives, "pitcher_id", 2), FIRST_RUN)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = session()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    results = {}

    def from_raw(name):
        layers.forget(spark)
        noop(QUERIES[name](spark, sf_dir))

    for name in HEADLINE:
        results[name] = timed(lambda: from_raw(name), runs)

    # the summaries on typed pitches that are stored already
    typed = durable(layers.layers(spark, sf_dir).pitches)
    results["pitcher_game_summary_from_silver"] = timed(lambda: noop(gold.pitcher_game_summary(typed)), runs)
    results["batter_game_summary_from_silver"] = timed(lambda: noop(gold.batter_game_summary(typed)), runs)

    # the look-back windows alone, on game rows that are stored already
    base = durable(gold.pitcher_game_base(typed))
    results["rolling_30d_from_gold"] = timed(lambda: noop(rolling.with_context(base)), runs)

    layers.forget(spark)
    t = layers.layers(spark, sf_dir)
    fitted, rows = t.fitted, t.summary
    results["score_batch"] = timed(lambda: noop(model.score_batch(fitted, rows)), runs)

    headline = sum(results.values())
    # the model itself, outside the headline total: one full fit, one fold with early stopping, and what reads it, once each
    stored = insights_of(t)
    for name, run in {
        "train_full_fit": lambda: model.train(t.training),
        "cv_one_fold": lambda: model.fold_metrics(t.folds.filter("val_fold < 5"), t.folds.filter("val_fold = 5")),
        "attributions": lambda: noop(attribution.attributions(fitted, rows)),
        "scouting_report": lambda: noop(report.scouting_report(rows, stored, fitted)),
    }.items():
        results[name] = once(run)

    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(headline, 3), "unit": "sec",
        "queries": results, "model_trees": fitted.stages[-1].getNumTrees, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    layers.forget(spark)
    spark.stop()


if __name__ == "__main__":
    main()
