import itertools
from math import factorial

import numpy as np
import pytest
from harness import DATA
from pyspark.sql import functions as F

from moundworks.constants import FEATURES, TARGET
from moundworks.operators import attribution, model
from moundworks.plans.layers import layers
from moundworks.sources import store


@pytest.fixture(scope="module")
def t(spark):
    return layers(spark, DATA)


@pytest.mark.parametrize("n", [13, 12, 6])
def test_fold_sizes(spark, t, n):
    rows = t.training.orderBy("game_date", "pitcher_id").limit(n)
    got = {r.val_fold: r["count"] for r in model.time_series_folds(rows).groupBy("val_fold").count().collect()}
    assert got == {0: n - 5 * (n // 6), **{k: n // 6 for k in range(1, 6)}}


def test_folds_never_look_ahead(t):
    ends = {r.val_fold: (r.lo, r.hi) for r in t.folds.groupBy("val_fold").agg(
        F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")).collect()}
    assert all(ends[k][1] + 1 == ends[k + 1][0] for k in range(5))
    by_day = model.time_series_folds(t.training, by_date=True)
    assert by_day.groupBy("game_date").agg(F.count_distinct("val_fold").alias("n")).agg(F.max("n")).first()[0] == 1


def test_medians_fill_nulls(spark, t):
    holes = t.training.withColumn("avg_spin", F.when(F.col("game_pk") % 2 == 0, F.col("avg_spin")))
    want = holes.agg(F.median("avg_spin")).first()[0]
    filled = model.feature_matrix(holes)
    assert filled.filter("avg_spin IS NULL").count() == 0
    assert filled.filter(F.col("avg_spin") == want).count() > 0


def test_lagged_features_come_from_the_previous_start(t):
    rows = model.lag_features(t.summary).filter("pitcher_id = 1000").orderBy("game_date").collect()
    now = t.summary.filter("pitcher_id = 1000").orderBy("game_date").collect()
    assert rows[0].zone_rate is None
    assert [r.zone_rate for r in rows[1:]] == [r.zone_rate for r in now[:-1]]
    assert [r.csw_rate for r in rows] == [r.csw_rate for r in now]


def test_contributions_add_up(t):
    got = attribution.contributions(t.fitted, t.summary).collect()
    for r in got:
        assert sum(r.contributions) + r.base_value == pytest.approx(r.prediction, abs=1e-9)
    top = attribution.attributions(t.fitted, t.summary).first().top_features
    sizes = [abs(f.contribution) for f in top]
    assert len(top) == 3 and sizes == sorted(sizes, reverse=True)


def test_summary_of_the_last_rows(t):
    got = attribution.attribution_summary(t.fitted, t.summary, last=20).collect()
    assert {r.feature for r in got} == set(FEATURES)
    assert all(r.mean_abs_contribution >= 0 for r in got)


def test_shapley_against_all_subsets():
    """Brute force over every subset of the features on random leaves."""
    rng = np.random.default_rng(1)
    width, leaves = 4, []
    for _ in range(6):
        feats = rng.choice(width, size=rng.integers(1, 4), replace=False)
        leaves.append((rng.normal(), {int(f): (rng.uniform(-1, 0), rng.uniform(0, 1), rng.uniform(0.1, 0.9))
                                      for f in feats}))
    x = rng.uniform(-1, 1, size=(5, width))

    def game(row, known):
        total = 0.0
        for value, path in leaves:
            for f, (low, high, share) in path.items():
                value *= float(low < row[f] <= high) if f in known else share
            total += value
        return total

    want = np.zeros_like(x)
    for n, row in enumerate(x):
        for f in range(width):
            others = [g for g in range(width) if g != f]
            for size in range(width):
                for known in itertools.combinations(others, size):
                    w = factorial(size) * factorial(width - size - 1) / factorial(width)
                    want[n, f] += w * (game(row, {*known, f}) - game(row, set(known)))
    assert np.allclose(attribution.shapley(x, attribution._packed(leaves), width), want)


def test_scores_survive_saving(spark, t):
    path = store.scratch_path(spark, "model")
    model.save_model(t.fitted, path)
    loaded, columns = model.load_model(spark, path)
    assert columns == FEATURES
    a = model.score_batch(t.fitted, t.summary).orderBy("game_pk", "pitcher_id").collect()
    assert a == model.score_batch(loaded, t.summary).orderBy("game_pk", "pitcher_id").collect()
    assert all(0 <= r.stuff_score <= 100 for r in a)


def test_best_round_waits_for_patience():
    errors = [5.0, 4.0, 4.5, 4.4, 3.0, 3.5]
    assert model.best_round(errors, 30) == 5
    assert model.best_round(errors, 2) == 2
    assert model.best_round([1.0], 30) == 1


def test_fold_metrics_are_those_of_a_fit_with_the_kept_rounds(t):
    training, validation = t.folds.filter("val_fold < 3"), t.folds.filter("val_fold = 3")
    for patience, settings in ((2, model.PARAMS), (30, {**model.PARAMS, "maxIter": 4})):
        got = model.fold_metrics(training, validation, settings, patience)
        fitted = model.train(training, {"maxIter": got["rounds"]})
        rows = [(r.prediction, r[TARGET]) for r in fitted.transform(validation).select("prediction", TARGET).collect()]
        error = [p - y for p, y in rows]
        mean = sum(y for _, y in rows) / len(rows)
        assert got["rmse"] == pytest.approx((sum(e * e for e in error) / len(rows)) ** 0.5)
        assert got["mae"] == pytest.approx(sum(map(abs, error)) / len(rows))
        assert got["r2"] == pytest.approx(1 - sum(e * e for e in error) / sum((y - mean) ** 2 for _, y in rows))
        assert got["rounds"] <= settings["maxIter"]


def test_registered_model_has_all_its_rounds(t):
    trees = t.fitted.stages[-1]
    assert model.PARAMS["maxIter"] == 400 and model.EARLY_STOP == 30
    assert trees.getNumTrees == model.PARAMS["maxIter"]
    assert {k: trees.getOrDefault(k) for k in ("maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "seed")} == {
        k: model.PARAMS[k] for k in ("maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "seed")}
    assert max(r.rounds for r in t.cv.collect()) <= 400


def test_model_fills_with_the_exact_medians(spark, t):
    medians = model.feature_medians(t.training).first().asDict()
    empty = spark.createDataFrame([tuple([None] * len(FEATURES))], ", ".join(f"{c} double" for c in FEATURES))
    filled = t.fitted.transform(empty).first()
    assert [filled[f"{c}_f"] for c in FEATURES] == [medians[c] for c in FEATURES]


def test_cross_validation(t):
    got = t.cv.orderBy("fold").collect()
    assert [r.fold for r in got] == [1, 2, 3, 4, 5]
    assert all(r.rmse >= r.mae > 0 and r.r2 <= 1 for r in got)
    assert all(a.n_train + a.n_val == b.n_train for a, b in zip(got, got[1:]))
