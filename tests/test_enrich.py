import pandas as pd
import pytest
from frames import by, day, summary
from pyspark.sql import functions as F

from moundworks.operators import anomaly, enrich, explore, quality, report


def named(spark, rows):
    return summary(spark, rows).withColumns({
        "pitcher_name": F.concat(F.lit("Pat #"), F.col("pitcher_id").cast("string")),
        "total_pitches": F.lit(90), "velo_vs_30d_avg": F.lit(-1.25), "rolling_30d_avg_velo": F.lit(90.0),
        "rolling_30d_csw_rate": F.lit(0.3), "rolling_30d_whiff_rate": F.lit(0.25),
        "whiff_rate_delta": F.round(F.col("whiff_rate") - 0.25, 4),
    })


def test_top_anomalies_of_each_day(spark):
    rows = [(p, p, 0, 90.0, 0.3, 0.30 + p / 100) for p in range(1, 10)] + [(1, 50, 1, 90.0, 0.3, 0.34)]
    got = anomaly.anomaly_literal(named(spark, rows)).collect()
    first = sorted((r.place, r.pitcher_id) for r in got if r.game_date == day(0))
    assert first == [(1, 9), (2, 8), (3, 7), (4, 6), (5, 5)]
    assert [r.whiff_z for r in got if r.game_date == day(1)] == [None]
    one_day = anomaly.anomaly_literal(named(spark, rows), day=day(1)).collect()
    assert [(r.pitcher_id, r.whiff_delta) for r in one_day] == [(1, 0.09)]


def test_doubleheader_has_a_z(spark):
    rows = [(1, 1, 0, 90.0, 0.3, 0.40), (1, 2, 0, 90.0, 0.3, 0.60)]
    got = by(anomaly.anomaly_literal(named(spark, rows)), "game_pk")
    sd = pd.Series([0.4, 0.6]).std()
    assert got[2].whiff_z == pytest.approx(0.35 / sd, abs=1e-4)


def test_z_uses_the_past_spread(spark):
    whiffs = [0.20, 0.22, 0.21, 0.19, 0.45]
    df = named(spark, [(1, g, g, 90.0, 0.3, w) for g, w in enumerate(whiffs)])
    got = by(anomaly.anomaly_z(df), "game_pk")
    past = pd.Series(whiffs[:4])
    assert got[4].whiff_z == pytest.approx(0.20 / past.std(), abs=1e-3)
    assert 1 not in got  # one past game has no spread


def test_anomaly_prompt_lists_in_order(spark):
    rows = [(p, p, 0, 90.0, 0.3, 0.30 + p / 20) for p in (4, 5)]
    r = enrich.anomaly_prompt(anomaly.anomaly_literal(named(spark, rows))).first()
    assert "- Pat #5: whiff_rate 55.0% (30d avg: 25.0%, velo delta: -1.2 mph)\n- Pat #4:" in r.prompt


def test_insight_lookup_with_default(spark):
    rows = spark.createDataFrame([(1, day(0)), (2, day(0))], "pitcher_id int, game_date date")
    stored = spark.createDataFrame(
        [(1, 5, day(0), "pitcher_game", '{"headline": "h"}', "2024-01-01"),
         (1, 5, day(0), "other", '{"headline": "no"}', "2024-02-01")],
        "pitcher_id int, game_pk int, game_date date, insight_type string, insight_json string, generated_at string")
    got = by(explore.with_insight(rows, stored), "pitcher_id")
    assert (got[1].headline, got[1].key_finding) == ("h", "Insight not available.")
    assert (got[2].headline, got[2].concern_flag) == ("Insight generation pending.", None)


def test_quality_counts_violations(spark):
    s = spark.createDataFrame(
        [(1, 1.2, 0.5, "elite", 90.0, 89.0, 1.0), (None, 0.3, None, "great", 90.0, 89.0, 2.0)],
        "pitcher_id int, csw_rate double, whiff_rate double, performance_tier string, avg_velo double, "
        "rolling_30d_avg_velo double, velo_vs_30d_avg double")
    b = spark.createDataFrame([(130.0, 0.1), (90.0, -0.1)], "avg_exit_velo double, barrel_rate double")
    i = spark.createDataFrame([('{"headline": "x"}',), ("oops",)], "insight_json string")
    got = {r.check: r.violations for r in quality.dq_report(s, b, i).collect()}
    assert got == {"csw_rate_bounds": 1, "whiff_rate_bounds": 0, "performance_tier_known": 1, "pitcher_id_present": 1,
                   "velo_delta_consistent": 1, "exit_velo_realistic": 1, "barrel_rate_bounds": 1,
                   "insight_keys_present": 2, "insight_tier_known": 2}


def test_report_features_for_the_next_start(spark):
    from moundworks.constants import FEATURES
    df = named(spark, [(1, 1, 0, 95.0, 0.3, None)])
    for c in FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    now, ahead = report.report_features(df).first(), report.report_features(df, next_start=True).first()
    assert (now.rolling_30d_avg_velo, ahead.rolling_30d_avg_velo) == (90.0, 95.0)
    assert now.whiff_rate_delta is None and now.avg_spin is None  # the model fills these, as in batch scoring
