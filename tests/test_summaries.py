import math
import re
import statistics

import pytest
from frames import by, day, pitches, summary

from moundworks.functions import rules
from moundworks.operators import explore, extras, gold, rolling, silver
from moundworks.sources import bronze


def test_rates_and_entropy_by_hand(spark):
    rows = [
        {"description": "swinging_strike", "pitch_type": "FF", "zone": 12, "release_speed": 90.0},
        {"description": "called_strike", "pitch_type": "FF", "zone": 5, "release_speed": 92.0},
        {"description": "swinging_strike_blocked", "pitch_type": "SL", "zone": 13, "release_speed": 94.0},
        {"description": "ball", "pitch_type": None, "zone": None, "release_speed": None},
        {"description": "hit_into_play", "pitch_type": "SL", "zone": 14, "release_speed": 96.0,
         "launch_speed": 100.0, "estimated_woba": 0.5, "is_barrel": True, "delta_run_exp": 0.25},
    ]
    r = gold.pitcher_game_base(pitches(spark, rows)).first()
    assert (r.total_pitches, r.avg_velo) == (5, 93.0)
    assert r.velo_stddev == round(statistics.stdev([90, 92, 94, 96]), 2)
    assert (r.whiff_rate, r.csw_rate, r.zone_rate) == (0.5, 0.4, 0.2)  # a null zone counts as a pitch
    assert r.chase_rate == 0.6667
    assert (r.avg_xwoba_allowed, r.avg_exit_velo_allowed, r.barrel_rate_allowed) == (0.5, 100.0, 1.0)
    assert r.total_re_delta == 0.25
    shares = [2 / 5, 2 / 5, 1 / 5]  # no pitch type is a class of its own
    assert r.stuff_diversity == round(-sum(p * math.log(p) for p in shares), 4)


def test_single_pitch_without_swing(spark):
    r = gold.pitcher_game_base(pitches(spark, [{}])).first()
    assert (r.total_pitches, r.velo_stddev, r.whiff_rate, r.csw_rate, r.stuff_diversity) == (1, None, None, 0.0, 0.0)
    assert (r.avg_exit_velo_allowed, r.barrel_rate_allowed) == (None, None)


def test_all_swings_variant(spark):
    rows = [{"description": "swinging_strike"}, {"description": "foul"}, {"description": "hit_into_play"},
            {"description": "ball"}]
    df = pitches(spark, rows)
    assert gold.pitcher_game_base(df).first().whiff_rate == 1.0
    assert gold.pitcher_game_base(df, swing=rules.SWING_ALL).first().whiff_rate == 0.3333


def test_null_pitchers_and_null_games(spark):
    df = pitches(spark, [{"pitcher_id": None}, {"game_pk": None}, {"game_pk": None}, {}])
    got = by(gold.pitcher_game_base(df), "pitcher_id", "game_pk")
    assert {k: v.total_pitches for k, v in got.items()} == {(10, None): 2, (10, 1): 1}
    # the literal lateral join loses rows without a game
    assert [r.game_pk for r in gold.pitcher_game_fanout(df).collect()] == [1]


def test_fanout_multiplies(spark):
    rows = [{"pitch_type": t, "delta_run_exp": 0.5} for t in ("FF", "FF", "SL")]
    r = gold.pitcher_game_fanout(pitches(spark, rows)).first()
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert (r.total_pitches, r.total_re_delta, r.stuff_diversity) == (6, 3.0, round(3 * h, 4))
    assert r.avg_velo == 95.0


def test_batter_by_hand(spark):
    rows = [
        {"description": "swinging_strike", "zone": 11, "inning": 1, "estimated_woba": 0.2},
        {"description": "ball", "zone": 11, "inning": 1},
        {"description": "hit_into_play", "launch_speed": 95.0, "launch_angle": 10.0, "inning": 3, "estimated_woba": 0.6},
        {"description": "hit_into_play", "launch_speed": 85.0, "launch_angle": 21.0, "is_barrel": True, "inning": None},
    ]
    r = gold.batter_game_summary(pitches(spark, rows)).first()
    assert (r.pitches_seen, r.innings_appeared, r.swing_rate, r.o_swing_rate) == (4, 2, 0.25, 0.5)
    assert (r.avg_exit_velo, r.avg_launch_angle, r.avg_xwoba) == (90.0, 15.5, 0.4)
    assert (r.barrel_rate, r.hard_hit_rate) == (0.5, 0.5)


def test_window_of_30_days(spark):
    rows = [(1, 1, 0, 90.0, 0.20, 0.10), (1, 2, 30, 92.0, 0.30, None), (1, 3, 31, 94.0, 0.40, 0.30)]
    got = by(rolling.with_context(summary(spark, rows)), "game_pk")
    assert got[1].rolling_30d_avg_velo is None and got[1].velo_vs_30d_avg is None
    assert (got[2].rolling_30d_avg_velo, got[2].velo_vs_30d_avg) == (90.0, 2.0)  # day 30 is inside
    assert (got[3].rolling_30d_avg_velo, got[3].velo_vs_30d_avg) == (92.0, 2.0)  # day 31 is not
    assert got[2].rolling_30d_whiff_rate == 0.1 and got[2].whiff_rate_delta is None
    assert got[3].rolling_30d_whiff_rate is None
    assert (got[1].season_avg_velo, got[1].season_avg_whiff) == (92.0, 0.2)


def test_doubleheader_games_share_the_baseline(spark):
    rows = [(1, 1, 0, 90.0, 0.2, 0.1), (1, 2, 5, 95.0, 0.3, 0.2), (1, 3, 5, 97.0, 0.5, 0.4), (1, 4, 6, 91.0, 0.3, 0.3)]
    got = by(rolling.with_context(summary(spark, rows)), "game_pk")
    assert got[2].rolling_30d_avg_velo == got[3].rolling_30d_avg_velo == 90.0
    assert got[4].rolling_30d_avg_velo == 94.0


def test_season_key_narrows_the_mean(spark):
    from pyspark.sql import functions as F
    rows = [(1, 1, 0, 90.0, 0.2, 0.1), (1, 2, 400, 96.0, 0.4, 0.3)]
    df = summary(spark, rows)
    assert by(rolling.with_context(df), "game_pk")[1].season_avg_velo == 93.0
    assert by(rolling.with_context(df, season=F.year("game_date")), "game_pk")[1].season_avg_velo == 90.0


def test_game_without_date_is_kept(spark):
    rows = [(1, 1, None, 90.0, 0.2, 0.1), (1, 2, 5, 95.0, 0.3, 0.2)]
    assert rolling.with_context(summary(spark, rows)).count() == 2


def test_duplicates_are_removed_whatever_their_order(spark):
    a = {"pitch_id": "x", "release_speed": 91.0}
    b = {"pitch_id": "x", "release_speed": 90.0}
    for rows in ([a, b, a], [b, a, a]):
        got = silver.clean_pitches(pitches(spark, rows)).collect()
        assert [r.release_speed for r in got] == [90.0]


def test_dedup_drops_copies_before_the_shuffle(spark):
    plan = silver.clean_pitches(pitches(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before and once after the exchange


def test_only_rows_with_repeated_ids_are_shuffled_whole(spark, tmp_path):
    rows = [{"pitch_id": f"p{k % 900}", "pitcher_id": k, "pitch_type": "FF"} for k in range(1000)] + [{"pitch_id": None, "pitcher_id": 5}] * 3
    pitches(spark, rows).write.parquet(f"{tmp_path}/p")
    typed = silver.clean_pitches(spark.read.parquet(f"{tmp_path}/p"), few_repeats=True)
    plan = gold.pitch_mix(typed)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert sorted("release_speed" in scan for scan in scans)[-2:] == [False, True] and len(scans) >= 3
    assert typed.count() == 901 and {r.pitcher_id for r in typed.filter("pitch_id IN ('p0', 'p899')").collect()} == {0, 899}


def test_a_full_map_of_repeated_ids_gives_the_same_rows(spark):
    rows = [{"pitch_id": f"p{k % 700}", "pitcher_id": k} for k in range(1000)]
    want = sorted(map(repr, silver.clean_pitches(pitches(spark, rows)).collect()))
    assert sorted(map(repr, silver.clean_pitches(pitches(spark, rows), few_repeats=True, bits=64).collect())) == want and len(want) == 700
    assert sorted(map(repr, silver.clean_pitches(pitches(spark, rows), few_repeats=True).collect())) == want


def test_missing_columns_become_nulls(spark):
    raw = spark.createDataFrame([(1, "2024-06-01", "77", 9)], "game_pk int, game_date string, pitcher string, batter int")
    row = silver.clean_pitches(bronze.conform(raw)).first()
    assert (row.pitcher_id, row.batter_id, row.is_barrel, row.release_speed) == (77, 9, False, None)


def test_bad_ids_become_null(spark):
    raw = spark.createDataFrame([(1, "x")], "game_pk int, pitcher string")
    assert bronze.conform(raw).first().pitcher_id is None


def test_switch_hitter_is_joined_once(spark):
    df = pitches(spark, [{"stand": "L"}, {"stand": "R"}, {"pitcher_id": 20}])
    listed = silver.players(df)
    assert sorted((r.player_id, r.hand, r.position) for r in listed.collect()) == [
        (10, "R", "SP"), (20, "L", "POS"), (20, "R", "POS"), (20, "R", "SP")]
    games = gold.batter_game_summary(df)
    named = explore.with_player(games, listed, "POS", "batter_id", "batter_name")
    assert [r.batter_name for r in named.collect()] == ["Batter #20"]


def test_side_of_the_pitcher(spark):
    df = pitches(spark, [{"inning_topbot": "Top"}, {"inning_topbot": "Bot", "pitcher_id": 11}])
    got = by(gold.pitcher_game_base(df, extras=True), "pitcher_id")
    assert (got[10].home_away, got[10].team, got[10].opponent) == (1, "H", "A")
    assert (got[11].home_away, got[11].team, got[11].opponent) == (0, "A", "H")


def test_disagreeing_teams_do_not_split_a_type(spark):
    df = pitches(spark, [{"home_team": None}, {"home_team": "H"}, {"pitch_type": "SL"}])
    plain, wide = gold.pitcher_game_base(df).first(), gold.pitcher_game_base(df, extras=True).first()
    assert plain.stuff_diversity == wide.stuff_diversity and wide.team == "H"


def test_pitches_are_never_sorted_for_the_summary(spark):
    plan = gold.pitcher_game_base(pitches(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_date_filter_and_columns_reach_the_files(spark):
    from harness import DATA

    from moundworks.plans.layers import layers
    rows = bronze.in_range(layers(spark, DATA).summary, day(0), day(30)).select("pitcher_id", "csw_rate")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(game_date" in plan
    assert "ReadSchema: struct<pitcher_id:int,game_date:date,csw_rate:double>" in plan


def test_mix_shares_add_up(spark):
    from pyspark.sql import functions as F
    df = pitches(spark, [{"pitch_type": t} for t in ("FF", "FF", "SL", None)])
    mix = gold.pitch_mix(df)
    assert mix.agg(F.sum("share")).first()[0] == 1.0
    assert extras.pitch_mix_text(mix).first().pitch_mix == "FF 50% / ?? 25% / SL 25%"


def test_properties_of_real_rows(spark):
    from harness import DATA

    from moundworks.plans.layers import Layers
    t = Layers(spark, DATA)
    rows = gold.pitcher_game_base(t.silver).collect()
    kinds = {(r.pitcher_id, r.game_pk): r.k for r in gold.pitch_mix(t.silver).groupBy("pitcher_id", "game_pk")
             .count().withColumnRenamed("count", "k").collect()}
    assert sum(r.total_pitches for r in rows) == t.silver.count()
    for r in rows:
        for rate in (r.whiff_rate, r.csw_rate, r.zone_rate, r.chase_rate, r.barrel_rate_allowed):
            assert rate is None or 0 <= rate <= 1
        assert 0 <= r.stuff_diversity <= math.log(kinds[(r.pitcher_id, r.game_pk)]) + 1e-4


def test_missing_tiers_are_listed_with_zero(spark):
    df = spark.createDataFrame([("elite",), ("elite",)], "performance_tier string")
    got = [(r.performance_tier, r.starts) for r in explore.tier_distribution(df).collect()]
    assert got == [("elite", 2), ("above_avg", 0), ("average", 0), ("below_avg", 0), ("poor", 0)]


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(90.0,), (90.0,), (None,)], "avg_exit_velo double")
    got = explore.exit_velo_histogram(df).collect()
    assert sum(r.games for r in got) == 2 and len(got) == 25


def test_rest_days(spark):
    from pyspark.sql import functions as F
    rows = [(1, 1, 0, 90.0, 0.2, 0.1), (1, 2, 5, 90.0, 0.2, 0.1), (1, 3, 5, 90.0, 0.2, 0.1)]
    df = summary(spark, rows).withColumn("total_pitches", F.col("game_pk") * 10)
    got = by(extras.days_rest(df), "game_pk")
    assert [(got[g].days_rest, got[g].pitch_count_last_game) for g in (1, 2, 3)] == [(None, None), (5, 10), (0, 20)]


@pytest.mark.parametrize("n", [1, 2])
def test_last_n(spark, n):
    rows = [(1, g, g, 90.0, 0.2, 0.1) for g in range(5)] + [(2, 9, 1, 90.0, 0.2, 0.1)]
    got = sorted((r.pitcher_id, r.game_pk) for r in rolling.last_n(summary(spark, rows), "pitcher_id", n).collect())
    assert got == sorted([(1, g) for g in range(5 - n, 5)] + [(2, 9)])
    assert day(0)
