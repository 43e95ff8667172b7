"""Further tables named in the data dictionary: rest days, teams, plate
appearances, splits by pitch type and zone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.constants import GAME_KEY
from moundworks.functions import rules
from moundworks.functions.numeric import ratio, rnd, scaled, sql_ratio, sql_rnd
from moundworks.operators.explore import exact_mean
from moundworks.operators.ordering import BLOCK_ROWS, trailing_frame


def velo_vs_season(summary: DataFrame) -> DataFrame:
    diff = (scaled(F.col("avg_velo"), 2) - scaled(F.col("season_avg_velo"), 2)) / F.lit(100.0)
    return summary.select(*GAME_KEY, "avg_velo", "season_avg_velo", rnd(diff, 2).alias("velo_vs_season_avg"))


def days_rest(summary: DataFrame, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """Days since the pitcher's previous game and that game's pitch count."""

    def columns(w):
        return {
            "days_rest": F.date_diff("game_date", F.lag("game_date").over(w)),
            "pitch_count_last_game": F.lag("total_pitches").over(w),
        }

    rows = summary.select(*GAME_KEY, "total_pitches")
    return trailing_frame(rows, ["pitcher_id"], ["game_date", "game_pk"], 1, columns, block_rows, stored)


def team_trends(summary: DataFrame) -> DataFrame:
    """Mean CSW of a team's pitchers on each day."""
    return summary.groupBy("team", "game_date").agg(
        F.count("*").alias("pitchers"),
        exact_mean("csw_rate").alias("avg_csw"),
        F.sum("total_pitches").alias("pitches"),
    )


def opposing_team_k_rate(summary: DataFrame, pitches: DataFrame) -> DataFrame:
    """Strikeouts per plate appearance of the team a pitcher faced."""
    batting = F.when(F.col("inning_topbot") == "Top", F.col("away_team")).otherwise(F.col("home_team"))
    teams = pitches.groupBy(batting.alias("opponent")).agg(
        rnd(ratio(F.count_if(F.col("events") == "strikeout"), F.count("events")), 4).alias("opposing_team_k_rate")
    )
    return summary.select(*GAME_KEY, "opponent").join(teams, "opponent", "left")


def at_bats(pitches: DataFrame) -> DataFrame:
    """One row per plate appearance: the pitch that decided it."""
    return pitches.filter(F.col("events").isNotNull()).select(
        "pitch_id", "game_pk", "game_date", "pitcher_id", "batter_id", "inning", "inning_topbot",
        "events", "pitch_type", "description", "launch_speed", "launch_angle", "estimated_woba", "delta_run_exp",
    )


def pitch_mix_text(mix: DataFrame) -> DataFrame:
    """'FF 54% / SL 28%': pitch types by share. A game's list holds distinct
    pitch-type codes, not pitches."""
    entry = F.struct(
        (-F.col("n")).alias("n"), F.coalesce("pitch_type", F.lit("??")).alias("t"),
        rules.pct(F.col("share"), 0).alias("p"),
    )
    parts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(" ", e["t"], e["p"]))
    return mix.groupBy(*GAME_KEY).agg(F.array_join(parts, " / ").alias("pitch_mix"))


def contact_by_type(pitches: DataFrame) -> DataFrame:
    """Batters' xwOBA and barrel rate by pitch type."""
    barrels = sql_ratio("count_if(is_barrel)", f"count_if({rules.BATTED})")
    return pitches.filter("batter_id IS NOT NULL").groupBy("batter_id", "pitch_type").agg(
        F.count("*").alias("pitches_seen"),
        F.expr(sql_rnd("avg(double(estimated_woba))", 4)).alias("avg_xwoba"),
        F.expr(sql_rnd(barrels, 4)).alias("barrel_rate"),
    )


def whiff_by_zone(pitches: DataFrame) -> DataFrame:
    """Pitchers' misses per swing by zone."""
    whiffs = sql_ratio(f"count_if({rules.MISSED})", f"count_if({rules.SWING_LITERAL})")
    return pitches.filter("pitcher_id IS NOT NULL").groupBy("pitcher_id", "zone").agg(
        F.count("*").alias("pitches"), F.expr(sql_rnd(whiffs, 4)).alias("whiff_rate")
    )
