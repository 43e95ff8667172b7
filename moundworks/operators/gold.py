"""Pitcher-game and batter-game summaries.

The pitcher summary aggregates twice over one scan: first by game and pitch
type, then by game. The first step carries every sum the metrics need, so the
pitch-mix entropy costs no second scan and no join, and a game of any size
reaches the second step as one row per pitch type and task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.constants import BATTER_KEY, FASTBALLS, GAME_KEY
from moundworks.functions import rules
from moundworks.functions.numeric import ratio, rnd, sql_ratio, sql_rnd, sql_sample_std
from moundworks.operators.rolling import with_context

MEASURES = {
    "speed": "CAST(release_speed AS DOUBLE)",
    "spin": "CAST(release_spin AS DOUBLE)",
    "h_break": "abs(CAST(pfx_x AS DOUBLE))",
    "v_break": "CAST(pfx_z AS DOUBLE)",
    "xwoba": f"CASE WHEN {rules.BATTED} THEN CAST(estimated_woba AS DOUBLE) END",
    "exit_velo": "CAST(launch_speed AS DOUBLE)",
    "run_value": "CAST(delta_run_exp AS DOUBLE)",
}
LEVERAGED = "CAST(delta_run_exp AS DOUBLE) > 0.1D"


def _flags(swing: str) -> dict[str, str]:
    return {
        "missed": rules.MISSED,
        "swings": swing,
        "csw": rules.CALLED_OR_MISSED,
        "inside": rules.IN_ZONE,
        "outside": rules.OUT_OF_ZONE,
        "chased": f"{rules.OUT_OF_ZONE} AND {swing}",
        "barrels": "is_barrel",
        "fastballs": f"pitch_type IN ({', '.join(repr(t) for t in FASTBALLS)})",
        "leveraged": LEVERAGED,
        "leveraged_csw": f"{LEVERAGED} AND {rules.CALLED_OR_MISSED}",
    }


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _by_type(pitches: DataFrame, swing: str, teams: bool = False) -> DataFrame:
    """Sums and counts of each pitch type in each of a pitcher's games.

    Every pitch is first turned into plain numbers, so that the aggregation
    itself is nothing but additions and stays a hash aggregate. Team names are
    carried as keys for the same reason: ``max`` of a string would sort all
    pitches, and a game has one pair of teams anyway.
    """
    names = ["home_team", "away_team"] if teams else []
    flags = {name: f"int(coalesce({cond}, false))" for name, cond in _flags(swing).items()}
    numbers = pitches.filter("pitcher_id IS NOT NULL").selectExpr(
        *GAME_KEY, "pitch_type", *names,
        "int(coalesce(inning_topbot = 'Top', false)) AS top",
        *_named(MEASURES), *_named(flags),
    )
    sums = [f"sum({k}) AS s_{k}" for k in MEASURES] + ["sum(speed * speed) AS s_speed_sq"]
    counts = [f"count({k}) AS c_{k}" for k in MEASURES if k != "run_value"]
    return numbers.groupBy(*GAME_KEY, "pitch_type", *names).agg(*map(F.expr, [
        "count(*) AS n", *sums, *counts, *[f"sum({k}) AS f_{k}" for k in flags], "max(top) AS is_top",
    ]))


def _by_game(typed: DataFrame) -> DataFrame:
    """Add up the pitch types of a game; a handful of rows per game."""
    names = [c for c in ("home_team", "away_team") if c in typed.columns]
    added = [c for c in typed.columns if c[:2] in ("s_", "c_", "f_")]
    return typed.groupBy(*GAME_KEY).agg(*map(F.expr, [
        "sum(n) AS total_pitches", "sum(double(n) * ln(double(n))) AS n_ln_n",
        *[f"sum({c}) AS {c}" for c in added],
        "max(is_top) AS home_away", *[f"max({c}) AS {c}" for c in names],
    ]))


def _one_row_per_type(typed: DataFrame) -> DataFrame:
    """Bring a type together again if a game's rows disagree about its teams;
    the entropy needs whole types."""
    added = [c for c in typed.columns if c == "n" or c[:2] in ("s_", "c_", "f_")]
    return typed.groupBy(*GAME_KEY, "pitch_type").agg(*map(F.expr, [
        *[f"sum({c}) AS {c}" for c in added],
        *[f"max({c}) AS {c}" for c in ("is_top", "home_team", "away_team")],
    ]))


def _mean(name: str, digits: int) -> str:
    return sql_rnd(sql_ratio(f"s_{name}", f"c_{name}"), digits)


def _share(name: str, of: str) -> str:
    return sql_rnd(sql_ratio(f"f_{name}", of), 4)


GAME_METRICS = {
    "total_pitches": "total_pitches",
    "avg_velo": _mean("speed", 2),
    "velo_stddev": sql_rnd(sql_sample_std("c_speed", "s_speed", "s_speed_sq"), 2),
    "avg_spin": _mean("spin", 0),
    "avg_h_break": _mean("h_break", 2),
    "avg_v_break": _mean("v_break", 2),
    "whiff_rate": _share("missed", "f_swings"),
    "csw_rate": _share("csw", "total_pitches"),
    "zone_rate": _share("inside", "total_pitches"),
    "chase_rate": _share("chased", "f_outside"),
    "avg_xwoba_allowed": _mean("xwoba", 4),
    "avg_exit_velo_allowed": _mean("exit_velo", 2),
    "barrel_rate_allowed": _share("barrels", "c_exit_velo"),
    "total_re_delta": sql_rnd("s_run_value", 3),
    # -sum p ln p with p = n / N
    "stuff_diversity": sql_rnd("ln(double(total_pitches)) - n_ln_n / double(total_pitches)", 4),
}
# home flag, teams and the optional metrics of a pitcher's game
SIDE_COLUMNS = {
    "home_away": "home_away",
    "team": "CASE WHEN home_away = 1 THEN home_team ELSE away_team END",
    "opponent": "CASE WHEN home_away = 1 THEN away_team ELSE home_team END",
    "fastball_pct": _share("fastballs", "total_pitches"),
    "high_leverage_csw": _share("leveraged_csw", "f_leveraged"),
}


def pitcher_game_base(
    pitches: DataFrame,
    swing: str = rules.SWING_LITERAL,
    extras: bool = False,
) -> DataFrame:
    """Metrics of one pitcher in one game. ``extras`` adds the pitcher's side
    and the documented but optional metrics from the same scan."""
    columns = {**GAME_METRICS, **(SIDE_COLUMNS if extras else {})}
    typed = _by_type(pitches, swing, teams=extras)
    return _by_game(_one_row_per_type(typed) if extras else typed).selectExpr(*GAME_KEY, *_named(columns))


def pitcher_game_summary(
    pitches: DataFrame,
    swing: str = rules.SWING_LITERAL,
    extras: bool = False,
    days: int = 30,
    season: Column | None = None,
) -> DataFrame:
    """Game metrics with their look-back windows, season means and tier, as one plan.

    The windows read the game rows twice (by day, and to join back). Where pitches
    are many, write ``pitcher_game_base`` first and give it to ``summary_of``.
    """
    return summary_of(pitcher_game_base(pitches, swing, extras), days, season)


def summary_of(games: DataFrame, days: int = 30, season: Column | None = None) -> DataFrame:
    """``pitcher_game_summary`` from the rows of ``pitcher_game_base``."""
    return with_context(games, days, season).withColumn(
        "performance_tier", rules.performance_tier(F.col("csw_rate"))
    )


def pitch_mix(pitches: DataFrame) -> DataFrame:
    """Pitches and share of each pitch type in a pitcher's game; no type is a type."""
    counts = (
        pitches.filter(F.col("pitcher_id").isNotNull())
        .groupBy(*GAME_KEY, "pitch_type")
        .agg(F.count("*").alias("n"))
    )
    # the window sees one row per pitch type, not per pitch
    all_types = Window.partitionBy(*GAME_KEY)
    return counts.withColumn("share", rnd(ratio(F.col("n"), F.sum("n").over(all_types)), 4))


def pitcher_game_fanout(pitches: DataFrame) -> DataFrame:
    """The summary as a pitch-by-pitch-type lateral join would give it: count,
    run value and entropy are multiplied by the number of types or pitches.

    The multiplication is done on the sums, so no pitch is copied. The mix is
    keyed by (pitcher, game) without the date, hence rows without a game drop out.
    """
    typed = _by_type(pitches.filter("game_pk IS NOT NULL"), rules.SWING_LITERAL)  # read twice; one exchange serves both
    mix = typed.groupBy("pitcher_id", "game_pk", "pitch_type").agg(F.expr("double(sum(n)) AS n"))
    spread = mix.groupBy("pitcher_id", "game_pk").agg(
        F.expr("double(count(*)) AS k"), F.expr("ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy")
    )
    columns = {
        **GAME_METRICS,
        "total_pitches": "total_pitches * bigint(k)",
        "velo_stddev": sql_rnd(sql_sample_std("(k * c_speed)", "(k * s_speed)", "(k * s_speed_sq)"), 2),
        "total_re_delta": sql_rnd("k * s_run_value", 3),
        "stuff_diversity": sql_rnd("total_pitches * entropy", 4),
    }
    return _by_game(typed).join(spread, ["pitcher_id", "game_pk"]).selectExpr(*GAME_KEY, *_named(columns))


def batter_game_summary(pitches: DataFrame) -> DataFrame:
    """Metrics of one batter in one game, in one aggregation."""
    swing, chased = rules.SWING_LITERAL, f"{rules.OUT_OF_ZONE} AND {rules.SWING_LITERAL}"
    batted = f"count_if({rules.BATTED})"
    columns = {
        "pitches_seen": "count(*)",
        "innings_appeared": "count(DISTINCT inning)",
        "swing_rate": sql_rnd(sql_ratio(f"count_if({swing})", "count(*)"), 4),
        "o_swing_rate": sql_rnd(sql_ratio(f"count_if({chased})", f"count_if({rules.OUT_OF_ZONE})"), 4),
        "avg_exit_velo": sql_rnd("avg(double(launch_speed))", 2),
        "avg_launch_angle": sql_rnd(f"avg(CASE WHEN {rules.BATTED} THEN double(launch_angle) END)", 2),
        "avg_xwoba": sql_rnd("avg(double(estimated_woba))", 4),
        "barrel_rate": sql_rnd(sql_ratio("count_if(is_barrel)", batted), 4),
        "hard_hit_rate": sql_rnd(sql_ratio("count_if(launch_speed >= 95)", batted), 4),
        "total_re_created": sql_rnd("sum(double(delta_run_exp))", 3),
    }
    return (
        pitches.filter("batter_id IS NOT NULL").groupBy(*BATTER_KEY).agg(*map(F.expr, _named(columns)))
    )
