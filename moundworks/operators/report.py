"""Scouting reports of all pitcher games in one pass."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.constants import FEATURES, GAME_KEY
from moundworks.functions import rules
from moundworks.functions.numeric import rnd
from moundworks.operators.attribution import attributions
from moundworks.operators.enrich import pitcher_label, zero
from moundworks.operators.explore import with_insight


def report_features(named: DataFrame, next_start: bool = False) -> DataFrame:
    """Feature row of a report. A missing number stays missing: the model fills it as it
    did in training, so a game has one prediction everywhere. ``next_start`` looks
    ahead by taking this game's velocity for the coming look-back mean."""
    return named.select(*GAME_KEY, *_features(next_start))


def _features(next_start: bool) -> list[Column]:
    source = {"rolling_30d_avg_velo": "avg_velo"} if next_start else {}
    return [F.col(source.get(c, c)).cast("double").alias(c) for c in FEATURES]


def _stats() -> dict[str, Column]:
    return {
        "pitcher_id": F.col("pitcher_id"),
        "pitcher_name": pitcher_label(),
        "game_date": F.col("game_date").cast("string"),
        "game_pk": F.col("game_pk"),
        "opponent": F.coalesce("opponent", F.lit("Unknown")),
        "total_pitches": F.col("total_pitches"),
        "avg_velo": rnd(F.col("avg_velo"), 1),
        "season_avg_velo": rnd(F.col("season_avg_velo"), 1),
        "velo_delta": rnd(zero("velo_vs_30d_avg"), 1),
        "whiff_rate": zero("whiff_rate"),
        "csw_rate": zero("csw_rate"),
        "zone_rate": zero("zone_rate"),
        "chase_rate": zero("chase_rate"),
        "barrel_rate": zero("barrel_rate_allowed"),
        "avg_xwoba": zero("avg_xwoba_allowed"),
        "stuff_diversity": zero("stuff_diversity"),
        "total_re_delta": zero("total_re_delta"),
        "performance_tier": F.col("performance_tier"),
        "rolling_30d_csw": zero("rolling_30d_csw_rate"),
        "rolling_30d_whiff": zero("rolling_30d_whiff_rate"),
    }


def report_stats(named: DataFrame, insights: DataFrame) -> DataFrame:
    """The part of a report that needs no model, flat: statistics, insight
    texts, grade and percentile."""
    rows = with_insight(named, insights)
    stats = {k: c for k, c in _stats().items() if k != "game_date"}
    return rows.select(
        "game_date", *[c.alias(k) for k, c in stats.items()],
        "headline", "key_finding", "concern_flag", "pitch_mix_note",
        rules.letter_grade(zero("csw_rate")).alias("letter_grade"),
        rules.csw_percentile(zero("csw_rate")).alias("percentile"),
    )


def scouting_report(named: DataFrame, insights: DataFrame, model: PipelineModel,
                    next_start: bool = False) -> DataFrame:
    """Nested report per pitcher and game: statistics, prediction with its top
    features, insight, grade and percentile."""
    stats = {f"s_{k}": c for k, c in _stats().items()}
    shown = ["pitcher_name", "opponent", "headline", "key_finding", "concern_flag", "pitch_mix_note", "letter_grade", "percentile"]
    rows = with_insight(named, insights)
    rows = rows.select(
        *GAME_KEY, *_features(next_start),
        pitcher_label().alias("pitcher_name"),
        F.coalesce("opponent", F.lit("Unknown")).alias("opponent"),
        *[c.alias(k) for k, c in stats.items()],
        "headline", "key_finding", "concern_flag", "pitch_mix_note",
        rules.letter_grade(zero("csw_rate")).alias("letter_grade"),
        rules.csw_percentile(zero("csw_rate")).alias("percentile"),
    )
    predicted = attributions(model, rows, keep=[*GAME_KEY, *shown, *stats])
    return predicted.select(
        *GAME_KEY, "pitcher_name", "opponent",
        F.struct(*[F.col(k).alias(k.removeprefix("s_")) for k in stats]).alias("stats"),
        F.struct(
            rnd(F.col("prediction"), 4).alias("predicted_csw_rate"),
            rules.stuff_score(F.col("prediction")).alias("stuff_score"),
            "top_features",
        ).alias("prediction"),
        *shown[2:],
    )
