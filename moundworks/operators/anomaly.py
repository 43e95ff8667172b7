"""Outliers of the whiff rate against a pitcher's own past 30 days."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.functions.numeric import rnd, sample_std, scaled
from moundworks.operators.ordering import join_null_safe
from moundworks.operators.rolling import past_spread

SHOWN = ["pitcher_id", "pitcher_name", "game_pk", "game_date", "whiff_rate", "rolling_30d_whiff_rate",
         "csw_rate", "rolling_30d_csw_rate", "avg_velo", "rolling_30d_avg_velo", "velo_vs_30d_avg"]


def anomaly_literal(named: DataFrame, day=None, delta: float = 0.08, min_pitches: int = 40,
                    top: int = 5) -> DataFrame:
    """Largest absolute whiff deltas of each day (or of one day).

    ``whiff_z`` divides by the deviation among the pitcher's remaining rows of
    that day, hence it is null unless a pitcher has two games on it.
    """
    rows = named if day is None else named.filter(F.col("game_date") == F.lit(day))
    gap = F.col("whiff_rate") - F.col("rolling_30d_whiff_rate")
    kept = rows.filter((F.abs(gap) > delta) & (F.col("total_pitches") >= min_pitches)).withColumn("gap", gap)
    w = Window.partitionBy("game_date").orderBy(F.abs("gap").desc(), F.col("pitcher_id"), F.col("game_pk"))
    best = kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    v = scaled(F.col("whiff_rate"), 4)
    spread = kept.groupBy("pitcher_id", "game_date").agg(
        (sample_std(F.count(v), F.sum(v), F.sum(v * v)) / F.lit(1e4)).alias("day_std")
    )
    z = F.col("gap") / F.nullif(F.col("day_std"), F.lit(0.0))
    return join_null_safe(best, spread, ["pitcher_id", "game_date"]).select(
        *SHOWN, rnd(F.col("gap"), 4).alias("whiff_delta"), rnd(z, 4).alias("whiff_z"), "place"
    )


def anomaly_z(named: DataFrame, z: float = 2.0, min_pitches: int = 40, days: int = 30) -> DataFrame:
    """Games whose whiff rate lies more than ``z`` past-30-day deviations away."""
    spread = past_spread(named, "whiff_rate", 4, days=days)
    score = F.col("whiff_rate_delta") / F.nullif(F.col("whiff_rate_std"), F.lit(0.0))
    return (
        join_null_safe(named, spread, ["pitcher_id", "game_date"])
        .filter(F.col("total_pitches") >= min_pitches)
        .withColumn("whiff_z", rnd(score, 4))
        .filter(F.abs("whiff_z") > z)
        .select(*SHOWN, "whiff_rate_delta", "whiff_z")
    )
