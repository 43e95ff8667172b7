"""Data-quality checks as (check, violations) rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.constants import TIERS


def _counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks of a table in one aggregate, one row per check."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    rows = [F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in checks]
    return counts.select(F.inline(F.array(*rows)))


def outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def dq_report(summary: DataFrame, batters: DataFrame, insights: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Violations of each check. ``landed`` are the rows before deduplication: those
    without an id count, as deduplication keeps one of them."""
    drift = F.abs(F.col("avg_velo") - F.col("rolling_30d_avg_velo") - F.col("velo_vs_30d_avg"))
    pitcher_checks = {
        "csw_rate_bounds": outside("csw_rate", 0, 1),
        "whiff_rate_bounds": outside("whiff_rate", 0, 1),
        "performance_tier_known": F.col("performance_tier").isNull() | ~F.col("performance_tier").isin(TIERS),
        "pitcher_id_present": F.col("pitcher_id").isNull(),
        "velo_delta_consistent": drift >= 0.05,
    }
    batter_checks = {
        "exit_velo_realistic": outside("avg_exit_velo", 60, 120),
        "barrel_rate_bounds": outside("barrel_rate", 0, 1),
    }
    keys = F.json_object_keys("insight_json")
    needed = F.array(*[F.lit(k) for k in ("performance_tier", "headline", "key_finding", "concern_flag")])
    insight_checks = {
        "insight_keys_present": keys.isNull() | (F.size(F.array_except(needed, keys)) > 0),
        "insight_tier_known": ~F.coalesce(
            F.get_json_object("insight_json", "$.performance_tier").isin(TIERS), F.lit(False)),
    }
    report = (
        _counted(summary, pitcher_checks)
        .unionByName(_counted(batters, batter_checks))
        .unionByName(_counted(insights, insight_checks))
    )
    if landed is None:
        return report
    return report.unionByName(_counted(landed, {"pitch_id_present": F.col("pitch_id").isNull()}))


def row_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each named table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out
