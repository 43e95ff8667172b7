"""Insight documents: reading, parsing and keyed replacement."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks.sources import versions
from moundworks.sources.json_array import read as json_array_rows
from moundworks.sources.schemas import INSIGHT_BODY, INSIGHT_FILE, INSIGHT_KEY


def read_insights(spark: SparkSession, path: str, json_array: bool = False) -> DataFrame:
    """Insight rows from JSON lines, or from JSON arrays, whose files are read in pieces as well."""
    rows = json_array_rows(spark, path, INSIGHT_FILE) if json_array else spark.read.schema(INSIGHT_FILE).json(path)
    return rows.withColumn("game_date", F.to_date("game_date"))


def parse_response(df: DataFrame, text: str = "response") -> DataFrame:
    """Split JSON text into fields; text that is no JSON object becomes an
    error record that keeps the raw text."""
    raw = F.trim(F.col(text))
    body = F.from_json(raw, INSIGHT_BODY)
    good = F.try_parse_json(raw).isNotNull() & raw.startswith("{")
    good = F.coalesce(good, F.lit(False))
    fields = {f.name: F.when(good, body[f.name]) for f in INSIGHT_BODY.fields}
    return df.withColumns({
        **fields,
        "error": F.when(~good, F.lit("json_parse_failed")),
        "raw": F.when(~good, raw),
    })


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = INSIGHT_KEY,
           order: str = "generated_at") -> DataFrame:
    """INSERT OR REPLACE: one row per key, the new batch before the old table,
    then the later ``order``. Keeping rank 1 is cut map-side before the shuffle."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = sorted(c for c in old.columns if c not in (*keys, order))
    w = Window.partitionBy(*keys).orderBy(
        F.col("_batch").desc(), F.col(order).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]
    )
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch")


def create_table(insights: DataFrame, path: str, buckets: int = versions.BUCKETS) -> None:
    """Make ``insights`` the keyed table at ``path``."""
    versions.replace(insights, path, INSIGHT_KEY, buckets)


def upsert_path(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Upsert into the keyed table at ``path``: the buckets of the new rows are written again, the
    others stay, and one commit makes it visible. A call that was cut off leaves the old rows."""
    versions.upsert(new, path, upsert)
