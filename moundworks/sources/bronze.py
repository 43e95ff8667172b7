"""Landing of raw extracts as date-partitioned Parquet."""

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks.operators.ordering import ordered_index
from moundworks.sources.schemas import FEED_COLUMNS, RENAMES
from moundworks.sources.store import durable


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed raw files. CSV is read with the feed's schema, never inferred."""
    if fmt == "csv":
        schema = ", ".join(f"{c} {t}" for c, t in FEED_COLUMNS)
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def select_available(raw: DataFrame, columns: list[tuple[str, str]] = FEED_COLUMNS) -> DataFrame:
    """Keep the listed columns; a column the extract lacks becomes a typed null."""
    present = set(raw.columns)
    return raw.selectExpr(*[c if c in present else f"CAST(NULL AS {t}) AS {c}" for c, t in columns])


def conform(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical names and types of a raw extract. An id the feed brings stays, and so do
    the columns named by ``keep``."""
    own_id = [("pitch_id", "string")] if "pitch_id" in raw.columns else []
    converted = {
        "game_date": "to_date(game_date)",
        "pitcher": "try_cast(pitcher AS BIGINT)",
        "batter": "try_cast(batter AS BIGINT)",
        "barrel": "CAST(coalesce(CAST(barrel AS INT), 0) AS BOOLEAN)",
    }
    columns = own_id + FEED_COLUMNS
    own = [(c, raw.schema[c].dataType.simpleString()) for c in keep]
    return select_available(raw, own + columns).selectExpr(
        *keep, *[f"{converted.get(c, c)} AS {RENAMES.get(c, c)}" for c, _ in columns]
    )


def add_pitch_key(df: DataFrame, drop_exact_duplicates: bool = False) -> DataFrame:
    """Deterministic ``pitch_id`` = game_pk, game_date and position in the game.

    The position follows the order of all columns, so a repeated download gives
    the same ids. With ``drop_exact_duplicates`` copies of a row count once. ``df`` should
    read files, so that a repeated task sees its rows in the same order: it is scanned
    twice and written once.
    """
    rows = df.drop("pitch_id")
    if drop_exact_duplicates:
        rows = rows.distinct()
    order = [c for c in rows.columns if c not in ("game_pk", "game_date")]
    placed = ordered_index(rows, order, ["game_pk", "game_date"], "_pos", stored=not drop_exact_duplicates)
    key = F.concat_ws("_", F.col("game_pk").cast("string"), F.col("game_date").cast("string"),
                      F.col("_pos").cast("string"))
    return placed.withColumn("pitch_id", key).drop("_pos")


def in_range(df: DataFrame, start: date | None = None, end: date | None = None,
             column: str = "game_date") -> DataFrame:
    """Inclusive date range; an open end is not filtered."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


#: A commit record: a day, its rows, and the landing that brought them.
RECORD = "game_date date, n_rows bigint, landing string"


def _beside(out: str, name: str) -> str:
    """A folder in the layer's own root that readers of the layer pass over."""
    return f"{out.rstrip('/')}/_{name}"


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:  # not written yet
        return None


def records(spark: SparkSession, out: str) -> DataFrame:
    """The commit records of the layer: one row for each day of each landing."""
    found = _table(spark, _beside(out, "days"), RECORD)
    return spark.createDataFrame([], RECORD) if found is None else found


def landed_days(spark: SparkSession, out: str) -> DataFrame:
    """Days that were landed to the end. A folder alone is no proof of that: where files are
    copied one by one, a landing that stopped leaves folders with a part of their rows."""
    return records(spark, out).select("game_date").distinct()


def commit_days(spark: SparkSession, out: str, days: DataFrame) -> None:
    """Record the rows that each of the ``days`` (game_date, n_rows) now has. Written last,
    in one small file, which appears as a whole."""
    days.withColumn("landing", F.lit(uuid.uuid4().hex)).coalesce(1).write.mode("append").parquet(_beside(out, "days"))


def damaged_days(spark: SparkSession, out: str) -> DataFrame:
    """Recorded days whose rows are not, or not all, there any more: game_date, n_rows, n_found.

    Only file footers are read. ``forget_days`` has them landed again.
    """
    day = Window.partitionBy("game_date").orderBy(F.desc("n_rows"))  # a day is landed once, seldom twice
    newest = records(spark, out).withColumn("_k", F.row_number().over(day)).filter("_k = 1")
    layer = _table(spark, out)
    there = spark.createDataFrame([], "game_date date, n_found bigint") if layer is None else layer.groupBy("game_date").agg(F.count("*").alias("n_found"))
    both = newest.join(there, "game_date", "left").select("game_date", "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found"))
    return both.filter("n_found <> n_rows")


def forget_days(spark: SparkSession, out: str, days: DataFrame) -> None:
    """Take the records of ``days`` back, so that the next landing brings these days again."""
    lost = F.broadcast(days.select("game_date").distinct())  # a row per calendar day
    kept = durable(records(spark, out).join(lost, "game_date", "left_anti"))
    kept.coalesce(1).write.mode("overwrite").parquet(_beside(out, "days"))


def new_days(raw: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows of days that were not landed yet.

    The landed side is one row per calendar day (a century is 36,525 rows), so
    it may be broadcast whatever the size of the extract.
    """
    return raw.join(F.broadcast(landed.select("game_date").distinct()), "game_date", "left_anti")


def write_bronze(df: DataFrame, out: str) -> None:
    """Write by day. REBALANCE gathers small days and lets AQE split a day that
    is too large for one task, which a plain repartition by date would not."""
    (
        df.hint("rebalance", F.col("game_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("game_date")
        .parquet(out)
    )


def read_bronze(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """All landed partitions, or only those from ``since`` on (pruned)."""
    return in_range(spark.read.parquet(path), start=since)


def undated(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows that came without a date, set aside by ``land``; None if there were none yet."""
    return _table(spark, _beside(out, "undated"))


def set_aside(spark: SparkSession, rows: DataFrame, out: str) -> None:
    """Keep rows without a date inside the layer's folder. They belong to no day that could
    be missing, so a row is added only as often as it is not there yet, and a call that
    stopped half-way is completed by the next one. Without such rows nothing is written."""
    there = undated(spark, out)
    fresh = rows if there is None else rows.exceptAll(there.select(*rows.columns))
    if fresh.limit(1).count():
        fresh.write.mode("append").option("compression", "snappy").parquet(_beside(out, "undated"))


def land(spark: SparkSession, raw: DataFrame, out: str,
         start: date | None = None, end: date | None = None) -> DataFrame:
    """Land the days of ``raw`` inside the range that ``out`` lacks; return all of ``out``.

    A day counts as landed once its commit record is there, which is written after its
    rows; a landing that stopped before is done again, and overwrites what it left.
    Rows without a date are in no partition: they are set aside (``undated``), whatever
    the range.
    """
    dated = raw.withColumn("game_date", F.to_date("game_date"))
    set_aside(spark, conform(dated.filter("game_date IS NULL")), out)
    wanted = in_range(dated.filter("game_date IS NOT NULL"), start, end)
    fresh = new_days(wanted, landed_days(spark, out))
    conformed = conform(fresh)
    write_bronze(conformed if "pitch_id" in raw.columns else add_pitch_key(conformed), out)
    layer = _table(spark, out)
    if layer is None:  # nothing was landed: an empty layer has no files
        return conformed.limit(0)
    days = F.broadcast(durable(fresh.select("game_date").distinct()))  # a row per calendar day
    commit_days(spark, out, layer.join(days, "game_date", "left_semi").groupBy("game_date").agg(F.count("*").alias("n_rows")))
    return layer
