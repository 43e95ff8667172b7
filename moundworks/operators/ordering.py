"""Row positions and trailing row frames, one plan for each.

A window over ``partitionBy(key)`` puts a whole key into one task. That is right
only where nature bounds a key, as the pitchers of a game are (``bounded_index``). Where
a key can hold any share of the table (a pitcher, a raw game, a shard, the table), the
other operators cut it into range slices and blocks, at every size, so no task ever
holds more than a slice or a block.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from moundworks.sources.store import durable

#: Consecutive rows of a key that one window holds in ``trailing_frame``.
BLOCK_ROWS = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join in which a null key equals a null key; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _order(cols: list[str | Column]) -> list[Column]:
    """Sort columns: names sort ascending with nulls first, Columns as they say."""
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in cols]


def bounded_index(df: DataFrame, order: list[str | Column], group: list[str], out: str = "row_idx") -> DataFrame:
    """Zero-based position in a group whose size nature bounds, such as the pitchers of a game."""
    w = Window.partitionBy(*group).orderBy(*_order(order))
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))


def ordered_index(
    df: DataFrame,
    order: list[str | Column],
    group: list[str] | None = None,
    out: str = "row_idx",
    stored: bool = False,
) -> DataFrame:
    """Zero-based position of each row in its group, or in the whole table, ordered by ``order``.

    A range shuffle sorts the rows into slices, where each gets a running number; position =
    rows of the group in earlier slices + running number - first one of the group in the
    slice. So the rows are shuffled and sorted once, and only counts meet them again.
    ``stored`` says that ``df`` reads files, so it need not be written first. The
    running id keeps copies of one row apart, so copies spread over slices too; over
    stored rows a repeated task gives the same ids. Slice numbers come from a
    sampled range partitioning, hence the written table: both readers below must
    see the same slices. The counts are written too, so that Spark knows their size
    when it joins them.
    """
    group = group or []
    df = df if stored else durable(df)
    marked = df.withColumn("_copy", F.monotonically_increasing_id())
    slices = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        df.sparkSession.sparkContext.defaultParallelism,
    )
    ranged = durable(
        marked.repartitionByRange(slices, *_order(group + order), F.col("_copy"))
        .sortWithinPartitions(*_order(group + order), F.col("_copy"))
        .withColumns({"_slice": F.spark_partition_id(), "_running": F.monotonically_increasing_id()})
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        ranged.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_n"), F.min("_running").alias("_start"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        join_null_safe(ranged, offsets, [*group, "_slice"], "inner")
        .withColumn(out, (F.col("_before") + F.col("_running") - F.col("_start")).cast("bigint"))
        .drop("_copy", "_slice", "_before", "_running", "_start")
    )


def trailing_frame(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    rows_back: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``rows_back`` rows back.

    ``columns(w)`` gets the ordered window and returns the new columns. Every key is
    cut into blocks of consecutive rows; the last ``rows_back`` rows of a block are
    also sent to the next block, only to be looked at, and dropped afterwards.
    ``stored`` says that ``df`` reads files; otherwise it is written first.
    """
    block = max(block_rows, rows_back)
    placed = ordered_index(df, order, keys, "_pos", stored).withColumn(
        "_block", F.floor(F.col("_pos") / block).cast("bigint")
    )
    near_end = (F.col("_pos") % block) >= (block - rows_back)
    seen_by = F.when(near_end, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    spread = placed.withColumn("_in", F.explode(seen_by))
    w = Window.partitionBy(*keys, "_in").orderBy("_pos")
    return (
        spread.withColumns(columns(w))
        .filter(F.col("_in") == F.col("_block"))
        .drop("_pos", "_block", "_in")
    )
