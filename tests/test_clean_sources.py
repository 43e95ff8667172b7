"""Deduplication that shuffles the order lines instead of the pitches derived from them."""

from harness import DATA
from pyspark.sql import functions as F

from moundworks.operators import silver
from moundworks.plans import layers
from moundworks.sources import bronze, feed


def _rows(df):
    return sorted(map(repr, df.collect()))


def _odd_lines(spark, tmp_path):
    """Lines with several copies of an id, and with nulls in either part of it."""
    lines = feed.read_lines(spark, DATA).limit(400)
    shifted = lines.withColumns({"l_partkey": F.col("l_partkey") + 3, "l_quantity": F.col("l_quantity") % 7})
    no_order = lines.limit(40).withColumn("l_orderkey", F.lit(None).cast("bigint"))
    no_line = shifted.limit(30).withColumn("l_linenumber", F.lit(None).cast("int"))
    no_day = lines.limit(20).withColumn("l_shipdate", F.lit(None).cast(lines.schema["l_shipdate"].dataType))
    every = lines.unionByName(shifted).unionByName(lines).unionByName(no_order).unionByName(no_line).unionByName(no_day)
    every.write.parquet(f"{tmp_path}/lines")
    return spark.read.parquet(f"{tmp_path}/lines")


def test_same_pitches_as_without(spark, tmp_path):
    lines = _odd_lines(spark, tmp_path)
    want = silver.clean_pitches(bronze.conform(feed.pitch_feed(lines)))
    for together, size in (([], 400_000), (["pitcher_id", "game_date"], 100)):
        kept = silver.clean_sources(lines, feed.SAME_PITCH, layers._typed, together, size)
        assert kept.columns == lines.columns
        assert _rows(layers._typed(kept)) == _rows(want)


def test_only_lines_are_shuffled_and_stored(spark):
    t = layers.Layers(spark, DATA)
    plan = t.pitches._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "_order" in moved[0] and "_line" in moved[0] and "pitch_id" not in moved[0]
    stored = t.silver.select("release_speed")._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in stored and "l_orderkey" not in stored


def test_tasks_follow_the_rows(spark, tmp_path):
    lines = _odd_lines(spark, tmp_path)
    small = silver.clean_sources(lines, feed.SAME_PITCH, layers._typed, sorted_rows=50)
    assert small.rdd.getNumPartitions() >= lines.count() // 50
