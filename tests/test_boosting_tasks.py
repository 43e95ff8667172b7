"""How the rows of a fit are spread over its tasks."""

import pytest
from pyspark.sql import functions as F

from moundworks.constants import FEATURES, TARGET
from moundworks.operators import model


@pytest.mark.parametrize("rows, share", [(120_000, 8), (9_000, 2), (7, 1)])
def test_rows_are_spread_evenly_over_the_cores(spark, rows, share):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(rows).select(*[F.rand(k).alias(c) for k, c in enumerate(FEATURES)], F.rand(99).alias(TARGET))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * cores + cores // 2))  # no multiple of the cores
    try:
        vectors = model._vectors(model._prepare(table.limit(20)), table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    sizes = [r[0] for r in vectors.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    tasks = min(share, cores)
    assert vectors.rdd.getNumPartitions() == len(sizes) == tasks
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 2 * cores


def test_no_rows_make_one_task(spark):
    table = spark.range(0).select(*[F.lit(0.5).alias(c) for c in FEATURES], F.lit(0.5).alias(TARGET))
    assert model._vectors(model._prepare(table), table).count() == 0
