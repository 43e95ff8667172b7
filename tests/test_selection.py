import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from moundworks.operators.selection import exact_medians


def frame(spark, **columns):
    longest = max(map(len, columns.values()))
    rows = list(zip(*[[*v, *[None] * (longest - len(v))] for v in columns.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("exact_values, accuracy", [(20_000, 10_000), (3, 10)])
def test_against_statistics(spark, exact_values, accuracy):
    rng = random.Random(1)
    columns = {
        "even": [rng.random() for _ in range(400)], "odd": [rng.gauss(0, 1) for _ in range(401)],
        "halves": [0.0] * 200 + [1.0] * 200, "more": [0.0] * 199 + [1.0] * 202, "same": [7.5] * 300, "single": [3.0], "pair": [1.0, 2.0],
        "steep": [10.0**rng.randint(-300, 300) for _ in range(401)], "signs": [-0.0, 0.0, -1.0, 1.0],
        "ends": [-math.inf] * 3 + [1.0, 2.0] + [math.inf] * 3, "few": [float(rng.randint(0, 3)) for _ in range(400)],
    }
    got = exact_medians(frame(spark, **columns), list(columns), exact_values, accuracy)
    assert got == {c: pytest.approx(statistics.median(v), rel=1e-15) for c, v in columns.items()}


def test_nulls_nan_and_empty(spark):
    rows = frame(spark, a=[1.0, float("nan"), 3.0], b=[float("nan")]).withColumn("c", F.lit(None).cast("double"))
    assert exact_medians(rows, ["a", "b", "c"]) == {"a": 2.0, "b": None, "c": None}
    assert exact_medians(rows.limit(0), ["a"]) == {"a": None}


def test_ten_million_unrounded_values(spark):
    rows = spark.range(10_000_000).select((F.pow(F.pmod(F.col("id") * 7_368_787, F.lit(10_000_000)) + 1, F.lit(0.37))).alias("x"))
    assert exact_medians(rows, ["x"]) == {"x": pytest.approx((5_000_000**0.37 + 5_000_001**0.37) / 2, rel=1e-14)}
