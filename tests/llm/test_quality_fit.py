"""The fit of the quality rules uses every labelled row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundworks.llm import quality
from moundworks.operators.selection import exact_quantiles


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 700), (3, 5000)])
def test_threshold_of_a_table_is_that_of_its_rows(spark, seed, n):
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < 0.2
    scores = np.round(rng.random(n) * 0.6 + 0.4 * bad, 3)
    rows = spark.createDataFrame([(float(s), int(b)) for s, b in zip(scores, bad)], "score double, _bad int")
    assert quality.threshold(rows, slices=20) == quality.calibrate(scores, bad)
    assert quality.threshold(rows.withColumn("_bad", F.lit(0))) == np.inf


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(5).lognormal(size=30_001)
    rows = spark.createDataFrame([(float(v), None if k % 2 else float(round(v))) for k, v in enumerate(values)], "a double, b double")
    shares = [0.0005, 0.5, 0.9995, 1.0]
    got = exact_quantiles(rows, ["a", "b"], shares, exact_values=500)
    assert got["a"] == pytest.approx(np.quantile(values, shares), rel=1e-12)
    assert got["b"] == pytest.approx(np.quantile(np.round(values[::2]), shares), rel=1e-12)


def test_every_labelled_row_counts(spark):
    """Bounds and threshold follow all 30,000 labelled rows; the far ones are few."""
    n = 30_000
    columns = ", ".join(f"{c} bigint" for c in quality.BASE + quality.MORE)
    stats = spark.range(n).selectExpr(
        "id AS doc_id", "100L AS n_words", "500 + id AS word_chars", "0L AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words",
        "10L AS n_lines", "5L AS n_upper", "0L AS n_digits", "10L AS n_punct", "90L AS n_distinct_words", "12L AS longest_word")
    assert stats.select(*quality.BASE, *quality.MORE).schema.simpleString() == f"struct<{columns.replace(' ', ':').replace(',:', ',')}>"
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id < 29990 AS INT) AS quality")
    model = quality.fit(stats, labels)
    good = (500 + np.arange(29_990)) / 100
    assert (model.low[0], model.high[0]) == pytest.approx(tuple(np.quantile(good, [quality.TAIL, 1 - quality.TAIL])), rel=1e-12)
    rows = np.column_stack([np.full(n, x) for x in (0, 0.0, 0.0, 0.0, 0, 0, 0, 0.9, np.log1p(12), np.log1p(10))])
    chars = 500.0 + np.arange(n)
    rows[:, 0], rows[:, 4], rows[:, 5], rows[:, 6] = chars / 100, 5 / chars, 0, 10 / chars
    assert model.threshold == quality.calibrate(model.score(rows), np.arange(n) >= 29_990)
