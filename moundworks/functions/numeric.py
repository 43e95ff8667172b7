"""Arithmetic helpers: explicit half-up rounding and null-on-zero ratios.

``ROUND`` is not the same function in every engine, so rounding is spelled out
as ``floor(x * 10^n + 0.5) / 10^n``. Means of already rounded columns are taken
over scaled integers, which makes them exact and independent of row order.

The ``sql_`` forms give the same expressions as SQL text. Wide tables are built
from those: one parsed string per column instead of many Column calls.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(col: Column, digits: int) -> Column:
    """``col`` as a BIGINT counted in units of ``10^-digits``."""
    return F.floor(col.cast("double") * F.lit(10.0**digits) + F.lit(0.5)).cast("bigint")


def rnd(col: Column, digits: int) -> Column:
    return scaled(col, digits).cast("double") / F.lit(10.0**digits)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` in double, null when ``den`` is zero or null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def mean_of_scaled(total: Column, count: Column, digits: int) -> Column:
    """Mean of ``count`` scaled integers, back in natural units, unrounded."""
    return ratio(total, count) / F.lit(10.0**digits)


def sample_std(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares."""
    n, s, q = (c.cast("double") for c in (count, total, squares))
    spread = F.greatest(n * q - s * s, F.lit(0.0))
    return F.when(n >= 2, F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0.0))))


def sql_scaled(expr: str, digits: int) -> str:
    return f"CAST(floor(CAST({expr} AS DOUBLE) * {10.0**digits}D + 0.5D) AS BIGINT)"


def sql_rnd(expr: str, digits: int) -> str:
    return f"CAST({sql_scaled(expr, digits)} AS DOUBLE) / {10.0**digits}D"


def sql_ratio(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0.0D)"


def sql_sample_std(count: str, total: str, squares: str) -> str:
    n, s, q = (f"CAST({e} AS DOUBLE)" for e in (count, total, squares))
    return f"CASE WHEN {n} >= 2 THEN sqrt(greatest({n} * {q} - {s} * {s}, 0.0D) / nullif({n} * ({n} - 1), 0.0D)) END"
