"""Look-back windows over the summaries.

Calendar frames (30 days) are computed on one row per entity and day. All sums
are scaled integers, so adding them up by day first changes nothing, and the
window of an entity is bounded by the calendar, however many games it has.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.functions.numeric import mean_of_scaled, rnd, sample_std, scaled, sql_ratio, sql_rnd, sql_scaled
from moundworks.operators.ordering import BLOCK_ROWS, join_null_safe, trailing_frame

# summary column -> digits it is rounded to
ROLLED = {"avg_velo": 2, "whiff_rate": 4, "csw_rate": 4}
CONTEXT_COLUMNS = [
    "rolling_30d_avg_velo", "rolling_30d_whiff_rate", "rolling_30d_csw_rate",
    "velo_vs_30d_avg", "whiff_rate_delta",
    "season_avg_velo", "season_avg_csw", "season_avg_whiff",
]


def daily_sums(summary: DataFrame, key: str, digits: dict[str, int], squares: tuple = (),
               season: Column | None = None) -> DataFrame:
    """Count and scaled sum of each column per entity and day."""
    values = {c: scaled(F.col(c), d) for c, d in digits.items()}
    rows = summary if season is None else summary.withColumn("_season", season)
    extra = [] if season is None else ["_season"]
    return rows.groupBy(key, *extra, "game_date").agg(
        *[F.count(v).alias(f"k_{c}") for c, v in values.items()],
        *[F.sum(v).alias(f"s_{c}") for c, v in values.items()],
        *[F.sum(values[c] * values[c]).alias(f"q_{c}") for c in squares],
    )


def past_days(key: str, days: int) -> Window:
    """Frame of the ``days`` days before the row's own day."""
    return Window.partitionBy(key).orderBy(F.unix_date("game_date")).rangeBetween(-days, -1)


def with_context(summary: DataFrame, days: int = 30, season: Column | None = None) -> DataFrame:
    """Add the rolling means, the deltas against them and the season means.

    A season mean covers every game of the pitcher, later ones included;
    ``season`` (such as ``year(game_date)``) narrows it to one season.
    """
    key = "pitcher_id"
    daily = daily_sums(summary, key, ROLLED, season=season)
    past = f"(PARTITION BY {key} ORDER BY unix_date(game_date) RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING)"
    whole = f"(PARTITION BY {key})" if season is None else f"(PARTITION BY {key}, _season)"
    frames = [
        f"sum({part}_{c}) OVER {window} AS {prefix}{part}_{c}"
        for prefix, window in (("p", past), ("w", whole)) for part in "ks" for c in ROLLED
    ]
    context = daily.selectExpr(key, "game_date", *frames)
    joined = join_null_safe(summary, context, [key, "game_date"])

    def mean(prefix: str, c: str) -> str:
        return sql_rnd(f"{sql_ratio(f'{prefix}s_{c}', f'{prefix}k_{c}')} / {10.0**ROLLED[c]}D", ROLLED[c])

    def above_past(c: str) -> str:
        # exact numerator: count * value - sum, all in scaled integers
        diff = f"(pk_{c} * {sql_scaled(c, ROLLED[c])} - ps_{c})"
        return sql_rnd(f"{sql_ratio(diff, f'pk_{c}')} / {10.0**ROLLED[c]}D", ROLLED[c])

    return joined.selectExpr(
        *summary.columns,
        f"{mean('p', 'avg_velo')} AS rolling_30d_avg_velo",
        f"{mean('p', 'whiff_rate')} AS rolling_30d_whiff_rate",
        f"{mean('p', 'csw_rate')} AS rolling_30d_csw_rate",
        f"{above_past('avg_velo')} AS velo_vs_30d_avg",
        f"{above_past('whiff_rate')} AS whiff_rate_delta",
        f"{mean('w', 'avg_velo')} AS season_avg_velo",
        f"{mean('w', 'csw_rate')} AS season_avg_csw",
        f"{mean('w', 'whiff_rate')} AS season_avg_whiff",
    )


def past_spread(summary: DataFrame, column: str, digits: int, key: str = "pitcher_id",
                days: int = 30) -> DataFrame:
    """Sample deviation of ``column`` over the past days, per entity and day."""
    daily = daily_sums(summary, key, {column: digits}, squares=(column,))
    past = past_days(key, days)
    k, s, q = (F.sum(f"{p}_{column}").over(past) for p in "ksq")
    return daily.select(key, "game_date",
                        (sample_std(k, s, q) / F.lit(10.0**digits)).alias(f"{column}_std"))


def rolling_mean_past(summary: DataFrame, column: str, digits: int, out: str,
                      key: str = "pitcher_id", days: int = 30) -> DataFrame:
    """Past-days mean of one more column."""
    daily = daily_sums(summary, key, {column: digits})
    past = past_days(key, days)
    mean = mean_of_scaled(F.sum(f"s_{column}").over(past), F.sum(f"k_{column}").over(past), digits)
    return join_null_safe(summary, daily.select(key, "game_date", rnd(mean, digits).alias(out)),
                          [key, "game_date"])


def rolling_rows(
    summary: DataFrame,
    digits: dict[str, int],
    key: str = "batter_id",
    n: int = 7,
    min_rows: int = 2,
    order: tuple = ("game_date", "game_pk"),
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Mean of the last ``n`` rows, this one included; null with too few values."""

    def columns(w):
        frame = w.rowsBetween(-(n - 1), 0)
        out = {}
        for c, d in digits.items():
            v = scaled(F.col(c), d)
            k = F.count(v).over(frame)
            out[f"{c}_{n}g"] = F.when(k >= min_rows, rnd(mean_of_scaled(F.sum(v).over(frame), k, d), d))
        return out

    return trailing_frame(summary, [key], list(order), n - 1, columns, block_rows, stored)


def rolling_prior(
    summary: DataFrame,
    baselines: dict[str, tuple[str, int]],
    key: str = "pitcher_id",
    n: int = 6,
    order: tuple = ("game_date", "game_pk"),
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Mean of the ``n`` previous rows; missing rows count as the baseline column."""

    def columns(w):
        frame = w.rowsBetween(-n, -1)
        out = {}
        for c, (baseline, d) in baselines.items():
            v = scaled(F.col(c), d)
            total = F.coalesce(F.sum(v).over(frame), F.lit(0))
            padding = (n - F.count(v).over(frame)) * scaled(F.col(baseline), d)
            out[f"prior_{n}_{c}"] = rnd(mean_of_scaled(total + padding, F.lit(n), d), d)
        return out

    return trailing_frame(summary, [key], list(order), n, columns, block_rows, stored)


def last_n(df: DataFrame, key: str, n: int, order: tuple = ("game_date", "game_pk"),
           position: str | None = None) -> DataFrame:
    """Latest ``n`` rows of each entity, cut to ``n`` per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", position) if position else ranked.drop("_rn")


def latest_row(df: DataFrame, key: str) -> DataFrame:
    return last_n(df, key, 1)
