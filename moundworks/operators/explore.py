"""Queries behind the exploration pages.

Every function works on all entities of the given table; pass a filtered table
(``in_range``, ``entity_rows``) for one entity or period. Means are taken over
scaled integers, see ``functions.numeric``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks import constants as K
from moundworks import templates as words
from moundworks.functions import rules
from moundworks.functions.numeric import mean_of_scaled, rnd, sample_std, scaled
from moundworks.operators.ordering import join_null_safe, ordered_index
from moundworks.operators.rolling import last_n
from moundworks.operators.silver import one_per_player

DIGITS = {
    "csw_rate": 4, "whiff_rate": 4, "avg_velo": 2, "avg_xwoba_allowed": 4, "barrel_rate_allowed": 4,
    "total_re_delta": 3, "avg_exit_velo": 2, "avg_xwoba": 4, "barrel_rate": 4, "hard_hit_rate": 4,
    "o_swing_rate": 4,
}


def exact_mean(name: str, out_digits: int | None = None) -> Column:
    """Mean of a rounded column as an aggregate."""
    d = DIGITS[name]
    v = scaled(F.col(name), d)
    return rnd(mean_of_scaled(F.sum(v), F.count(v), d), d if out_digits is None else out_digits)


def exact_sum(name: str) -> Column:
    d = DIGITS[name]
    return F.sum(scaled(F.col(name), d)).cast("double") / F.lit(10.0**d)


# --- names, sides, lookups ---------------------------------------------------

def with_player(summary: DataFrame, player_rows: DataFrame, position: str = "SP",
                key: str = "pitcher_id", out: str = "pitcher_name") -> DataFrame:
    """LEFT join to the one-row-per-player view. No side is hinted: the player
    table grows with the data, so its measured size decides the join."""
    names = one_per_player(player_rows, position).select(
        F.col("player_id").alias(key), F.col("full_name").alias(out), "hand"
    )
    return summary.join(names, key, "left")


def with_game(summary: DataFrame, game_rows: DataFrame) -> DataFrame:
    """Teams and score of each row's game. A game resumed on another day has a row per
    day, so day and teams' game number both have to agree."""
    lookup = game_rows.groupBy("game_pk", "game_date").agg(
        F.min(F.struct("home_team", "away_team", "home_score", "away_score")).alias("_game")
    )
    return join_null_safe(summary, lookup, ["game_pk", "game_date"]).select(*summary.columns, "_game.*")


def with_insight(summary: DataFrame, insights: DataFrame) -> DataFrame:
    """Insight text of each pitcher and day, with the pending text where none is stored."""
    w = Window.partitionBy("pitcher_id", "game_date").orderBy(
        F.col("generated_at").desc_nulls_last(), F.col("game_pk").asc_nulls_last()
    )
    one = (
        insights.filter(F.col("insight_type") == "pitcher_game")
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select("pitcher_id", "game_date", "insight_json")
    )
    joined = join_null_safe(summary, one, ["pitcher_id", "game_date"])
    text = F.col("insight_json")
    return joined.select(
        *summary.columns,
        F.coalesce(F.get_json_object(text, "$.headline"), F.when(
            text.isNull(), F.lit(words.PENDING_HEADLINE)), F.lit(words.NO_HEADLINE)).alias("headline"),
        F.coalesce(F.get_json_object(text, "$.key_finding"), F.when(
            text.isNull(), F.lit(words.PENDING_FINDING)),
            F.lit(words.NO_FINDING)).alias("key_finding"),
        F.get_json_object(text, "$.concern_flag").alias("concern_flag"),
        F.get_json_object(text, "$.pitch_mix_note").alias("pitch_mix_note"),
    )


# --- row filters -------------------------------------------------------------

def game_rows(named: DataFrame, game_pk: int | None = None, day=None) -> DataFrame:
    """Pitchers of a game, best CSW first; of every game when none is given.
    ``csw_place`` is the place in the game, counted in range slices: rows without a
    game are one group, of any size. ``named`` should be a stored table."""
    rows = named
    if game_pk is not None:
        rows = rows.filter(F.col("game_pk") == game_pk)
    if day is not None:
        rows = rows.filter(F.col("game_date") == F.lit(day))
    order = [F.col("csw_rate").desc_nulls_last(), F.col("pitcher_id").asc()]
    placed = ordered_index(rows, order, ["game_pk", "game_date"], "csw_place", stored=True)
    return placed.withColumn("csw_place", F.col("csw_place") + 1)


def entity_rows(named: DataFrame, names: list[str] | None = None, column: str = "pitcher_name",
                order: tuple = ("game_date", "game_pk")) -> DataFrame:
    """Rows of the named players (all players by default) in date order."""
    rows = named if names is None else named.filter(F.col(column).isin(names))
    return rows.orderBy(column, *order)


def explorer_points(named: DataFrame) -> DataFrame:
    """Points of the command and stuff-versus-contact charts."""
    return named.select("pitcher_name", "game_date", "game_pk", "opponent", "zone_rate", "chase_rate", "csw_rate",
                        "total_pitches", "avg_xwoba_allowed", "performance_tier")


def trend_series(named: DataFrame) -> DataFrame:
    return named.select(
        "pitcher_name", "game_date", "game_pk", "csw_rate", "avg_velo", "rolling_30d_avg_velo",
        "whiff_rate", "rolling_30d_whiff_rate", "performance_tier",
        F.lit(K.LEAGUE_AVG["csw_rate"]).alias("league_csw"),
        F.lit(K.LEAGUE_AVG["whiff_rate"]).alias("league_whiff"),
    )


# --- overview ----------------------------------------------------------------

def overview_kpis(summary: DataFrame) -> DataFrame:
    elite = F.count_if(F.col("performance_tier") == "elite").cast("double")
    return summary.agg(
        F.count_distinct("game_pk").alias("total_games"),
        rnd(elite / F.nullif(F.count("*").cast("double"), F.lit(0.0)), 4).alias("elite_share"),
        exact_mean("csw_rate").alias("avg_csw"),
        exact_mean("avg_xwoba_allowed").alias("avg_xwoba"),
        exact_mean("avg_velo").alias("avg_velo"),
    )


def tier_distribution(summary: DataFrame) -> DataFrame:
    """Count of each of the five tiers in fixed order, zeros included."""
    tiers = summary.sparkSession.createDataFrame(
        [(n, t) for n, t in enumerate(K.TIERS)], "tier_order int, performance_tier string"
    )
    counts = summary.groupBy("performance_tier").agg(F.count("*").alias("starts"))
    return (
        tiers.join(counts, "performance_tier", "left")
        .select("tier_order", "performance_tier", F.coalesce("starts", F.lit(0)).alias("starts"))
        .orderBy("tier_order")
    )


def _most_frequent(columns: list[str]) -> Column:
    """Name of the largest count column, the first one of equals; null if all are 0."""
    most = F.greatest(*columns)
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) == most, F.lit(c)).otherwise(name)
    return F.when(most > 0, name)


def leaderboard(named: DataFrame, top: int = 10, by: tuple = ("pitcher_id", "pitcher_name", "team")) -> DataFrame:
    """Best pitchers by mean CSW with their most frequent tier (ties: lowest name)."""
    return (
        named.groupBy(*by)
        .agg(
            F.count_distinct("game_pk").alias("starts"),
            exact_mean("csw_rate").alias("avg_csw"),
            exact_mean("whiff_rate").alias("avg_whiff"),
            exact_mean("avg_velo").alias("avg_velo"),
            exact_mean("avg_xwoba_allowed").alias("avg_xwoba"),
            *[F.count_if(F.col("performance_tier") == tier).alias(tier) for tier in K.TIERS],
        )
        .withColumn("best_tier", _most_frequent(sorted(K.TIERS)))
        .drop(*K.TIERS)
        .orderBy(F.col("avg_csw").desc_nulls_last(), *by)
        .limit(top)
    )


def top_pitcher_trend(named: DataFrame, top: int = 6) -> DataFrame:
    """Game series of the pitchers with the highest mean CSW. The kept side is
    ``top`` rows, so broadcasting it is safe at any size."""
    best = (
        named.groupBy("pitcher_name")
        .agg(exact_mean("csw_rate").alias("m"))
        .orderBy(F.col("m").desc_nulls_last(), "pitcher_name")
        .limit(top)
        .select("pitcher_name")
    )
    return (
        named.join(F.broadcast(best), "pitcher_name", "left_semi")
        .select("pitcher_name", "game_date", "game_pk", "csw_rate")
        .orderBy("game_date", "pitcher_name", "game_pk")
    )


# --- one card per player -----------------------------------------------------

def pitcher_card(named: DataFrame) -> DataFrame:
    return named.groupBy("pitcher_id", "pitcher_name").agg(
        F.count("*").alias("starts"),
        exact_mean("csw_rate").alias("avg_csw"),
        exact_mean("whiff_rate").alias("avg_whiff"),
        exact_mean("avg_velo").alias("avg_velo"),
        exact_mean("avg_xwoba_allowed").alias("avg_xwoba"),
        exact_sum("total_re_delta").alias("re_delta"),
    )


def batter_card(named: DataFrame) -> DataFrame:
    return named.groupBy("batter_id", "batter_name").agg(
        exact_mean("avg_exit_velo").alias("avg_exit_velo"),
        exact_mean("avg_xwoba").alias("avg_xwoba"),
        exact_mean("barrel_rate").alias("barrel_rate"),
        exact_mean("hard_hit_rate").alias("hard_hit_rate"),
        exact_mean("o_swing_rate").alias("o_swing_rate"),
    )


def pitcher_tiers(named: DataFrame) -> DataFrame:
    """Tiers a pitcher had, without zero rows."""
    return named.groupBy("pitcher_id", "pitcher_name", "performance_tier").agg(F.count("*").alias("starts"))


def season_matrix(named: DataFrame) -> DataFrame:
    """Statistic by metric for each pitcher; combinations not asked for are null."""

    def spread(name: str) -> Column:
        d = DIGITS[name]
        v = scaled(F.col(name), d)
        return rnd(sample_std(F.count(v), F.sum(v), F.sum(v * v)) / F.lit(10.0**d), 4)

    cells = {
        ("mean", "csw_rate"): exact_mean("csw_rate"), ("max", "csw_rate"): F.max("csw_rate"),
        ("min", "csw_rate"): F.min("csw_rate"), ("std", "csw_rate"): spread("csw_rate"),
        ("mean", "whiff_rate"): exact_mean("whiff_rate"), ("max", "whiff_rate"): F.max("whiff_rate"),
        ("mean", "avg_velo"): exact_mean("avg_velo", 4), ("max", "avg_velo"): F.max("avg_velo"),
        ("min", "avg_velo"): F.min("avg_velo"),
        ("mean", "barrel_rate_allowed"): exact_mean("barrel_rate_allowed"),
        ("mean", "avg_xwoba_allowed"): exact_mean("avg_xwoba_allowed"),
        ("sum", "total_re_delta"): exact_sum("total_re_delta"),
    }
    metrics = ["csw_rate", "whiff_rate", "avg_velo", "barrel_rate_allowed", "avg_xwoba_allowed", "total_re_delta"]
    stats = ["mean", "max", "min", "std", "sum"]
    wide = named.groupBy("pitcher_id", "pitcher_name").agg(
        *[c.alias(f"{s}_{m}") for (s, m), c in cells.items()]
    )
    rows = [
        F.struct(F.lit(s).alias("stat"), *[
            (F.col(f"{s}_{m}") if (s, m) in cells else F.lit(None)).cast("double").alias(m) for m in metrics
        ])
        for s in stats
    ]
    return wide.select("pitcher_id", "pitcher_name", F.inline(F.array(*rows)))


def exit_velo_histogram(summary: DataFrame, bins: int = 25) -> DataFrame:
    """Equal-width bins of a batter's game exit velocity over the whole table,
    empty bins included; bins that start at 95 or more are hard hit."""
    value = F.col("avg_exit_velo")
    known = summary.filter(value.isNotNull())
    ends = known.agg(F.struct(F.min("avg_exit_velo").alias("low"), F.max("avg_exit_velo").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = F.nullif(high - low, F.lit(0.0))
    place = F.coalesce(F.floor((value - low) / width * F.lit(float(bins))), F.lit(0))
    counts = known.groupBy(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(
        F.count("*").alias("games")
    )
    start = low + (high - low) * F.col("bin") / F.lit(float(bins))
    return (
        summary.sparkSession.range(bins).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select("bin", F.coalesce("games", F.lit(0)).alias("games"),
                rnd(start, 4).alias("bin_start"), (start >= 95).alias("hard_hit"))
    )


def date_bounds(df: DataFrame, column: str = "game_date") -> DataFrame:
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def distinct_sorted(df: DataFrame, columns: list[str], desc: bool = False) -> DataFrame:
    """Distinct values for a selection list, sorted by the last column."""
    *lead, last = columns
    end = F.col(last).desc() if desc else F.col(last).asc()
    return df.select(*columns).distinct().orderBy(*lead, end)


def recent_form(named: DataFrame, n: int = 8, selected_day=None) -> DataFrame:
    """Last ``n`` starts of each pitcher; the start of the selected day is
    marked, by default each pitcher's latest."""
    rows = last_n(named, "pitcher_id", n, position="starts_ago")
    mark = F.col("starts_ago") == 1 if selected_day is None else F.col("game_date") == F.lit(selected_day)
    return rows.select("pitcher_id", "pitcher_name", "game_date", "game_pk", "csw_rate", "performance_tier",
                       "starts_ago", mark.alias("selected"))


# --- rule columns over the summary -------------------------------------------

def metric_tiers(summary: DataFrame) -> DataFrame:
    """Tier of each rated metric, one row per game and metric. The table of cut
    values has one row per metric and is broadcast."""
    cuts = summary.sparkSession.createDataFrame(
        K.METRIC_TIERS, "metric string, higher boolean, elite double, above_avg double, average double"
    )
    names = [m[0] for m in K.METRIC_TIERS]
    long = summary.select(
        *K.GAME_KEY,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])),
    )

    def reaches(cut: str) -> Column:
        return F.when(F.col("higher"), F.col("value") >= F.col(cut)).otherwise(F.col("value") <= F.col(cut))

    tier = (
        F.when(F.col("value").isNull(), F.lit(None).cast("string"))
        .when(reaches("elite"), "elite")
        .when(reaches("above_avg"), "above_avg")
        .when(reaches("average"), "average")
        .otherwise("below_avg")
    )
    return long.join(F.broadcast(cuts), "metric").select(*K.GAME_KEY, "metric", "value", tier.alias("tier"))


def vs_league(summary: DataFrame) -> DataFrame:
    """Rates beside the league mean, with the stars of a report."""
    league = {"csw_rate": "csw_rate", "whiff_rate": "whiff_rate", "zone_rate": "zone_rate",
              "chase_rate": "chase_rate", "barrel_rate_allowed": "barrel_rate",
              "avg_xwoba_allowed": "avg_xwoba", "avg_exit_velo_allowed": "avg_exit_velo"}
    return summary.select(
        *K.GAME_KEY,
        *[F.col(c) for c in league],
        *[rnd(F.col(c) - F.lit(K.LEAGUE_AVG[k]), 4).alias(f"{c}_vs_league") for c, k in league.items()],
        F.coalesce(F.col("whiff_rate") >= K.STAR_WHIFF, F.lit(False)).alias("whiff_star"),
        F.coalesce(F.col("csw_rate") >= K.STAR_CSW, F.lit(False)).alias("csw_star"),
    )


def display_leaderboard(board: DataFrame) -> DataFrame:
    """Leaderboard with display headings and formatted numbers."""
    return board.select(
        F.col("pitcher_name").alias("Pitcher"),
        F.col("team").alias("Team"),
        F.col("starts").alias("GS"),
        rules.or_dash(rules.pct(F.col("avg_csw")), F.col("avg_csw")).alias("CSW%"),
        rules.or_dash(rules.pct(F.col("avg_whiff")), F.col("avg_whiff")).alias("Whiff%"),
        rules.or_dash(rules.fixed(F.col("avg_velo"), 1), F.col("avg_velo")).alias("Velo"),
        rules.or_dash(rules.fixed(F.col("avg_xwoba"), 3), F.col("avg_xwoba")).alias("xwOBA"),
        rules.tier_words(F.col("best_tier")).alias("Top Tier"),
    )


def display_matrix(matrix: DataFrame) -> DataFrame:
    """Season matrix with display headings; absent cells become a dash."""
    formats = {
        "Velo": lambda c: rules.fixed(c, 1), "xwOBA": lambda c: rules.fixed(c, 3), "RE Delta": lambda c: rules.signed(c, 3),
    }
    return matrix.select(
        "pitcher_id", F.col("stat").alias("Stat"),
        *[rules.or_dash(formats.get(h, rules.pct)(F.col(c)), F.col(c)).alias(h) for h, c in words.MATRIX_HEADINGS.items()],
    )


def _shown(text: Column, source: str, name: str) -> Column:
    return rules.or_dash(text, F.col(source)).alias(name)


def display_overview(kpis: DataFrame) -> DataFrame:
    """Overview figures as the page prints them."""
    return kpis.select(
        rules.grouped(F.col("total_games")).alias("Total Games"),
        _shown(rules.pct(F.col("elite_share"), 0), "elite_share", "Elite Outings"),
        _shown(rules.pct(F.col("avg_csw")), "avg_csw", "Avg CSW Rate"),
        _shown(rules.fixed(F.col("avg_xwoba"), 3), "avg_xwoba", "Avg xwOBA Allowed"),
        _shown(F.concat(rules.fixed(F.col("avg_velo"), 1), F.lit(" mph")), "avg_velo", "Avg Fastball Velo"),
    )


def display_pitcher_card(named: DataFrame) -> DataFrame:
    """Head of a pitcher's page: latest start and formatted card."""
    latest = last_n(named, "pitcher_id", 1).select(
        "pitcher_id", "team", rules.tier_words(F.col("performance_tier")).alias("Tier"),
        F.concat(F.lit("Last start: "), rules.short_date(F.col("game_date")), F.lit(" vs. "),
                 F.coalesce("opponent", F.lit("Unknown"))).alias("Last start"),
    )
    card = pitcher_card(named).select(
        "pitcher_id", "pitcher_name",
        F.col("starts").cast("string").alias("GS (filtered)"),
        _shown(rules.pct(F.col("avg_csw")), "avg_csw", "Avg CSW%"),
        _shown(rules.pct(F.col("avg_whiff")), "avg_whiff", "Avg Whiff%"),
        _shown(rules.fixed(F.col("avg_velo"), 1), "avg_velo", "Avg Velo"),
        _shown(rules.fixed(F.col("avg_xwoba"), 3), "avg_xwoba", "xwOBA"),
        _shown(rules.signed(F.col("re_delta"), 1), "re_delta", "RE Delta"),
    )
    return card.join(latest, "pitcher_id")


def display_batter_card(named: DataFrame) -> DataFrame:
    return batter_card(named).select(
        "batter_id", "batter_name",
        _shown(F.concat(rules.fixed(F.col("avg_exit_velo"), 1), F.lit(" mph")), "avg_exit_velo", "Avg Exit Velo"),
        _shown(rules.fixed(F.col("avg_xwoba"), 3), "avg_xwoba", "Avg xwOBA"),
        _shown(rules.pct(F.col("barrel_rate")), "barrel_rate", "Barrel Rate"),
        _shown(rules.pct(F.col("hard_hit_rate")), "hard_hit_rate", "Hard Hit%"),
        _shown(rules.pct(F.col("o_swing_rate")), "o_swing_rate", "O-Swing%"),
    )


def display_game(named: DataFrame) -> DataFrame:
    """Figures of the report page for each game."""
    return named.select(
        *K.GAME_KEY,
        rules.long_date(F.col("game_date")).alias("Game date"),
        F.concat(F.col("pitcher_name"), F.lit(" · "), rules.short_date(F.col("game_date")), F.lit(" vs. "),
                 F.coalesce("opponent", F.lit("Unknown"))).alias("Title"),
        F.col("total_pitches").cast("string").alias("Pitches"),
        _shown(rules.pct(F.col("csw_rate")), "csw_rate", "CSW Rate"),
        _shown(rules.pct(F.col("whiff_rate")), "whiff_rate", "Whiff Rate"),
        _shown(F.concat(rules.fixed(F.col("avg_velo"), 1), F.lit(" mph")), "avg_velo", "Avg Velo"),
        _shown(rules.pct(F.col("zone_rate")), "zone_rate", "Zone Rate"),
        _shown(rules.pct(F.col("chase_rate")), "chase_rate", "Chase Rate"),
        _shown(rules.fixed(F.col("avg_xwoba_allowed"), 3), "avg_xwoba_allowed", "xwOBA"),
        _shown(rules.signed(F.col("total_re_delta"), 2), "total_re_delta", "RE Delta"),
    )
