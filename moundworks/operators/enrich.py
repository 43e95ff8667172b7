"""Prompts, narratives and insight rows built from the summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks import templates as text
from moundworks.constants import FASTBALLS, GAME_KEY, OFFSPEED_WORDS
from moundworks.functions import rules
from moundworks.functions.numeric import ratio
from moundworks.operators.ordering import join_null_safe


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def pitcher_label() -> Column:
    return F.coalesce("pitcher_name", F.concat(F.lit("Pitcher #"), F.col("pitcher_id").cast("string")))


def pitcher_prompt(named: DataFrame) -> DataFrame:
    """Prompt of each pitcher's game. Missing numbers are written as zero."""
    prompt = F.format_string(
        text.PITCHER_PROMPT,
        pitcher_label(),
        F.col("game_date").cast("string"),
        F.coalesce("opponent", F.lit("Unknown")),
        F.col("total_pitches").cast("string"),
        rules.fixed(zero("avg_velo"), 1),
        rules.fixed(zero("season_avg_velo"), 1),
        rules.signed(zero("velo_vs_30d_avg"), 1),
        rules.pct(zero("whiff_rate")),
        rules.pct(zero("csw_rate")),
        rules.pct(zero("zone_rate")),
        rules.pct(zero("chase_rate")),
        rules.fixed(zero("avg_xwoba_allowed"), 3),
        rules.pct(zero("barrel_rate_allowed")),
        rules.fixed(zero("stuff_diversity"), 3),
        rules.signed(zero("total_re_delta"), 2),
    )
    return named.select(*GAME_KEY, prompt.alias("prompt"))


def live_prompt(named: DataFrame) -> DataFrame:
    """Prompt of the report page for each pitcher's game."""
    prompt = F.format_string(
        text.LIVE_PROMPT,
        pitcher_label(),
        F.col("game_date").cast("string"),
        F.coalesce("opponent", F.lit("Unknown")),
        F.col("total_pitches").cast("string"),
        rules.fixed(zero("avg_velo"), 1),
        rules.fixed(zero("season_avg_velo"), 1),
        rules.pct(zero("whiff_rate")),
        rules.pct(zero("csw_rate")),
        rules.pct(zero("zone_rate")),
        rules.pct(zero("chase_rate")),
        rules.fixed(zero("avg_xwoba_allowed"), 3),
        rules.pct(zero("barrel_rate_allowed")),
        rules.signed(zero("total_re_delta"), 2),
        F.col("performance_tier"),
    )
    return named.select(*GAME_KEY, prompt.alias("prompt"))


def anomaly_prompt(anomalies: DataFrame) -> DataFrame:
    """One prompt per day from its ranked anomalies (a handful per day)."""
    line = F.format_string(
        text.ANOMALY_LINE,
        pitcher_label(),
        rules.pct(F.col("whiff_rate")),
        rules.pct(F.col("rolling_30d_whiff_rate")),
        rules.signed(zero("velo_vs_30d_avg"), 1),
    )
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return anomalies.groupBy("game_date").agg(
        F.count("*").alias("anomalies"),
        F.format_string(text.ANOMALY_PROMPT, F.array_join(lines["line"], "\n")).alias("prompt"),
    )


def _best_of_game(rows: DataFrame, value: str, tie: str, line: Column, out: str, top: int) -> DataFrame:
    """Text of the ``top`` best rows of each game; the rank filter is applied
    per task before rows of a game meet."""
    w = Window.partitionBy("game_pk", "game_date").orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    ranked = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    lines = F.array_sort(F.collect_list(F.struct("_rn", line.alias("line"))))
    return ranked.groupBy("game_pk", "game_date").agg(F.array_join(lines["line"], "\n").alias(out))


def game_brief_inputs(pitchers: DataFrame, batters: DataFrame, games: DataFrame, top: int = 3) -> DataFrame:
    """Teams, score and best performers of each game, with the prompt."""
    p = _best_of_game(
        pitchers, "csw_rate", "pitcher_id",
        F.concat_ws(" ", F.lit("-"), "pitcher_name", F.lit("CSW"), rules.pct(zero("csw_rate"))),
        "pitcher_table", top,
    )
    b = _best_of_game(
        batters, "avg_xwoba", "batter_id",
        F.concat_ws(" ", F.lit("-"), "batter_name", F.lit("xwOBA"), rules.fixed(zero("avg_xwoba"), 3)),
        "batter_table", top,
    )
    key = ["game_pk", "game_date"]
    joined = join_null_safe(join_null_safe(games, p, key), b, key)
    prompt = F.format_string(
        text.GAME_PROMPT, "home_team", "away_team", F.col("game_date").cast("string"),
        F.col("home_score").cast("string"), F.col("away_score").cast("string"),
        F.coalesce("pitcher_table", F.lit("")), F.coalesce("batter_table", F.lit("")),
    )
    return joined.withColumn("prompt", prompt)


def mix_profile(mix: DataFrame) -> DataFrame:
    """Fastball share and most used off-speed pitch of each pitcher's game."""
    is_fast = F.col("pitch_type").isin(FASTBALLS)
    offspeed = F.when(F.col("pitch_type").isin(list(OFFSPEED_WORDS)),
                      F.struct((-F.col("n")).alias("n"), F.col("pitch_type").alias("t")))
    return mix.groupBy(*GAME_KEY).agg(
        ratio(F.sum(F.when(is_fast, F.col("n")).otherwise(0)), F.sum("n")).alias("fastball_share"),
        F.min(offspeed)["t"].alias("top_offspeed"),
    )


def template_narrative(named: DataFrame, mix: DataFrame) -> DataFrame:
    """Narrative by tier with the game's numbers filled in; the mix note names
    the real fastball share and off-speed pitch, for the two top tiers."""
    spark = named.sparkSession
    tiers = spark.createDataFrame(
        text.NARRATIVES, "performance_tier string, headline string, key_finding string, concern_flag string"
    )
    numbers = {
        "name": rules.first_name(pitcher_label()),
        "whiff": rules.pct(zero("whiff_rate"), 0),
        "csw": rules.pct(zero("csw_rate"), 0),
        "velo": rules.fixed(zero("avg_velo"), 0),
        "vdelta": rules.fixed(F.abs(zero("velo_vs_30d_avg")), 1),
        "zone": rules.pct(zero("zone_rate"), 0),
        "xwoba": rules.fixed(zero("avg_xwoba_allowed"), 3),
        "barrel": rules.pct(zero("barrel_rate_allowed"), 0),
        "div": rules.fixed(zero("stuff_diversity"), 2),
    }

    def filled(column: str) -> Column:
        expr = F.col(column)
        for name, value in numbers.items():
            expr = F.replace(expr, F.lit("{" + name + "}"), value)
        return expr

    word = F.lit(None).cast("string")
    for code, name in OFFSPEED_WORDS.items():
        word = F.when(F.col("top_offspeed") == code, F.lit(name)).otherwise(word)
    note = F.when(
        F.col("performance_tier").isin("elite", "above_avg") & F.col("top_offspeed").isNotNull(),
        F.format_string(text.MIX_NOTE, rules.fixed(F.col("fastball_share") * 100, 0), word),
    )
    # five template rows: a fixed size
    rows = join_null_safe(named, mix_profile(mix), GAME_KEY).join(F.broadcast(tiers), "performance_tier", "left")
    return rows.select(
        *GAME_KEY, "pitcher_name", "performance_tier",
        filled("headline").alias("headline"),
        filled("key_finding").alias("key_finding"),
        "concern_flag",
        note.alias("pitch_mix_note"),
    )


def insight_rows(narratives: DataFrame, generated_at: str | None = None,
                 insight_type: str = "pitcher_game") -> DataFrame:
    """Insight-table rows with the texts as one JSON document."""
    fields = ["performance_tier", "headline", "key_finding", "concern_flag", "pitch_mix_note"]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return narratives.select(
        *GAME_KEY,
        F.lit(insight_type).alias("insight_type"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("insight_json"),
        (F.lit(generated_at) if generated_at else now).alias("generated_at"),
    )


def narrative_json(narratives: DataFrame) -> DataFrame:
    """The narrative of each game as one JSON text, the default of ``generate``."""
    fields = ["headline", "key_finding", "concern_flag", "pitch_mix_note"]
    return narratives.select(*GAME_KEY, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("template"))
