"""Registered queries: each builds its result from the given tables."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.constants import BATTER_KEY, GAME_KEY, TARGET
from moundworks.functions import rules
from moundworks.operators import (
    anomaly, attribution, enrich, explore, extras, generation, gold, model, quality, report, rolling, silver,
)
from moundworks.operators.ordering import join_null_safe
from moundworks.plans.layers import Layers, layers
from moundworks.sources import bronze, insights, store, versions
from moundworks.sources.schemas import PITCH_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PITCH_NAMES = [c for c, _ in PITCH_COLUMNS]
METRICS = ["total_pitches", "avg_velo", "velo_stddev", "avg_spin", "avg_h_break", "avg_v_break", "whiff_rate",
           "csw_rate", "zone_rate", "chase_rate", "avg_xwoba_allowed", "avg_exit_velo_allowed",
           "barrel_rate_allowed", "total_re_delta", "stuff_diversity"]
SEASON_START, SEASON_END = date(2024, 4, 1), date(2024, 9, 30)
MIDSEASON = date(2024, 6, 30)
FIRST_RUN, SECOND_RUN = "2024-10-01T00:00:00+00:00", "2024-10-02T00:00:00+00:00"


def query(fn: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(layers(spark, sf_dir))
    return fn


# --- landing and typing ------------------------------------------------------

@query
def bronze_ingest(t):
    out = store.scratch_path(t.spark, "bronze")
    return bronze.land(t.spark, t.raw.drop("pitch_id"), out, SEASON_START, SEASON_END).select(*PITCH_NAMES)


@query
def incremental_days(t):
    out = store.scratch_path(t.spark, "bronze")
    bronze.land(t.spark, t.raw, out, end=MIDSEASON)
    return bronze.new_days(t.bronze, bronze.landed_days(t.spark, out)).select(*PITCH_NAMES)


@query
def pitch_key(t):
    return bronze.add_pitch_key(t.bronze).select(*PITCH_NAMES)


@query
def pitches_clean(t):
    return t.pitches


@query
def games(t):
    return silver.games(t.typed)


@query
def players(t):
    return silver.players(t.typed)


@query
def players_roster(t):
    pitchers = t.summary.groupBy("pitcher_id", "pitcher_name").agg(F.min("team").alias("team"), F.min("hand").alias("hand"))
    names = silver.one_per_player(t.players, "POS").select(F.col("player_id").alias("batter_id"), "full_name")
    batters = t.battery().join(names, "batter_id")
    return silver.roster(
        pitchers.withColumnsRenamed({"pitcher_id": "player_id", "pitcher_name": "full_name"}),
        batters.withColumnRenamed("batter_id", "player_id"),
    )


@query
def games_on_date(t):
    return silver.games_on(t.summary)


@query
def row_counts(t):
    return quality.row_counts(
        pitches=t.silver, games=silver.games(t.silver), players=t.players,
        pitcher_game_summary=t.summary, batter_game_summary=t.batters,
    )


# --- summaries and windows ---------------------------------------------------

@query
def pitcher_game_summary(t):
    return gold.summary_of(t.game_base)


@query
def pitcher_game_all_swings(t):
    return gold.pitcher_game_base(t.typed, swing=rules.SWING_ALL)


@query
def pitcher_game_fanout(t):
    return gold.pitcher_game_fanout(t.typed)


@query
def batter_game_summary(t):
    return gold.batter_game_summary(t.typed)


@query
def pitch_mix(t):
    return gold.pitch_mix(t.typed)


@query
def rolling_30d(t):
    return gold.summary_of(t.game_base).select(*GAME_KEY, *rolling.CONTEXT_COLUMNS[:5])


@query
def season_averages(t):
    return gold.summary_of(t.game_base).select(*GAME_KEY, *rolling.CONTEXT_COLUMNS[5:])


@query
def season_averages_by_year(t):
    return rolling.with_context(t.game_base, season=F.year("game_date")).select(*GAME_KEY, *rolling.CONTEXT_COLUMNS[5:])


@query
def rolling_7_games(t):
    rows = t.batters.select(*BATTER_KEY, "avg_xwoba", "barrel_rate")
    return rolling.rolling_rows(rows, {"avg_xwoba": 4, "barrel_rate": 4}, stored=True)


@query
def rolling_6_starts(t):
    rows = t.summary.select(*GAME_KEY, "avg_velo", "csw_rate", "whiff_rate",
                            "season_avg_velo", "season_avg_csw", "season_avg_whiff")
    return rolling.rolling_prior(rows, {
        "avg_velo": ("season_avg_velo", 2), "csw_rate": ("season_avg_csw", 4), "whiff_rate": ("season_avg_whiff", 4),
    }, stored=True)


@query
def last_n_per_player(t):
    return rolling.last_n(t.summary, "pitcher_id", 2).select(*GAME_KEY, "pitcher_name", "csw_rate", "performance_tier")


@query
def latest_row(t):
    return rolling.latest_row(t.summary, "pitcher_id").select(*GAME_KEY, "pitcher_name", "team", "opponent",
                                                              "performance_tier")


@query
def home_away(t):
    return gold.pitcher_game_base(t.typed, extras=True).select(*GAME_KEY, "home_away", "team", "opponent")


# --- joins and filters -------------------------------------------------------

@query
def summary_with_player(t):
    rows = gold.pitcher_game_base(t.silver)
    return explore.with_player(rows, t.players).select(*GAME_KEY, "pitcher_name", "hand", "csw_rate")


@query
def summary_with_game(t):
    return explore.with_game(t.summary, silver.games(t.silver)).select(
        *GAME_KEY, "csw_rate", "home_team", "away_team", "home_score", "away_score", "home_away", "opponent")


@query
def game_rows(t):
    return explore.game_rows(t.summary).select(*GAME_KEY, "pitcher_name", "opponent", "csw_rate", "csw_place")


@query
def date_range(t):
    return bronze.in_range(t.summary, date(2024, 5, 1), date(2024, 8, 31)).select(*GAME_KEY, *METRICS)


@query
def gold_scan(t):
    path = store.scratch_path(t.spark, "gold")
    store.write_table(t.summary, path, [F.col("game_date").desc(), F.col("pitcher_id")])
    return store.read_table(t.spark, path).select(*GAME_KEY, *METRICS, *rolling.CONTEXT_COLUMNS, "performance_tier")


@query
def entity_rows(t):
    return explore.entity_rows(t.summary).select("pitcher_name", *GAME_KEY, "csw_rate", "whiff_rate", "avg_velo")


@query
def explorer_points(t):
    return explore.explorer_points(t.summary)


@query
def report_insight(t):
    stored = enrich.insight_rows(rolling.last_n(t.narratives, "pitcher_id", 2), FIRST_RUN)
    return explore.with_insight(t.summary.select(*GAME_KEY, "pitcher_name"), stored)


@query
def top_pitcher_trend(t):
    return explore.top_pitcher_trend(t.summary)


# --- exploration -------------------------------------------------------------

@query
def overview_kpis(t):
    return explore.overview_kpis(t.summary)


@query
def tier_distribution(t):
    return explore.tier_distribution(t.summary)


@query
def leaderboard(t):
    return explore.leaderboard(t.summary)


@query
def display_names(t):
    return explore.display_leaderboard(explore.leaderboard(t.summary))


@query
def display_matrix(t):
    return explore.display_matrix(explore.season_matrix(t.summary))


@query
def display_overview(t):
    return explore.display_overview(explore.overview_kpis(t.summary))


@query
def display_pitcher_card(t):
    return explore.display_pitcher_card(t.summary)


@query
def display_batter_card(t):
    return explore.display_batter_card(t.batters)


@query
def display_game(t):
    return explore.display_game(t.summary)


@query
def pitcher_card(t):
    return explore.pitcher_card(t.summary)


@query
def season_matrix(t):
    return explore.season_matrix(t.summary)


@query
def pitcher_tiers(t):
    return explore.pitcher_tiers(t.summary)


@query
def batter_card(t):
    return explore.batter_card(t.batters)


@query
def exit_velo_histogram(t):
    return explore.exit_velo_histogram(t.batters)


@query
def date_bounds(t):
    return explore.date_bounds(t.summary)


@query
def name_list(t):
    return explore.distinct_sorted(t.summary, ["pitcher_name"])


@query
def date_list(t):
    return explore.distinct_sorted(t.summary, ["pitcher_name", "game_date"], desc=True)


@query
def recent_form(t):
    return explore.recent_form(t.summary)


@query
def trend_series(t):
    return explore.trend_series(t.summary)


# --- rules -------------------------------------------------------------------

@query
def performance_tier(t):
    return t.summary.select(*GAME_KEY, "csw_rate", rules.performance_tier(F.col("csw_rate")).alias("tier"))


@query
def letter_grade(t):
    return t.summary.select(*GAME_KEY, "csw_rate", rules.letter_grade(F.col("csw_rate")).alias("grade"))


@query
def csw_percentile(t):
    return t.summary.select(*GAME_KEY, "csw_rate", rules.csw_percentile(F.col("csw_rate")).alias("percentile"))


@query
def stuff_score(t):
    return t.summary.select(*GAME_KEY, "csw_rate", rules.stuff_score(F.col("csw_rate")).alias("stuff_score"))


@query
def metric_tiers(t):
    return explore.metric_tiers(t.summary)


@query
def vs_league(t):
    return explore.vs_league(t.summary)


@query
def player_first_name(t):
    name = F.col("full_name")
    return t.players.select("player_id", "position", "hand", rules.first_name(name).alias("first_name"),
                            F.upper(name).alias("upper_name"))


# --- anomalies and enrichment ------------------------------------------------

@query
def anomaly_literal(t):
    return anomaly.anomaly_literal(t.summary)


@query
def anomaly_z(t):
    return anomaly.anomaly_z(t.summary)


@query
def pitcher_prompt(t):
    return enrich.pitcher_prompt(t.summary)


@query
def live_prompt(t):
    return enrich.live_prompt(t.summary)


@query
def generate_text(t):
    # a stand-in writer: answers with the prompt's pitcher line as headline
    def writer(prompts):
        who = prompts.str.extract(r"Pitcher: ([^\n]*)", expand=False)
        return '{"headline": "Report on ' + who + '"}'

    kept = store.scratch_path(t.spark, "answers")
    answers = generation.generate_once(enrich.live_prompt(t.summary), writer, kept).drop("prompt")
    return insights.parse_response(answers).select(*GAME_KEY, "headline", "error")


@query
def anomaly_prompt(t):
    return enrich.anomaly_prompt(anomaly.anomaly_literal(t.summary))


@query
def game_brief_inputs(t):
    return enrich.game_brief_inputs(t.summary, t.batters, silver.games(t.silver))


@query
def template_narrative(t):
    return enrich.template_narrative(t.summary, t.mix)


@query
def insight_rows(t):
    return enrich.insight_rows(t.narratives, FIRST_RUN)


@query
def parse_response(t):
    # the 'average' rows answer in prose, which no JSON parser takes
    rows = enrich.insight_rows(t.narratives, FIRST_RUN).drop("insight_type", "generated_at")
    tier = F.get_json_object("insight_json", "$.performance_tier")
    prose = F.concat(F.lit("Here is my analysis: "), F.get_json_object("insight_json", "$.headline"))
    answers = rows.withColumn("response", F.when(tier == "average", prose).otherwise(F.col("insight_json")))
    return insights.parse_response(answers).drop("insight_json", "response")


@query
def insight_upsert(t):
    latest = rolling.latest_row(t.narratives, "pitcher_id").withColumn("concern_flag", F.lit("Reviewed."))
    path = store.scratch_path(t.spark, "insights")
    insights.create_table(enrich.insight_rows(t.narratives, FIRST_RUN), path)
    insights.upsert_path(t.spark, path, enrich.insight_rows(latest, SECOND_RUN))
    return versions.read(t.spark, path)


@query
def insights_scan(t):
    path = store.scratch_path(t.spark, "insights")
    store.write_json(t.narratives, path)
    return insights.read_insights(t.spark, path)


# --- model -------------------------------------------------------------------

@query
def training_rows(t):
    return model.training_rows(t.summary)


@query
def lagged_features(t):
    return model.training_rows(t.summary, lagged=True, stored=True)


@query
def feature_medians(t):
    return model.feature_medians(t.training)


@query
def feature_matrix(t):
    return model.feature_matrix(t.training)


@query
def time_series_folds(t):
    return model.time_series_folds(t.training, stored=True).select(*GAME_KEY, TARGET, "row_idx", "val_fold")


@query
def time_series_folds_by_date(t):
    return model.time_series_folds(t.training, by_date=True).select(*GAME_KEY, TARGET, "val_fold")


@query
def fold_ranges(t):
    return model.fold_ranges(t.folds)


@query
def cv_metrics(t):
    return t.cv


@query
def train_model(t):
    return model.model_facts(t.tree_nodes)


@query
def score_batch(t):
    return model.score_batch(t.fitted, t.summary)


@query
def attributions(t):
    return attribution.attributions(t.fitted, t.summary)


@query
def attribution_sums(t):
    """Contributions and base value add up to the prediction of every game."""
    rest = F.col("prediction") - F.col("base_value") - F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return t.contributions.select(*GAME_KEY, F.round(F.abs(rest), 6).alias("residue"))


@query
def training_size(t):
    """The part of the training metadata that does not depend on the fit, and how its parts agree."""
    meta = training_metadata(t)
    inner = t.tree_nodes.filter("leftChild >= 0").agg(F.count("*")).scalar()
    counted = F.aggregate("feature_importance", F.lit(0).cast("bigint"), lambda a, f: a + f["importance"])
    return meta.select(
        "n_training_rows", "first_date", "last_date", F.size("cv_results").alias("folds"), F.size("attribution_summary").alias("features"),
        F.forall("cv_results", lambda f: (f["rmse"] >= f["mae"]) & (f["mae"] > 0) & (f["r2"] <= 1)).alias("metrics_in_bounds"),
        (counted == inner).alias("importance_counts_splits"),
    )


@query
def report_predictions(t):
    """Reports and batch scoring give a game one prediction."""
    shown = report.scouting_report(t.summary, _stored_insights(t), t.fitted).select(*GAME_KEY, F.col("prediction.predicted_csw_rate").alias("shown"))
    scored = model.score_batch(t.fitted, t.summary)
    return join_null_safe(shown, scored, GAME_KEY).select(*GAME_KEY, (F.col("shown") == F.col("predicted_csw_rate")).alias("agrees"))


@query
def attribution_summary(t):
    return attribution.attribution_summary(t.fitted, t.summary)


@query
def feature_importance(t):
    return attribution.feature_importance(t.tree_nodes)


@query
def training_metadata(t):
    return model.training_metadata(
        t.training, t.cv, attribution.feature_importance(t.tree_nodes),
        attribution.attribution_summary(t.fitted, t.training))


@query
def model_store(t):
    path = store.scratch_path(t.spark, "model")
    model.save_model(t.fitted, path, training_metadata(t))
    loaded, _ = model.load_model(t.spark, path)
    return model.score_batch(loaded, t.summary)


# --- reports and quality -----------------------------------------------------

def _stored_insights(t):
    return enrich.insight_rows(rolling.last_n(t.narratives, "pitcher_id", 2), FIRST_RUN)


@query
def report_features(t):
    return report.report_features(t.summary)


@query
def report_stats(t):
    return report.report_stats(t.summary, _stored_insights(t))


@query
def scouting_report(t):
    return report.scouting_report(t.summary, _stored_insights(t), t.fitted)


@query
def report_json(t):
    """Reports written as nested JSON, and what a reader of the files finds in them."""
    path = store.scratch_path(t.spark, "reports")
    store.write_json(report.scouting_report(t.summary, _stored_insights(t), t.fitted), path)
    fields = ("pitcher_id bigint, game_pk bigint, game_date date, pitcher_name string, opponent string, letter_grade string, percentile int, "
              "headline string, stats struct<csw_rate: double, chase_rate: double, performance_tier: string>")
    found = t.spark.read.schema(fields).json(path)
    return found.select(*GAME_KEY, "pitcher_name", "opponent", "letter_grade", "percentile", "headline", "stats.*")


@query
def dq_report(t):
    return quality.dq_report(t.summary, t.batters, enrich.insight_rows(t.narratives, FIRST_RUN), t.bronze)


# --- data dictionary extras --------------------------------------------------

@query
def fastball_pct(t):
    return t.summary.select(*GAME_KEY, "fastball_pct")


@query
def velo_vs_season(t):
    return extras.velo_vs_season(t.summary)


@query
def high_leverage_csw(t):
    return t.summary.select(*GAME_KEY, "high_leverage_csw")


@query
def days_rest(t):
    return extras.days_rest(t.summary, stored=True)


@query
def barrel_rate_allowed_30d(t):
    rows = t.summary.select(*GAME_KEY, "barrel_rate_allowed")
    return rolling.rolling_mean_past(rows, "barrel_rate_allowed", 4, "barrel_rate_allowed_30d")


@query
def opposing_team_k_rate(t):
    return extras.opposing_team_k_rate(t.summary, t.silver)


@query
def team_trends(t):
    return extras.team_trends(t.summary)


@query
def at_bats(t):
    return extras.at_bats(t.typed)


@query
def pitch_mix_text(t):
    return extras.pitch_mix_text(t.mix)


@query
def contact_by_type(t):
    return extras.contact_by_type(t.typed)


@query
def whiff_by_zone(t):
    return extras.whiff_by_zone(t.typed)
