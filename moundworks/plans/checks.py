"""Queries about results that SQL cannot compute again, such as those of a fitted model.

Each asks for something that must hold whatever the fit was, and names it row by row:
per game, per tree, per feature. The SQL side lists the rows from the tables alone.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundworks.constants import FEATURES, GAME_KEY
from moundworks.functions import rules
from moundworks.functions.numeric import rnd
from moundworks.operators import attribution, enrich, explore, model, silver
from moundworks.operators.ordering import join_null_safe
from moundworks.plans.queries import FIRST_RUN, METRICS, query
from moundworks.sources import store, versions

NOBODY = "Nobody #0"


def _near(a: Column, b: Column, by: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.lit(by)


# --- tables --------------------------------------------------------------------

@query
def table_replace(t):
    """A replaced table has the new rows, and the version before it still the old ones."""
    path = store.scratch_path(t.spark, "replaced")
    rows = t.summary.select(*GAME_KEY, *METRICS)
    first = versions.replace(rows.filter("csw_rate >= 0.3"), path)
    versions.replace(rows, path)
    old = versions.read(t.spark, path, first).select(*GAME_KEY, F.lit(True).alias("_old"))
    return join_null_safe(versions.read(t.spark, path), old, GAME_KEY).withColumn("was_there", F.coalesce("_old", F.lit(False))).drop("_old")


@query
def register_batch(t):
    store.register(t.summary, "moundworks_batch")
    return t.spark.sql("SELECT pitcher_id, count(*) AS games, max(game_date) AS last_date FROM moundworks_batch GROUP BY pitcher_id")


@query
def loaded_at(t):
    """Load times lie between the start of the query and now."""
    begun = t.spark.sql("SELECT current_timestamp()").first()[0]
    rows = silver.stamped(t.pitches)
    return rows.select("pitch_id", (F.col("loaded_at") >= F.lit(begun)).alias("after_start"), (F.col("loaded_at") <= F.current_timestamp()).alias("before_now"))


@query
def empty_guards(t):
    """Lookups that find nothing give no rows, and the report keeps every game all the same."""
    named = t.summary
    counts = {
        "entity_rows": explore.entity_rows(named, [NOBODY]), "game_rows": explore.game_rows(named, game_pk=-1),
        "pitcher_card": explore.pitcher_card(named.filter(F.col("pitcher_name") == NOBODY)),
        "report_without_insights": explore.with_insight(named, enrich.insight_rows(t.narratives.limit(0), FIRST_RUN)),
    }
    parts = [df.agg(F.lit(name).alias("lookup"), F.count("*").alias("n")) for name, df in counts.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query
def generated_at_format(t):
    """Without a given time, insights carry the UTC time of their making in ISO form."""
    rows = enrich.insight_rows(t.narratives)
    shape = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"
    recent = F.abs(F.unix_seconds(F.to_timestamp("generated_at")) - F.unix_seconds(F.current_timestamp())) < 3600
    return rows.select(*GAME_KEY, F.regexp_like("generated_at", F.lit(shape)).alias("in_form"), recent.alias("recent"))


# --- model ---------------------------------------------------------------------

@query
def cv_ranges(t):
    """Fold metrics: sizes and dates of each fold, bounds of the errors, and rounds within the limit."""
    bounds = (F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0) & (F.col("r2") <= 1)
    return t.cv.select("fold", "n_train", "n_val", "val_start", "val_end", bounds.alias("in_bounds"),
                       F.col("rounds").between(1, model.PARAMS["maxIter"]).alias("rounds_in_bounds"))


@query
def tree_shapes(t):
    """Every round has its tree with its weight; a tree of n splits has 2 n + 1 nodes and depth 4 at most."""
    facts = model.model_facts(t.tree_nodes)
    return facts.select(F.col("tree").cast("int").alias("tree"), "weight", (F.col("nodes") == 2 * F.col("splits") + 1).alias("binary"),
                        F.col("splits").between(0, 2 ** model.PARAMS["maxDepth"] - 1).alias("bounded"))


@query
def score_rules(t):
    """Scores follow from the unrounded predictions that the attributions start from."""
    scored = join_null_safe(model.score_batch(t.fitted, t.summary), t.contributions.select(*GAME_KEY, "prediction"), GAME_KEY)
    return scored.select(*GAME_KEY, (F.col("predicted_csw_rate") == rnd(F.col("prediction"), 4)).alias("rate_agrees"),
                         (F.col("stuff_score") == rules.stuff_score(F.col("prediction"))).alias("score_agrees"))


@query
def model_round_trip(t):
    """A saved and loaded model scores every game as the live one does."""
    path = store.scratch_path(t.spark, "model")
    model.save_model(t.fitted, path)
    loaded, _ = model.load_model(t.spark, path)
    again = model.score_batch(loaded, t.summary).toDF(*GAME_KEY, "rate_again", "score_again")
    both = join_null_safe(model.score_batch(t.fitted, t.summary), again, GAME_KEY)
    return both.select(*GAME_KEY, ((F.col("predicted_csw_rate") == F.col("rate_again")) & (F.col("stuff_score") == F.col("score_again"))).alias("agrees"))


@query
def top_features(t):
    """The three features shown are the largest in size, in order, each with its own value and direction."""
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURES]), F.col("contributions"))
    sizes = F.sort_array(F.transform("contributions", F.abs), asc=False)
    both = join_null_safe(attribution.attributions(t.fitted, t.summary).select(*GAME_KEY, "top_features"), t.contributions.select(*GAME_KEY, "contributions"), GAME_KEY)
    shown = both.withColumns({"named": named, "sizes": sizes})
    in_order = F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: _near(F.abs(F.element_at("named", F.get("top_features", i)["feature"])), F.get("sizes", i), 1e-9))
    own = F.forall("top_features", lambda e: _near(e["contribution"], F.element_at("named", e["feature"]), 6e-6))
    signs = F.forall("top_features", lambda e: e["direction"] == rules.direction(F.element_at("named", e["feature"])))
    return shown.select(*GAME_KEY, in_order.alias("largest_in_order"), own.alias("own_values"), signs.alias("signs_agree"))


@query
def attribution_means(t):
    """The summary of a feature is the mean size of its stored contributions."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in FEATURES]).alias("feature"), F.col("contributions").alias("value"))
    means = t.contributions.select(F.inline(pairs)).toDF("feature", "value").groupBy("feature").agg(F.avg(F.abs("value")).alias("mean"))
    told = attribution.attribution_summary(t.fitted, t.summary)
    return told.join(means, "feature").select("feature", _near(F.col("mean_abs_contribution"), F.col("mean")).alias("agrees"))


@query
def importance_counts(t):
    """Importance is the number of splits of a feature, the most used first; together they are all splits."""
    told = attribution.feature_importance(t.tree_nodes)
    inner = t.tree_nodes.filter("leftChild >= 0")
    split_on = inner.groupBy("feature").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "n"))).alias("counts"))
    places = F.array(*[F.lit(c) for c in FEATURES])
    counted = F.forall("told", lambda e: e["importance"] == F.element_at("counts", (F.array_position(places, e["feature"]) - 1).cast("int")))
    falling = F.forall(F.sequence(F.lit(1), F.size("told") - 1), lambda i: F.get("told", i)["importance"] <= F.get("told", i - 1)["importance"])
    total = F.aggregate("told", F.lit(0).cast("bigint"), lambda a, e: a + e["importance"])
    return told.agg(F.collect_list(F.struct("feature", "importance")).alias("told")).withColumn("counts", split_on.scalar()).select(
        counted.alias("own_counts"), falling.alias("in_order"), (total == inner.agg(F.count("*")).scalar()).alias("all_splits"))
