"""Boosted-tree model of a pitcher's CSW rate on Spark ML."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks.constants import FEATURES, GAME_KEY, TARGET
from moundworks.functions import rules
from moundworks.functions.numeric import rnd
from moundworks.operators.boosting import Boosting
from moundworks.operators.ordering import BLOCK_ROWS, ordered_index, trailing_frame
from moundworks.operators.selection import exact_medians
from moundworks.sources.store import durable

# --- fixed values: settings of the boosted trees ------------------------------
PARAMS = {
    "maxIter": 400, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.7", "minInstancesPerNode": 5, "seed": 42, "lossType": "squared",
    "checkpointInterval": 10,
}
FOLDS = 5
EARLY_STOP = 30
# ------------------------------------------------------------------------------

#: Rows of a boosting task below which starting it costs more than its work.
TASK_ROWS = 5_000

HISTORY = ["rolling_30d_csw_rate", "rolling_30d_whiff_rate", "rolling_30d_avg_velo"]
SAME_GAME = ["avg_spin", "avg_h_break", "avg_v_break", "stuff_diversity", "zone_rate", "chase_rate",
             "barrel_rate_allowed", "avg_xwoba_allowed", "total_pitches", "velo_vs_30d_avg", "whiff_rate_delta"]


def lag_features(summary: DataFrame, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """Replace what is only known after the game by the previous start's value."""

    def columns(w):
        return {c: F.lag(c).over(w) for c in SAME_GAME}

    return trailing_frame(summary, ["pitcher_id"], ["game_date", "game_pk"], 1, columns, block_rows, stored)


def training_rows(summary: DataFrame, lagged: bool = False, stored: bool = False) -> DataFrame:
    """Rows with a target and full history, features and target as doubles."""
    rows = lag_features(summary, stored=stored) if lagged else summary
    doubles = [F.col(c).cast("double").alias(c) for c in [*FEATURES, TARGET]]
    return rows.na.drop(subset=[*HISTORY, TARGET]).select(*GAME_KEY, *doubles)


def feature_medians(rows: DataFrame) -> DataFrame:
    """Exact median of each feature, in one row; see ``selection`` for its bounded aggregates."""
    medians = exact_medians(rows, FEATURES)
    one = rows.sparkSession.createDataFrame([tuple(medians[c] for c in FEATURES)], ", ".join(f"{c} double" for c in FEATURES))
    return one.select(*[rnd(F.col(c), 6).alias(c) for c in FEATURES])


def feature_matrix(rows: DataFrame) -> DataFrame:
    """Features with nulls filled by the exact median, and the target."""
    medians = feature_medians(rows).first().asDict()
    return rows.na.fill({k: v for k, v in medians.items() if v is not None})


def time_series_folds(rows: DataFrame, n: int = FOLDS, by_date: bool = False, stored: bool = False) -> DataFrame:
    """Mark each row with the fold that validates on it.

    Rows in time order are cut into n + 1 parts; the n last ones have equal size
    and are the validation parts 1..n, the first one is 0. Fold t trains on all
    rows with ``val_fold < t``, so no row is copied. With ``by_date`` whole days
    are cut instead of rows. ``stored`` says that ``rows`` reads files.
    """
    if by_date:
        # one row per calendar day
        days = rows.groupBy("game_date").agg(F.count("*").alias("_rows"))
        w = Window.orderBy("game_date")
        numbered = days.withColumn("row_idx", (F.row_number().over(w) - 1).cast("bigint")).drop("_rows")
        size, unit = numbered.count(), numbered
    else:
        unit = ordered_index(rows, ["game_date", "pitcher_id", "game_pk"], stored=stored)
        size = rows.count()
    part = size // (n + 1)
    start = size - n * part
    fold = F.when(F.col("row_idx") >= start, F.floor((F.col("row_idx") - start) / max(part, 1)) + 1).otherwise(0)
    marked = unit.withColumn("val_fold", fold.cast("int"))
    return rows.join(F.broadcast(marked), "game_date") if by_date else marked


def fold_ranges(folds: DataFrame) -> DataFrame:
    """Sizes and dates of each fold, from one count per part."""
    parts = folds.groupBy("val_fold").agg(
        F.count("*").alias("n_val"), F.min("game_date").alias("val_start"), F.max("game_date").alias("val_end")
    )
    earlier = Window.orderBy("val_fold").rowsBetween(Window.unboundedPreceding, -1)  # six rows
    return (
        parts.withColumn("n_train", F.sum("n_val").over(earlier))
        .filter("val_fold > 0")
        .select(F.col("val_fold").alias("fold"), "n_train", "n_val", "val_start", "val_end")
    )


def _prepare(rows: DataFrame) -> PipelineModel:
    """Fill missing features with the exact medians of ``rows``, and assemble the vector."""
    medians = feature_medians(rows).first().asDict()
    filled = ", ".join(f"coalesce(double({c}), {float(medians[c] or 0.0)!r}D) AS {c}_f" for c in FEATURES)
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_f" for c in FEATURES], outputCol="features"),
    ])


def _trees(params: dict) -> Boosting:
    # Spark's boosting adds to the lineage every round; with a shared folder set, as ``durable``
    # has done for the vectors, Spark cuts it every ``checkpointInterval`` rounds
    return Boosting(GBTRegressor(featuresCol="features", labelCol=TARGET, predictionCol="prediction", **params))


def _vectors(prepared: PipelineModel, rows: DataFrame) -> DataFrame:
    """Features and target, written once: every round of boosting reads them several times.

    A level of a tree waits for its slowest task, so rows are spread evenly over as many
    files as there are cores, whatever the shuffle's partitions; one file more would be a second
    wave in every level of every round. Fewer files where a task would get few rows.
    ``rows`` should be a stored table, as it is counted.
    """
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return durable(prepared.transform(rows).select("features", TARGET).repartition(max(tasks, 1)))


def train(rows: DataFrame, params: dict | None = None) -> PipelineModel:
    """Fit on all rows. The medians stay in the model, so scoring fills nulls
    exactly as training did."""
    prepared = _prepare(rows)
    trees = _trees({**PARAMS, **(params or {})}).fit(_vectors(prepared, rows))
    return PipelineModel([*prepared.stages, trees])


def best_round(errors: list[float], patience: int) -> int:
    """Rounds to keep: those up to the lowest error that ``patience`` further
    rounds did not beat."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        if k - best >= patience:
            break
    return best + 1


def fold_metrics(training: DataFrame, validation: DataFrame, params: dict = PARAMS, patience: int = EARLY_STOP) -> dict:
    """rmse, mae, r2 and rounds of a fit that stops early on the validation rows.

    The errors of all rounds come from one fit: its first k trees are the model of k
    rounds, and Spark evaluates each. Stopping needs ``patience`` rounds past the best
    one. A first portion of three times that has them on small tables; if it does not, the
    table is one whose error keeps falling, and all ``maxIter`` rounds are fitted at
    once, as every longer portion would begin again. No validation row leaves the executors.
    """
    prepared = _prepare(training)
    x, x_val = _vectors(prepared, training), _vectors(prepared, validation)
    fitted = min(params["maxIter"], 3 * patience)
    while True:
        model = _trees({**params, "maxIter": fitted}).fit(x)
        squared = model.evaluateEachIteration(x_val, "squared")
        rounds = best_round(squared, patience)
        if rounds + patience <= fitted or fitted == params["maxIter"]:
            break
        fitted = params["maxIter"]
    spread = x_val.agg(F.var_pop(TARGET)).first()[0]
    mse, mae = squared[rounds - 1], model.evaluateEachIteration(x_val, "absolute")[rounds - 1]
    return {"rmse": mse**0.5, "mae": mae, "r2": 1 - mse / spread if spread else None, "rounds": rounds}


def cv_metrics(folds: DataFrame, params: dict | None = None, patience: int = EARLY_STOP) -> DataFrame:
    """RMSE, MAE and R2 of each expanding fold; a distributed fit for each.

    The folds are fitted side by side: a fit is a long row of short jobs, which
    leave most of a cluster idle one by one. ``folds`` should be a stored table, as
    every fold reads it.
    """
    settings = {**PARAMS, **(params or {})}

    def measured(fold: int) -> tuple:
        m = fold_metrics(folds.filter(F.col("val_fold") < fold), folds.filter(F.col("val_fold") == fold), settings, patience)
        return fold, m["rmse"], m["mae"], m["r2"], m["rounds"]

    with ThreadPoolExecutor(FOLDS) as pool:
        found = list(pool.map(inheritable_thread_target(folds.sparkSession)(measured), range(1, FOLDS + 1)))
    metrics = folds.sparkSession.createDataFrame(found, "fold int, rmse double, mae double, r2 double, rounds int").select(
        "fold", rnd(F.col("rmse"), 5).alias("rmse"), rnd(F.col("mae"), 5).alias("mae"), rnd(F.col("r2"), 4).alias("r2"), "rounds")
    return fold_ranges(folds).join(F.broadcast(metrics), "fold")


def cv_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(rnd(F.avg("rmse"), 5).alias("avg_rmse"), rnd(F.avg("mae"), 5).alias("avg_mae"),
                       rnd(F.avg("r2"), 4).alias("avg_r2"))


def score_batch(model: PipelineModel, rows: DataFrame, keep: list[str] = GAME_KEY) -> DataFrame:
    """Predicted CSW rate (4 digits) and stuff score of each row."""
    doubles = rows.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return model.transform(doubles).select(
        *keep,
        rnd(F.col("prediction"), 4).alias("predicted_csw_rate"),
        rules.stuff_score(F.col("prediction")).alias("stuff_score"),
    )


def save_model(model: PipelineModel, path: str, metadata: DataFrame | None = None) -> None:
    """Model, feature list, target and training metadata below one path."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(FEATURES, TARGET)], "feature_cols array<string>, target string") \
        .write.mode("overwrite").json(f"{path}/columns")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    columns = spark.read.json(f"{path}/columns").first()
    return PipelineModel.load(f"{path}/pipeline"), list(columns["feature_cols"])


def training_metadata(rows: DataFrame, metrics: DataFrame, importance: DataFrame,
                      attribution: DataFrame) -> DataFrame:
    """One row: training size and dates, fold metrics and their means, importances, mean
    attributions. The nested lists have one entry per fold or feature; ``metrics`` is
    a stored ``cv_metrics``."""
    facts = rows.agg(F.count("*").alias("n_training_rows"),
                     F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"))

    def listed(df: DataFrame) -> DataFrame:
        return df.agg(F.collect_list(F.struct(*df.columns)))

    return facts.select(
        "*",
        listed(metrics).scalar().alias("cv_results"),
        cv_summary(metrics).select(F.struct("*")).scalar().alias("cv_summary"),
        listed(importance).scalar().alias("feature_importance"),
        listed(attribution).scalar().alias("attribution_summary"),
    )


def model_facts(nodes: DataFrame) -> DataFrame:
    """Size and weight of each tree, from the model's nodes (``attribution.tree_nodes``)."""
    inner = F.col("leftChild") >= 0
    return nodes.groupBy("tree").agg(F.first("weights").alias("weight"), F.count("*").alias("nodes"), F.count_if(inner).alias("splits"))
