"""Additive feature attributions of the boosted trees.

Shapley values of a tree under its training weights (Lundberg et al.): a leaf
with path features F is worth ``value`` times, per feature, either "does the row
pass the path's tests" (feature known) or "share of training weight that does"
(feature unknown). A path of depth d tests at most d features, so a row meets a
leaf in one of at most 2^d patterns. The contributions of each pattern are computed once
for each leaf, as a sum over subset sizes; the tasks then find a row's pattern for all
leaves at once and look its contributions up.
"""

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.constants import FEATURES, GAME_KEY
from moundworks.functions import rules
from moundworks.functions.numeric import rnd
from moundworks.sources.store import exists, scratch_path, ship_package

ROWS_PER_STEP = 128


def tree_nodes(model: PipelineModel) -> DataFrame:
    """Nodes of all trees with their tree's weight, from the saved model. A model that was
    read from files is not saved again while they are there."""
    trees = model.stages[-1]
    spark = SparkSession.active()
    path = getattr(trees, "saved_at", None)
    if path is None or not exists(spark, path):
        path = scratch_path(spark, "trees")
        trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "settings", "weights").drop("settings")
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), "weights", "id", "prediction", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"),
    )


def leaf_paths(nodes: list) -> list[tuple[float, dict[int, list[float]]]]:
    """Leaves as (weighted value, feature -> [low, high, weight share]).

    ``nodes`` are the rows of ``tree_nodes``: the model, at most 2^(depth+1)
    per tree, whatever the size of the data.
    """
    by_tree: dict[int, dict[int, object]] = {}
    for n in nodes:
        by_tree.setdefault(n.tree, {})[n.id] = n
    leaves = []
    for tree in by_tree.values():
        stack = [(tree[0], {})]
        while stack:
            node, path = stack.pop()
            if node.leftChild < 0:
                leaves.append((node.prediction * node.weights, path))
                continue
            left, right = tree[node.leftChild], tree[node.rightChild]
            weight = left.rawCount + right.rawCount
            low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            stack.append((left, {**path, node.feature: (
                low, min(high, node.threshold), share * left.rawCount / weight)}))
            stack.append((right, {**path, node.feature: (
                max(low, node.threshold), high, share * right.rawCount / weight)}))
    return leaves


def _worth(share: np.ndarray) -> np.ndarray:
    """Contribution of each path feature per unit of leaf value, for every pattern of passed tests.

    ``share`` is (leaves, m); the result (leaves, 2^m, m). Bit j of a pattern says
    whether the row passes the tests on feature j. What a feature adds, over all
    orders in which features become known, is a sum over the sizes of the subsets
    known before it.
    """
    m = share.shape[1]
    passes = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    out = np.empty((len(share), 1 << m, m))
    for i in range(m):
        sizes = [np.ones((len(share), 1 << m))]  # entry s: sum over the subsets of s other features
        for j in range(m):
            if j == i:
                continue
            grown = [np.zeros_like(sizes[0]) for _ in range(len(sizes) + 1)]
            for s, c in enumerate(sizes):
                grown[s] += c * share[:, None, j]
                grown[s + 1] += c * passes[:, j]
            sizes = grown
        weighted = sum(factorial(s) * factorial(m - s - 1) / factorial(m) * c for s, c in enumerate(sizes))
        out[:, :, i] = weighted * (passes[:, i] - share[:, None, i])
    return out


def _packed(leaves: list) -> list[tuple]:
    """For each tested feature: its cut values; for each place between two cuts the bit that
    each leaf's pattern of passed tests gets; the leaves that test it, and for each of them
    where in a table its patterns' contributions start. A path of depth d has at most 2^d patterns."""
    groups: dict[int, list] = {}
    for value, path in leaves:
        if path:
            groups.setdefault(len(path), []).append((value, path))
    if not groups:
        return []
    slots, tables, n = [], [], 0  # a slot is one feature of one leaf
    for size, members in groups.items():
        values = np.array([v for v, _ in members])
        feats = np.array([list(p) for _, p in members])
        low, high, share = (np.array([[p[f][k] for f in p] for _, p in members]) for k in range(3))
        worth = values[:, None, None] * _worth(share)
        number = np.arange(n, n + len(members))
        for j in range(size):
            same = np.ones_like(number)
            slots.append((number, feats[:, j], same << j, low[:, j], high[:, j], same << size))
            tables.append(worth[:, :, j].ravel())
        n += len(members)
    leaf, feature, bit, low, high, patterns = (np.concatenate(c) for c in zip(*slots))
    table, start = np.concatenate(tables), np.cumsum(patterns) - patterns
    packed = []
    for f in np.unique(feature):
        own = np.flatnonzero(feature == f)
        cuts = np.unique([low[own], high[own]])
        place = np.arange(len(cuts) + 1)[:, None]
        passes = (place > np.searchsorted(cuts, low[own])) & (place <= np.searchsorted(cuts, high[own]))
        bits = np.zeros((len(cuts) + 1, n), dtype=np.min_scalar_type(int(patterns.max()) - 1))
        bits[:, leaf[own]] = passes * bit[own]
        packed.append((f, cuts, bits, leaf[own], start[own][:, None], table))
    return packed


def base_value(leaves: list) -> float:
    """Mean prediction under the training weights."""
    return float(sum(v * np.prod([s for _, _, s in p.values()]) for v, p in leaves))


def shapley(x: np.ndarray, packed: list[tuple], width: int) -> np.ndarray:
    """Contributions of each feature for the rows of ``x``: a lookup by leaf and pattern.

    A value is placed among its feature's cuts once, for all leaves. Sums are plain ones: a
    matrix product would start threads of its own in every task.
    """
    out = np.zeros((len(x), width))
    if not packed:
        return out
    pattern = np.zeros((len(x), packed[0][2].shape[1]), dtype=packed[0][2].dtype)
    for f, cuts, bits, *_ in packed:
        pattern |= bits[np.searchsorted(cuts, x[:, f])]
    by_leaf = np.ascontiguousarray(pattern.T)
    for f, _, _, leaf, start, table in packed:
        out[:, f] = table.take(by_leaf[leaf] + start, mode="clip").sum(axis=0)
    return out


def contributions(model: PipelineModel, rows: DataFrame, keep: list[str] = GAME_KEY) -> DataFrame:
    """Per row the unrounded prediction, the base value and one contribution
    per feature; they add up to the prediction."""
    ship_package(rows.sparkSession)
    leaves = leaf_paths(tree_nodes(model).collect())
    packed, base, width = _packed(leaves), base_value(leaves), len(FEATURES)
    doubles = rows.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    scored = model.transform(doubles).select(*keep, "prediction", vector_to_array("features").alias("x"))
    fields = [f for f in scored.schema.fields if f.name != "x"]
    schema = T.StructType([*fields, T.StructField("contributions", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_STEP):
                part = batch.iloc[at:at + ROWS_PER_STEP]
                values = shapley(np.stack(part["x"].to_numpy()), packed, width)
                yield part.drop(columns="x").assign(contributions=list(values))

    return scored.mapInPandas(run, schema).withColumn("base_value", F.lit(base))


def attributions(model: PipelineModel, rows: DataFrame, top: int = 3, keep: list[str] = GAME_KEY) -> DataFrame:
    """The ``top`` features of each prediction by absolute contribution."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("feature"),
            F.col("contributions")[k].alias("value"),
        )
        for k, name in enumerate(FEATURES)
    ])
    # stable for equal sizes: the feature list's own order
    ranked = F.slice(F.array_sort(entries, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                                  .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0)), 1, top)
    shown = F.transform(ranked, lambda e: F.struct(
        e["feature"].alias("feature"),
        rnd(e["value"], 5).alias("contribution"),
        rules.direction(e["value"]).alias("direction"),
    ))
    return contributions(model, rows, keep).select(*keep, "base_value", "prediction", shown.alias("top_features"))


def attribution_summary(model: PipelineModel, rows: DataFrame, last: int | None = None) -> DataFrame:
    """Mean absolute contribution of each feature, over all given rows or over
    the ``last`` ones in time."""
    if last is not None:
        rows = rows.orderBy(F.col("game_date").desc_nulls_last(), "pitcher_id", "game_pk").limit(last)
    names = F.array(*[F.lit(n) for n in FEATURES])
    pairs = F.arrays_zip(names.alias("feature"), F.col("contributions").alias("value"))
    return (
        contributions(model, rows)
        .select(F.inline(pairs))
        .toDF("feature", "value")
        .groupBy("feature")
        .agg(rnd(F.avg(F.abs("value")), 8).alias("mean_abs_contribution"))
    )


def feature_importance(nodes: DataFrame) -> DataFrame:
    """How often each feature splits a node, most used first, from ``tree_nodes``."""
    names = F.array(*[F.lit(n) for n in FEATURES])
    return (
        nodes
        .filter("feature >= 0")
        .groupBy(F.element_at(names, F.col("feature") + 1).alias("feature"))
        .agg(F.count("*").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )
