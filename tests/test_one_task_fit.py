"""The fit in one task against Spark's own fit of the same rows."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from moundworks.constants import TARGET
from moundworks.operators import attribution, boosting, model
from moundworks.sources.store import drop_paths, durable, scratch_path

SETTINGS = {**model.PARAMS, "maxIter": 7}


def rows(spark, n, parts, label="round(0.3 + 0.1 * a - 0.05 * b * c + 0.02 * d * rand(9), 3)"):
    """Rows whose features have holes of zeros, few values, one value and many values."""
    table = spark.range(n, numPartitions=parts).select(
        F.rand(1).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b"), (F.randn(3) * (F.rand(4) > 0.4).cast("double")).alias("c"),
        F.rand(5).alias("d"), F.lit(1.5).alias("e"))
    table = table.withColumn(TARGET, F.expr(label).cast("double"))
    return durable(VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(table).select("features", TARGET))


def trees_of(spark, fitted):
    path = scratch_path(spark, "compared")
    fitted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    return [r.asDict(recursive=True) for r in nodes], fitted.treeWeights


def own(params):
    return GBTRegressor(featuresCol="features", labelCol=TARGET, predictionCol="prediction", **params)


@pytest.mark.parametrize("n, parts, settings, label", [
    (3_000, 1, {}, None), (2_000, 3, {"subsamplingRate": 1.0}, None), (12, 1, {}, None), (1, 1, {}, None),
    (400, 2, {"featureSubsetStrategy": "1.0", "maxDepth": 6, "minInstancesPerNode": 1}, "round(a, 1)"), (300, 2, {}, "0.25"),
    (15_000, 3, {"maxIter": 3}, None), (40_000, 2, {"maxIter": 3, "seed": -7}, None),
])
def test_trees_are_those_of_sparks_fit(spark, n, parts, settings, label):
    x, params = rows(spark, n, parts, *[label] * bool(label)), {**SETTINGS, **settings}
    assert x.rdd.getNumPartitions() == parts
    want, weights = trees_of(spark, own(params).fit(x))
    fitted = boosting.Boosting(own(params)).fit(x)
    got, got_weights = trees_of(spark, fitted)
    assert got_weights == weights and len(got) == len(want)
    for a, b in zip(got, want):
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == (pytest.approx(b[k], rel=1e-9, abs=1e-12) if k in ("prediction", "impurity", "gain", "impurityStats") else b[k]), (k, a, b)
    assert fitted.numFeatures == 5 and fitted.getNumTrees == params["maxIter"]
    assert {p.name: v for p, v in fitted.extractParamMap().items()} == {p.name: v for p, v in own(params).extractParamMap().items()}


def test_a_fit_takes_few_jobs(spark):
    """Spark's own fit of 40 trees of depth 4 takes 160 jobs and more."""
    x, sc = rows(spark, 500, 1), spark.sparkContext
    sc.setJobGroup("a fit", "a fit")
    try:
        model._trees({**model.PARAMS, "maxIter": 40}).fit(x)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("a fit")) <= 20


def test_nodes_are_read_where_the_fit_wrote_them(spark, monkeypatch):
    fitted = boosting.Boosting(own(SETTINGS)).fit(rows(spark, 300, 1))
    whole, saved = PipelineModel([fitted]), []
    write = fitted.write
    monkeypatch.setattr(fitted, "write", lambda: saved.append(True) or write())
    first = attribution.tree_nodes(whole).orderBy("tree", "id").collect()
    assert len(first) > 7 and not saved
    drop_paths(spark, [fitted.saved_at])
    assert attribution.tree_nodes(whole).orderBy("tree", "id").collect() == first and saved


@pytest.mark.parametrize("settings, most", [({}, 499), ({"lossType": "absolute"}, 500), ({"minInfoGain": 0.1}, 500), ({"featureSubsetStrategy": "sqrt"}, 500)])
def test_larger_tables_and_other_settings_go_to_sparks_fit(spark, monkeypatch, settings, most):
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", most)
    trees = own({**SETTINGS, **settings})
    monkeypatch.setattr(trees, "fit", lambda x: "spark's")
    assert boosting.Boosting(trees).fit(rows(spark, 500, 1)) == "spark's"


@pytest.mark.parametrize("label", ["if(a > 0.5, NULL, a)", "if(a > 0.5, double('NaN'), a)"])
def test_rows_that_spark_refuses_are_refused(spark, label):
    with pytest.raises(Exception, match="(?i)label"):
        model._trees({**SETTINGS, "maxIter": 2}).fit(rows(spark, 50, 1, label))


def test_threads_ship_the_package_once(monkeypatch):
    from moundworks.sources import store

    shipped = []
    context = SimpleNamespace(applicationId="threads", addPyFile=lambda path: time.sleep(0.05) or shipped.append(path))
    monkeypatch.setattr(store, "_SHIPPED", set())
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(store.ship_package, [SimpleNamespace(sparkContext=context)] * 5))
    assert len(shipped) == 1
