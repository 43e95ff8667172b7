import pytest
from pyspark.sql import functions as F

from moundworks.sources import store, versions


def rows(spark, ids, value):
    return spark.createDataFrame([(i, f"k{i}", value) for i in ids], "id int, name string, value string")


def newest(old, new):
    return old.join(new, "id", "left_anti").unionByName(new)


def listing(spark, path):
    return {b: f for b, f in versions.current(spark, path).folders.items()}


@pytest.fixture
def path(spark):
    return store.scratch_path(spark, "versioned")


def test_a_one_row_upsert_rewrites_one_bucket(spark, path):
    versions.replace(rows(spark, range(500), "old"), path, ["id"], 16)
    before = listing(spark, path)
    assert len(before) == 16
    versions.upsert(rows(spark, [7], "new"), path, newest)
    after = listing(spark, path)
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.id: r.value for r in versions.read(spark, path).collect()}
    assert got == {**{i: "old" for i in range(500)}, 7: "new"}
    assert [r.value for r in versions.read_key(spark, path, {"id": 7}).collect()] == ["new"]
    assert versions.read_key(spark, path, {"id": 9999}).count() == 0


def test_readers_keep_their_version(spark, path):
    versions.replace(rows(spark, [1, 2], "old"), path)
    reader = versions.read(spark, path)
    versions.replace(rows(spark, [3], "new"), path)
    assert reader.count() == 2 and versions.read(spark, path).count() == 1 and versions.read(spark, path, 1).count() == 2
    assert versions.vacuum(spark, path) == 1 and versions.read(spark, path).count() == 1
    assert versions.current(spark, path, 1) is None


def test_an_upsert_that_stops_leaves_the_old_rows(spark, path, monkeypatch):
    versions.replace(rows(spark, range(20), "old"), path, ["id"], 4)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        versions.upsert(rows(spark, range(10, 30), "new"), path, newest)
    monkeypatch.undo()
    assert {r.value for r in versions.read(spark, path).collect()} == {"old"}
    assert versions.vacuum(spark, path) == 4  # what the stopped call wrote
    versions.upsert(rows(spark, range(10, 30), "new"), path, newest)
    assert versions.read(spark, path).groupBy("value").count().orderBy("value").collect() == [("new", 20), ("old", 10)]


def test_two_writers(spark, path):
    versions.replace(rows(spark, [1], "old"), path, ["id"], 4)

    def meanwhile(old, new):
        versions.replace(rows(spark, [1], "first"), path, ["id"], 4)
        return newest(old, new)

    with pytest.raises(versions.Conflict):
        versions.upsert(rows(spark, [1], "second"), path, meanwhile)
    assert [r.value for r in versions.read(spark, path).collect()] == ["first"]


def test_nulls_empty_tables_and_batches(spark, path):
    versions.replace(rows(spark, [], "x"), path, ["id", "name"], 4)
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path).columns == ["id", "name", "value"]
    assert versions.upsert(rows(spark, [], "x"), path, newest) == 1
    odd = spark.createDataFrame([(None, None, "n"), (1, None, "m")], "id int, name string, value string")
    versions.upsert(odd, path, lambda old, new: old.unionByName(new))
    assert [r.value for r in versions.read_key(spark, path, {"id": None, "name": None}).collect()] == ["n"]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, store.scratch_path(spark, "nothing"))
    with pytest.raises(ValueError):
        other = store.scratch_path(spark, "plain")
        versions.replace(odd, other)
        versions.upsert(odd, other, newest)
    assert odd.filter(F.col("id").isNull()).count() == 1
