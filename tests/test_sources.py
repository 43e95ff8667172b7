import json
from datetime import date

import pytest
from frames import by, day
from pyspark.sql import functions as F

from moundworks.sources import bronze, insights, store, versions


def raw(spark, days, per_day=3):
    rows = [(1 + d, str(day(d)), k, f"{100 + k}") for d in days for k in range(per_day)]
    return spark.createDataFrame(rows, "game_pk int, game_date string, inning int, pitcher string")


def test_landing_skips_landed_days(spark):
    out = store.scratch_path(spark, "bronze")
    first = bronze.land(spark, raw(spark, [0, 1]), out)
    assert first.count() == 6
    second = bronze.land(spark, raw(spark, [1, 2], per_day=5), out)
    counts = {r.game_date: r["count"] for r in second.groupBy("game_date").count().collect()}
    assert counts == {day(0): 3, day(1): 3, day(2): 5}  # day 1 kept its first landing


def test_landing_keeps_the_range_and_ids(spark):
    out = store.scratch_path(spark, "bronze")
    got = bronze.land(spark, raw(spark, range(5)), out, day(1), day(3))
    assert sorted({r.game_date for r in got.collect()}) == [day(1), day(2), day(3)]
    ids = sorted(r.pitch_id for r in got.filter(F.col("game_date") == F.lit(day(2))).collect())
    assert ids == ["3_2024-06-03_0", "3_2024-06-03_1", "3_2024-06-03_2"]


def test_landing_nothing(spark):
    out = store.scratch_path(spark, "bronze")
    assert bronze.land(spark, raw(spark, [0]), out, date(1999, 1, 1), date(1999, 1, 2)).count() == 0


def test_since_prunes_partitions(spark):
    out = store.scratch_path(spark, "bronze")
    bronze.land(spark, raw(spark, range(4)), out)
    df = bronze.read_bronze(spark, out, since=day(2))
    assert df.count() == 6
    assert "PartitionFilters: [isnotnull(game_date" in df._jdf.queryExecution().executedPlan().toString()


def test_pitch_key_is_independent_of_row_order(spark):
    df = bronze.conform(raw(spark, [0, 1]))
    shuffled = df.orderBy(F.col("inning").desc())
    key = {(r.game_pk, r.inning): r.pitch_id for r in bronze.add_pitch_key(df).collect()}
    assert key == {(r.game_pk, r.inning): r.pitch_id for r in bronze.add_pitch_key(shuffled).collect()}


def test_undated_rows_are_set_aside_and_none_is_lost(spark, tmp_path):
    out = f"{tmp_path}/bronze"
    dated, later = raw(spark, [0]), raw(spark, [1])
    lost = dated.withColumn("game_date", F.lit(None).cast(dated.schema["game_date"].dataType))
    for batch in (dated.union(lost), lost, later.union(lost.union(lost))):
        bronze.land(spark, batch, out)
    assert bronze.read_bronze(spark, out).count() == dated.count() + later.count()
    assert bronze.undated(spark, out).count() == 2 * lost.count()


def folders(path):
    import os
    return sorted(n for n in os.listdir(path) if n[0] not in "_.")


def test_a_landing_that_stopped_is_done_again(spark, tmp_path, monkeypatch):
    out, lost = f"{tmp_path}/bronze", raw(spark, [0], per_day=2).withColumn("game_date", F.lit(None).cast("string"))
    bronze.land(spark, raw(spark, [0]), out)
    whole = raw(spark, [0, 1, 2], per_day=5).unionByName(lost)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(bronze, "commit_days", stop)
    with pytest.raises(KeyboardInterrupt):
        bronze.land(spark, whole, out)
    monkeypatch.undo()
    half = spark.read.parquet(f"{out}/game_date={day(2)}").limit(1).persist()
    assert half.count() == 1
    half.write.mode("overwrite").parquet(f"{out}/game_date={day(2)}")  # as if only a part had been copied
    assert len(folders(out)) == 3 and {r.game_date for r in bronze.landed_days(spark, out).collect()} == {day(0)}
    got = bronze.land(spark, whole, out)
    counts = {r.game_date: r["count"] for r in got.groupBy("game_date").count().collect()}
    assert counts == {day(0): 3, day(1): 5, day(2): 5}
    assert bronze.undated(spark, out).count() == 2
    assert bronze.damaged_days(spark, out).count() == 0


def test_days_that_lost_rows_are_found_and_landed_again(spark, tmp_path):
    out = f"{tmp_path}/bronze"
    bronze.land(spark, raw(spark, [0, 1, 2]), out)
    spark.createDataFrame([], "inning int").write.mode("overwrite").parquet(f"{out}/game_date={day(1)}")
    damaged = bronze.damaged_days(spark, out)
    assert [(r.game_date, r.n_rows, r.n_found) for r in damaged.collect()] == [(day(1), 3, 0)]
    bronze.forget_days(spark, out, damaged)
    bronze.land(spark, raw(spark, [0, 1, 2], per_day=4), out)
    counts = {r.game_date: r["count"] for r in bronze.read_bronze(spark, out).groupBy("game_date").count().collect()}
    assert counts == {day(0): 3, day(1): 4, day(2): 3} and bronze.damaged_days(spark, out).count() == 0


def test_landing_leaves_nothing_outside_its_folder(spark, tmp_path):
    out = f"{tmp_path}/bronze"
    bronze.land(spark, raw(spark, [0]), out)
    import os
    assert os.listdir(tmp_path) == ["bronze"] and bronze.undated(spark, out) is None


def test_exact_copies(spark):
    df = bronze.conform(raw(spark, [0]))
    assert bronze.add_pitch_key(df.unionByName(df)).select("pitch_id").distinct().count() == 6
    assert bronze.add_pitch_key(df.unionByName(df), drop_exact_duplicates=True).count() == 3


def test_csv_is_read_with_the_feed_schema(spark):
    from moundworks.sources.schemas import FEED_COLUMNS
    path = store.scratch_path(spark, "csv")
    bronze.select_available(raw(spark, [0])).write.option("header", True).csv(path)
    got = bronze.read_raw(spark, path, "csv")
    assert [c for c, _ in FEED_COLUMNS] == got.columns
    assert got.schema["game_date"].dataType.simpleString() == "date" and got.count() == 3


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"pitcher_id": 1, "pitcher_name": "A B", "game_pk": 7, "game_date": "2024-06-01",
             "performance_tier": "elite", "headline": "h", "key_finding": "k", "concern_flag": None,
             "pitch_mix_note": None}]
    f = tmp_path / "a.json"
    f.write_text(json.dumps(rows, indent=2))
    array = insights.read_insights(spark, str(f), json_array=True)
    assert array.first().game_date == date(2024, 6, 1)
    path = store.scratch_path(spark, "json")
    store.write_json(array, path)
    assert insights.read_insights(spark, path).collect() == array.collect()


def test_parse_response(spark):
    texts = ['{"headline": "h", "performance_tier": "elite", "concern_flag": null}', "Here is my analysis: great",
             '{"headline": "cut', '  {"headline": "x"}  ', "[1, 2]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, response string")
    got = by(insights.parse_response(df), "n")
    assert (got[0].headline, got[0].performance_tier, got[0].error) == ("h", "elite", None)
    assert (got[1].error, got[1].raw, got[1].headline) == ("json_parse_failed", "Here is my analysis: great", None)
    assert got[2].error == got[4].error == got[5].error == "json_parse_failed"
    assert got[3].headline == "x" and got[3].error is None


def table(spark, rows):
    return spark.createDataFrame(rows, "pitcher_id int, game_pk int, insight_type string, insight_json string, "
                                       "generated_at string")


def test_upsert_replaces_by_key(spark):
    old = table(spark, [(1, 1, "a", "old", "2024-01-02"), (2, 1, "a", "keep", "2024-01-01")])
    new = table(spark, [(1, 1, "a", "new", "2024-01-01"), (3, 1, "a", "add", "2024-01-01"),
                        (3, 1, "a", "later", "2024-01-03")])
    want = {1: "new", 2: "keep", 3: "later"}
    assert {r.pitcher_id: r.insight_json for r in insights.upsert(old, new).collect()} == want
    path = store.scratch_path(spark, "insights")
    insights.create_table(old, path)
    insights.upsert_path(spark, path, new)
    assert {r.pitcher_id: r.insight_json for r in versions.read(spark, path).collect()} == want


def test_a_swap_cut_off_in_between_is_undone(spark):
    path = store.scratch_path(spark, "swap")
    store.write_table(spark.range(3), path)
    fs, where = store._file_system(spark, path)
    fs.rename(where, store._file_system(spark, store._aside(path))[1])
    assert store.recover_path(spark, path) and spark.read.parquet(path).count() == 3
    fresh = store.scratch_path(spark, "fresh")
    store.write_table(spark.range(7), fresh)
    store.replace_path(spark, fresh, path)
    assert spark.read.parquet(path).count() == 7


def test_view_and_table(spark):
    df = spark.range(3)
    store.register(df, "some_batch")
    assert spark.sql("SELECT count(*) AS n FROM some_batch").first().n == 3


def test_release_drops_only_intermediate_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "_INTERMEDIATE", {"another application": ["/not/ours"]})
    kept = f"{tmp_path}/kept"
    store.write_table(spark.range(3), kept)
    table = store.durable(spark.range(4))
    path = store._INTERMEDIATE[spark.sparkContext.applicationId][0]
    assert table.count() == 4 and store.release(spark) == 1 and store.release(spark) == 0
    assert spark.read.parquet(kept).count() == 3 and list(store._INTERMEDIATE) == ["another application"]
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_replace_catalog_table(spark):
    for n in (2, 5):
        store.save_as_table(spark.range(n), "moundworks_test_table")
        assert spark.table("moundworks_test_table").count() == n
    spark.sql("DROP TABLE moundworks_test_table")


def test_load_time_is_optional(spark):
    from moundworks.operators.silver import clean_pitches
    df = bronze.add_pitch_key(bronze.conform(raw(spark, [0])))
    assert "loaded_at" not in clean_pitches(df).columns
    assert clean_pitches(df, loaded_at=True).filter("loaded_at IS NULL").count() == 0


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        store.shared_dir(Session())


def test_a_large_game_is_cut_into_slices(spark):
    """Positions of a game that holds all rows: no window takes a whole game, and nothing is lost."""
    rows = spark.range(3000).selectExpr("7 AS game_pk", "CAST(NULL AS DATE) AS game_date", "CAST(id % 1000 AS INT) AS inning")
    keyed = bronze.add_pitch_key(rows)
    assert "_slice" in keyed._jdf.queryExecution().toString()
    found = sorted((int(r.pitch_id.split("_")[-1]), r.inning) for r in keyed.collect())
    assert [p for p, _ in found] == list(range(3000)) and [i for _, i in found] == sorted(i for _, i in found)


def test_intermediates_of_a_block_are_named_and_dropped(spark, tmp_path):
    outside = store.durable(spark.range(3))
    with store.intermediates(spark) as made:
        inside = store.durable(spark.range(5))
    assert [f"file:{p}".replace("file:file:", "file:") for p in made] == [inside.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "file:")]
    assert store.drop_paths(spark, made) == 1
    assert outside.count() == 3 and not store._file_system(spark, made[0])[0].exists(store._file_system(spark, made[0])[1])
    assert store.drop_paths(spark, made) == 1  # dropping again does no harm
