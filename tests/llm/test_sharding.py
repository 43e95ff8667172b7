import zlib

from pyspark.sql import functions as F

from moundworks.llm import sharding


def jump(key, shards):
    key &= 2**64 - 1
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * sharding.MULTIPLIER + sharding.INCREMENT) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_against_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 42, 123456789012345] + list(range(10, 200))
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 8, 9, 100):
        found = rows.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
        assert [(r.k, r.s) for r in found] == [(k, jump(k, shards)) for k in keys]


def check(rows, shards=8):
    found = sharding.shard_rows(rows, shards).collect()
    want = sorted(repr((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in rows.collect())
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in found) == want
    for s in range(shards):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, shards) and r.law == "key" for r in found)
    assert len({(r.doc_id, r.shard) for r in found}) == len({r.doc_id for r in found})
    return found


def test_documents(docs):
    found = check(docs)
    assert len({r.shard for r in found}) == 8
    moved = sum(r.grown_shard != r.shard for r in found)
    assert 0 < moved < 0.25 * len(found)


def test_odd_rows(odd, none):
    check(odd)
    check(odd.union(odd))
    assert check(none) == []


def test_plan_is_native(docs):
    plan = sharding.shard_rows(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
