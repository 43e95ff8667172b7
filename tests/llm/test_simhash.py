import brute
import numpy as np
from pyspark.sql import functions as F

from moundworks.llm import simhash


def check(rows):
    found = simhash.near_duplicates(rows).collect()
    plain = [(r.doc_id, brute.fingerprint(r.text)) for r in rows.collect()]
    group = brute.linked([fp for _, fp in plain])
    low = {}
    for (key, _), g in zip(plain, group):
        if key is not None:
            low[g] = min(low.get(g, key), key)
    want = sorted(repr((key, f"{fp:016x}", low.get(g))) for (key, fp), g in zip(plain, group))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in found) == want


def test_documents(docs):
    check(docs.select("doc_id", "text"))


def test_odd_rows(odd, none):
    check(odd)
    assert simhash.near_duplicates(none).count() == 0


def test_tiles_find_every_pair():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:100] ^ np.uint64(1 << 40), fps[:50] ^ np.uint64(5)]))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    found = {(int(a), int(b)) for i, j in simhash.tile_links(fps, 2, tile=16) for a, b in zip(i, j)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_large_groups_are_cut_without_loss(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base} | {base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 63, (300, 2))} | {int(x) for x in rng.integers(0, 2**62, 200)})
    rows = spark.createDataFrame([(x,) for x in fps], "fp bigint")

    def groups(**settings):
        root = {r.node: r.root for r in simhash.components(simhash.links(rows, **settings)).collect()}
        return [root.get(x, x) for x in fps]

    want = groups()
    assert groups(group_rows=10, tile=8) == want
    number = brute.linked(fps)
    assert [want.index(x) for x in want] == [number.index(x) for x in number]


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a bigint, b bigint")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(1, 201)) and roots[501] == 500


def test_one_row_of_each_group_stays(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = {r.component_id if r.component_id is not None else r.fingerprint for r in simhash.near_duplicates(odd).collect()}
    assert kept.count() >= len(groups) - 1
    again = simhash.one_of_each(kept)
    assert again.count() == kept.count()
    assert kept.filter(F.col("doc_id") == 2).count() <= 1


def test_a_dense_group_holds_a_forest_only():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    i, j = simhash.group_links(fps, np.zeros(len(fps), dtype=np.int64), 2, 64)
    assert len(i) < len(fps)
    root = simhash.forest(i, j, len(fps))
    assert [root[k] == root[0] for k in range(len(fps))] == [g == 0 for g in brute.linked([int(x) for x in fps])]
