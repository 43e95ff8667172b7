import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from moundworks.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fan_out=3):
    """Root, and for each leaf the (left, right) siblings of each level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            low = i - i % fan_out
            path.append(("".join(nodes[low:i]), "".join(nodes[i + 1:low + fan_out])))
        nodes = [sha("".join(nodes[i:i + fan_out])) for i in range(0, len(nodes), fan_out)]
        at = [i // fan_out for i in at]
    return nodes[0], paths


def leaf(row, changed=False):
    text = row.text.replace("\n", "") if changed and row.text is not None else row.text
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows, fan_out=3):
    """Every result row, from lists in memory."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    grown = []
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        grown.append((own, *tree([leaf(r) for r in own], fan_out)))
    root, tops = tree([subroot for _, subroot, _ in grown], fan_out) if grown else (None, [])
    out = []
    for (own, subroot, paths), top in zip(grown, tops):
        for r, path in zip(own, paths):
            folded = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0)
            for left, right in path + top:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((r.doc_id, leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(map(repr, out))


def audited(rows, **how):
    return sorted(repr(tuple(r)) for r in merkle.audited(rows, **how).collect())


@pytest.mark.parametrize("fan_out, depth", [(3, 5), (3, 1), (3, 2), (2, 2)])
def test_documents_over_one_tier_and_over_many(docs, fan_out, depth):
    found = audited(docs, fan_out=fan_out, depth=depth)
    assert found == plain(docs.collect(), fan_out)
    assert 0 < sum(r.endswith("True)") for r in found) < len(found)


@pytest.fixture(scope="module")
def rows(odd):
    """The odd rows with sources of one row, many rows and none."""
    source = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("doc_id") < 7, "ä").when(F.col("doc_id") < 9, "z").otherwise(F.concat(F.lit("s"), "doc_id"))
    return odd.select("doc_id", "text", "lang", source.alias("source"), F.length("text").alias("n_chars"),
                      F.lit(1).alias("tree"), F.lit(2).alias("pos"), F.lit(3).alias("hash"), F.lit(4).alias("block"), F.lit(5).alias("kids"))


@pytest.mark.parametrize("depth", [1, 5])
def test_odd_rows_repeats_and_clashing_names(rows, depth):
    assert audited(rows, depth=depth) == plain(rows.collect())
    many = rows.union(rows).union(rows.withColumn("source", F.lit("one")))
    assert audited(many, depth=depth) == plain(many.collect())


def test_trees_of_every_small_size(spark):
    sizes = list(range(1, 12)) + [26, 27, 28, 81, 82]
    rows = spark.createDataFrame([(k, f"a\nb{k}", None, f"n{n:02}", 1) for n in sizes for k in range(n)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for depth in (1, 3):
        assert audited(rows, depth=depth) == plain(rows.collect())
    one = rows.filter("source = 'n01'")
    found = merkle.audited(one).first()
    assert found.leaf == found.subroot == found.root and found.proof_sha256 == sha("")


def test_empty_table(rows):
    assert audited(rows.limit(0)) == []


def test_no_python_and_no_join_beside_the_numbering(docs, spark):
    nodes = docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("item"))
    plan = merkle.nest(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    blocks = spark.read.parquet(merkle.tiers(nodes.filter("pos < 10").withColumn("tree", F.lit("t")))[0].inputFiles()[0])
    above = blocks.select("tree", "block", F.array().cast(merkle._PATH).alias("path"), F.lit("x").alias("top"))
    assert "Join" not in merkle.proofs(blocks, above)._jdf.queryExecution().executedPlan().toString()
