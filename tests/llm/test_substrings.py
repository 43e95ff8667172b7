import brute
import pytest
from pyspark.sql import functions as F

from moundworks.llm import substrings


def check(rows, width=35):
    plain = rows.select("doc_id", "text").collect()
    want = sorted(repr((r.doc_id, *x)) for r, x in zip(plain, brute.passages([r.text for r in plain], width)))
    found = substrings.removed_words(rows, width=width).collect()
    assert sorted(repr(tuple(r)) for r in found) == want
    return sum(r.n_removed for r in found)


def test_documents(docs):
    assert check(docs) > 0


def test_odd_rows(odd, none):
    assert check(odd) > 0
    assert substrings.removed_words(none).count() == 0


@pytest.mark.parametrize("width", [3, 4, 8])
def test_widths_and_overlaps(spark, width):
    texts = ["a b a b a b a b", "x y z a b a b q", " ".join(f"t{i % 5}" for i in range(40)), "x y z a b", None, "q"] + [f"u{i} a b a b a v{i}" for i in range(20)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), width)


def test_small_flushes_give_the_same(docs, monkeypatch):
    want = sorted(map(tuple, substrings.removed_words(docs).collect()))
    monkeypatch.setattr(substrings, "FLUSH_KEYS", 500)
    monkeypatch.setattr(substrings, "BITMAP_BITS", 1 << 10)
    assert sorted(map(tuple, substrings.removed_words(docs).collect())) == want


def test_cut_texts_keep_the_kept_words(odd):
    cut = substrings.without_passages(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    want = sorted(repr((r.doc_id, r.kept_sha256)) for r in substrings.removed_words(odd).collect())
    assert sorted(repr((r.doc_id, brute.sha(" ".join(brute.words(r.text))))) for r in cut.collect()) == want
    assert cut.filter(F.col("text").isNull()).count() == odd.filter(F.col("text").isNull()).count()


def test_very_many_copies_of_one_row(spark):
    line = " ".join(f"w{i}" for i in range(60))
    copies = spark.range(100_000).selectExpr("7 AS doc_id", f"'{line} end' AS text")
    other = spark.createDataFrame([(8, f"head {line}"), (9, " ".join(f"v{i}" for i in range(60)))], "doc_id int, text string")
    found = substrings.removed_words(copies.union(other)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(7, 61, 61, 100_000), (8, 61, 60, 1), (9, 60, 0, 1)]


def test_groups_follow_the_bytes_of_the_input(docs, monkeypatch):
    want = sorted(map(tuple, substrings.removed_words(docs).collect()))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 10_000)
    assert sorted(map(tuple, substrings.removed_words(docs).collect())) == want
