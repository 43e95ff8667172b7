import brute
import pytest

from moundworks.llm import decontamination


def check(docs, items, **settings):
    listed = [("null" if r.item_id is None else r.item_id, r.text) for r in items.collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, names = brute.hits(r.text, listed, settings.get("width", 10))
        want.append(repr((r.doc_id, n, hit, len(names), brute.sha(",".join(names)), hit > 0)))
    found = decontamination.contamination(docs, items, **settings).drop("items")
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(want)


def test_documents(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    check(docs, items)


@pytest.mark.parametrize("width,shingle_words", [(10, 3), (4, 2), (2, 3)])
def test_short_items_nulls_and_repeats(spark, odd, width, shingle_words):
    items = spark.createDataFrame(
        [(1, "same3 same4 same5 same6 same7 same8 same9 same10 same11 same12 same13"), (1, "same3 same4 same5 same6 same7 same8 same9 same10 same11 same12 same13"),
         (2, "A B"), (3, ""), (4, None), (None, "cödé ñandú"), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (11, "different"), (12, "w5 w6 w7 never seen")],
        "item_id bigint, text string")
    check(odd, items, width=width, shingle_words=shingle_words)


def test_without_items_or_rows(spark, odd, none):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in decontamination.contamination(odd, items).collect())
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.uncontaminated(odd, items).count() == odd.count()


def test_hit_documents_go(spark, odd):
    items = spark.createDataFrame([(1, "same20 same21 same22 same23 same24 same25 same26 same27 same28 same29 same30")], "item_id bigint, text string")
    kept = decontamination.uncontaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted(repr(r.text) for r in kept.collect()) == sorted(repr(r.text) for r in odd.collect() if "same20" not in (r.text or ""))


def test_a_window_that_all_items_share(spark):
    head = "answer the next question with one letter and nothing else at all please"
    items = spark.createDataFrame([(k, f"{head} question {k} of many") for k in range(60)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"filler {head} tail {i}") for i in range(40)] + [(99, f"{head} question 7 of many"), (100, "clean")], "doc_id bigint, text string")
    check(docs, items)
    found = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert len(found[0]["items"]) == 60 and found[0].items_sha256 == found[39].items_sha256 and found[100]["items"] == []
