import brute
import pytest

import corpus_pipeline
from test_language import plain as plain_languages
from moundworks.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        kept = after
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(brute.hits(r.text, items)[1] == 0 for r in kept.collect())
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    result = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in kept.collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_documents(spark, odd, k):
    rows = odd.selectExpr(
        "doc_id", "text", "lang", "hits AS source", "CAST(length(text) AS BIGINT) AS n_chars", "n_words", "score")
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, rows, SF)
    assert 0 < found.count() <= rows.count(), name
    if k < 4:
        assert found.columns == rows.columns and found.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
    assert stage(spark, rows.limit(0), SF).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage on the small documents."""
    rows, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, SF).cache()
        found[name] = rows.collect(), after.collect()
        rows = after
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language_id_keeps_what_a_plain_version_keeps(stages):
    before, after = stages["language_id"]
    told = plain_languages([(r.text, r.lang) for r in before if r.text is not None and r.lang is not None], [r.text for r in before])
    assert ids(after) == sorted(r.doc_id for r, (best, score) in zip(before, told) if best != "und" and score >= 0.5)


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    before, after = stages["near_dedup"]
    groups = {}
    for r, g in zip(before, brute.linked([brute.fingerprint(r.text) for r in before])):
        groups[g] = min(groups.get(g, r.doc_id), r.doc_id)
    assert ids(after) == sorted(groups.values()) and len(after) < len(before)


def test_substring_dedup_keeps_the_words_outside_repeated_passages(stages):
    before, after = stages["substring_dedup"]
    want = {r.doc_id: sha for r, (_, _, sha) in zip(before, brute.passages([r.text for r in before]))}
    assert {r.doc_id: brute.sha(" ".join(brute.words(r.text))) for r in after} == want
    assert [(r.lang, r.source) for r in sorted(after, key=lambda r: r.doc_id)] == [(r.lang, r.source) for r in sorted(before, key=lambda r: r.doc_id)]


def test_decontamination_keeps_the_documents_without_a_window(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r.doc_id for r in before if not brute.hits(r.text, items)[1])
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before if r.doc_id in set(ids(after))}


def test_encoding_is_that_of_the_tokenizers_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["bpe_encode"]
    assert {r.doc_id: list(r.ids) for r in after} == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in before}
    assert {r.doc_id: (r.lang, r.source) for r in after} == {r.doc_id: (r.lang, r.source) for r in before}
