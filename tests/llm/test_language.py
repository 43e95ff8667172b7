import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moundworks.llm import language


def languages(model):
    return [x for k in range(model.n_slices) for x in model.slice(k).languages]


def plain(labelled, texts):
    """Naive Bayes with dictionaries: (language, score) of each text."""
    counts, totals, width = defaultdict(Counter), defaultdict(Counter), language.CELLS
    for text, lang in labelled:
        for c in language.grams(pa.array([text])).cells.tolist():
            counts[lang][c] += 1
            totals[lang][c // width] += 1
    for text in texts:
        cells = language.grams(pa.array([text])).cells.tolist()
        if not any(ch.isalpha() for ch in text or "") or not cells:
            yield "und", 0.0
            continue
        logs = {k: sum(math.log((counts[k][c] + 1) / (totals[k][c // width] + width)) for c in cells) for k in sorted(counts)}
        best = max(logs, key=logs.get)
        scale = min(len(cells), language.EVIDENCE) / len(cells)
        yield best, 1 / sum(math.exp((v - logs[best]) * scale) for v in logs.values())


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.filter(~language.held_out("doc_id", 3, 1)))


def test_held_out_accuracy(docs, model):
    held = language.identify(docs, model).filter(language.held_out("doc_id", 3, 1))
    wrong, n = held.filter("lang_pred <> lang").count(), held.count()
    assert n > 40 and wrong <= 0.02 * n


def test_prediction_looks_at_the_text_alone(docs, model):
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 7)
    a, b = (language.identify(d, model).select("text", "lang_pred", "score").collect() for d in (docs, changed))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows(odd, none, model):
    found = language.identify(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in languages(model) and 0 <= r.score <= 1
    assert language.identify(none, model).count() == 0


def test_long_words_do_not_crash_training(odd):
    assert languages(language.train(odd)) == ["de", "en", "es"]  # the French texts have no letter


def test_model_without_rows_knows_nothing(odd, none):
    assert {r.lang_pred for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_filter_keeps_columns_and_clean_rows(docs, odd, model):
    assert language.in_known_language(docs, model).count() == docs.count()
    kept = language.in_known_language(odd, model)
    assert kept.columns == odd.columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_grams_do_not_cross_rows():
    one, two, both = (language.grams(pa.array(x)) for x in (["ab c"], ["é9 x"], ["ab c", "é9 x"]))
    assert both.cells[:both.first[1]].tolist() == one.cells.tolist()
    assert both.cells[both.first[1]:].tolist() == two.cells.tolist()


def test_against_dictionaries(docs, odd, model):
    learned = [(r.text, r.lang) for r in docs.filter(~language.held_out("doc_id", 3, 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect()]
    rows = docs.select("text").union(odd.filter("length(text) < 100000 OR text IS NULL").select("text"))
    found = language.identify(rows, model).collect()
    for r, (best, score) in zip(found, plain(learned, [r.text for r in found])):
        assert r.lang_pred == best and r.score == pytest.approx(score, abs=1e-4)


def test_slices_give_what_one_matrix_gives(docs, odd, model, monkeypatch):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    whole = {(r.doc_id, r.text): (r.lang_pred, r.score, r.fits) for r in language.identify(rows, model, fits="fits").collect()}
    monkeypatch.setattr(language, "SLICE_LANGUAGES", 1)
    assert model.n_slices == 4
    for r in language.identify(rows, model, fits="fits").collect():
        best, score, fits = whole[r.doc_id, r.text]
        assert (r.lang_pred, r.fits) == (best, fits) and r.score == pytest.approx(score, abs=1e-9)


def test_three_hundred_languages_and_ties(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(f"l{k:03}", " ".join([letters[k % 20] * 3 + letters[k // 20] * 4 + letters[k % 20]] * 8)) for k in range(300)]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)] + [(300, rows[0][1], "a first twin")], "doc_id bigint, text string, lang string")
    model = language.train(docs)
    assert model.n_languages == 301 and model.n_slices > 1
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert found == {**{i: k for i, (k, _) in enumerate(rows)}, 0: "a first twin", 300: "a first twin"}


def test_texts_unlike_all_languages_go(docs, spark, model):
    strange = ["这是一个完全没有学过的语言的文本，它的字母表中没有一个字母出现在训练数据里，所以应该被拒绝。" * 3, "Это текст на языке, которого модель никогда не видела, и он должен уйти.", "zx"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(strange)], "doc_id bigint, text string")
    assert [r.doc_id for r in language.in_known_language(rows, model, min_score=0.0).collect()] == [2]  # too short to tell
    assert language.identify(docs, model, fits="fits").filter("NOT fits").count() == 0
