import brute
import numpy as np
import pytest

from moundworks.llm import quality


def test_statistics_match_plain_counts(docs, odd):
    for rows in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        labels = rows.sparkSession.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
        found = quality.quality_rules(rows, labels).collect()
        want = sorted((repr((r.doc_id, *brute.quality(r.text))) for r in rows.collect()))
        assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found) == want
        assert all(r.kept is not None and not (r.kept and r.base_failed) for r in found)


def test_junk_goes_and_prose_stays(spark):
    prose = [" ".join(f"{a}{b}" for b in range(60) for a in ("word", "other", "third")) + f" {k}" for k in range(300)]
    junk = [" ".join(f"w{k}x{b}#$%" for b in range(90)) for k in range(60)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(prose + junk)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, good int")
    labels = docs.filter("doc_id % 2 = 0").selectExpr("doc_id", "good AS quality", "0 AS toxic")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 360))


def test_without_labels_or_rows(docs, none):
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, empty).collect())
    assert quality.quality_rules(none, empty).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(500, 3)), np.full((3, 3), 12.0)])
    score = quality.IsolationForest.fit(rows).score(rows)
    assert score[500:].min() > np.quantile(score[:500], 0.99)


@pytest.mark.parametrize("scores,bad,want", [([0.1, 0.2, 0.8], [False, False, True], 0.8), ([0.5, 0.5], [False, True], np.inf), ([0.3], [True], np.inf)])
def test_threshold(scores, bad, want):
    assert quality.calibrate(np.array(scores), np.array(bad)) == want


def test_scores_are_those_of_a_plain_walk():
    rng = np.random.default_rng(2)
    rows = np.round(rng.random((300, 4)), 2)  # with ties
    forest = quality.IsolationForest.fit(rows, trees=20, tree_rows=64)
    for x, got in zip(rows[:50], forest.score(rows[:50])):
        depths = []
        for t in range(len(forest.path)):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] + (x[forest.feature[t, node]] > forest.cut[t, node])
            depths.append(forest.path[t, node])
        assert got == pytest.approx(2 ** (-np.mean(depths) / forest.norm))


def test_threshold_is_the_best_of_all():
    rng = np.random.default_rng(4)
    bad = rng.random(200) < 0.3
    scores = np.round(rng.random(200) + 0.3 * bad, 2)
    found = quality.calibrate(scores, bad)
    gains = {t: np.mean(scores[bad] >= t) - quality.GOOD_WEIGHT * np.mean(scores[~bad] >= t) for t in set(scores.tolist())}
    assert gains[found] == pytest.approx(max(gains.values())) and max(gains.values()) > 0
    assert quality.calibrate(scores, np.zeros(200, dtype=bool)) == np.inf
