import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moundworks.llm import language, toxicity


def rates(*texts, entries=()):
    lexicon = toxicity.Lexicon([np.zeros(0, dtype=np.uint64)] * (1 + len(toxicity.PREFIXES)))
    found = lexicon.features(pa.array(list(texts)))
    return [dict(zip(toxicity.FEATURES, row)) for row in found]


def test_features():
    insult, near, spelled, plain, empty, null = rates("he is a moron indeed", "YOU total moron!", "such an 1d10t", "a calm text 2024", "", None)
    assert insult["insults"] == 0.2 and insult["near_you"] == 0 and near["near_you"] > 0
    assert spelled["obfuscated_hits"] > 0 and plain["obfuscated"] == 0
    assert near["capitals"] > 0 and near["exclaims"] > 0 and plain["digits"] > 0
    assert empty == null and not any(empty.values())


def test_learned_words_separate(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)) + (f" zorbl{i % 9} " if i % 4 == 0 else " ") + "end", int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    held = language.held_out("doc_id", 5, 0)
    found = toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), ~held).join(docs.select("doc_id", "toxic"), "doc_id")
    right = found.filter(held & (F.col("predicted") == F.col("toxic"))).count()
    assert right >= 0.98 * found.filter(held).count()


def test_labels_of_held_out_rows_do_not_matter(docs):
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS toxic")
    held = language.held_out("doc_id", 5, 0)
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x, ~held).collect())) for x in (labels, turned))
    assert a == b


def test_odd_rows_and_missing_labels(spark, docs, odd, none):
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for rows in (odd, none):
        found = toxicity.toxicity(rows, no_labels, F.lit(True)).collect()
        assert len(found) == rows.count() and all((r.score, r.predicted) == (0.0, 0) for r in found)
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 5 = 1 AS INT) AS toxic")
    both = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text"))
    found = toxicity.toxicity(both, labels, F.lit(True)).collect()
    assert len(found) == both.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def plain_rates(text):
    """The rules for densities, closeness and characters, word by word."""
    words, raw = brute.small_words(text), brute.words(text)
    n, chars = max(len(words), 1), max(sum(len(w.encode()) for w in raw), 1)
    hits = [w in toxicity.INSULTS for w in words]
    you = [w in toxicity.SECOND_PERSON for w in words]
    near = [any(you[j] for j in range(max(0, i - toxicity.NEAR), min(len(words), i + toxicity.NEAR + 1))) and hits[i] for i in range(len(words))]
    joined = "".join(raw)
    return {"insults": sum(hits) / n, "you": sum(you) / n, "near_you": sum(near) / n, "capitals": sum("A" <= c <= "Z" for c in joined) / chars,
            "exclaims": joined.count("!") / chars, "questions": joined.count("?") / chars, "digits": sum("0" <= c <= "9" for c in joined) / chars,
            "log_words": float(np.log1p(len(words)))}


def test_rates_against_a_plain_version(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["You MORON! are you? a 1 stupid you", "moron a b c d e f you", "", None, "du Idiot und tu moron!!"]
    for text, found in zip(texts, rates(*texts)):
        want = plain_rates(text)
        assert {k: found[k] for k in want} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_scores_are_those_of_a_plain_walk_over_trees_and_steps(spark):
    rng = np.random.default_rng(5)
    rows = [[float(x) for x in rng.random(len(toxicity.FEATURES))] for _ in range(400)]
    data = spark.createDataFrame([(*r, int(r[0] + 0.3 * r[1] + 0.2 * rng.random() > 0.7), 1 + k % 2) for k, r in enumerate(rows)],
                                 ", ".join(f"{f} double" for f in toxicity.FEATURES) + ", label int, part int")
    model = toxicity.fit(data)
    steps, heights = list(model.calibration.boundaries), list(model.calibration.predictions)
    trees = [(w, _nodes(t)) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    for r in model.score(data).limit(80).collect():
        margin = sum(w * _walk(nodes, [r[f] for f in toxicity.FEATURES]) for w, nodes in trees)
        p = 1 / (1 + np.exp(-2 * margin))
        assert r.score == pytest.approx(0.99 * np.interp(p, steps, heights) + 0.01 * p, abs=1e-9)


def _nodes(tree):
    """(feature, threshold, left, right) or a number, from the tree's own description."""
    lines = [x.strip() for x in tree.toDebugString.split("\n")[1:] if x.strip()]

    def read():
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line).groups()
        left = read()
        assert lines.pop(0).startswith("Else")
        return int(feature), float(threshold), left, read()

    return read()


def _walk(node, row):
    while not isinstance(node, float):
        feature, threshold, left, right = node
        node = left if row[feature] <= threshold else right
    return node
