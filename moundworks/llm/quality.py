"""Quality rules, with an isolation forest over the rule statistics.

The rule statistics of every document are counted in one pass over the texts and
stored as a narrow table. From all labelled rows come, for each rate, the bounds
inside which good rows lie, and an isolation forest over how far rows lie outside of
them: each tree cuts a few hundred rows, drawn from all, at random values of random
rates, and rows that end up alone after few cuts are unusual. The threshold on the
score is calibrated on all labelled rows too. Every document is then scored, by
numpy, from the narrow table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm.batches import map_batches, records, text_steps, texts
from moundworks.operators.selection import exact_quantiles
from moundworks.sources.store import durable

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The forest: trees, and rows that a tree sees.
TREES, TREE_ROWS = 100, 256
#: Parts into which scores are cut where the threshold is looked for.
SLICES = 200
#: Share of the good rows that may lie outside either bound of a rate.
TAIL = 0.0005
#: How many bad rows must be caught for one more good row lost, as shares.
GOOD_WEIGHT = 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_punct", "n_distinct_words", "longest_word"]
RATES = ["word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "longest", "line_length"]
_SCHEMA = pa.schema([(c, pa.int64()) for c in BASE + MORE])


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur at least twice, first ones included."""
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    hit = b"\x01" * width
    for i, window in enumerate(zip(*(words[k:] for k in range(width)))):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + width] = hit
            covered[j:j + width] = hit
    return covered.count(1)


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """BASE and MORE of one text; a null text counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    letters = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        len(words),
        len(text or "") - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(letters),
        len(raw) - len(raw.translate(None, b"0123456789")),
        len(raw) - len(raw.translate(None, b"!?.,;:'\"()[]{}-_/\\@^~`=+")),
        len(set(words)),
        max(map(len, words), default=0),
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of rule statistics per document, from its whole text."""
    id_type = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            found = np.array([rule_statistics(t) for t in texts(part, text)], dtype=np.int64)
            numbers = records(_SCHEMA, **{f.name: found[:, i] for i, f in enumerate(_SCHEMA)})
            yield pa.RecordBatch.from_arrays([part.column(key), *numbers.columns], names=[key, *BASE, *MORE])

    wanted = ", ".join(f"{c} bigint" for c in BASE + MORE)
    return map_batches(docs.select(key, text), step, f"`{key}` {id_type}, {wanted}")


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's inputs, RATES: statistics made independent of the length of a text."""
    f = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    words, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    lines = np.maximum(f["n_lines"], 1)
    return np.column_stack([
        f["word_chars"] / words,
        f["n_symbols"] / words,
        f["n_dup_lines"] / lines,
        f["n_repeat_words"] / words,
        f["n_upper"] / chars,
        f["n_digits"] / chars,
        f["n_punct"] / chars,
        f["n_distinct_words"] / words,
        np.log1p(f["longest_word"]),
        np.log1p(words / lines),
    ])


def _path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as arrays (tree, node): inner nodes cut ``feature`` at ``cut``; leaves hold a path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    depth: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42) -> "IsolationForest":
        rng = np.random.default_rng(seed)
        take = min(tree_rows, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(2, take)))))
        nodes = 2 ** (depth + 1)
        shape = (trees, nodes)
        forest = cls(np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=int), np.zeros(shape), _path_norm(take), depth)
        for t in range(trees):
            stack, used = [(0, rows[rng.choice(len(rows), take, replace=False)] if take else rows, 0)], 1
            while stack:
                node, part, level = stack.pop()
                low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
                open_ = np.flatnonzero(high > low)
                if level >= depth or len(part) <= 1 or not len(open_):
                    forest.path[t, node] = level + _path_norm(len(part))
                    continue
                f = rng.choice(open_)
                at = rng.uniform(low[f], high[f])
                forest.feature[t, node], forest.cut[t, node], forest.left[t, node] = f, at, used
                below = part[:, f] <= at
                stack += [(used, part[below], level + 1), (used + 1, part[~below], level + 1)]
                used += 2
        return forest

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1; about one half is usual."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path):
            node = np.zeros(len(rows), dtype=int)
            for _ in range(self.depth):
                f = feature[node]
                down = left[node] + (rows[at, np.maximum(f, 0)] > cut[node])
                node = np.where(f >= 0, down, node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(self.norm, 1e-9))


@dataclass
class AnomalyModel:
    """Bounds of the rates, the forest over what exceeds them, and the score from which rows are anomalous."""

    low: np.ndarray
    high: np.ndarray
    forest: IsolationForest | None = None
    threshold: float = np.inf

    def excess(self, inputs: np.ndarray) -> np.ndarray:
        span = np.maximum(self.high - self.low, 1e-3)
        return np.log1p(np.maximum(0, (inputs - self.high) / span) + np.maximum(0, (self.low - inputs) / span))

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return self.forest.score(self.excess(inputs)) if self.forest else np.zeros(len(inputs))


def calibrate(scores: np.ndarray, bad: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """Score from which rows are rejected: most of the share of bad rows caught less
    ``good_weight`` times the share of good rows lost; the highest such score.

    Without rows of both kinds nothing is rejected.
    """
    if bad.all() or not bad.any():
        return np.inf
    at = np.unique(scores)
    caught = 1 - np.searchsorted(np.sort(scores[bad]), at) / bad.sum()
    lost = 1 - np.searchsorted(np.sort(scores[~bad]), at) / (~bad).sum()
    gain = caught - good_weight * lost
    best = len(at) - 1 - int(np.argmax(gain[::-1]))
    return float(at[best]) if gain[best] > 0 else np.inf


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def labelled_rates(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every labelled row that passes the base rules: its rates, whether it is bad, and the
    place of its id in a random order. Written, as the fit reads it several times."""
    labelled = (
        labels.filter(F.col("quality").isNotNull())
        .groupBy(F.col(key))
        .agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("_bad"))
    )
    rows = stats.filter(~base_failed()).join(labelled, key).select(*BASE, *MORE, "_bad", F.xxhash64(key).alias("_order"))

    def step(batch: pa.RecordBatch):
        inputs = rates({c: batch.column(c).to_numpy() for c in BASE + MORE})
        yield pa.RecordBatch.from_arrays([*map(pa.array, inputs.T), batch.column("_bad"), batch.column("_order")], names=[*RATES, "_bad", "_order"])

    return durable(map_batches(rows, step, ", ".join(f"{c} double" for c in RATES) + ", _bad int, _order bigint"))


def threshold(scores: DataFrame, good_weight: float = GOOD_WEIGHT, slices: int = SLICES) -> float:
    """``calibrate`` over a table of any size, of columns score and _bad (0 or 1).

    Rows are counted by score, and scores cut into slices: the counts below a score are
    those of the slices before and of its own slice's lower scores.
    """
    counts = durable(scores.groupBy("score").agg(F.count_if(F.col("_bad") == 1).alias("bad"), F.count_if(F.col("_bad") == 0).alias("good")))
    n_bad, n_good, cuts = counts.agg(F.sum("bad"), F.sum("good"), F.percentile_approx("score", [k / slices for k in range(1, slices)])).first()
    if not n_bad or not n_good:
        return np.inf
    cut = counts.withColumn("_slice", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("score"))))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    before = cut.groupBy("_slice").agg(F.sum("bad").alias("_b"), F.sum("good").alias("_g")).select(
        "_slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_b", "_g")])
    lower = Window.partitionBy("_slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = cut.join(F.broadcast(before), "_slice").select("score", *[
        (F.col(f"{c}0") + F.coalesce(F.sum(name).over(lower), F.lit(0))).alias(c) for c, name in (("_b", "bad"), ("_g", "good"))])
    gain = (1 - F.col("_b") / n_bad) - good_weight * (1 - F.col("_g") / n_good)
    best = below.agg(F.max(F.struct(gain.alias("gain"), "score"))).first()[0]
    return best["score"] if best["gain"] > 0 else np.inf


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> AnomalyModel:
    """Model from all labelled rows that pass the base rules.

    Bounds and threshold are exact over all of them. The forest's trees each see
    ``TREE_ROWS`` rows, as the method has it; these are drawn from all rows by a hash of
    their ids, as many as the trees can use.
    """
    rows = labelled_rates(stats, labels, key)
    found = exact_quantiles(rows.filter("_bad = 0"), RATES, [TAIL, 1 - TAIL])
    if found[RATES[0]] is None:  # no good row
        return AnomalyModel(np.zeros(len(RATES)), np.zeros(len(RATES)))
    model = AnomalyModel(*np.array([found[c] for c in RATES]).T)
    drawn = rows.orderBy("_order", *RATES).limit(TREES * TREE_ROWS).select(*RATES).toArrow()
    model.forest = IsolationForest.fit(model.excess(np.column_stack([drawn.column(c).to_numpy() for c in RATES])))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch):
        score = shared.value.score(np.column_stack([batch.column(c).to_numpy() for c in RATES]))
        yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("_bad")], names=["score", "_bad"])

    model.threshold = threshold(map_batches(rows.select(*RATES, "_bad"), step, "score double, _bad int"))
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """Rule statistics, base verdict, anomaly score and verdict of every document.

    ``labels`` has ``key`` and quality (1 good, 0 bad, null: no label). One row per
    input row, in no order: repeated rows come back repeated, a null key is kept. A
    null or empty text has all counts 0 and fails the base rules. Very long texts are
    counted whole; equal scores get equal verdicts. With no labelled
    row nothing is an anomaly; an empty table gives no rows. Other columns, whatever
    they are called, are not read.
    """
    narrow = durable(stats if stats is not None else statistics(docs, key, text))
    shared = docs.sparkSession.sparkContext.broadcast(fit(narrow, labels, key))
    id_type = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        inputs = rates({c: batch.column(c).to_numpy() for c in BASE + MORE})
        score = shared.value.score(inputs)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(score), pa.array(score >= shared.value.threshold)],
            names=[*batch.schema.names, "anomaly_score", "anomalous"],
        )

    counts = ", ".join(f"{c} bigint" for c in BASE + MORE)
    scored = map_batches(narrow.select(key, *BASE, *MORE), step, f"`{key}` {id_type}, {counts}, anomaly_score double, anomalous boolean")
    kept = ~base_failed() & ~F.col("anomalous")
    return scored.select(key, *BASE, base_failed().alias("base_failed"), kept.alias("kept"), "anomaly_score")
