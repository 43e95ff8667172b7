"""Toxicity scores: gradient-boosted trees over dense text features, calibrated.

The features are rates per word or character: densities of lexicon words, how close
they stand to the second person, capitals, punctuation, obfuscated spellings. Besides
the fixed lexicon there is a learned one: words and word beginnings that labelled
toxic documents hold far more often than others.

A bounded sample of labelled rows is cut into three parts by a hash of the id: the
first gives the learned lexicon, the second the trees, the third the isotonic
calibration, so no step is fitted on rows whose labels shaped its inputs. Features of
all documents are computed in numpy, in one pass, and written as a narrow table;
trees and calibration are Spark ML.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.llm.batches import map_batches, text_steps
from moundworks.llm.words import NOT_ALNUM, SPACE, Split, key_of, member, mixed, split
from moundworks.sources.store import durable

# --- fixed values: word lists -------------------------------------------------
INSULTS = """idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown dumb imbecile
 fool fools jerk hate hateful ugly garbage filth vermin coward liar freak degenerate brainless
 idiota estúpido estúpida imbécil basura asqueroso crétin stupide ordure minable dégoûtant
 dummkopf abschaum erbärmlich widerlich trottel""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre ti tú usted vosotros".split()
# ------------------------------------------------------------------------------

#: Bounds of the fit: labelled rows used, entries of each learned list, tree rounds and depth.
SAMPLE_ROWS, LEXICON_ROWS, ROUNDS, DEPTH = 20_000, 3_000, 20, 3
#: Toxic documents that a learned entry needs, and how much more often they must hold it.
MIN_DOCS, MIN_LIFT = 4, 8.0
#: Byte lengths of the learned word beginnings.
PREFIXES = (4, 5, 6)
#: Words to either side that count as close.
NEAR = 5

FEATURES = [
    "insults", "learned", *(f"begin_{n}" for n in PREFIXES), "hits", "any_hit", "near_you", "you", "obfuscated", "obfuscated_hits",
    "capitals", "exclaims", "questions", "punctuation", "digits", "log_words",
]

_PLAIN = np.arange(256, dtype=np.uint8)  # what obfuscating characters stand for
for _a, _b in zip(b"01345789@$!+", b"oieastbgasit"):
    _PLAIN[_a] = _b
for _a in range(65, 91):
    _PLAIN[_a] = _a + 32


def _keys(words: list[str]) -> np.ndarray:
    return np.sort(np.array([key_of(w.encode()) for w in words], dtype=np.uint64))


_INSULTS, _YOU = _keys(INSULTS), _keys(SECOND_PERSON)


def entry_keys(found: Split) -> list[np.ndarray]:
    """Keys of each word and of its beginnings; words no longer than a beginning have key 0 for it."""
    size = found.end - found.start
    whole, *starts = found.keys_of([found.end, *(np.minimum(found.end, found.start + n) for n in PREFIXES)])
    return [whole, *(np.where(size > n, mixed(k + np.uint64(n)), np.uint64(0)) for n, k in zip(PREFIXES, starts))]


def _per_row(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[first[1:]] - total[first[:-1]]


def obfuscated(raw: Split, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a sign or digit between letters, and those of them that spell a lexicon word."""
    data = raw.data
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sign = _PLAIN[data] != data
    sign &= ~letter
    signs = np.concatenate([[0], np.cumsum(sign)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    inside = (signs[raw.end] - signs[raw.start] > 0) & (letters[raw.end] - letters[raw.start] > 1)
    inside &= (signs[raw.end] - signs[raw.start]) + (letters[raw.end] - letters[raw.start]) >= raw.end - raw.start - 1
    at = np.flatnonzero(inside)
    spelled = Split(_PLAIN[data], raw.start[at], raw.end[at], raw.first).keys()
    hit = np.zeros(len(inside), dtype=bool)
    hit[at] = member(spelled, lexicon)
    return inside, hit


@dataclass
class Lexicon:
    """Sorted keys of the learned words, and of the learned beginnings by length."""

    entries: list[np.ndarray]

    def features(self, column: pa.Array) -> np.ndarray:
        """FEATURES of each row."""
        found, raw = split(column, NOT_ALNUM, lower=True), split(column, SPACE)
        keys = entry_keys(found)
        row, first = found.rows(), found.first
        n, chars = np.maximum(found.counts, 1), np.maximum(_chars(raw), 1)
        insult = member(keys[0], _INSULTS)
        learned = [member(k, e) for k, e in zip(keys, self.entries)]
        hits = insult | np.logical_or.reduce(learned)
        you = member(keys[0], _YOU)
        near = np.zeros(len(hits), dtype=bool)
        for d in range(1, NEAR + 1):
            if len(hits) > d:
                same = row[d:] == row[:-d]
                near[d:] |= hits[d:] & you[:-d] & same
                near[:-d] |= hits[:-d] & you[d:] & same
        odd, spelled = obfuscated(raw, _INSULTS)
        total = _per_row(hits, first) + _per_row(spelled, raw.first)
        words = np.maximum(raw.counts, 1)
        marks = {name: _char_rate(raw, signs) / chars for name, signs in _MARKS.items()}
        rate = {
            "insults": _per_row(insult, first) / n, "learned": _per_row(learned[0], first) / n,
            **{f"begin_{p}": _per_row(m, first) / n for p, m in zip(PREFIXES, learned[1:])},
            "hits": np.log1p(total), "any_hit": total > 0, "near_you": _per_row(near, first) / n, "you": _per_row(you, first) / n,
            "obfuscated": _per_row(odd, raw.first) / words, "obfuscated_hits": _per_row(spelled, raw.first) / words,
            **marks, "log_words": np.log1p(found.counts),
        }
        return np.column_stack([np.asarray(rate[f], dtype=np.float64) for f in FEATURES])


def _table(signs: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(signs)] = True
    return table


_MARKS = {
    "capitals": _table(bytes(range(65, 91))), "exclaims": _table(b"!"), "questions": _table(b"?"),
    "punctuation": _table(b"!?.,;:'\"()[]{}-_/\\#*$%&|<>@^~`=+"), "digits": _table(b"0123456789"),
}


def _chars(raw: Split) -> np.ndarray:
    """Bytes inside words, per row."""
    size = np.concatenate([[0], np.cumsum(raw.end - raw.start)])
    return size[raw.first[1:]] - size[raw.first[:-1]]


def _char_rate(raw: Split, signs: np.ndarray) -> np.ndarray:
    """How many bytes of the words of each row are in the table."""
    total = np.concatenate([[0], np.cumsum(signs[raw.data])])
    return _per_row(total[raw.end] - total[raw.start], raw.first)


def learn_lexicon(labelled: DataFrame, text: str, label: str) -> Lexicon:
    """Entries that toxic documents hold at least MIN_LIFT times as often as others.

    Documents are counted per entry, first inside each batch; of each kind of entry
    the LEXICON_ROWS strongest are kept.
    """
    kinds = 1 + len(PREFIXES)

    def step(batch: pa.RecordBatch):
        seen = []
        for part in text_steps(batch, text):
            found = split(part.column(text), NOT_ALNUM, lower=True)
            toxic = part.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            row = found.rows()
            for kind, keys in enumerate(entry_keys(found)):
                order = np.lexsort((row, keys))
                k, r = keys[order], row[order]
                once = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))[:len(k)] & (k != 0)
                seen.append((kind, k[once], toxic[r[once]]))
        for kind in range(kinds):
            keys = np.concatenate([k for x, k, _ in seen if x == kind])
            toxic = np.concatenate([t for x, _, t in seen if x == kind])
            entry, place = np.unique(keys, return_inverse=True)
            held = np.bincount(place, minlength=len(entry))
            bad = np.bincount(place, weights=toxic, minlength=len(entry)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), kind, dtype=np.int32)), pa.array(entry.view(np.int64)), pa.array(bad), pa.array(held - bad)],
                names=["kind", "entry", "bad", "good"])

    sizes = labelled.agg(F.sum(label).alias("bad"), F.count("*").alias("n")).first()
    if not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return Lexicon([np.zeros(0, dtype=np.uint64)] * kinds)
    bad, good = int(sizes["bad"]), int(sizes["n"] - sizes["bad"])
    counts = map_batches(labelled.select(text, label), step, "kind int, entry bigint, bad bigint, good bigint")
    lift = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    strongest = (
        counts.groupBy("kind", "entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("lift", lift).filter((F.col("bad") >= MIN_DOCS) & (F.col("lift") >= MIN_LIFT))
    )
    entries = []
    for kind in range(kinds):
        top = strongest.filter(F.col("kind") == kind).orderBy(F.desc("bad"), F.desc("lift"), "entry").limit(LEXICON_ROWS).select("entry").toArrow()
        entries.append(np.sort(top.column("entry").to_numpy().view(np.uint64)))
    return Lexicon(entries)


def features(docs: DataFrame, lexicon: Lexicon, key: str, text: str) -> DataFrame:
    """``key`` and FEATURES of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    id_type = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            found = shared.value.features(part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(key), *map(pa.array, found.T.copy())], names=[key, *FEATURES])

    return map_batches(docs.select(key, text), step, f"`{key}` {id_type}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class ToxicityModel:
    """Trees and calibration; without rows of both labels, a constant."""

    prior: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column score. Within a flat piece of the calibration the trees
        keep the order: they have a hundredth of the score."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.prior))
        scored = self.trees.transform(_assembled(rows)).withColumn("p", vector_to_array("probability")[1])
        scored = self.calibration.transform(scored).drop("features", "rawPrediction", "probability")
        mixed_score = F.lit(0.99) * F.col("calibrated") + F.lit(0.01) * F.col("p")
        return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed_score)))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fit(rows: DataFrame) -> ToxicityModel:
    """Trees from the rows of part 1 and calibration from those of part 2. ``rows`` has
    FEATURES, label and part, and reads files."""
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    bad, n = sum(v for (_, y), v in counts.items() if y == 1), sum(counts.values())
    if not all(counts.get((part, y)) for part in (1, 2) for y in (0, 1)):
        return ToxicityModel(bad / n if n else 0.0)
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=42, labelCol="label", minInstancesPerNode=5)
    model = trees.fit(_assembled(rows.filter("part = 1")).select("features", "label").coalesce(2))
    held = model.transform(_assembled(rows.filter("part = 2"))).select(vector_to_array("probability")[1].alias("p"), F.col("label").cast("double"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated")
    return ToxicityModel(bad / n, model, isotonic.fit(held.coalesce(1)))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every document: ``key``, score (0 to 1) and predicted (1 from 0.5 on).

    ``labels`` has ``key`` and toxic (0, 1 or null); only its rows where ``learn``
    holds are learned from, at most SAMPLE_ROWS of them, chosen by a hash of the id.

    One row per input row, repeated rows and null keys too. Null and empty texts have
    all rates 0 and get the score that the model gives to that. Very long texts are
    rated whole; equal rates get equal scores, and a row on a cut goes left. Without labelled rows
    of both kinds every score is the share of toxic ones, or 0. An empty table gives
    no rows. Other columns, whatever they are called, are not read.
    """
    part = F.when(F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(10)) < 6, 0).when(F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(10)) < 8, 1).otherwise(2)
    sample = durable(
        labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & learn)
        .groupBy(key).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
        .withColumn("part", part).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(SAMPLE_ROWS)
    )
    known = docs.select(key, text).join(F.broadcast(sample), key)  # at most SAMPLE_ROWS rows
    lexicon = learn_lexicon(durable(known.filter("part = 0").select(text, "label")), text, "label")
    rows = durable(features(docs, lexicon, key, text))
    model = fit(durable(rows.join(F.broadcast(sample), key).filter("part > 0").select(*FEATURES, "label", "part")))
    return model.score(rows).select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
