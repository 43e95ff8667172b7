"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become letters and gaps: every letter in small form, any run of other
characters one gap. Each 1- to 3-gram of them is hashed into a fixed number of cells.
Training counts cells by language over all labelled documents; the model is one
matrix of log probabilities, cells by languages, which is broadcast (its size is
fixed by the parameters). A document's score for a language is the sum of its cells'
rows, gathered and summed per batch in numpy. A matrix of many languages is cut into
slices that are applied one after the other, with the best language carried along.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.batches import give_back, map_batches, text_steps
from moundworks.llm.rows import numbered_columns
from moundworks.operators.ordering import bounded_index, ordered_index
from moundworks.sources.store import drop_paths, durable, intermediates, ship_package

#: Cells per n-gram length, and lengths.
CELLS, ORDERS = 1 << 15, (1, 2, 3)
#: Languages of a model that are held at once (12.6 MB for 32), and those that a task counts before it sends them.
SLICE_LANGUAGES, TASK_LANGUAGES = 32, 64
#: n-grams from which a text is asked whether it fits its language.
FIT_GRAMS = 30
#: n-grams whose evidence the score may use in full; more of them are averaged down to so many.
EVIDENCE = 60
#: Bytes of text per numpy step: each character becomes three cells and a row of the matrix for each.
STEP_BYTES = 1 << 18
UNKNOWN = "und"
#: Score from which a document's language counts as known.
MIN_SCORE = 0.5

_GAP = 32


def _letters() -> np.ndarray:
    """Small letter of each code point of the basic plane; the gap for what is no letter."""
    table = np.full(1 << 16, _GAP, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


_TABLE = _letters()


@dataclass
class Grams:
    """n-gram cells of the rows of a slice; row r has cells first[r] to first[r + 1]."""

    cells: np.ndarray
    first: np.ndarray
    letters: np.ndarray


def grams(column: pa.Array, cells: int = CELLS) -> Grams:
    """Cells of the 1- to 3-grams of each row, each length in a range of its own."""
    rows = ["" if t is None else t for t in column.to_pylist()]
    points = np.frombuffer("".join([t + " " for t in rows]).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in rows])
    code = _TABLE[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        ch = chr(points[i])
        code[i] = ord(ch.lower()[0]) if ch.isalpha() else _GAP
    row = np.repeat(np.arange(len(rows)), sizes)
    gap = code == _GAP
    letters = np.bincount(row[~gap], minlength=len(rows))
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of a run of gaps, the first one after a letter stays
    code, row = code[keep], row[keep]
    out, owners = [], []
    for n in ORDERS:
        h = np.zeros(max(len(code) - n + 1, 0), dtype=np.uint32)
        for k in range(n):
            h = (h ^ code[k:len(code) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = row[:len(h)] == row[n - 1:] if n > 1 else code != _GAP
        out.append((h[inside] % np.uint32(cells)) + np.uint32(cells * (n - 1)))
        owners.append(row[:len(h)][inside])
    cell, owner = np.concatenate(out), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Grams(cell[order], np.searchsorted(owner[order], np.arange(len(rows) + 1)), letters)


@dataclass
class Slice:
    """Some languages of a model, in sorted order: log probabilities (cell, language), and for each
    language the mean log probability that separates its own texts from unknown n-grams."""

    languages: list[str]
    logs: np.ndarray
    floor: np.ndarray


@dataclass
class LanguageModel:
    """Counts of n-grams by language in a written table (place, name, cell, n), read slice by slice.

    ``place`` numbers the languages in sorted order; a slice is a run of SLICE_LANGUAGES
    of them. One slice is held at a time, so its size does not grow with their number.
    """

    counts: DataFrame
    n_languages: int
    cells: int

    @property
    def n_slices(self) -> int:
        return -(-self.n_languages // SLICE_LANGUAGES)

    def slice(self, k: int) -> Slice:
        low = k * SLICE_LANGUAGES
        sums = self.counts.filter(F.col("place").between(low, low + SLICE_LANGUAGES - 1)).drop("name").toArrow()
        names = self.counts.filter(F.col("place").between(low, low + SLICE_LANGUAGES - 1)).groupBy("place").agg(F.min("name").alias("name")).toArrow()
        languages = [name for _, name in sorted(zip(names.column("place").to_pylist(), names.column("name").to_pylist()))]
        table = np.ones((self.cells * len(ORDERS), len(languages)), dtype=np.float32)
        table[sums.column("cell").to_numpy(), sums.column("place").to_numpy() - low] += sums.column("n").to_numpy()
        own, unknown = np.zeros(len(languages)), np.zeros(len(languages))
        for o in range(len(ORDERS)):
            part = table[o * self.cells:(o + 1) * self.cells]
            total = part.sum(axis=0, dtype=np.float64)
            part /= total
            own += (part * np.log(part)).sum(axis=0, dtype=np.float64) / len(ORDERS)
            unknown -= np.log(total) / len(ORDERS)
        return Slice(languages, np.log(table, out=table), (own + unknown) / 2)


#: Columns that a slice hands on to the next: best language and its sum of logs, its floor, and the
#: largest evidence with the sum of shares relative to it.
_CARRIED = ["_slice_best", "_slice_sum", "_slice_floor", "_slice_top", "_slice_share"]


def _score(found: Grams, part: Slice, before: list[np.ndarray] | None) -> list[np.ndarray]:
    """The _CARRIED values of each row after one more slice; ties stay with the earlier language."""
    n = np.diff(found.first)
    sums = np.zeros((len(n), len(part.languages)))
    full = n > 0
    if full.any():
        for k in range(len(part.languages)):
            sums[full, k] = np.add.reduceat(part.logs[found.cells, k].astype(np.float64), found.first[:-1][full])
    evidence = sums / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
    at = sums.argmax(axis=1)
    row = np.arange(len(n))
    best, total, floor, top = np.array(part.languages, dtype=object)[at], sums[row, at], part.floor[at], evidence.max(axis=1)
    share = np.exp(evidence - top[:, None]).sum(axis=1)
    if before is None:
        return [best, total, floor, top, share]
    stays = before[1] >= total
    both = np.maximum(before[3], top)
    return [np.where(stays, before[0], best), np.where(stays, before[1], total), np.where(stays, before[2], floor), both,
            before[4] * np.exp(before[3] - both) + share * np.exp(top - both)]


def train(labelled: DataFrame, text: str = "text", language: str = "lang", cells: int = CELLS) -> LanguageModel:
    """Count n-grams over every row with a text and a language.

    Each task adds up its batches in one dense table per language and sends the cells
    that occur; the sums by cell and language are written, and numbered by language.
    Nulls in either column are passed over; an empty table gives a model without languages.
    """
    ship_package(labelled.sparkSession)
    width = cells * len(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for name, table in total.items():
                cell = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(table[cell])], names=["name", "cell", "n"])
            total.clear()

        for batch in batches:
            for part in text_steps(batch, text, STEP_BYTES):
                found = grams(part.column(text), cells)
                names = part.column(language).to_pylist()
                index = {x: i for i, x in enumerate(sorted(set(names)))}
                own = np.repeat(np.array([index[x] for x in names]), np.diff(found.first))
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(len(index) + 1))
                for name, i in index.items():
                    here = np.bincount(found.cells[order[ends[i]:ends[i + 1]]], minlength=width)
                    total[name] = total[name] + here if name in total else here
                    if len(total) >= TASK_LANGUAGES:
                        yield from send()
        give_back()
        yield from send()

    rows = labelled.filter(F.col(text).isNotNull() & F.col(language).isNotNull())
    counts = rows.select(F.col(text), F.col(language)).mapInArrow(count, "name string, cell int, n bigint")
    sums = durable(counts.groupBy("name", "cell").agg(F.sum("n").alias("n")))
    names = sums.select("name").distinct()
    n_languages = names.count()
    # one slice: its names fit in one task; more are numbered in range slices of their own
    placed = bounded_index(names, ["name"], [], "place") if n_languages <= SLICE_LANGUAGES else ordered_index(names, ["name"], None, "place")
    return LanguageModel(durable(sums.join(placed, "name").select("place", "name", "cell", "n")), n_languages, cells)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"),
             fits: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, or what ``names`` says; columns of ``docs`` with
    these names are replaced. ``fits`` names a further boolean column.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or where
    the model knows no language. The score is the posterior under equal priors, with
    the evidence of a long text averaged down to EVIDENCE n-grams; of languages that
    are equally likely the first by name wins. ``fits`` tells whether the text looks like
    its language at all: its mean log probability is nearer to that of the language's
    own n-grams than to that of unknown ones. Texts of fewer than FIT_GRAMS n-grams
    always fit. Long texts are taken whole, some at a time. Every row of the input comes
    back, repeated ones too; an empty table gives no rows.

    A model of more than SLICE_LANGUAGES languages is applied slice by slice; between
    them the rows are written with what was found so far.
    """
    added = [*names, *([fits] if fits else [])]
    columns = [c for c in docs.columns if c not in added]
    plain = docs.select(*columns)
    kinds = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), *([T.StructField(fits, T.BooleanType())] if fits else [])]
    out = T.StructType([*plain.schema.fields, *kinds])
    carried = T.StructType([*plain.schema.fields, *[T.StructField(c, T.DoubleType() if i else T.StringType()) for i, c in enumerate(_CARRIED)]])
    spark, width = docs.sparkSession, len(columns)
    rows, spent = plain, []
    for k in range(max(model.n_slices, 1)):
        shared = spark.sparkContext.broadcast(model.slice(k) if model.n_languages else None)
        last = k >= model.n_slices - 1

        def step(batch: pa.RecordBatch, shared=shared, first=k == 0, last=last):
            for part in text_steps(batch, text, STEP_BYTES):
                found = grams(part.column(text), model_cells)
                n = np.diff(found.first)
                kept = part.columns[:width]
                known = found.letters > 0
                if shared.value is None:
                    state = [np.full(len(n), UNKNOWN, dtype=object), *[np.zeros(len(n))] * 3, np.ones(len(n))]
                    known = np.zeros(len(n), dtype=bool)
                else:
                    before = None if first else [np.array(c.to_pylist(), dtype=object if i == 0 else float) for i, c in enumerate(part.columns[width:])]
                    state = _score(found, shared.value, before)
                if not last:
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, state)], names=[*part.schema.names[:width], *_CARRIED])
                    continue
                best, total, floor, top, share = state
                own = np.exp(total / np.maximum(n, 1) * np.minimum(n, EVIDENCE) - top) / share
                result = [pa.array(np.where(known, best, UNKNOWN), pa.string()), pa.array(np.where(known, own, 0.0))]
                if fits:
                    result.append(pa.array((n < FIT_GRAMS) | (total >= floor * n)))
                yield pa.RecordBatch.from_arrays([*kept, *result], names=[*part.schema.names[:width], *added])

        model_cells = model.cells
        rows = map_batches(rows, step, out if last else carried)
        if not last:
            with intermediates(spark) as written:
                rows = durable(rows)
            drop_paths(spark, spent)
            spent = written
    return rows


def in_known_language(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language the model tells with at least ``min_score``, and whose
    text fits that language, unchanged.

    Texts that are null or have no letter go, and so do texts in a language or script
    unlike all learned ones. Repeated rows stay or go together; an empty table, or a
    model without languages, keeps none. Columns may have any names.
    """
    plain, name = numbered_columns(docs)
    found = identify(plain, model, name[text], ("_language", "_score"), "_fits")
    kept = found.filter((F.col("_language") != UNKNOWN) & (F.col("_score") >= min_score) & F.col("_fits"))
    return kept.drop("_language", "_score", "_fits").toDF(*docs.columns)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that is never learned from; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold
