"""Importance resampling of documents towards a target collection, by hashed n-grams.

An n-gram's bucket is the CRC-32 of its words, joined by one space, modulo the number of
buckets. The words of many texts are laid out with one space after each, and this
buffer is scanned once: the running CRC after every byte is kept. Appending bytes acts
on a CRC register as a linear map over GF(2), so what came before a substring cancels
out of two running CRCs: crc(a..b) = R(b) + shift by b - a bytes of R(a). An n-gram of
any length thus costs one shift, however long it is, and texts need no buffer of their own.

The scan works on rows of ROW_BYTES bytes in step; the registers at the row ends are
then carried over by shifts in powers of two, which is the same law once more.

Tasks add up their buckets and send one dense row each, so counts are summed by bucket
over as many rows as there are tasks. Gains are one number for each bucket, which is all
that is sent back; a second scan turns them into a weight for each document.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.batches import give_back, map_batches, text_steps
from moundworks.llm.words import NOT_ALNUM, Split, split
from moundworks.operators.ordering import ordered_index
from moundworks.sources.store import durable, ship_package

BUCKETS, WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Fixed value: the generator polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Bytes of a row of the scan.
ROW_BYTES = 256

_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """Register after one byte, for each value of (register xor byte) in its low eight bits."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


_BYTE = _byte_table()


def _shift_tables(levels: int) -> list[np.ndarray]:
    """Tables (4, 256) that shift a register by 2^k zero bytes, for k below ``levels``."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = _BYTE[bits & np.uint32(0xFF)] ^ (bits >> np.uint32(8))  # of each single bit, under one byte
    out = []
    for _ in range(levels):
        table = np.zeros((4, 256), dtype=np.uint32)
        for octet in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                table[octet, has] ^= images[8 * octet + bit]
        out.append(table)
        images = _apply(table, images)  # twice as far
    return out


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    octets = np.ascontiguousarray(register, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return table[0][octets[:, 0]] ^ table[1][octets[:, 1]] ^ table[2][octets[:, 2]] ^ table[3][octets[:, 3]]


_SHIFTS = _shift_tables(40)


def shifted(register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after ``lengths`` zero bytes."""
    register = register.astype(np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero((lengths >> k) & 1)
        register[on] = _apply(_SHIFTS[k], register[on])
    return register


def running_crcs(data: np.ndarray) -> np.ndarray:
    """Register (from 0, not inverted) before the first byte and after each byte."""
    n = len(data)
    rows = max(1, -(-n // ROW_BYTES))
    padded = np.zeros(rows * ROW_BYTES, dtype=np.uint8)
    padded[:n] = data
    steps = np.ascontiguousarray(padded.reshape(rows, ROW_BYTES).T).astype(np.uint32)
    register = np.zeros(rows, dtype=np.uint32)
    for column in steps:  # all rows by one byte; a column becomes the registers after it
        register = _BYTE[(register ^ column) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
        column[:] = register
    carry, reach, level = register.copy(), 1, ROW_BYTES.bit_length() - 1
    while reach < rows:
        carry[reach:] ^= _apply(_SHIFTS[level], carry[:-reach])
        reach, level = 2 * reach, level + 1
    carry = np.concatenate([np.zeros(1, dtype=np.uint32), carry[:-1]])
    for column in steps:
        carry = _BYTE[carry & np.uint32(0xFF)] ^ (carry >> np.uint32(8))
        column ^= carry
    out = np.zeros(n + 1, dtype=np.uint32)
    out[1:] = steps.T.reshape(-1)[:n]
    return out


def substring_crcs(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges, each from two running CRCs."""
    return running[end] ^ shifted(running[start] ^ _ONES, end - start) ^ _ONES


def _normalised(words: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each; where each starts and ends there."""
    lengths = words.end - words.start
    start = np.cumsum(lengths + 1) - (lengths + 1)
    source = np.arange(int(lengths.sum()) + len(lengths)) + np.repeat(words.start - start, lengths + 1)
    data = np.append(words.data, np.uint8(0))[np.minimum(source, len(words.data))]
    data[start + lengths] = 32
    return data, start, start + lengths


def ngram_buckets(column: pa.Array, words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every run of 1 to ``words`` words, row after row; runs and words of each row."""
    found = split(column, NOT_ALNUM, lower=True)
    data, start, end = _normalised(found)
    running, row = running_crcs(data), found.rows()
    cells, owners = [], []
    for n in range(1, words + 1):
        first = np.arange(max(len(start) - n + 1, 0))
        first = first[row[first] == row[first + n - 1]]
        cells.append((substring_crcs(running, start[first], end[first + n - 1]) % np.uint32(buckets)).astype(np.int64))
        owners.append(row[first])
    cell, owner = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return cell[order], np.bincount(owner, minlength=len(column)), found.counts


def bucket_counts(texts: DataFrame, text: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_steps(batch, text):
                total += np.bincount(ngram_buckets(part.column(text), words, buckets)[0], minlength=buckets)
        give_back()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    sums = texts.select(F.col(text)).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares in the target and the raw texts, rounded down."""
    n, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    ratios = (float((int(t) + 1) * (all_raw + n)) / float((int(s) + 1) * (all_target + n)) for s, t in zip(raw, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(key: str | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate, rounded down, drawn by a digest of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``key``, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    id_type = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            cell, n, n_words = ngram_buckets(part.column(text), words, len(shared.value))
            total = np.add.reduceat(np.append(shared.value[cell], 0), np.minimum(np.cumsum(n) - n, len(cell)))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            drawn = np.array([noise(k, seed) for k in part.column("_key").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(pa.array(c.astype(np.int64)) for c in (n_words, n, weight, weight + drawn))],
                names=["_id", "n_words", "n_features", "weight", "score"])

    keyed = docs.select(F.col(key).alias("_id"), F.col(key).cast("string").alias("_key"), F.col(text).alias(text))
    return map_batches(keyed, step, f"_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, buckets: int = BUCKETS,
              min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Score of every row and the rank of the rows that are drawn: ``key``, n_features, weight, score, rank.

    Features are the runs of 1 to ``words`` words, repeats counted, over every text of
    ``docs`` and of ``target``. A row's weight is the mean gain of its features, rounded
    down, and its score is that with Gumbel noise, so the highest scores are a sample
    without replacement by weight. Of the rows with at least ``min_words`` words,
    ``percent`` in a hundred are drawn, ties to the smaller key; others have no rank.

    Null and empty texts have no features and weight 0; a null key draws its noise by
    an empty text, and comes before other keys in a tie. Rows that repeat a key share
    its noise, and each takes a rank of its own. Long texts are taken whole. An empty
    table gives no rows; with an empty target every word is rated by its rarity. Other
    columns, whatever they are called, are not read.
    """
    gain = gains(bucket_counts(docs, text, words, buckets), bucket_counts(target, text, words, buckets))
    rows = durable(scored(docs, gain, key, text, words, seed))
    enough = rows.filter(F.col("n_words") >= min_words)
    n_drawn = percent * enough.count() // 100
    ranked = ordered_index(enough, [F.desc("score"), F.col("_id").asc_nulls_first()], None, "_place", stored=True)
    place = F.when(F.col("_place") < n_drawn, F.col("_place") + 1)
    columns = [F.col("_id").alias(key), "n_features", "weight", "score"]
    short = rows.filter(F.col("n_words") < min_words)
    return ranked.select(*columns, place.alias("rank")).union(short.select(*columns, F.lit(None).cast("bigint").alias("rank")))
