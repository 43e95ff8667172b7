"""Removal of word passages that occur more than once, by fixed-block anchors.

A passage of W words that starts anywhere contains one whole block of
B = (W + 1) // 2 words at a multiple of B. So:

1. *Anchors.* Every document is cut into blocks at multiples of B; these are the
   index. Every rolling window of B words of every document probes it. A block that
   nothing but itself probes can't lie in a repeated passage. Keys travel packed, by
   bucket, 4 bytes for each probe; an accidental match only costs work in step 2.
2. *Extension.* Around each hit block, exactly the W-word windows that contain it are
   compared with those of all other hits, by keys of 64 bits within a bucket that
   further bits of the key select (about 80 bits on a large cluster). Windows that
   occur twice are joined into maximal repeats.
3. *Cut.* Documents with repeats are joined to their spans and cut.

Both comparisons first settle what a task sees twice by itself, and send each key at
most twice (step 1) or once (step 2). A passage that a third of all documents share
thus costs a bucket a few keys per task, not a row per document. A fixed-size bitmap
keeps documents without any hit out of the shuffles of text; when it fills up, more
texts are shuffled, and results stay the same.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.batches import give_back, map_batches, records, text_steps, texts
from moundworks.llm.rows import numbered_columns, row_keys
from moundworks.llm.words import split, window_keys, window_rows
from moundworks.sources.store import durable, ship_package

#: Words of a passage that must not repeat.
PASSAGE_WORDS = 35
#: Probes that a task gathers before it packs them by bucket.
FLUSH_KEYS = 1_000_000
#: Buckets of probes for each shuffle partition: a group in memory is a part of a partition.
BUCKETS_PER_PARTITION = 4
#: Bytes of text for which there is one bucket at least, so that groups in memory stay of one size.
BUCKET_BYTES = 64 << 20
#: Bits of the bitmap of documents with hits (8 MB, whatever the size of the input).
BITMAP_BITS = 1 << 26


def row_bitmap(rows: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A set of ``_row`` values as a bitmap of fixed size, put together by bit_or on the executors."""
    slot = F.pmod(F.col("_row"), F.lit(bits))
    words = (
        rows.groupBy(F.floor(slot / 32).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 32).cast("int"))).alias("set"))
        .toArrow()
    )
    bitmap = np.zeros(bits // 32, dtype=np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("set").to_numpy().astype(np.uint32)
    return bitmap


def in_bitmap(bitmap: np.ndarray, rows: np.ndarray) -> np.ndarray:
    slot = np.mod(rows, len(bitmap) * 32)
    return (bitmap[slot // 32] >> (slot % 32).astype(np.uint32)) & 1 == 1


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, slices of columns) of arrays that are sorted by bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    for low, high in zip(bounds, bounds[1:]):
        yield (int(bucket[low]), *(c[low:high] for c in columns))


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All values of packed arrays."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)


_ANCHORS = pa.schema([
    ("bucket", pa.int32()), ("probes", pa.binary()), ("block_key", pa.binary()),
    ("block_row", pa.binary()), ("block_check", pa.binary()), ("block_at", pa.binary()),
    ("hit_row", pa.binary()), ("hit_check", pa.binary()), ("hit_at", pa.binary()),
])
_HITS = pa.schema([("_row", pa.int64()), ("_check", pa.int32()), ("at", pa.int32())])


def _anchor_rows(batch_parts, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pack what one task has gathered: probes by bucket, and its blocks, settled or not."""
    keys, indexed, rows, checks, at = (np.concatenate(x) for x in zip(*batch_parts))
    spread = (keys >> np.uint64(32)) % np.uint64(buckets)
    code = (spread << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    ordered = np.sort(code)
    twice = np.ones(len(ordered), dtype=bool)
    twice[2:] = ordered[2:] != ordered[:-2]
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    own = code[indexed]  # rows, checks and at belong to these
    place = np.searchsorted(again, own)
    settled = place < len(again)
    settled[settled] = again[place[settled]] == own[settled]
    probes = ordered[twice]
    open_ = np.flatnonzero(~settled)
    open_ = open_[np.argsort(own[open_], kind="stable")]
    waiting = {b: x for b, *x in by_bucket(own[open_] >> np.uint64(32), own[open_], rows[open_], checks[open_], at[open_])}
    done = np.flatnonzero(settled)
    out = []
    for b, mine in by_bucket(probes >> np.uint64(32), probes):
        k, r, c, a = waiting.get(b, [np.zeros(0, dtype=np.uint64)] * 4)
        out.append((b, mine.astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes(), r.astype(np.int64).tobytes(),
                    c.astype(np.int32).tobytes(), a.astype(np.int32).tobytes(), None, None, None))
    for i in range(0, len(done), 100_000):
        d = done[i:i + 100_000]
        out.append(((len(keys) + i // 100_000) % buckets, None, None, None, None, None,
                    rows[d].tobytes(), checks[d].tobytes(), at[d].tobytes()))
    for i in range(0, len(out), 64):
        yield records(_ANCHORS, **{f.name: list(c) for f, c in zip(_ANCHORS, zip(*out[i:i + 64]))})


def anchor_hits(docs: DataFrame, text: str, width: int, buckets: int) -> DataFrame:
    """(_row, _check, at): word positions of the blocks that occur at another place too.

    ``docs`` has _row, _check and the text.
    """
    block = (width + 1) // 2

    def probe(batches):
        parts, gathered = [], 0
        for batch in batches:
            for part in text_steps(batch, text):
                found = split(part.column(text))
                starts = window_rows(found.first, block)
                row = found.rows()[starts] if len(starts) else starts
                long_enough = found.counts[row] >= width
                starts, row = starts[long_enough], row[long_enough]
                if not len(starts):
                    continue
                keys = window_keys(found.keys(), block)[starts]
                at = (starts - found.first[row]).astype(np.int32)
                indexed = np.flatnonzero(at % block == 0)
                ids, checks = (part.column(c).to_numpy()[row[indexed]] for c in ("_row", "_check"))
                parts.append((keys, indexed + gathered, ids, checks, at[indexed]))
                gathered += len(keys)
                if gathered >= FLUSH_KEYS:
                    yield from _anchor_rows(parts, buckets)
                    parts, gathered = [], 0
        if parts:
            yield from _anchor_rows(parts, buckets)
        parts.clear()
        give_back()

    def settle(table: pa.Table) -> pa.Table:
        probes = np.sort(joined(table.column("probes"), np.uint32))
        again = probes[1:][probes[1:] == probes[:-1]]
        key = joined(table.column("block_key"), np.uint32)
        place = np.searchsorted(again, key)
        hit = place < len(again)
        hit[hit] = again[place[hit]] == key[hit]
        columns = {}
        for name, dtype in (("row", np.int64), ("check", np.int32), ("at", np.int32)):
            late = joined(table.column(f"block_{name}"), dtype)[hit]
            columns[name] = np.concatenate([late, joined(table.column(f"hit_{name}"), dtype)])
        return pa.Table.from_arrays([pa.array(c) for c in columns.values()], schema=_HITS)

    packed = docs.mapInArrow(probe, "bucket int, probes binary, block_key binary, block_row binary, block_check binary, "
                                    "block_at binary, hit_row binary, hit_check binary, hit_at binary")
    return packed.groupBy("bucket").applyInArrow(settle, "_row bigint, _check int, at int")


_WINDOWS = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int32()), ("probes", pa.binary()), ("keys", pa.binary()), ("order", pa.binary()),
    ("rows", pa.binary()), ("checks", pa.binary()), ("lengths", pa.binary()), ("blocks", pa.binary()), ("n_blocks", pa.binary()),
    ("settled", pa.binary()),
])


def window_starts(lengths: np.ndarray, n_blocks: np.ndarray, blocks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows of ``width`` words whose first whole block is hit, in order."""
    block = (width + 1) // 2
    doc = np.repeat(np.arange(len(lengths)), n_blocks)
    start = blocks[:, None] + np.arange(1 - block, 1)
    doc = np.repeat(doc[:, None], block, axis=1)
    inside = (start >= 0) & (start <= lengths[doc] - width)
    return doc[inside], start[inside]


def repeated_spans(docs: DataFrame, text: str, width: int, buckets: int) -> DataFrame:
    """(_row, _check, spans): merged word spans covered by repeated windows, as packed int32 pairs.

    ``docs`` has _row, _check, the text, ``hits``, the sorted positions of its hit blocks, and
    ``copies``, the number of rows that are equal in id and text and stand here once.
    """
    def extend(key: tuple, table: pa.Table) -> pa.Table:
        give_back()  # what the group before left
        chunk = key[0].as_py()
        table = table.sort_by([("_row", "ascending"), ("_check", "ascending")]).combine_chunks()
        rows, checks, copies = (table.column(c).to_numpy() for c in ("_row", "_check", "copies"))
        keys, other, lengths, owners, n_before = [], [], [], [], 0
        for batch in table.select([text, "hits"]).to_batches():
            for part in text_steps(batch, text):
                found = split(part.column(text))
                words = found.keys()
                hits = part.column("hits")
                n_blocks = pa.compute.list_value_length(hits).to_numpy()
                doc, start = window_starts(found.counts, n_blocks, hits.flatten().to_numpy(), width)
                at = found.first[doc] + start
                keys.append(window_keys(words, width)[at])
                other.append(window_keys(words, width, second=True)[at])
                lengths.append(found.counts)
                owners.append(doc + n_before)
                n_before += part.num_rows
        keys, other, lengths, owners = (np.concatenate(x) for x in (keys, other, lengths, owners))
        order = np.lexsort((keys, other))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (keys[order][1:] != keys[order][:-1]) | (other[order][1:] != other[order][:-1])
        opens = np.flatnonzero(first)
        places = np.add.reduceat(copies[owners][order], opens) if len(order) else copies[:0]  # of each key
        settled = np.zeros(len(order), dtype=bool)
        settled[order] = np.repeat(places > 1, np.diff(np.append(opens, len(order))))
        bucket = (other % np.uint64(buckets)).astype(np.int32)
        told = order[opens[places > 1]]  # one of each settled key is enough for the others
        told = told[np.argsort(bucket[told], kind="stable")]
        probes = {b: k for b, k in by_bucket(bucket[told], keys[told])}
        open_ = np.flatnonzero(~settled)
        open_ = open_[np.argsort(bucket[open_], kind="stable")]
        asked = {b: (k, o) for b, k, o in by_bucket(bucket[open_], keys[open_], open_)}
        out = []
        for b in sorted({*probes, *asked}):
            k, o = asked.get(b, (keys[:0], open_[:0]))
            steps = np.diff(o, prepend=0)
            small = steps.max(initial=0) < 1 << 16
            out.append((b, chunk, probes.get(b, keys[:0]).tobytes(), k.tobytes(), bytes([2 if small else 4]) + steps.astype(np.uint16 if small else np.uint32).tobytes(),
                        None, None, None, None, None, None))
        hits = table.column("hits").combine_chunks()
        out.append((chunk % buckets, chunk, None, None, None, rows.tobytes(), checks.tobytes(), lengths.astype(np.int32).tobytes(),
                    pa.compute.list_flatten(hits).to_numpy().astype(np.int32).tobytes(),
                    pa.compute.list_value_length(hits).to_numpy().astype(np.int32).tobytes(), np.packbits(settled).tobytes()))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for f, c in zip(_WINDOWS, zip(*out))], schema=_WINDOWS)

    def settle(table: pa.Table) -> pa.Table:
        asked = table.filter(pa.compute.is_valid(table.column("keys")))
        everything = np.sort(np.concatenate([joined(asked.column("probes"), np.uint64), joined(asked.column("keys"), np.uint64)]))
        again = everything[1:][everything[1:] == everything[:-1]]
        chunks, found = [], []
        for chunk, keys, order in zip(*(asked.column(c).to_pylist() for c in ("chunk", "keys", "order"))):
            keys = np.frombuffer(keys, dtype=np.uint64)
            at = np.cumsum(np.frombuffer(order, dtype=np.uint16 if order[0] == 2 else np.uint32, offset=1), dtype=np.int64)
            place = np.searchsorted(again, keys)
            hit = place < len(again)
            hit[hit] = again[place[hit]] == keys[hit]
            if hit.any():
                chunks.append(chunk)
                found.append(at[hit].astype(np.int32).tobytes())
        rest = table.filter(pa.compute.is_null(table.column("keys"))).drop_columns(["bucket", "probes", "keys", "order"])
        lines = pa.table({"chunk": pa.array(chunks, pa.int32()), "found": pa.array(found, pa.binary())})
        return pa.concat_tables([lines, rest], promote_options="default")

    def merge(table: pa.Table) -> pa.Table:
        about = table.filter(pa.compute.is_valid(table.column("rows")))
        rows, checks, lengths, blocks, n_blocks = (
            joined(about.column(c), t) for c, t in (("rows", np.int64), ("checks", np.int32), ("lengths", np.int32), ("blocks", np.int32), ("n_blocks", np.int32)))
        doc, start = window_starts(lengths, n_blocks, blocks, width)
        repeated = np.unpackbits(joined(about.column("settled"), np.uint8))[:len(doc)].astype(bool)
        repeated[joined(table.column("found"), np.int32)] = True
        doc, start = doc[repeated], start[repeated]
        opens = np.ones(len(doc), dtype=bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
        low = np.flatnonzero(opens)
        high = np.append(low[1:], len(doc)) - 1 if len(low) else low
        pairs = np.column_stack([start[low], start[high] + width]).astype(np.int32)
        out = [(rows[d], checks[d], p.tobytes()) for d, p in by_bucket(doc[low], pairs)]
        r, c, s = zip(*out) if out else ((), (), ())
        return pa.table({"_row": pa.array(r, pa.int64()), "_check": pa.array(c, pa.int32()), "spans": pa.array(s, pa.binary())})

    windows = ("bucket int, chunk int, probes binary, keys binary, order binary, rows binary, checks binary, lengths binary, "
               "blocks binary, n_blocks binary, settled binary")
    verdicts = "chunk int, found binary, rows binary, checks binary, lengths binary, blocks binary, n_blocks binary, settled binary"
    return (
        docs.withColumn("chunk", F.pmod(F.col("_row"), F.lit(buckets)).cast("int"))
        .groupBy("chunk").applyInArrow(extend, windows)
        .groupBy("bucket").applyInArrow(settle, verdicts)
        .groupBy("chunk").applyInArrow(merge, "_row bigint, _check int, spans binary")
    )


def kept_text(text: str, spans: np.ndarray) -> str:
    """The text without the words of the spans and the white space after them."""
    raw = text.encode()
    found = split(pa.array([text]))
    out, at = [], 0
    for low, high in spans:
        out.append(raw[at:found.start[low]])
        at = found.start[high] if high < len(found.start) else found.end[high - 1]
    return b"".join([*out, raw[at:]]).decode()


def kept_words(text: str | None, spans: np.ndarray) -> tuple[int, int, str]:
    """Words, words removed, and SHA-256 of the kept words joined by one space."""
    words = (text or "").encode().split()
    n = len(words)
    for low, high in spans[::-1]:
        del words[low:high]
    return n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = PASSAGE_WORDS) -> tuple[DataFrame, np.ndarray]:
    """Spans of repeated passages per document with any, by row key, and the bitmap of those documents."""
    ship_package(docs.sparkSession)
    keyed = docs.select(text, *row_keys(key, text))
    size = keyed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    hits = durable(anchor_hits(keyed, text, width, BUCKETS_PER_PARTITION * partitions))
    listed = hits.groupBy("_row", "_check").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    candidates = only_rows(keyed, row_bitmap(hits))
    once = candidates.groupBy("_row", "_check").agg(F.first(text).alias(text), F.count("*").alias("copies"))
    spans = durable(repeated_spans(once.join(listed, ["_row", "_check"]), text, width, partitions))
    return spans, row_bitmap(spans)


def only_rows(keyed: DataFrame, bitmap: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose ``_row`` is in the bitmap, or is not."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def step(batch: pa.RecordBatch):
        yield batch.filter(pa.array(in_bitmap(shared.value, batch.column("_row").to_numpy()) == inside))

    return map_batches(keyed, step, keyed.schema)


def with_spans(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Documents that may have repeats, with a column _spans (null if they have none);
    all documents with their _row; and the bitmap of the former. Only they are shuffled."""
    spans, bitmap = passages(docs, key, text, width)
    keyed = docs.select("*", *row_keys(key, text))
    found = only_rows(keyed, bitmap).join(spans.withColumnRenamed("spans", "_spans"), ["_row", "_check"], "left")
    return found.drop("_row", "_check"), keyed.drop("_check"), bitmap


def _spans_of(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", dtype=np.int32).reshape(-1, 2) for x in part.column("_spans").to_pylist()]


def removed_words(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = PASSAGE_WORDS) -> DataFrame:
    """Per document: n_words, n_removed and kept_sha256 after the removal of repeated passages.

    A word goes if it lies in a window of ``width`` words whose sequence also starts
    anywhere else, in the same document or another; all occurrences go. One row per
    input row. Repeated rows are several places, so they lose all of their windows. A
    null or empty text has no words and keeps none; texts of fewer words than a
    window stay whole, very long ones are taken whole. Windows are equal if two 64-bit
    keys of their words are. A null key is a key like any other. An empty table gives no
    rows. Other columns, whatever they are called, are not read.
    """
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    id_type = docs.schema[key].dataType.simpleString()

    found, every, bitmap = with_spans(docs.select(key, text), key, text, width)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def measured(part: pa.RecordBatch, spans: list[np.ndarray]) -> pa.RecordBatch:
        digest = records(schema, **{f.name: c for f, c in zip(schema, zip(*map(kept_words, texts(part, text), spans)))})
        return pa.RecordBatch.from_arrays([part.column(key), *digest.columns], names=[key, *schema.names])

    def cut(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            yield measured(part, _spans_of(part))

    def whole(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            part = part.filter(pa.array(~in_bitmap(shared.value, part.column("_row").to_numpy())))
            if part.num_rows:
                yield measured(part, [np.zeros((0, 2), dtype=np.int32)] * part.num_rows)

    out = f"`{key}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string"
    return map_batches(found.select(key, text, "_spans"), cut, out).unionByName(map_batches(every.select(key, text, "_row"), whole, out))


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; all other columns as they are.

    White space between kept words stays as it was. A document without repeats, or
    with a null or empty text, is unchanged; one that is all repeats keeps an empty text, and
    so do repeated rows of a window's length or more. Very long texts are cut whole. An
    empty table gives no rows. Columns may have any names.
    """
    plain, name = numbered_columns(docs)
    column, columns = name[text], plain.columns
    found, every, bitmap = with_spans(plain, name[key], column, width)
    rest = only_rows(every, bitmap, inside=False)

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, column):
            cut = [t if t is None or not len(s) else kept_text(t, s) for t, s in zip(texts(part, column), _spans_of(part))]
            at = part.schema.get_field_index(column)
            part = part.set_column(at, part.schema.field(at), pa.array(cut, type=part.schema.field(at).type))
            yield part.select(columns)

    return map_batches(found, step, plain.schema).unionByName(rest.select(*columns)).toDF(*docs.columns)
