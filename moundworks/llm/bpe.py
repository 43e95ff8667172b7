"""Byte-level BPE: encoding by merge ranks, decoding by vocabulary strings.

The tokenizer file is read, never trained. A text is cut at special tokens and into
pieces by the pre-tokenizer's pattern. A piece starts as a doubly linked list of byte
symbols; a priority queue holds the rank and place of every adjacent pair that merges,
lowest rank first, then leftmost. Popped entries whose symbols have changed since are
skipped. The cost is n log n in the length of a piece, however long it is.

Pieces repeat, so each worker keeps the tokens of short pieces; the memory is bounded.
"""

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from moundworks.llm.batches import give_back, text_steps, texts
from moundworks.sources.store import ship_package

#: Fixed value: the pre-tokenizer pattern of the byte-level vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers, and the longest piece worth it.
REMEMBERED, SHORT = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary and merges of one tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [vocab[s] for s in symbols]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self._known: dict[str, list[int]] = {}

    @cached_property
    def _pieces(self):
        return regex.compile(PATTERN).findall

    @cached_property
    def _specials(self):
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # a stale entry: one of its symbols has been merged
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [t for t in ids if t >= 0]

    def _piece(self, piece: str) -> list[int]:
        tokens = self.merge(piece.encode())
        if len(piece) <= SHORT:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = tokens
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """Tokens of a whole text; special tokens in it are recognised. A null text has none."""
        out: list[int] = []
        known, extend = self._known, out.extend
        for k, part in enumerate(self._specials.split(text or "") if self._specials else [text or ""]):
            if k % 2:
                out.append(self.special[part])
                continue
            for piece in self._pieces(part):
                tokens = known.get(piece)
                extend(self._piece(piece) if tokens is None else tokens)
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", errors="replace")

    def forget(self) -> None:
        """Give back the memory of the pieces; workers outlive their tasks."""
        self._known.clear()


_LOADED: dict[str, Tokenizer] = {}


def shipped(name: str) -> Tokenizer:
    """The tokenizer file sent along by ``encode_documents``, loaded once per worker."""
    if name not in _LOADED:
        _LOADED[name] = Tokenizer(SparkFiles.get(name))
    return _LOADED[name]


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                     with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``key`` and the ``carry`` columns, n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit integers), decoded_sha256 (of the decoded text), and the
    token ids if asked for. A null or empty text has no tokens; a very long one is encoded
    whole, and of equal merge ranks the leftmost pair goes first. Every row comes back,
    repeated rows and null keys too; an empty table gives no rows. Other columns,
    whatever they are called, are not read. The tokenizer file is sent to the
    executors by Spark, so only the driver needs to reach its path.
    """
    sc = docs.sparkSession.sparkContext
    name = tokenizer_path.rsplit("/", 1)[-1]
    sc.addFile(tokenizer_path)
    kept = docs.select(key, *carry).schema.fields
    out = T.StructType([
        *kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped(name)
        try:
            for batch in batches:
                yield from encoded(bpe, batch)
        finally:
            bpe.forget()
            give_back()

    def encoded(bpe: Tokenizer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batch, text):
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for t in texts(part, text):
                ids = bpe.encode(t)
                packed = np.array(ids, dtype="<u4")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(packed.astype(np.int32))
            columns = [part.column(f.name) for f in kept]
            columns += [pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    ship_package(docs.sparkSession)
    return docs.select(*dict.fromkeys([key, *carry, text])).mapInArrow(run, out)
