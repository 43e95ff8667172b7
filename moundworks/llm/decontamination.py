"""Benchmark passages in documents, by a prefix-filtered set join.

An item is cut into windows of ``width`` words (one window if it has fewer). A window
is the set of its shingles; shingles are ordered by rarity, that is by how many
documents hold them. To hold a window whole, a document must hold every shingle of
it, so the necessary prefix is its single rarest one. The join runs on that token:

1. Count, over all documents, those that hold each shingle of the items. A bitmap of
   fixed size drops other shingles in the scan, so what is counted is the items'
   vocabulary, once per batch.
2. Probe: documents' shingles that are some window's prefix (again by a bitmap of
   fixed size) are emitted with their position and the words around, and joined to
   the windows with that prefix. The shingle's place in the window gives the only
   place where the window can start (positional bound), which must lie inside the
   document (length bound).
3. Verify: the words at that place equal the window's words, one by one.

The item side is joined as a table, not collected; Spark broadcasts it if it is
small. A prefix that a third of all documents hold is a key of one or few item rows,
whose large side AQE splits.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.batches import map_batches, text_steps
from moundworks.llm.rows import numbered_columns, row_keys
from moundworks.llm.words import NOT_ALNUM, Split, split, window_keys, window_rows
from moundworks.sources.store import durable

WINDOW_WORDS, SHINGLE_WORDS = 10, 3
#: Bits of the bitmaps that drop shingles in the scan (2 MB, whatever the number of items).
BITMAP_BITS = 1 << 24


def shingles(found: Split, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of every shingle of ``size`` words that lies in one row."""
    at = window_rows(found.first, size)
    return at, window_keys(words, size)[at].view(np.int64)


def _tokens(found: Split, low: int, high: int) -> str:
    raw = found.data
    return " ".join(raw[a:b].tobytes().decode() for a, b in zip(found.start[low:high], found.end[low:high]))



def item_windows(items: DataFrame, key: str, text: str, width: int, shingle_words: int) -> DataFrame:
    """(item_id, win, size, shingle, offset): each shingle of each window; windows of items
    shorter than a shingle have one shingle of that many words."""
    id_type = items.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text, 1 << 18):
            found = split(part.column(text), NOT_ALNUM, lower=True)
            words = found.keys()
            ids = part.column(key)
            keys = {n: window_keys(words, n).view(np.int64) for n in range(1, shingle_words + 1)}
            rows, wins, sizes, sh, off = [], [], [], [], []
            for r, (low, high) in enumerate(zip(found.first, found.first[1:])):
                size = min(width, high - low)
                n = min(shingle_words, size)
                for start in range(low, high - size + 1) if size else ():
                    win = _tokens(found, start, start + size)
                    for k in range(size - n + 1):
                        rows.append(r)
                        wins.append(win)
                        sizes.append(size)
                        sh.append(keys[n][start + k])
                        off.append(k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(wins, pa.string()), pa.array(sizes, pa.int32()), pa.array(sh, pa.int64()), pa.array(off, pa.int32())],
                names=["item_id", "win", "size", "shingle", "offset"])

    out = f"item_id {id_type}, win string, size int, shingle bigint, offset int"
    return map_batches(items.select(key, text), step, out)


def key_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """The values of a bigint column as a bitmap of fixed size."""
    slot = F.pmod(F.col(column), F.lit(bits))
    found = (
        keys.groupBy(F.floor(slot / 32).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 32).cast("int"))).alias("set"))
        .toArrow()
    )
    bitmap = np.zeros(bits // 32, dtype=np.uint32)
    bitmap[found.column("word").to_numpy()] = found.column("set").to_numpy().astype(np.uint32)
    return bitmap


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & (len(bitmap) * 32 - 1)
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def document_counts(docs: DataFrame, text: str, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, docs): documents that hold each shingle which the bitmap may know."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def step(batch: pa.RecordBatch):
        held = []
        for part in text_steps(batch, text):
            found = split(part.column(text), NOT_ALNUM, lower=True)
            words = found.keys()
            row = found.rows()
            for n in sizes:
                at, keys = shingles(found, words, n)
                known = _marked(shared.value, keys)
                pairs = np.unique(np.column_stack([keys[known], row[at[known]]]), axis=0)
                held.append(pairs[:, 0])
        shingle, count = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(count.astype(np.int64))], names=["shingle", "n"])

    counted = map_batches(docs.select(text), step, "shingle bigint, n bigint")
    return counted.groupBy("shingle").agg(F.sum("n").alias("docs"))


def probes(docs: DataFrame, text: str, bitmap: np.ndarray, width: int, sizes: list[int], columns: str) -> DataFrame:
    """_row, _check, n_words of every row, and for each shingle that may be a prefix its
    place (at), key, and the words from ``low`` on around it, as lists."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("low", pa.int32()), ("around", pa.string())]))

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            found = split(part.column(text), NOT_ALNUM, lower=True)
            words = found.keys()
            row = found.rows()
            hits: list[list] = [[] for _ in range(part.num_rows)]
            for n in sizes:
                at, keys = shingles(found, words, n)
                for i in np.flatnonzero(_marked(shared.value, keys)):
                    r = row[at[i]]
                    begin, end = found.first[r], found.first[r + 1]
                    low, high = max(begin, at[i] - (width - n)), min(end, at[i] + width)
                    hits[r].append({"at": at[i] - begin, "shingle": keys[i], "low": low - begin, "around": _tokens(found, low, high)})
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c != text), pa.array(found.counts, pa.int64()), pa.array(hits, kind)],
                names=[*(c for c in part.schema.names if c != text), "n_words", "hits"])

    out = f"{columns}, n_words bigint, hits array<struct<at: int, shingle: bigint, low: int, around: string>>"
    return map_batches(docs, step, out)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS, with_items: bool = True) -> DataFrame:
    """Per document: ``key``, n_words, n_hit, n_items, items_sha256, contaminated and, ``with_items``, items.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not
    none, is one window. A word of the document inside any occurrence of a window is
    hit; items are those with a window that occurs, sorted as strings.

    One row per input row, repeated rows and null keys too. Null and empty texts have
    no words and no hits; null and empty items have no windows. Repeated item rows
    count as one item; a null item id counts as the text "null". With no items nothing
    is hit; an empty table gives no rows. Texts of any length are taken whole. Other
    columns, whatever they are called, are not read.
    """
    scanned, verdicts, lists = _verdicts(docs, items, key, text, item_key, item_text, width, shingle_words)
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    told = lists if with_items else lists.drop("items")
    return scanned.join(verdicts, ["_row", "_check"], "left").join(told, "held", "left").select(
        F.col("_id").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *([names.alias("items")] if with_items else []),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", width: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without any word that ``contamination`` calls hit, unchanged.

    Null and empty texts stay, as does everything where there are no items; repeated
    rows stay or go together. Columns may have any names.
    """
    plain, name = numbered_columns(docs)
    _, verdicts, _ = _verdicts(plain, items, name[key], name[text], item_key, item_text, width, shingle_words)
    keyed = plain.select("*", *row_keys(name[key], name[text]))
    return keyed.join(verdicts.select("_row", "_check"), ["_row", "_check"], "left_anti").drop("_row", "_check").toDF(*docs.columns)


def _verdicts(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, width: int,
              shingle_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its n_words; the rows with a hit: _row, _check, n_hit, held; and the
    items of each value of held: items, n_items, items_sha256.

    Windows with the same items are one class, and ``held`` names a set of classes, so a
    window that all items share costs a document one class, and its list of items is
    put together once for all documents that hold the same.
    """
    windows = durable(item_windows(items, item_key, item_text, width, shingle_words))
    windows = windows.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle_words))).distinct().collect())  # 1 to shingle_words
    keyed = docs.select(text, *row_keys(key, text), F.col(key).alias("_id"))
    counts = document_counts(docs, text, key_bitmap(windows, "shingle"), sizes)
    # the rarest shingle of each window; one that no document holds rules its window out
    ranked = (
        windows.join(counts, "shingle")
        .groupBy("win", "size")
        .agg(F.min_by(F.struct("shingle", "offset"), F.struct("docs", "shingle", "offset")).alias("p"), F.count_distinct("shingle").alias("known"))
    )
    whole = windows.groupBy("win", "size").agg(F.count_distinct("shingle").alias("all"))
    prefixes = durable(
        ranked.join(whole, ["win", "size"]).filter("known = all").select("win", "size", F.col("p.shingle"), F.col("p.offset"))
    )
    id_type = docs.schema[key].dataType.simpleString()
    scanned = durable(probes(keyed, text, key_bitmap(prefixes, "shingle"), width, sizes, f"_row bigint, _check int, _id {id_type}"))
    hits = scanned.filter(F.size("hits") > 0).select("_row", "_check", "n_words", F.explode("hits").alias("h"))
    start = F.col("at") - F.col("offset")
    placed = (
        hits.select("_row", "_check", "n_words", "h.*").join(prefixes, "shingle")
        .filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .withColumn("begin", start)
        .filter(F.array_join(F.slice(F.split("around", " "), F.col("begin") - F.col("low") + 1, F.col("size")), " ") == F.col("win"))
        .select("_row", "_check", "begin", "size", "win")
    )
    found = durable(placed)
    owners = windows.select("win", "item_id").distinct().groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    owners = durable(owners.withColumn("class", F.sha2(F.to_json("items"), 256)))
    hold = (
        found.select("_row", "_check", "win").distinct().join(owners.select("win", "class"), "win")
        .groupBy("_row", "_check").agg(F.sort_array(F.collect_set("class")).alias("classes"))
        .withColumn("held", F.sha2(F.array_join("classes", ""), 256))
    )
    hold = durable(hold)
    classes = owners.groupBy("class").agg(F.first("items").alias("items"))
    lists = (
        hold.groupBy("held").agg(F.first("classes").alias("classes")).select("held", F.explode("classes").alias("class")).join(classes, "class")
        .select("held", F.explode("items").alias("item")).groupBy("held").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumns({"n_items": F.size("items").cast("bigint"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    )
    spans = found.groupBy("_row", "_check").agg(F.sort_array(F.collect_set(F.struct("begin", "size"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["begin"] + s["size"] - F.greatest(acc["end"], s["begin"]))).alias("n"),
            F.greatest(acc["end"], s["begin"] + s["size"]).alias("end")),
        lambda acc: acc["n"].cast("bigint"))
    verdicts = spans.join(hold.select("_row", "_check", "held"), ["_row", "_check"])
    return scanned, verdicts.select("_row", "_check", covered.alias("n_hit"), "held"), lists
