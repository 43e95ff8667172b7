"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint has a bit for each bit of the shingle hashes that is set in more than
half of them. Two fingerprints link if they differ in at most ``radius`` bits.

Rows with one fingerprint are linked by it already, so only distinct fingerprints are
compared. If 64 bits are cut into radius + 2 blocks, two fingerprints within the
radius agree in at least two whole blocks; each pair of blocks is a table in which
fingerprints with those blocks equal meet. There they are compared exactly: sorted by
population count, in square tiles of exclusive-or and bit counts, leaving out tiles
whose population counts differ by more than the radius. A group that is too large
for one task is cut into sub-groups by further bits, which again lose no pair.

A tile group gives a spanning forest of its links, never the pairs; components are
found over the forests by label passing with shortcuts, cut by checkpoints.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm.batches import map_batches, text_steps, texts
from moundworks.llm.rows import numbered_columns, row_keys
from moundworks.sources.store import drop_paths, durable, intermediates

BITS = 64
SHINGLE_WORDS, RADIUS = 3, 2
#: Fingerprints on a side of a tile.
TILE = 1024
#: Fingerprints of one group that are compared as they are; larger groups are cut by further bits.
GROUP_ROWS = 20_000
#: Groups up to this size are compared without tiles.
SMALL_GROUP = 24
#: Groups are gathered in so many buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: Rows of the meeting table for which there is one bucket at least.
BUCKET_ROWS = 500_000
#: Pairs of a file that a round of label passing writes.
ROWS_PER_FILE = 500_000

_LANES = np.array([int.from_bytes(bytes((v >> b) & 1 for b in range(8)), "little") for v in range(256)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first.

    Eight counters share a 64-bit word, so at most 255 hashes are added at once.
    """
    total = np.zeros(BITS, dtype=np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    starts = np.arange(0, len(hashes), 255)
    for k in range(8):
        sums = np.add.reduceat(_LANES[octets[:, k]], starts)
        total[8 * k:8 * k + 8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-shingle_words])]
    hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1:])]
    counts = bit_counts(np.array(hashes, dtype=np.uint64))
    set_ = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(set_, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str, shingle_words: int) -> DataFrame:
    """(_id, _row, _check, fp) for each row; fp is the fingerprint as a signed 64-bit integer."""
    id_type = docs.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            found = np.array([fingerprint(t, shingle_words) for t in texts(part, text)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "_row", "_check")), pa.array(found.view(np.int64))],
                                             names=["_id", "_row", "_check", "fp"])

    keyed = docs.select(F.col(key).alias("_id"), *row_keys(key, text), text)
    return map_batches(keyed, step, f"_id {id_type}, _row bigint, _check int, fp bigint")


def tile_links(fps: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of links, tile by tile. ``fps`` is sorted by population count."""
    pops = np.bitwise_count(fps).astype(np.int64)
    for a in range(0, len(fps), tile):
        left = fps[a:a + tile]
        for b in range(a, len(fps), tile):
            if pops[b] - pops[min(a + tile, len(fps)) - 1] > radius:
                break  # sorted: all later tiles are further away still
            near = np.bitwise_count(left[:, None] ^ fps[None, b:b + tile]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            yield i + a, j + b


def group_links(fps: np.ndarray, group: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links that connect what the links inside each group connect; ``fps`` is
    sorted by group, then population count.

    Groups of up to SMALL_GROUP rows are compared all at once, each row with the
    k-th after it; larger ones in tiles, whose links are merged into a spanning forest
    tile by tile, so that a dense group never holds more of them than it has rows.
    """
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    found = []
    at = np.flatnonzero(np.repeat(size, size) <= SMALL_GROUP)
    for k in range(1, SMALL_GROUP):
        at = at[at + k < len(group)]
        at = at[group[at] == group[at + k]]
        near = np.bitwise_count(fps[at] ^ fps[at + k]) <= radius
        found.append((at[near], at[near] + k))
    for low, n in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        root, own = np.arange(n), np.arange(n)
        for i, j in tile_links(fps[low:low + n], radius, tile):
            if not len(i):
                continue
            linked = np.flatnonzero(root != own)
            root = forest(np.concatenate([i, linked]), np.concatenate([j, root[linked]]), n)
        linked = np.flatnonzero(root != own)
        found.append((linked + low, root[linked] + low))
    i, j = zip(*found)
    return np.concatenate(i), np.concatenate(j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest of 0..n - 1 that each of them is linked to, by links (i, j)."""
    root = np.arange(n)
    while True:  # hook larger roots under smaller ones, then flatten
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _blocks(radius: int) -> list[list[int]]:
    """The 64 bits in radius + 2 blocks."""
    return [b.tolist() for b in np.array_split(np.arange(BITS), radius + 2)]


def _mask(bits: list[int]) -> int:
    """These bits as a signed 64-bit integer."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` that connect what the links connect.

    A group is named by a hash of the blocks that agree; should two groups get one
    name, more is compared, and the result is the same.
    """
    pairs = [(sorted(x + y), sorted(set(range(BITS)) - set(x + y))) for x, y in combinations(_blocks(radius), 2)]
    named = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_mask(same)))) for t, (same, _) in enumerate(pairs)])
    meets = durable(distinct.select("fp", F.posexplode(named).alias("t", "g")))
    sizes = meets.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    # in a group at most ``radius`` of the other bits differ: cut into radius + 1 pieces, one piece agrees
    rest = F.array(*[F.array(*[F.lit(_mask(p)) for p in np.array_split(np.array(other), radius + 1)]) for _, other in pairs])
    pieces = F.transform(F.element_at(rest, F.col("t") + 1), lambda m, i: F.xxhash64("g", i, F.col("fp").bitwiseAND(m)))
    grouped = meets.join(sizes, "g").select("fp", F.explode(F.when(F.col("n") > group_rows, pieces).otherwise(F.array("g"))).alias("g"))

    def compare(table: pa.Table) -> pa.Table:
        fps, group = table.column("fp").to_numpy().view(np.uint64), table.column("g").to_numpy()
        order = np.lexsort((np.bitwise_count(fps), group))
        i, j = group_links(fps[order], group[order], radius, tile)
        values, place = np.unique(fps[order], return_inverse=True)
        root = forest(place[i], place[j], len(values))
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": pa.array(values[linked].view(np.int64)), "b": pa.array(values[root[linked]].view(np.int64))})

    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(BUCKETS_PER_PARTITION * partitions, -(-meets.count() // BUCKET_ROWS))
    return (
        grouped.withColumn("part", F.pmod(F.col("g"), F.lit(parts)).cast("int"))
        .groupBy("part").applyInArrow(compare, "a bigint, b bigint")
    )


def _seal(pairs: DataFrame) -> tuple:
    """Number of pairs and two digests of them that do not depend on their order."""
    h = F.xxhash64("a", "b")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of the component of every node with an edge (a, b).

    Large-star and small-star rounds: every node's neighbours are hooked to the
    smallest one, which halves distances; nothing is collected and a node of many
    edges only meets min aggregates. Each round is written, which cuts the lineage,
    in as many files as its rows ask for, and the round before it is dropped. Rounds
    end when count and digests of the pairs stay as they were.
    """
    spark = edges.sparkSession
    spent: list[str] = []
    pairs = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _seal(pairs)
    while True:
        files = -(-before[0] // ROWS_PER_FILE) or 1  # a round never has more pairs than the one before it
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        with intermediates(spark) as stars:
            large = durable(large.distinct().coalesce(files))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        hooked = small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        with intermediates(spark) as written:
            pairs = durable(hooked.filter("a <> b").distinct().coalesce(files))
        drop_paths(spark, spent + stars)
        spent = written
        after = _seal(pairs)
        if after == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row: ``key``, fingerprint (16 hex digits), component_id.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest key that can be reached over links, the row's own included. Shingles
    are ``shingle_words`` words long; a shorter text is one shingle, and one without
    words (null, empty, white space) has fingerprint 0 and is linked like any other.

    Very long texts are hashed whole, shingle by shingle; a bit set in exactly half of
    them is 0. One row per input row: repeated rows come back repeated, in one component. A null
    key takes part but is no component_id unless all keys of its component are null.
    An empty table gives no rows. Other columns, whatever they are called, are not read.
    """
    prints, placed = _grouped(docs, key, text, shingle_words, radius)
    names = placed.groupBy("root").agg(F.min("low._id").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    found = prints.join(named, "fp")
    return found.select(F.col("_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, key: str, text: str, shingle_words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and of each distinct one its smallest row (low) and its component (root)."""
    prints = durable(fingerprints(docs, key, text, shingle_words))
    row = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "_check")
    smallest = durable(prints.groupBy("fp").agg(F.min(row).alias("low")))
    roots = components(links(smallest.select("fp"), radius))
    return prints, smallest.join(roots, smallest["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, unchanged: that with the smallest key (nulls last), and of
    repeated rows any one. Null and empty texts share a fingerprint, so one of them stays. An
    empty table keeps none. Columns may have any names."""
    plain, name = numbered_columns(docs)
    _, placed = _grouped(plain, name[key], name[text], shingle_words, radius)
    kept = placed.groupBy("root").agg(F.min("low").alias("low")).select("low._row", "low._check")
    keyed = plain.select("*", *row_keys(name[key], name[text])).join(kept, ["_row", "_check"])
    first = F.row_number().over(Window.partitionBy("_row", "_check").orderBy(F.lit(0)))
    return keyed.withColumn("_first", first).filter("_first = 1").drop("_row", "_check", "_first").toDF(*docs.columns)
