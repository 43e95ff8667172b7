"""Merkle manifest of a table: one tree for each source, and one over their roots.

A leaf is the digest of a row. The leaves of a source are numbered in key order, and
the number in base FAN_OUT says where a leaf hangs: digit i is its place among its
siblings on level i. A block is a range of FAN_OUT^depth numbers. Rows are shuffled
once by source and block; inside a block the digit columns are then grouped away one
after the other, lowest first, and each grouping nests the structs of the level below
it. What is left is one row for each block, with its whole subtree and its digest.

Blocks are the leaves of the next tier, which is built in the same way, until every
tree is a single block. Then proofs come down again. A block's row meets the proof of
the block itself in one grouping by block (so nothing is joined, and null sources need
no care), nested transforms hand it to the nodes below, and an explode makes them
rows. A block is bounded by its depth, and so is every row, group and task.

Only column expressions are used, no Python.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.operators.ordering import ordered_index
from moundworks.sources.store import durable

#: Consecutive nodes that become one, and levels of a block: 243 nodes.
FAN_OUT, DEPTH = 3, 5
#: Columns of a row that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string, hashed: boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or ``-``; no two lists of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def nest(nodes: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """(tree, block, node): the subtree of each block of nodes (tree, pos, hash, item).

    ``pos`` counts from 0 without gaps in a tree. A run of nodes becomes the digest
    of their digests, even a run of one, unless that one is all that its tree has
    on the level: then the tree is complete, and the node stays as it is.
    """
    digits = [f"d{i}" for i in range(depth)]
    at = F.col("pos")
    df = nodes.select(
        "tree",
        F.floor(at / fan_out**depth).cast("bigint").alias("block"),
        *[(F.floor(at / fan_out**i) % fan_out).cast("int").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", "item").alias("node"),
    ).repartition("tree", "block")
    for i, digit in enumerate(digits):
        above = digits[i + 1:]
        df = df.groupBy("tree", "block", *above).agg(F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("kids"))
        only = F.size("kids") == 1
        for column in ["block", *above]:
            only = only & (F.col(column) == 0)
        hashes = F.col("kids.node.hash")
        kids = F.col("kids.node")
        df = df.select(
            "tree", "block", *above,
            F.struct(F.when(only, hashes[0]).otherwise(digest(F.array_join(hashes, ""))).alias("hash"), (~only).alias("hashed"), kids.alias("kids")).alias("node"),
        )
    return df


def tiers(nodes: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> list[DataFrame]:
    """Nested blocks of the nodes, of those blocks, and so on, until each tree is one block."""
    found = []
    while True:
        blocks = durable(nest(nodes, fan_out, depth))
        found.append(blocks)
        if not blocks.filter("block > 0").limit(1).count():
            return found
        nodes = blocks.select("tree", F.col("block").alias("pos"), "node.hash", F.col("block").alias("item"))


def proofs(blocks: DataFrame, above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, item, hash, path, top) of the nodes under ``blocks``.

    ``above`` has one row for each block: (tree, block, path, top). A path has an
    entry for each level, lowest first: the digests left and right of the node, and
    whether they were hashed.
    """
    node_type = blocks.schema["node"].dataType.simpleString()
    top_type = above.schema["top"].dataType.simpleString()
    both = blocks.select("tree", "block", "node", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast(top_type).alias("top")).union(
        above.select("tree", "block", F.lit(None).cast(node_type).alias("node"), "path", "top")
    )
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "path", "top")])
    open_ = F.array(F.struct("node", "path"))
    for _ in range(depth):
        open_ = F.flatten(F.transform(open_, _kids_of))
    return met.select("tree", "top", F.explode(open_).alias("x")).select("tree", "x.node.item", "x.node.hash", "x.path", "top")


def _kids_of(parent: Column) -> Column:
    """Each child of a node, with the path that leads from it to the top."""
    node = parent["node"]
    hashes = node["kids"]["hash"]

    def step(kid: Column, i: Column) -> Column:
        entry = F.struct(
            F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
            F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "").alias("right"),
            node["hashed"].alias("hashed"),
        )
        return F.struct(kid.alias("node"), F.concat(F.array(entry), parent["path"]).alias("path"))

    return F.transform(node["kids"], step)


def descend(built: list[DataFrame], above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proofs of the lowest nodes, from those of the top blocks (block 0 of each tree)."""
    for i, blocks in reversed(list(enumerate(built))):
        found = proofs(blocks, above, depth)
        above = found.select("tree", F.col("item").alias("block"), "path", "top") if i else found
    return above


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.when(x["hashed"], digest(x["left"], acc, x["right"])).otherwise(acc))


def siblings(path: Column) -> Column:
    """Digests of a path's siblings, level by level, left to right, in one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def manifest(rows: DataFrame, key: str = "doc_id", source: str = "source", covered: tuple[str, ...] = COVERED, extra: Column | None = None,
             fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """Leaf, tree and proof of every row: ``key``, ``source``, leaf, extra, path, subroot, root.

    A leaf covers the ``covered`` columns, a null as ``-``. A tree holds the rows of
    one source in the order of ``key`` (nulls first; rows that repeat a key in the
    order of their leaves), and a last tree the subroots in the order of ``source``
    (null first, by UTF-8 bytes). ``path`` leads from the leaf over subroot to root.
    ``extra`` is a column expression over a row that is carried along.

    One row per input row: repeated rows are leaves of their own. A source of one row
    has that leaf as its subroot, and a table of one source that subroot as its root;
    null sources are a source. An empty table gives no rows. Texts of any length are
    hashed whole, once. Other columns, whatever they are called, are not read.
    """
    leaf = digest(*[field(F.col(c)) for c in covered])
    carried = F.lit(None).cast("string") if extra is None else extra
    leaves = rows.select(F.col(source).alias("tree"), F.col(key).alias("key"), leaf.alias("hash"), carried.alias("extra"))
    placed = ordered_index(leaves, ["key", "hash"], ["tree"], "pos")
    built = tiers(placed.select("tree", "pos", "hash", F.struct("key", "extra").alias("item")), fan_out, depth)

    subroots = built[-1].select("tree", "node.hash")
    ranked = ordered_index(subroots, ["tree"], None, "pos")
    whole = tiers(ranked.select(F.lit(0).alias("tree"), "pos", "hash", F.struct("tree").alias("item")), fan_out, depth)
    none = F.array().cast(_PATH)
    root = whole[-1].select("tree", "block", none.alias("path"), F.col("node.hash").alias("top"))
    sources = descend(whole, root, depth)
    above = sources.select("item.tree", F.lit(0).cast("bigint").alias("block"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"))

    found = descend(built, above, depth)
    return found.select(
        F.col("item.key").alias(key), F.col("tree").alias(source), F.col("hash").alias("leaf"), F.col("item.extra").alias("extra"),
        "path", "top.subroot", "top.root",
    )


def audited(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", covered: tuple[str, ...] = COVERED,
            every: int = 2, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """The manifest, and a check of it against rows that were changed.

    A row is changed where ``every`` divides the unsigned CRC-32 of its key in
    decimal: its text loses its line feeds (a null text stays, and so does a row
    with a null key). Returns ``key``, leaf, subroot, root, proof_sha256 (digest of the
    siblings on the way up, of nothing where there are none), folded_root (the root
    that the row as it is now and the siblings as they were lead to) and verified.
    """
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    plain = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    changed = digest(*[field(plain if c == text else F.col(c)) for c in covered])
    touched = F.when(chosen & F.contains(F.col(text), F.lit("\n")), changed)
    found = manifest(docs, key, source, covered, touched, fan_out, depth)
    folded = fold(F.col("path"), F.coalesce("extra", "leaf"))
    return found.select(
        key, "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
