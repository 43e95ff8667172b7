"""Reading large JSON arrays in pieces.

A file that is one JSON array can't be cut at line ends, so Spark reads it in one task.
Here it is cut at any byte. A first pass tells for each piece what it does to the state
of a reader: whether a string is open at its end, and by how much the bracket depth has
changed, for each state that the piece might start in. Put together piece by piece, that
gives the state at every start. In a second pass each piece gives the objects that start
in it, and reads on beyond its end for the last one.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moundworks.sources.store import _file_system, open_folder, qualified, ship_package

#: Bytes of a piece, and of what is read beyond it at a time.
PIECE_BYTES, MORE_BYTES = 32 << 20, 1 << 20
#: States of a reader: outside of strings, inside one, and inside one right after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2

_SIGNS = re.compile(rb'["\\{}\[\]]')
_OPEN, _CLOSE = b"{[", b"}]"


def brackets(data: bytes, state: int, ends: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """(position, sign) of the brackets outside of strings; the last state is added to ``ends``."""
    inside, escaped = state != OUTSIDE, 0 if state == ESCAPED else -1
    for m in _SIGNS.finditer(data):
        at, sign = m.start(), data[m.start()]
        if inside:
            if at == escaped:
                continue
            if sign == 0x5C:
                escaped = at + 1
            elif sign == 0x22:
                inside = False
        elif sign == 0x22:
            inside = True
        elif sign != 0x5C:
            yield at, sign
    if ends is not None:
        ends.append((ESCAPED if escaped == len(data) else INSIDE) if inside else OUTSIDE)


def effect(data: bytes) -> list[int]:
    """[state, depth change] after the bytes, for each state before them, one after the other."""
    out = []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        ends: list[int] = []
        depth = sum(1 if sign in _OPEN else -1 for _, sign in brackets(data, state, ends))
        out += [ends[0], depth]
    return out


def objects(data: bytes, state: int, depth: int, base: int, more) -> Iterator[bytes]:
    """The objects of depth ``base`` that start in the bytes. ``more(n)`` gives n bytes from
    their end on, or what there is of them."""
    start = -1
    for at, sign in brackets(data, state):
        if sign in _OPEN:
            if depth == base and sign == 0x7B and start < 0:
                start = at
            depth += 1
        else:
            depth -= 1
            if depth == base and start >= 0:
                yield data[start:at + 1]
                start = -1
    if start < 0:
        return
    size = MORE_BYTES
    while True:  # the last object goes on beyond the piece
        rest = more(size)
        text, level = data[start:] + rest, 0
        for at, sign in brackets(text, OUTSIDE):
            level += 1 if sign in _OPEN else -1
            if level == 0:
                yield text[:at + 1]
                return
        if len(rest) < size:
            yield text  # cut off: no parser takes it
            return
        size *= 4


def _pieces(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    """(file, start, stop) of all files under ``path``, in pieces, a few to a task; and the number of tasks."""
    fs, folder = _file_system(spark, path)
    listed = [s for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.isFile() and s.getPath().getName()[0] not in "._"]
    files = [(qualified(spark, s.getPath().toString()), s.getLen()) for s in listed]
    if not files:
        raise FileNotFoundError(path)
    rows = spark.createDataFrame(files, "file string, length bigint").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start")
    n = max(1, min(sum(-(-length // size) for _, length in files), 10_000))
    return rows.select("file", "length", starts).withColumn("stop", F.least(F.col("start") + size, "length")).drop("length").repartition(n, "file", "start"), n


def _opened(file: str):
    store, name = open_folder(file)
    return store.open_input_file(name)


def records(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(record) the text of every object of the JSON arrays in the files under ``path``; a file
    that holds one object gives that one. Other elements of an array are passed over."""
    ship_package(spark)
    pieces, tasks = _pieces(spark, path, piece_bytes)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for file, start, stop in batch[["file", "start", "stop"]].itertuples(index=False):
                with _opened(file) as f:
                    data = f.read_at(stop - start, start)
                told.append((effect(data), next((sign for _, sign in brackets(data, OUTSIDE)), 0)))
            yield batch.assign(effect=[e for e, _ in told], first=[b for _, b in told])

    def link(table: pd.DataFrame) -> pd.DataFrame:
        """State, depth and depth of records at the start of each piece of one file."""
        table = table.sort_values("start")
        base = 1 if next((b for b in table["first"] if b), 0) == 0x5B else 0
        state, depth, rows = OUTSIDE, 0, []
        for row in table.itertuples(index=False):
            rows.append((row.file, row.start, row.stop, state, depth, base))
            state, change = row.effect[2 * state:2 * state + 2]
            depth += change
        return pd.DataFrame(rows, columns=["file", "start", "stop", "state", "depth", "base"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with _opened(row.file) as f:
                    data = f.read_at(row.stop - row.start, row.start)
                    found = []
                    for text in objects(data, row.state, row.depth, row.base, lambda n, f=f, at=row.stop: f.read_at(n, at)):
                        found.append(text.decode("utf-8", "replace"))
                        if len(found) == 1000:
                            yield pd.DataFrame({"record": found})
                            found = []
                if found:
                    yield pd.DataFrame({"record": found})

    looked = pieces.mapInPandas(look, "file string, start bigint, stop bigint, effect array<bigint>, first int")
    linked = looked.groupBy("file").applyInPandas(link, "file string, start bigint, stop bigint, state int, depth bigint, base int")
    spread = linked.repartition(tasks, "file", "start")
    return spread.mapInPandas(cut, "record string")


def read(spark: SparkSession, path: str, schema: StructType, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of the objects of JSON arrays, with the columns of ``schema``."""
    parsed = records(spark, path, piece_bytes).select(F.from_json("record", schema).alias("r"))
    return parsed.select("r.*")
