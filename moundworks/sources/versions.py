"""Tables that change by commits: replaced whole, or upserted bucket by bucket.

A table is a folder. ``data`` holds folders of Parquet files, each written once and
never changed. ``commits`` holds a small JSON file for each version, which names the
folder of every bucket. The file with the highest number is the table; it appears by one
rename, so a reader sees the old rows or the new ones, and a job that stops in
between leaves the old ones. Rows belong to buckets by a hash of their key, so an upsert
reads and writes only the buckets that its rows fall into.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moundworks.sources.store import _file_system

#: Buckets of a keyed table. More make an upsert touch less of it, and a commit longer.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed in the meantime; nothing was changed."""


class Version:
    """One state of a table: its number, schema, keys, and the folder of each bucket."""

    def __init__(self, number: int, schema: str, keys: list[str], buckets: int, folders: dict[int, str]):
        self.number, self.schema, self.keys, self.buckets, self.folders = number, schema, keys, buckets, folders

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema, "keys": self.keys, "buckets": self.buckets,
                           "folders": {str(b): f for b, f in sorted(self.folders.items())}})

    @staticmethod
    def from_json(text: str) -> "Version":
        v = json.loads(text)
        return Version(v["number"], v["schema"], v["keys"], v["buckets"], {int(b): f for b, f in v["folders"].items()})


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _file_system(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of the table, or the one with this number; None if there is none yet."""
    known = _numbers(spark, path)
    if not known or number is not None and number not in known:
        return None
    text = spark.read.text(f"{path}/commits/{(number or known[-1]):010d}.json", wholetext=True).first()[0]
    return Version.from_json(text)


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Put the version's file in place by a rename that fails if there is one already."""
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame([(version.to_json(),)], "line string").coalesce(1).write.text(draft)
    fs, folder = _file_system(spark, draft)
    source = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    _, target = _file_system(spark, f"{path}/commits/{version.number:010d}.json")
    fs.mkdirs(target.getParent())
    done = not fs.exists(target) and fs.rename(source, target)
    fs.delete(folder, True)
    if not done:
        raise Conflict(f"version {version.number} of {path} was written by another job")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def _write(path: str, df: DataFrame, keys: list[str], buckets: int) -> dict[int, str]:
    """Write rows by bucket below a new folder; returns the folder of each bucket that has rows."""
    spark, token = df.sparkSession, uuid.uuid4().hex
    placed = df.withColumn("_bucket", _bucket(keys, buckets)).hint("rebalance", F.col("_bucket"))
    placed.write.partitionBy("_bucket").option("compression", "snappy").parquet(f"{path}/data/{token}")
    fs, folder = _file_system(spark, f"{path}/data/{token}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n.split("=")[1]): f"{token}/{n}" for n in names if n.startswith("_bucket=")}


def replace(df: DataFrame, path: str, keys: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """Make ``df`` the table; returns the number of the version. Readers of the version
    before keep their files until ``vacuum``."""
    keys = keys or []
    buckets = buckets if keys else 1
    before = current(df.sparkSession, path)
    number = before.number + 1 if before else 1
    folders = _write(path, df, keys, buckets)
    _commit(df.sparkSession, path, Version(number, df.schema.json(), keys, buckets, folders))
    return number


def upsert(new: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Merge rows into a keyed table: ``merge(old, new)`` gets the rows of the buckets that
    ``new`` falls into, and only these are written again. Returns the number of the version."""
    spark = new.sparkSession
    before = current(spark, path)
    if before is None or not before.keys:
        raise ValueError(f"{path} is no keyed table")
    touched = [r[0] for r in new.select(_bucket(before.keys, before.buckets)).distinct().collect()]  # at most ``buckets``
    if not touched:
        return before.number
    old = _rows(spark, path, before, touched)
    folders = _write(path, merge(old, new.select(*old.columns)), before.keys, before.buckets)
    kept = {b: f for b, f in before.folders.items() if b not in touched}
    _commit(spark, path, Version(before.number + 1, before.schema, before.keys, before.buckets, {**kept, **folders}))
    return before.number + 1


def _rows(spark: SparkSession, path: str, version: Version, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    folders = [f"{path}/data/{f}" for b, f in sorted(version.folders.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the one with this number. The frame stays with
    that version, whatever is committed later."""
    version = current(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path} has no version {number or ''}".rstrip())
    return _rows(spark, path, version)


def read_key(spark: SparkSession, path: str, values: dict) -> DataFrame:
    """The rows with this key, from its bucket alone."""
    version = current(spark, path)
    schema = StructType.fromJson(json.loads(version.schema))
    typed = [F.lit(values[k]).cast(schema[k].dataType) for k in version.keys]
    bucket = spark.range(1).select(F.pmod(F.xxhash64(*typed), F.lit(version.buckets))).first()[0]
    rows = _rows(spark, path, version, [bucket])
    for k, v in zip(version.keys, typed):
        rows = rows.filter(F.col(k).eqNullSafe(v))
    return rows


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop all versions but the newest ``keep``, and the files that none of those names,
    left-overs of stopped jobs included. Not while another job writes. Returns the number
    of folders dropped."""
    numbers = _numbers(spark, path)
    used = {f for n in numbers[-keep:] for f in current(spark, path, n).folders.values()}
    for n in numbers[:-keep]:
        fs, file = _file_system(spark, f"{path}/commits/{n:010d}.json")
        fs.delete(file, False)
    dropped = 0
    fs, data = _file_system(spark, f"{path}/data")
    for token in (s.getPath() for s in fs.listStatus(data)) if fs.exists(data) else []:
        inner = [s.getPath() for s in fs.listStatus(token)]
        stale = [b for b in inner if f"{token.getName()}/{b.getName()}" not in used]
        if len(stale) == len(inner):
            fs.delete(token, True)
        else:
            for b in stale:
                fs.delete(b, True)
        dropped += sum(b.getName().startswith("_bucket=") for b in stale)
    return dropped
