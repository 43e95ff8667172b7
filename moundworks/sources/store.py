"""Where data is kept: durable intermediate tables, scratch paths, layer tables."""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the
    setting has to be there, as a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="moundworks-"))
        current = sc.getCheckpointDir()
    return current


#: Intermediate paths of each application, until ``release``.
_INTERMEDIATE: dict[str, list[str]] = {}


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result has several readers: it is computed once, every reader
    sees the same rows even after executors were lost, and each reader scans
    only the columns it needs. ``release`` drops these tables again.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Drop the intermediate tables and scratch paths of this application, once no
    result that reads them is needed any more; ``plans.layers.forget`` also drops
    the layers that read them. Returns how many there were."""
    return drop_paths(spark, _INTERMEDIATE.pop(spark.sparkContext.applicationId, []))


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete intermediate tables and scratch paths; returns how many there were."""
    known = _INTERMEDIATE.get(spark.sparkContext.applicationId, [])
    for name in paths:
        fs, path = _file_system(spark, name)
        fs.delete(path, True)
        if name in known:
            known.remove(name)
    return len(paths)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the names of the intermediate tables and scratch paths made in the block.
    Pass them to ``drop_paths`` once nothing reads them any more, as the output that
    was computed from them is written."""
    app = spark.sparkContext.applicationId
    before, made = set(_INTERMEDIATE.get(app, [])), []
    yield made
    made += [name for name in _INTERMEDIATE.get(app, []) if name not in before]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never an existing one. ``release`` drops it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _INTERMEDIATE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _file_system(spark, name)
    return fs.exists(path)


def qualified(spark: SparkSession, name: str) -> str:
    """The path with its scheme. A path without one means the default file system, as in
    Spark's own readers and writers, not the disk of whoever opens it."""
    fs, path = _file_system(spark, name)
    return fs.makeQualified(path).toString()


def open_folder(path: str):
    """(file system, path in it) of a ``qualified`` path, for reading and writing inside tasks."""
    from pyarrow.fs import FileSystem
    if ":/" not in path:
        raise ValueError(f"{path} has no scheme; pass it through qualified() on the driver")
    return FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))


def changed(spark: SparkSession, name: str) -> tuple[int, int]:
    """Latest change and total length of a file, or of the files of a folder."""
    fs, path = _file_system(spark, name)
    if not fs.exists(path):
        return 0, 0
    files = fs.listStatus(path)
    return max((f.getModificationTime() for f in files), default=0), sum(f.getLen() for f in files)


def replace_path(spark: SparkSession, fresh: str, target: str) -> None:
    """Put the table at ``fresh`` in the place of ``target``.

    The old table is moved aside first and dropped last. If the swap stops in
    between, ``recover_path`` brings the old table back.
    """
    recover_path(spark, target)
    fs, path = _file_system(spark, target)
    _, new = _file_system(spark, fresh)
    _, old = _file_system(spark, _aside(target))
    if fs.exists(path) and not fs.rename(path, old):
        raise OSError(f"could not move {target} aside")
    if not fs.rename(new, path):
        fs.rename(old, path)
        raise OSError(f"could not put the new table at {target}")
    fs.delete(old, True)


def recover_path(spark: SparkSession, target: str) -> bool:
    """Finish or undo a swap that was cut off; True if the old table came back."""
    fs, path = _file_system(spark, target)
    _, old = _file_system(spark, _aside(target))
    if not fs.exists(old):
        return False
    if fs.exists(path):  # the new table was in place already
        fs.delete(old, True)
        return False
    return fs.rename(old, path)


def _aside(target: str) -> str:
    return f"{target.rstrip('/')}.old"


_SHIPPED: set[str] = set()
_SHIPPING = Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may have been started in a folder
    or on a machine where it can't be imported. Once per application, whichever thread asks first."""
    with _SHIPPING:
        if spark.sparkContext.applicationId not in _SHIPPED:
            _ship(spark)


def _ship(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="moundworks-zip-")), "moundworks.zip")  # the driver's own copy
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)


def write_table(df: DataFrame, path: str, order: list | None = None) -> None:
    """Replace a layer table with ``df`` as snappy Parquet.

    ``order`` sorts inside each file only: enough for min/max skipping, without
    a global sort of the table.
    """
    out = df.sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)


def save_as_table(df: DataFrame, name: str) -> None:
    """CREATE OR REPLACE of a catalog table."""
    df.write.mode("overwrite").option("compression", "snappy").saveAsTable(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register(df: DataFrame, view: str) -> DataFrame:
    """Expose ``df`` to SQL under ``view``."""
    df.createOrReplaceTempView(view)
    return df


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, so that a reader can split the files; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
