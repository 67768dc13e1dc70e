"""Session helpers: shipping the package to workers, and tables in the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}
_open = threading.local()  # a stream's batches run in a thread of their own


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that workers need no installed copy."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "trajq.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, where that is unset, a
    temporary folder of this application stands in; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which temporary_tables() deletes."""
    path = scratch(spark, name)
    for made in _scopes():
        made.append(path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    return write_table(df, temporary(df.sparkSession, name), **options)


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write df to path, replacing what an earlier try left there, and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def whole_tables(spark: SparkSession, path: str) -> set[str]:
    """The names of the tables under path that were written to their end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return {s.getPath().getParent().getName() for s in found or []}


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for as long as a job takes; the caller's value comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """What materialise() writes and temporary() names inside is deleted at the end, but what is taken from the list."""
    made: list[str] = []
    scopes = _scopes()
    scopes.append(made)
    try:
        yield made
    finally:
        scopes[:] = [s for s in scopes if s is not made]
        for path in made:
            delete(spark, path)
