"""Versioned snapshots of Q-tables, and a log of what made them."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from trajq import schemas


class Note(NamedTuple):
    """Which batch of which source made a version, and from which parent (-1: from nothing)."""

    version: int
    parent: int
    batch: int
    source: str


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def _found(spark: SparkSession, pattern: str) -> list:
    """The paths of a glob, by the file system alone: no Spark job."""
    fs, where, _ = _fs(spark, pattern)
    return [s.getPath() for s in fs.globStatus(where) or []]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were written whole, in order."""
    return sorted(int(p.getParent().getName()[2:]) for p in _found(spark, f"{path.rstrip('/')}/v=*/_SUCCESS"))


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v={version}"


def _table(folder: str) -> str:
    return "q_" + hashlib.md5(folder.encode()).hexdigest()


def save_q(q: DataFrame, path: str, version: int, buckets: int | None = None) -> None:
    """Write q as one version. Versions are folders of their own, as Spark must not overwrite what it is reading.

    With buckets, rows are written in so many buckets by (state, action), sorted: what is joined by these with the table
    that load_q gives is shuffled to the buckets, and the table itself is not. How many there are is kept beside them."""
    spark, folder = q.sparkSession, _folder(path, version)
    rows = q.select("state", "action", "q")
    if buckets is None:
        rows.write.mode("overwrite").parquet(folder)
        return
    spark.sql(f"DROP TABLE IF EXISTS {_table(folder)}")
    dealt = rows.repartition(buckets, "state", "action").write.mode("overwrite").format("parquet").option("path", folder)
    dealt.bucketBy(buckets, "state", "action").sortBy("state", "action").saveAsTable(_table(folder))
    fs, where, _ = _fs(spark, f"{folder}/_buckets_{buckets}")
    fs.create(where, True).close()


def load_q(spark: SparkSession, path: str, version: int | None = None, schema: str = schemas.Q) -> DataFrame:
    """A version, by default the latest; an empty table where there is none."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return spark.createDataFrame([], schema)
        version = known[-1]
    folder = _folder(path, version)
    marks = _found(spark, f"{folder}/_buckets_*")
    if not marks:
        return spark.read.schema(schema).parquet(folder)
    n = int(marks[0].getName().rpartition("_")[2])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(folder)} ({schema}) USING parquet CLUSTERED BY (state, action) SORTED BY (state, action) INTO {n} BUCKETS LOCATION '{folder}'")
    return spark.table(_table(folder))


def source_id(source: str) -> str:
    return hashlib.md5(source.encode()).hexdigest()


def notes(spark: SparkSession, path: str) -> list[Note]:
    """The log, by version: empty files whose names are the notes, so that one listing reads all of it."""
    found = [p.getName().split("_") for p in _found(spark, f"{path.rstrip('/')}/log/*_*_*_*")]
    return sorted(Note(int(v), int(parent), int(batch), source) for v, parent, batch, source in found)


def write_note(spark: SparkSession, path: str, note: Note) -> None:
    fs, where, _ = _fs(spark, f"{path.rstrip('/')}/log/{'_'.join(map(str, note))}")
    fs.create(where, True).close()


def retire(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the `keep` newest whole versions, what older writes left unfinished, and the notes of versions that
    are gone, but for each source's newest: a source comes back with its last batch at most."""
    whole = versions(spark, path)
    oldest = whole[-keep:][0] if whole else 0
    fs, _, new_path = _fs(spark, path)
    for p in _found(spark, f"{path.rstrip('/')}/v=*"):
        if int(p.getName()[2:]) < oldest:
            spark.sql(f"DROP TABLE IF EXISTS {_table(_folder(path, int(p.getName()[2:])))}")
            fs.delete(p, True)
    log = notes(spark, path)
    newest = {n.source: n.version for n in log}
    for n in log:
        if n.version < oldest and n.version != newest[n.source]:
            fs.delete(new_path(f"{path.rstrip('/')}/log/{'_'.join(map(str, n))}"), False)
