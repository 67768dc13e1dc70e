"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.session import delete, materialise, scratch, setting, ship_package, temporary_tables  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of DataFrames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Called by a task at its end: memory that its worker no longer uses goes back to the system, so that what one
    stage needed doesn't add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def discard(table: DataFrame) -> None:
    """Delete a table that materialise() wrote, once all that was derived from it is written as well."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        delete(spark, files[0].rpartition("/")[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts, which have as many bytes as characters, take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hot_keys(weighted: DataFrame, key: str, partitions: int, *extra: Column) -> DataFrame:
    """Keys that weigh more than a mean partition, with the number of salts that each needs.

    weighted has the columns key and w; extra are further aggregates per key. At most `partitions` keys can be hot,
    as each holds over 1/partitions of the total, so the result may be broadcast whatever the input's size.
    """
    sums = materialise(weighted.groupBy(key).agg(F.sum("w").alias("w"), *extra), "weights")
    total = sums.agg(F.sum("w")).first()[0] or 0
    share = F.col("w") * float(partitions) / float(max(total, 1))
    return sums.where(share > 1).withColumn("n_salts", F.ceil(share * 2).cast("int")).drop("w")
