"""Exact duplicates by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, hot_keys, materialise, shuffle_partitions


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", carry: bool = False, head_chars: int = 32) -> DataFrame:
    """Group equal texts (after lower-casing A-Z only; null counts as empty) and mark the one that stays.

    Spark samples splitters and range-partitions the rows by their normalised text; each partition is sorted, with
    spilling, so that equal texts are adjacent, and the window compares neighbours in full. Splitters hold a text's
    first head_chars characters and a hash of the rest, so the sample that the driver sees is small however long the
    texts are, and texts that share a head are still dealt apart. keep: "max" or "min" of
    id_col stays. A text that weighs more than a mean partition is dealt over several ranges by a hash of its id, and
    its parts' results are merged afterwards, so no group has to fit in one task.

    Returns id_col, keep_id, group_size, kept and text_sha256 of every row; with carry, the whole row as a struct `row`
    and those columns, so names of its own can't clash. Null ids rank behind all others; of repeated rows with the
    same id and text exactly one is kept. An empty input gives no rows.
    """
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Equal normalised texts have equal lower() too, which is cheaper than the A-Z form; here it only finds hot texts.
    rough = F.xxhash64(F.lower(text)).alias("_h")
    hot = hot_keys(docs.select(rough, (F.octet_length(text) + F.lit(64)).cast("long").alias("w")), "_h", parts)
    rows = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else [id_col])]).alias("row"), F.col(id_col).alias("_id"), rough, ascii_lower(text).alias("_norm"))
        .join(F.broadcast(hot), "_h", "left")
        .withColumn("_split", F.col("n_salts").isNotNull())
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("n_salts")).cast("int"), F.lit(0)))
        .withColumn("_head", F.substring("_norm", 1, head_chars))
        .drop("n_salts")
        .repartitionByRange(parts, "_head", "_h", "_salt")
    )
    best = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    equal = Window.partitionBy("_head", "_h", "_norm", "_salt").orderBy(best)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parted = materialise(
        rows.withColumns({"_rank": F.row_number().over(equal), "_keep": F.first("_id").over(whole), "_size": F.count(F.lit(1)).over(whole)})
        .withColumn("text_sha256", F.sha2(F.col("_norm"), 256))
        .drop("_norm", "_salt", "_head", "_h"),
        "content-sort",
    )
    pick = F.max("_keep") if keep == "max" else F.min("_keep")
    merged = materialise(parted.where(F.col("_split") & (F.col("_rank") == 1)).groupBy("text_sha256").agg(pick.alias("_all_keep"), F.sum("_size").alias("_all_size")), "split-texts")
    out = parted.join(merged, "text_sha256", "left")
    keep_id = F.when(F.col("_split"), F.col("_all_keep")).otherwise(F.col("_keep"))
    return out.select(
        "row" if carry else "row.*",
        keep_id.alias("keep_id"),
        F.when(F.col("_split"), F.col("_all_size")).otherwise(F.col("_size")).cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
