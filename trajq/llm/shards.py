"""Dealing documents into shards of nearly equal bytes, equal texts together."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, temporary_tables

#: Groups of fewer bytes (a power of two) are classed by their exact size; larger ones by size classes, so many to each power of two.
EXACT, STEPS = 1 << 16, 1024
#: All cells (a class, or a part of a crowded one) number at most so many above the number of classes.
PARTS = 1 << 16
#: A class of more groups than this is crowded.
CROWDED = 100_000


def size_class(size: Column) -> Column:
    """The class of a group's size: itself below EXACT, else one of STEPS equal classes between two powers of two.

    Classes rise with the size, and there are at most EXACT + 47 * STEPS of them (113,664) for any long.
    """
    power = F.length(F.bin(size)) - 1
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS).cast("long")
    return F.when(size < EXACT, size).otherwise(F.lit(EXACT) + (power - (EXACT.bit_length() - 1)) * STEPS + step).cast("long")


class Shards:
    """The shards' loads in a heap; cells of equal groups are given to the least-loaded, the lowest of equal ones first."""

    def __init__(self, loads: Sequence[float]):
        self.heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(self.heap)

    def give(self, count: int, size: float) -> list[int]:
        """How many of `count` groups of one size each shard gets, as if they came one by one.

        However large the count, all but about two a shard are given at once: up to the level that the shards would be
        filled to if groups could be cut, less two groups, none of these could go to another shard.
        """
        won = [0] * len(self.heap)
        if count > 2 * len(self.heap):
            level = self._level(count * size)
            for i, (load, shard) in enumerate(self.heap):
                won[shard] = max(0, int((level - load) / size) - 2)
                self.heap[i] = (load + won[shard] * size, shard)
            heapq.heapify(self.heap)
        for _ in range(count - sum(won)):
            load, shard = self.heap[0]
            won[shard] += 1
            heapq.heapreplace(self.heap, (load + size, shard))
        return won

    def _level(self, volume: float) -> float:
        """How high the lowest shards stand once `volume` is poured over them."""
        loads, below = sorted(load for load, _ in self.heap), 0
        for n, load in enumerate(loads, 1):
            below += load
            level = (below + volume) / n
            if n == len(loads) or level <= loads[n]:
                break
        return level


def _cuts(cells: list[tuple], loads: Sequence[float]) -> list[tuple]:
    """cells of (class, part, number of groups, their bytes), the largest first, as (class, part, cuts): of the cell's
    groups in order, shard i has those from cuts[i] to before cuts[i + 1]."""
    shards, out = Shards(loads), []
    for cls, part, n, total in cells:
        edges = [0]
        for won in shards.give(n, total // n if total % n == 0 else total / n):
            edges.append(edges[-1] + won)
        out.append((cls, part, edges))
    return out


def _give(groups: DataFrame, loads: Sequence[float]) -> DataFrame:
    """groups(key, bytes, cls, part) with their shards, those of larger classes given first."""
    cells = groups.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    cells = sorted(map(tuple, cells), key=lambda c: (-c[0], c[1]))
    schedule = groups.sparkSession.createDataFrame(_cuts(cells, loads), "cls long, part long, cuts array<long>")
    ranked = groups.withColumn("_rank", F.row_number().over(Window.partitionBy("cls", "part").orderBy("key")) - 1)
    shard = F.size(F.filter("cuts", lambda c: c <= F.col("_rank"))) - 1  # the last cut at or below the rank
    return ranked.join(schedule, ["cls", "part"]).select("key", "bytes", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with a shard, such that the shards' bytes are nearly equal and equal texts share a shard.

    A row's size is its text's bytes in UTF-8 plus 1. Rows of equal texts are a group, its size their sum. Groups go, the
    largest first, to the least-loaded shard (longest processing time first; Graham, 1969). Groups of one size are
    interchangeable, so the driver sees a count per size only: exact sizes below EXACT bytes, classes of 0.1 % width
    above, at most 113,664 of them; a class with very many groups is dealt over parts of its own, at most PARTS in all,
    so that no task ranks more than its share. Large groups are placed first and their true loads measured; the exact
    sizes then level these. A shard's rows are numbered by the pieces of a written table, not in one task.

    Returns id_col, size, text_crc32 (unsigned, of the UTF-8 bytes), law ("bytes"), shard, slot (0, 1, ... in each shard)
    and grown_shard (null under this law). A null text counts as empty and is in the group of empty texts; long texts are
    read whole; repeated rows are rows of their own, in one shard; null ids are kept; an empty table gives no rows; other
    columns are not read, so their names can't clash. One group larger than a shard's share has a shard to itself.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")]
    with temporary_tables(docs.sparkSession) as made:
        rows = materialise(docs.select(*columns), "sizes")
        # Equal texts have equal keys; texts that share a key by chance merely stay together.
        groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("cls", size_class(F.col("bytes")))
        groups = materialise(groups, "groups")
        counts = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
        n = F.col("n")
        wanted = F.least(F.ceil(n / CROWDED), F.ceil(n * F.lit(PARTS / max(groups.count(), 1))))
        parts = materialise(counts.select("cls", wanted.cast("long").alias("parts")), "classes")
        celled = groups.join(F.broadcast(parts), "cls").withColumn("part", F.pmod(F.col("key"), F.col("parts"))).drop("parts")  # at most 113,664 classes
        large = materialise(_give(celled.where(F.col("cls") >= EXACT), [0] * n_shards), "large")
        loads = {r.shard: r.load for r in large.groupBy("shard").agg(F.sum("bytes").alias("load")).collect()}
        small = _give(celled.where(F.col("cls") < EXACT), [loads.get(i, 0) for i in range(n_shards)])
        given = materialise(large.unionByName(small).select("key", "shard"), "given")
        placed = materialise(rows.join(given, "key").select("id", "size", "text_crc32", "shard", F.spark_partition_id().alias("piece")), "placed")
        made.pop()
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "piece").orderBy(F.col("id").asc_nulls_last(), "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(within) - 1).join(pieces, ["shard", "piece"])
    slot = (F.col("first") + F.col("nth")).cast("long").alias("slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
