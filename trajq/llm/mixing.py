"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: So many shards of a source are one task's at most: beyond, quotas go to groups of them first.
GROUPED = 1024


def capped_targets(sources: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """sources(source, source_size) with target: shares of the whole by weight, none above max_repeat times its size.

    Weights go round by source in code-point order, null last. What capped sources leave is shared again by weight:
    in order of cap over weight, the capped ones are a prefix, so two cumulative sums give the fixed point.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rest = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(every)
    return (
        sources.withColumns({"_weight": weight, "_cap": cap, "_total": F.sum(F.col("source_size").cast("double")).over(every)})
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_capped", F.col("_ratio") * onward <= F.col("_total") - before)
        .withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * rest / F.nullif(open_weight, F.lit(0.0))))
        .select("source", "source_size", "target")
    )


def sainte_lague(parties: DataFrame, group: Sequence[str], party: Sequence[str], votes: str, seats: str, out: str) -> DataFrame:
    """Adds out: the integer number of `seats` of each group that a party gets by highest quotients votes / (2k + 1).

    The rule's divisor lies between V/(M + n/2) and V/(M - n/2) for n parties, M seats and V votes. Seats sure at the
    upper bound are given at once; only those between the bounds, 2n in all, are ranked.
    """
    whole = Window.partitionBy(*group)
    share = F.col(votes).cast("double") / F.nullif(F.col("_votes"), F.lit(0.0))
    surely = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5))
    perhaps = F.greatest(surely, F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5))
    bounds = (
        parties.withColumns({"_votes": F.sum(F.col(votes).cast("double")).over(whole), "_n": F.count(F.lit(1)).over(whole)})
        .withColumns({"_sure": F.coalesce(surely, F.lit(0)).cast("long"), "_most": F.coalesce(perhaps, F.lit(0)).cast("long")})
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    )
    order = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in party])
    ks = F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1)).otherwise(F.array().cast("array<long>"))
    ranked = (
        bounds.withColumn("_k", F.explode_outer(ks))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_won", (F.row_number().over(order) <= F.col("_open")) & F.col("_k").isNotNull())
    )
    own = [c for c in parties.columns]
    return ranked.groupBy(*own).agg((F.max("_sure") + F.sum(F.col("_won").cast("long"))).alias(out))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    block_words: int = 16,
    shard_words: int = 65536,
    seed: int = 20,
    carry: bool = False,
) -> DataFrame:
    """How many words of each document a mix takes that gives every source its target.

    Blocks of block_words words are apportioned to the sources by highest quotients of their targets, then each
    source's blocks to its shards by their words (to groups of them first, where there are more than GROUPED). What a shard can't hold goes to the source's other shards in a further
    round. A shard's documents, in an order seeded by their ids, make a stream that repeats up to max_repeat times; its
    quota of blocks is cut from the stream's head, so that a document is taken whole zero or more times but for one at
    the cut. A source has a shard for each shard_words of its own words (by a hash of the id), so a large one is no
    single task's work and a small one isn't spread thin. The windows over all sources, a row each, are one task's, as are those over a source's groups of shards.

    Returns a row per row of docs: id_col, source_col, size, source_size, target, taken; with carry, the row itself as a
    struct `row`, size and taken. A null or empty text has size 0 and nothing taken, however long ones are counted whole; null
    sources are one source, the last; repeated rows count each, those of one id going to one shard; an empty input gives no rows;
    other columns are not read, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("digest")]
    sizes = materialise(docs.select(*columns, *row), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    fits = lambda words: F.floor(words * F.lit(max_repeat) / F.lit(block_words)).cast("long")

    targets = capped_targets(sources, weights, max_repeat).withColumn("_all", F.lit(round(total / block_words)).cast("long"))
    seated = sainte_lague(targets, [], ["source"], "target", "_all", "_blocks").withColumn("_blocks", F.least("_blocks", fits(F.col("source_size")))).drop("_all")
    seated = materialise(seated.withColumnRenamed("source", "_source"), "sources")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    sharded = sizes.join(seated, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), n_shards)).drop("_source")
    cells = sharded.groupBy("source", "shard", "_blocks").agg(F.sum("size").alias("cell_size"))
    cells = materialise(cells.withColumn("room", fits(F.col("cell_size"))).withColumnRenamed("_blocks", "seats"), "shards")
    quotas = shard_quotas(cells)
    quotas = materialise(quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size", "quota"), "quotas")

    order = (F.xxhash64(F.lit(seed + 1), "id"), F.col("id").asc_nulls_last(), "size", "digest")
    stream = Window.partitionBy("source", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = sharded.withColumn("_before", F.sum("size").over(stream) - F.col("size"))
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    words = F.col("quota") * block_words
    passes = F.coalesce(F.floor(words / F.nullif(F.col("cell_size"), F.lit(0))), F.lit(0))
    head = F.least(F.greatest(words - passes * F.col("cell_size") - F.col("_before"), F.lit(0)), F.col("size"))
    taken = (passes * F.col("size") + head).cast("long").alias("taken")
    if carry:
        return joined.select("row", "size", taken)
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken)


def quotas_within(cells: DataFrame, group: Sequence[str], party: str, name: str) -> DataFrame:
    """cells(group, party, cell_size, room, seats) with quota: the group's seats by highest quotients of the cells' sizes, none
    above its room; seats that find none there are given by highest quotients of the room that is left."""
    whole = Window.partitionBy(*group)
    cells = sainte_lague(cells, group, [party], "cell_size", "seats", "_first")
    cells = cells.withColumn("_given", F.least("_first", "room")).withColumn("_left", F.col("room") - F.col("_given"))
    again = F.least(F.col("seats") - F.sum("_given").over(whole), F.sum("_left").over(whole))
    cells = materialise(cells.withColumn("_again", F.greatest(again, F.lit(0)).cast("long")).drop("_first"), name)
    cells = sainte_lague(cells, group, [party], "_left", "_again", "_second")
    return cells.withColumn("quota", F.col("_given") + F.least("_second", "_left")).drop("_given", "_left", "_again", "_second")


def shard_quotas(cells: DataFrame) -> DataFrame:
    """cells(source, shard, cell_size, room, seats), seats being the source's, with quota. A source's shards are dealt in
    groups of GROUPED: seats go to the groups and then, within each, to its shards, so that a source of very many
    shards is many tasks' work."""
    cells = cells.withColumn("_group", F.floor(F.col("shard") / GROUPED))
    groups = cells.groupBy("source", "_group", "seats").agg(F.sum("cell_size").alias("cell_size"), F.sum("room").alias("room"))
    groups = materialise(quotas_within(groups, ["source"], "_group", "groups"), "group-quotas")
    groups = groups.select(F.col("source").alias("_source"), F.col("_group").alias("_of"), F.col("quota").alias("seats"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_of"))
    within = cells.drop("seats").join(groups, same).drop("_source", "_of")
    return quotas_within(within, ["source", "_group"], "shard", "cells").drop("_group")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as its taken words round to whole documents, with all its columns.
    Repeated rows are each taken for themselves; empty texts are never taken; an empty table gives no rows; columns may have
    any names."""
    mixed = mix_sources(docs, id_col, text_col, source_col, carry=True, **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
