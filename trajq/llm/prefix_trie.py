"""The trie of conversations' common beginnings, with sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq.operators.segments import SUM, WIDTH, XOR, running
from trajq.session import ship_package

from .common import discard, materialise, shuffle_partitions, temporary_tables

#: Ids of a node's members are listed so many at a time.
LISTED = 1 << 14
SUMS = ["leaves", "saved"]
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, a, b, chars): each turn's place from 1 in its conversation, a digest of role and text in two longs,
    and the text's code points. Order is that of turn, null first; turns that share it are in order of their digests.

    A sort by range cuts a long conversation over several partitions; places are counted in each and shifted by what lies
    before, so no task holds a whole conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    a, b = F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), a, b, F.char_length(text).cast("long").alias("chars"))
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b"]
    ranged = rows.where("conv is not null").repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = materialise(ranged.select("conv", "a", "b", "chars", at.alias("at"), F.shiftright(at, 33).alias("piece")), "ranged")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("conv", "piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.select("conv", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("conv", "piece").orderBy("at"))
    return ranged.withColumn("nth", nth).join(pieces, ["conv", "piece"]).select("conv", (F.col("first") + F.col("nth")).alias("depth"), "a", "b", "chars")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ordered turns, those of the rebuilt conversations, and (conv, len) of all of these.

    A conversation c gets the first h turns of c - c % 100, then its own after its first h; h is crc32 of c in decimals, modulo 6.
    """
    turns = materialise(turns, "turns")
    own = turns.groupBy("conv").agg(F.max("depth").alias("own"))
    heads = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = own.select("conv", "own", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h"))
    k = F.least("h", F.coalesce("base_own", F.lit(0)))
    plan = plan.join(heads, "base", "left").select("conv", "base", "h", k.alias("k"), (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    plan = materialise(plan, "plan")
    first = turns.where("depth <= 5 and conv % 100 = 0").withColumnRenamed("conv", "base")
    taken = plan.join(first, "base").where("depth <= k").select("conv", "depth", "a", "b", "chars", "len")
    kept = turns.join(plan, "conv").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "chars", "len")
    return taken.unionByName(kept), plan.select("conv", "len")


def member_digests(ends: DataFrame) -> DataFrame:
    """ends(key…, conv) to (conv, sha256): per key, its smallest conv and the digest of all of them, ascending, comma-joined.

    Runs of ids are joined in the order of a sort by range, so that a key with very many is spread over tasks; SHA-256 is
    then fed the runs one after another, and no task holds more than one.
    """
    keys = [c for c in ends.columns if c != "conv"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def run() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(keys, now)) | {"first": held[0], "listing": ",".join(map(str, held))}], schema)

        schema = pa.schema([*[pa.field(k, pa.int64()) for k in keys], pa.field("first", pa.int64()), pa.field("listing", pa.string())])
        for batch in batches:
            columns = batch.to_pydict()
            for key, conv in zip(zip(*[columns[k] for k in keys]), columns["conv"]):
                if held and (key != now or len(held) == LISTED):
                    yield run()
                    held = []
                now = key
                held.append(conv)
        if held:
            yield run()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, conv = None, None, None
        row = lambda: pa.RecordBatch.from_pydict({"conv": pa.array([conv], pa.int64()), "sha256": pa.array([digest.hexdigest()])})
        for batch in batches:
            columns = batch.to_pydict()
            for key, first, listing in zip(zip(*[columns[k] for k in keys]), columns["first"], columns["listing"]):
                if key == now:
                    digest.update(b"," + listing.encode())
                    continue
                if digest is not None:
                    yield row()
                now, digest, conv = key, hashlib.sha256(listing.encode()), first
        if digest is not None:
            yield row()

    n = shuffle_partitions(ends.sparkSession)
    joined = ends.repartitionByRange(n, *keys, "conv").sortWithinPartitions(*keys, "conv")
    listed = materialise(joined.mapInArrow(runs, ", ".join(f"{k} long" for k in keys) + ", first long, listing string"), "listed")
    return listed.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "conv long, sha256 string")


def subtree_sums(vertices: DataFrame, ancestors: DataFrame, sums: list[str]) -> DataFrame:
    """(v, sums…): the sums over each vertex's subtree, by centroid decomposition.

    vertices(v, size, sums…) of a tree: size is what the subtree weighs, each vertex 1 or more. ancestors(v, a, top, via): every proper
    ancestor a of v, how deep it is, and its child on the way to v (v itself, if that is its child).

    In every component at once, the centroid is the lowest vertex with more than half of the component's weight below or at it.
    What is below it, and its own, is its total; that is added to it and to all vertices between it and the component's
    top. It is then taken out: each child's branch is a component, and so is the rest. Weights at least halve, so there are
    as many rounds as the logarithm of the whole; a row of ancestors is read until its two ends are parted. Each
    round's tables are written.
    """
    root = vertices.agg(F.max_by("v", "size")).first()[0]
    alive = materialise(vertices.withColumn("comp", F.lit(root).cast("long")), "alive")
    pairs = materialise(ancestors.join(vertices.drop("size"), "v"), "pairs")
    added = []
    while True:
        whole = alive.groupBy("comp").agg(F.max("size").alias("whole"))
        low = F.min(F.struct("size", "v", *sums)).alias("low")
        centroids = alive.join(whole, "comp").where("2 * size > whole").groupBy("comp").agg(low)
        centroids = materialise(centroids.select(F.col("low.v").alias("c"), F.col("low.size").alias("c_size"), *[F.col(f"low.{s}").alias(f"c_{s}") for s in sums]), "centroids")
        below = pairs.join(centroids.select("c"), F.col("a") == F.col("c")).select("v", "c", "via", F.col("top").alias("c_top"), *sums)
        below = materialise(below, "below")
        under = below.groupBy("c").agg(*[F.sum(s).alias(f"u_{s}") for s in sums])
        totals = centroids.join(under, "c", "left").select("c", "c_size", *[(F.col(f"c_{s}") + F.coalesce(f"u_{s}", F.lit(0))).alias(s) for s in sums])
        totals = materialise(totals, "totals")
        upward = materialise(pairs.select("v", "a").join(totals, F.col("v") == F.col("c")).select(F.col("a").alias("v"), "c_size", *sums), "upward")
        added += [totals.select(F.col("c").alias("v"), *sums), upward.select("v", *sums)]
        moved = below.select("v", "via", "c_top").unionByName(centroids.select(F.col("c").alias("v"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("c_top")))
        moved = moved.withColumn("moved", F.lit(True))
        apart = pairs.join(moved.drop("via"), "v", "left").where("moved is null or top > c_top").drop("moved", "c_top")
        now = materialise(apart, "pairs")
        less = upward.groupBy("v").agg(F.sum("c_size").alias("less"))
        left = alive.join(moved.drop("c_top"), "v", "left").where("moved is null or via is not null").join(less, "v", "left")
        later = materialise(left.select("v", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *sums, F.coalesce("via", "comp").alias("comp")), "alive")
        for table in (alive, pairs, centroids, below):
            discard(table)
        alive, pairs = later, now
        if pairs.isEmpty():
            break
    added.append(alive.select("v", *sums))
    return reduce(DataFrame.unionByName, added).groupBy("v").agg(*[F.sum(s).alias(s) for s in sums])


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of turns(conv, depth, a, b, chars, len), given lengths(conv, len) of all conversations: a row per node.

    A node is a distinct sequence of the first turns of some conversations, its members; the root is the empty one.
    Beginnings are told apart by 128 bits of digests of (depth, turn), combined over segments of a conversation. Equal
    conversations are taken once. A node goes by its smallest member and depth, so the nodes of one smallest member are
    the lower part of its conversation: the trie is a tree of such paths, each hanging from a node of another. Sums over
    subtrees are taken over that tree of paths (subtree_sums), then from the end of each path upward, in segments.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (each node's
    members but one, times its last text's code points, summed over the subtree) and ends_sha256 (of the members that end
    there). No conversations give no rows.
    """
    spark = turns.sparkSession
    with temporary_tables(spark) as made:
        hashed = turns.select("conv", "depth", "chars", "len", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "depth", "a").alias("y"))
        rows = materialise(running(hashed, ["conv"], "depth", {"x": (XOR, F.col("x")), "y": (XOR, F.col("y"))}, width=WIDTH), "beginnings")
        none = F.lit(0).cast("long")
        ends = rows.where("depth = len").select("len", "x", "y", "conv").unionByName(lengths.where("len = 0").select("len", none.alias("x"), none.alias("y"), "conv"))
        ends = materialise(ends, "ends")
        distinct = materialise(ends.groupBy("len", "x", "y").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("times")).select("conv", "len", "times"), "distinct")
        root = distinct.agg(F.min("conv").alias("rep"), F.sum("times").alias("n_convs"), F.count(F.lit(1)).alias("d")).first()
        if root.rep is None:
            return spark.createDataFrame([], NODES)
        digests = materialise(member_digests(ends), "digests")
        own = materialise(rows.join(distinct.select("conv", "times"), "conv"), "distinct-turns")
        nodes = own.groupBy("depth", "x", "y").agg(F.min("conv").alias("rep"), F.sum("times").alias("n_convs"), F.count(F.lit(1)).alias("d"))
        nodes = materialise(nodes, "nodes")
        below = own.join(nodes, ["depth", "x", "y"]).select("conv", "depth", "chars", "len", "rep", "n_convs", "d")
        top = distinct.select("conv", none.alias("depth"), none.alias("chars"), "len", *[F.lit(root[c]).cast("long").alias(c) for c in ("rep", "n_convs", "d")])
        below = materialise(below.unionByName(top), "members")

        mine, other = F.col("rep") == F.col("conv"), F.col("rep") < F.col("conv")
        saved = (F.col("n_convs") - 1) * F.col("chars")
        paths = below.groupBy(F.col("conv").alias("v"), "len").agg(
            F.max(F.when(other, F.col("rep"))).alias("parent"), F.max(F.when(other, F.col("depth"))).alias("at"), F.max(F.when(mine, F.col("d"))).alias("size"), F.sum(F.when(mine, saved)).alias("saved")
        )
        paths = materialise(paths.where("size is not null"), "paths")  # others end on the path of a smaller member
        hung = paths.where("parent is not null").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
        open_ends = paths.join(hung.withColumnRenamed("conv", "v").withColumnRenamed("depth", "len"), ["v", "len"], "left")
        vertices = materialise(open_ends.select("v", "size", F.col("hung").isNull().cast("long").alias("leaves"), "saved"), "vertices")
        ancestors = below.where(other).groupBy(F.col("conv").alias("v"), F.col("rep").alias("a")).agg(F.min("depth").alias("top"))
        via = F.coalesce(F.lead("a").over(Window.partitionBy("v").orderBy("top")), F.col("v"))
        summed = materialise(subtree_sums(vertices, ancestors.withColumn("via", via), SUMS), "sums")

        branches = paths.where("parent is not null").join(summed.select("v", "leaves", F.col("saved").alias("_saved")), "v")
        branches = branches.groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(
            F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("leaves"), F.sum("_saved").alias("saved")
        )
        children = (F.col("depth") < F.col("len")).cast("long") + F.coalesce("hung", none)
        tops = paths.where("parent is not null").select(F.col("v").alias("conv"), (F.col("at") + 1).alias("depth"), "parent")
        ending = below.where("depth = len").select(F.col("conv").alias("ending"), F.col("rep").alias("conv"), "depth").join(digests.withColumnRenamed("conv", "ending"), "ending").drop("ending")
        each = below.where(mine).join(branches, ["conv", "depth"], "left").join(tops, ["conv", "depth"], "left").join(ending, ["conv", "depth"], "left")
        each = each.select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
            "n_convs",
            children.alias("n_children"),
            ((children == 0).cast("long") + F.coalesce("leaves", none)).alias("n_leaves"),
            (saved + F.coalesce("saved", none)).alias("saved_tokens"),
            F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        upward = {c: (SUM, F.col(c)) for c in ("n_leaves", "saved_tokens")}
        out = materialise(running(each, ["conv_id"], "depth", upward, reverse=True, width=WIDTH), "trie")
        made.pop()
    return out.select(*[c.split()[0] for c in NODES.split(", ")])


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of the rebuilt conversations of turns (see rebuild and prefix_trie).

    A null role or text counts as empty; a null turn comes first; rows of one turn are in order of their digests, repeated
    ones each a turn; rows with a null conv_id belong to no conversation and are left out; long texts enter by digest and
    length only; an empty table gives no rows; other columns are not read, so their names can't clash.
    """
    ship_package(turns.sparkSession)
    with temporary_tables(turns.sparkSession) as made:
        out = prefix_trie(*rebuild(ordered_turns(turns, conv_col, turn_col, role_col, text_col)))
        if made:
            made.pop()
    return out
