"""Exact self-join of documents by the Jaccard similarity of their word n-grams."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import discard, give_back, materialise, release, setting
from .components import connected_components
from .lm import WordIds

#: Cells of the two count sketches, and cells in a block of them.
FREQUENCY_CELLS, KEY_CELLS, BLOCK = 1 << 22, 1 << 20, 1 << 16
#: Documents in a group; ids of a group whose token sets are held at once.
GROUP_DOCS, GROUP_TOKENS = 128, 1 << 18
#: Groups are formed ahead of the search where at least so many different sets share a key.
LARGE_GROUP = 16
#: Keys of a set. What the first leaves apart of a large group of near copies, the others bring together.
N_KEYS = 3
#: Fewer documents of a piece form no group; those nearly similar, at this part of the similarity, form one too.
SMALL_GROUP, LOOSER = 8, 0.75
#: Bytes that a task takes at once when it compares groups; texts that it shingles at once.
BATCH_BYTES, SLICE = "32m", 256
#: Of the filter of wanted ids: bits an id, and the most ids it is made for. Beyond them, texts are joined with the ids.
ID_BITS, MOST_FILTERED = 16, 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit n-gram hashes. A-Z is lower-cased; words end at ASCII white space."""

    def __init__(self, words: int):
        self.n, self.word_ids = words, WordIds()

    def __call__(self, text: str | None) -> np.ndarray:
        ids = self.word_ids([text])[0][:-1]
        if not len(ids):
            return ids
        n = min(self.n, len(ids))
        grams = np.full(len(ids) - n + 1, n, np.uint64)
        for i in range(n):
            grams = _mix(grams) + ids[i : len(ids) - n + 1 + i]
        return np.unique(_mix(grams))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few texts at a time, so that a task holds the n-grams of no more."""
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _pack(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order: enough to compare the few sets that meet in one place, where two of n
    and m differing n-grams are taken for one with a chance of n * m / 2**48."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(packed) -> np.ndarray:
    upper = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = np.zeros((len(upper), 8), np.uint8)
    out[:, 2:] = upper
    return out.view("<u8").reshape(-1)


@dataclass(frozen=True)
class Threshold:
    """Sets are similar when scale * intersection >= least * union."""

    least: int
    scale: int

    def similar(self, overlap: int, a: int, b: int) -> bool:
        return self.scale * overlap >= self.least * (a + b - overlap)

    def overlap_needed(self, n: int) -> int:
        """That any similar set has in common with a set of n."""
        return -(-self.least * n // self.scale)

    def prefix(self, n: int) -> int:
        """Of any so many elements of a set of n, a similar set has one at least."""
        return n - self.overlap_needed(n) + 1

    @property
    def smallest(self) -> int:
        """Smaller sets are similar to equal ones only."""
        return -(-self.least // max(1, self.scale - self.least))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _group_keys(grams: np.ndarray) -> list[int]:
    """The set's smallest n-gram under each of N_KEYS hashes: sets of similarity s share each with probability s."""
    return [int(_mix(grams + np.uint64(0xA0761D6478BD642F * (i + 1) & 0xFFFFFFFFFFFFFFFF)).min().view(np.int64)) for i in range(N_KEYS)]


def _cells(counts: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    blocks = np.minimum(counts, 65535).astype("<u2", copy=False).reshape(-1, BLOCK)
    for b in np.flatnonzero(blocks.any(axis=1)):
        yield kind, int(b), zlib.compress(blocks[b].tobytes(), 1)


def _add_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of a block, as 4 log2(1 + count) in a byte."""
    total = np.zeros(BLOCK, np.int64)
    for packed in rows["cells"]:
        total += np.frombuffer(zlib.decompress(packed), "<u2")
    levels = np.minimum(np.ceil(4 * np.log2(1 + total)), 255).astype(np.uint8)
    return pd.DataFrame({"kind": [rows["kind"].iloc[0]], "block": [rows["block"].iloc[0]], "cells": [zlib.compress(levels.tobytes(), 1)]})


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """First pass: id, n, digest and group key of every row, and each task's counts of n-grams and of keys."""
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, n long, digest binary, kind int, block int, cells binary"
    names = ["id", "n", "digest", "kind", "block", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, frequency, keys, id_type = Shingler(words), np.zeros(FREQUENCY_CELLS, np.uint32), np.zeros((N_KEYS, KEY_CELLS), np.uint32), pa.int64()

        def count(into: np.ndarray, hashes: np.ndarray) -> None:
            cells, n = np.unique(hashes & np.uint64(len(into) - 1), return_counts=True)
            into[cells.astype(np.int64)] += n.astype(np.uint32)

        for batch in _slices(batches):
            id_type = batch.column(0).type
            sets = [shingle(text) for text in batch.column(1).to_pylist()]
            count(frequency, np.concatenate([np.zeros(0, np.uint64), *sets]))
            own = np.array([_group_keys(grams) for grams in sets if len(grams)], np.int64).reshape(-1, N_KEYS).view(np.uint64)
            for i in range(N_KEYS):
                count(keys[i], own[:, i])
            none = len(sets)
            blank = [pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(_digest, sets), pa.binary()), *blank], names)
        rows = [*_cells(frequency, 0), *_cells(keys.reshape(-1), 1)]
        none = len(rows)
        blank = [pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())]
        cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*blank, *cells], names)
        give_back()

    return materialise(docs.mapInArrow(run, schema), "survey")


def _sketches(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed sketches of n-grams and of each key, one byte a cell; 7 MB whatever the input."""
    out = (np.zeros((FREQUENCY_CELLS // BLOCK, BLOCK), np.uint8), np.zeros((N_KEYS * KEY_CELLS // BLOCK, BLOCK), np.uint8))
    summed = survey.where("kind is not null").select("kind", "block", "cells").groupBy("kind", "block").applyInPandas(_add_blocks, "kind int, block int, cells binary")
    for row in summed.collect():
        out[row.kind][row.block] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    return out[0].reshape(-1), out[1].reshape(N_KEYS, KEY_CELLS)


def _prefixes(docs: DataFrame, words: int, threshold: Threshold, frequency, keys) -> DataFrame:
    """Second pass: the prefix of every set that can have a similar one, rarest n-grams first by the sketch (an order
    that all tasks share), and the whole set where one of its keys is common."""
    common = int(np.ceil(4 * np.log2(1 + LARGE_GROUP)))
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, often, crowded = Shingler(words), frequency.value, keys.value
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingle(text)
                if len(grams) < threshold.smallest:
                    continue
                rank = (often[(grams & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
                p = threshold.prefix(len(grams))
                first = grams[np.argpartition(rank, p - 1)[:p]] if p < len(grams) else grams
                own = _group_keys(grams)
                whole = any(crowded[i, k & (KEY_CELLS - 1)] >= common for i, k in enumerate(own))
                row = (doc, len(grams), _digest(grams), own, first.view(np.int64), _pack(grams) if whole else None)
                for column, value in zip(out, row):
                    column.append(value)
            types = (batch.column(0).type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["id", "n", "digest", "keys", "prefix", "grams"])
        give_back()

    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, keys array<long>, prefix array<long>, grams binary")


def _overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The group's token matrix, documents by distinct n-grams, gives all overlaps. Returns sizes and overlaps."""
    sizes = np.array([len(s) for s in sets])
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[which] > 1
    column = (np.cumsum(counts > 1) - 1)[which[shared]]
    owner, overlaps = owner[shared], np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int((counts > 1).sum()), 8192):
        part = (column >= start) & (column < start + 8192)
        matrix = np.zeros((len(sets), 8192), np.float32)
        matrix[owner[part], column[part] - start] = 1
        overlaps += matrix @ matrix.T
    return sizes, overlaps


def _roots(sizes: np.ndarray, overlaps: np.ndarray, least: float, scale: float) -> np.ndarray:
    """Each document's root: of those connected with it, the one with the most links, which is likeliest to be similar
    to others of its kind."""
    linked = scale * overlaps >= least * (sizes[:, None] + sizes[None, :] - overlaps)
    degree, root = linked.sum(axis=1), np.full(len(sizes), -1)
    for i in np.argsort(-degree, kind="stable"):
        if root[i] < 0:
            root[i], reach = i, [i]
            while reach:
                new = np.flatnonzero(linked[reach.pop()] & (root < 0))
                root[new] = i
                reach.extend(new.tolist())
    return root


def _form_groups(reps: DataFrame, threshold: Threshold, most_rounds: int = 8) -> tuple[DataFrame, DataFrame] | None:
    """Groups where many documents share a key: (id, gid), and the links (a, b) found on the way.

    A key's documents are dealt into pieces of bounded size, and each piece's matrix gives all links within it. Those
    found connected form a group, and so do others that are nearly similar. A connected group sends its root on to
    the next round, where a key's remaining documents are dealt anew, until a key has been seen whole or its documents
    turn out not to be similar. Then comes the next key. That connects most of a large group of near copies; what no
    piece holds together, the search compares.
    """

    def root_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        sets = [_unpack(b) for b in rows["grams"]]
        ids, free, (sizes, overlaps) = rows["id"].to_numpy(), ~rows["grouped"].to_numpy(bool), _overlaps(sets)
        root = _roots(sizes, overlaps, threshold.least, threshold.scale)
        gid, single = ids.copy(), free.copy()
        for near in (root, _roots(sizes, overlaps, LOOSER * threshold.least, threshold.scale)):
            for r, size in zip(*np.unique(near[single], return_counts=True)):
                if size >= SMALL_GROUP:
                    own = single & (near == r)
                    gid[own], single = ids[own].min(), single & ~own
        return pd.DataFrame({"id": ids, "root": ids[root], "gid": gid, "free": free, "key": rows["key"].to_numpy(), "whole": rows["whole"].to_numpy()})

    links, gids = None, None
    for number in range(N_KEYS):
        keyed = reps.where("grams is not null").select("id", "n", F.col("keys")[number].alias("key"), "grams")
        if links is None:
            keyed = keyed.withColumn("grouped", F.lit(False))
        else:
            keyed = keyed.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
            keyed = keyed.join(gids.select("id", F.lit(True).alias("grouped")), "id", "left").withColumn("grouped", F.coalesce("grouped", F.lit(False)))
        enough = LARGE_GROUP if number == 0 else 2
        counted = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams_in")).where(F.col("docs") >= enough), "keys")
        active = keyed.select("id", "key", "grams", "grouped")
        for turn in range(most_rounds):
            if counted.isEmpty():
                break
            pieces = F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.ceil(F.col("grams_in") / GROUP_TOKENS))
            dealt = active.join(counted.withColumnsRenamed({"key": "_key"}), F.col("key") == F.col("_key"))
            dealt = dealt.select("id", "key", "grams", "grouped", F.pmod(F.xxhash64(F.lit(turn), "id"), pieces).alias("piece"), (pieces == 1).alias("whole"))
            found = materialise(dealt.groupBy("key", "piece").applyInPandas(root_of, "id long, root long, gid long, free boolean, key long, whole boolean"), "groups")
            links = _union(links, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
            if turn == 0:
                gids = _union(gids, found.where("free").select("id", "gid"))
            roots = found.where("id = root and not whole")
            left = roots.groupBy("key").agg(F.count(F.lit(1)).alias("left"))
            again = left.join(counted, "key").where("left > 1 and left < 0.9 * docs")
            counted = materialise(again.select("key", F.col("left").alias("docs"), F.ceil(F.col("grams_in") * F.col("left") / F.col("docs")).alias("grams_in")), "keys")
            active = active.join(roots.select("id", "key"), ["id", "key"], "left_semi").select("id", "key", "grams", F.lit(True).alias("grouped"))
    return None if links is None else (gids, links)


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _may_reach(threshold: Threshold) -> Column:
    """Whether `both` n-grams that two groups share on prefixes leave a pair of similar members possible.

    Beyond its prefix a set has under s * size n-grams (s = least / scale), so sets of n and m that share `both` on
    prefixes share under both + s * max(n, m) in all, and similar ones share s / (1 + s) * (n + m) at least. Over the
    sizes in the groups the difference is least at their ends, m cut to what can be similar to n.
    """
    s = threshold.least / threshold.scale

    def lacking(n: Column, m: Column) -> Column:
        m = F.least(F.greatest(m, n * s), n / s)
        return (n + m) * (s / (1 + s)) - F.greatest(n, m) * s

    return F.col("both") + 1e-6 >= F.least(*[lacking(F.col(n), F.col(m)) for n in ("a_min", "a_max") for m in ("b_min", "b_max")])


def _links_between(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]], threshold: Threshold) -> list[tuple[int, int]]:
    """Links that connect what is similar between two groups: the other group's token union bounds each document's
    overlap, and only documents that reach what they need are compared."""
    if len(a) == len(b) == 1:
        (i, x), (j, y) = a[0], b[0]
        return [(i, j)] if threshold.similar(_overlap(x, y), len(x), len(y)) else []
    opened = []
    for group, other in ((a, b), (b, a)):
        union = np.unique(np.concatenate([grams for _, grams in other]))
        opened.append([(i, grams) for i, grams in group if _overlap(grams, union) >= threshold.overlap_needed(len(grams))])
    if not all(opened):
        return []
    every = [*opened[0], *opened[1]]
    root = _roots(*_overlaps([grams for _, grams in every]), threshold.least, threshold.scale)
    return [(every[k][0], every[r][0]) for k, r in enumerate(root) if k != r]


def _verify(pairs: DataFrame, threshold: Threshold) -> DataFrame:
    """pairs(a, b: array<struct<id, grams>>), the members of two groups, to links (a, b)."""

    def members(group: pa.Scalar) -> list[tuple[int, np.ndarray]]:
        return [(m["id"].as_py(), _unpack(m["grams"].as_buffer())) for m in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for a, b in zip(batch.column(0), batch.column(1)) for link in _links_between(members(a), members(b), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
        give_back()

    return pairs.mapInArrow(run, "a long, b long")


def _id_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((_mix(ids + np.uint64(i + 1)) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32) for i in range(4)]


def _id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n ids, ID_BITS bits each: every task fills its own, and they are OR-ed where they come to the
    driver one after another, compressed."""
    n_bytes = max(8, n * ID_BITS // 8)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            for at in _id_places(batch.column(0).to_numpy().view(np.uint64), 8 * n_bytes):
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(n_bytes, np.uint8)
    for row in ids.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The wanted(id, digest, gid) with their sets, in a third pass. A filter of their ids thins the texts before any
    shuffle; if they are too many for a filter of a bounded size, the texts are first joined with them."""
    n = wanted.count()
    if n > MOST_FILTERED:
        bits = None
        docs = docs.join(wanted.select("id").distinct(), "id").select("id", "text")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted.select("id"), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in _slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            if bits is not None:
                hit = np.ones(batch.num_rows, bool)
                for at in _id_places(batch.column(0).to_numpy().view(np.uint64), 8 * len(bits.value)):
                    hit &= (bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                batch = batch.filter(pa.array(hit))
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array(map(_pack, sets), pa.binary())], ["id", "digest", "grams"])
        give_back()

    return docs.mapInArrow(run, "id long, digest binary, grams binary").dropDuplicates(["id", "digest"]).join(wanted, ["id", "digest"])


def _search(docs: DataFrame, reps: DataFrame, groups: tuple[DataFrame, DataFrame] | None, words: int, threshold: Threshold) -> DataFrame:
    """Links (a, b) beyond those of the groups: with them, all documents are connected that similar pairs connect."""
    spark = docs.sparkSession
    rows = reps.select("id", "n", "digest", "prefix")
    if groups is None:
        placed = rows.withColumns({"gid": F.col("id"), "comp": F.col("id")})
    else:
        gids, links = groups
        comps = materialise(connected_components(links).withColumnRenamed("component", "comp"), "components")
        placed = rows.join(gids, "id", "left").join(comps, "id", "left").withColumns({"gid": F.coalesce("gid", "id"), "comp": F.coalesce("comp", "id")})
    placed = materialise(placed, "placed")
    discard(reps)
    release(spark)
    # N-grams found in the prefixes of two components at least.
    tokens = placed.select(F.explode("prefix").alias("gram"), "comp").groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    tokens = materialise(tokens.select("gram"), "grams")
    # The token-group matrix, on prefixes: a row for each n-gram and group.
    cells = placed.select(F.explode("prefix").alias("gram"), "n", "gid", "comp").join(tokens, "gram").groupBy("gram", "gid")
    matrix = materialise(cells.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("comp").alias("low"), F.max("comp").alias("high")), "matrix")
    release(spark)
    a, b = matrix.alias("a"), matrix.alias("b")
    apart = (F.col("a.low") != F.col("b.low")) | (F.col("a.high") != F.col("b.high")) | (F.col("a.low") != F.col("a.high"))
    fits = (F.col("a.n_min") * threshold.least <= F.col("b.n_max") * threshold.scale) & (F.col("b.n_min") * threshold.least <= F.col("a.n_max") * threshold.scale)
    shared = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.gid") < F.col("b.gid")) & apart & fits)
    ends = {f"{side}_{end}": getattr(F, end)(f"{side}.n_{end}") for side in "ab" for end in ("min", "max")}
    pairs = shared.groupBy(F.col("a.gid").alias("gid"), F.col("b.gid").alias("other")).agg(F.count(F.lit(1)).alias("both"), *[c.alias(n) for n, c in ends.items()])
    candidates = materialise(pairs.where(_may_reach(threshold)).select("gid", "other"), "candidates")
    both = candidates.select("gid").unionByName(candidates.select(F.col("other").alias("gid"))).distinct()
    members = materialise(placed.select("id", "digest", "gid").join(both, "gid"), "wanted")
    for table in (placed, matrix):
        discard(table)
    # Written before they are grouped: the two joins below then share one shuffle by group.
    sets = materialise(_sets_of(docs, members, words), "sets")
    grouped = sets.groupBy("gid").agg(F.collect_list(F.struct("id", "grams")).alias("members"))
    release(spark)
    first = candidates.join(grouped.withColumnRenamed("members", "a"), "gid").select("a", F.col("other").alias("gid"))
    opened = first.join(grouped.withColumnRenamed("members", "b"), "gid").select("a", "b")
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        links = materialise(_verify(opened, threshold), "links")
    for table in (sets, candidates, members):
        discard(table)
    return links


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: int = 80, scale: int = 100) -> DataFrame:
    """Documents linked when scale * |A & B| >= least * |A | B|, A and B their sets of distinct n-grams of `words`
    words (A-Z lower-cased; a shorter text is one n-gram; a text without words is empty and linked with nothing).

    A token-group matrix finds the links. Equal sets are one node. Where many sets share a min-hash key they are
    put in groups of bounded size, whose n-gram matrices give the links within. The matrix of all groups (most hold one
    document), restricted to prefixes, of which similar sets share one, then gives the pairs of groups that may hold
    similar documents. The n-grams they share there bound the overlap, and so does the union of a group's n-grams for
    each document of the other; only what reaches the bound is compared in full.
    Prefixes take the rarest n-grams first, by a count sketch of fixed size over all documents, so what many texts share
    (licence lines, passages) is hardly ever searched. No pairs of documents within
    a group are made, nor any between groups that are known to be of one component.

    Returns a row per row of docs: id_col, n_shingles, component_id. Rows with a null id take the component of their
    set, null if no row with an id has it; rows of one id count as linked; ids must be integers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    threshold = Threshold(least, scale)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    survey = _survey(texts, words)
    rows = survey.where("kind is null")
    frequency, keys = (spark.sparkContext.broadcast(x) for x in _sketches(survey))
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    release(spark)
    prefixes = _prefixes(texts, words, threshold, frequency, keys).where("id is not null")
    reps = classes.where("rep is not null").withColumnsRenamed({"digest": "_digest"})
    reps = prefixes.join(reps, (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("_digest"))).drop("rep", "_digest").dropDuplicates(["id", "digest"])
    reps = materialise(reps, "representatives")
    release(spark)
    groups = _form_groups(reps, threshold)
    links = _search(texts, reps, groups, words, threshold)
    release(spark)
    components = connected_components(links if groups is None else links.unionByName(groups[1]))
    named = materialise(
        classes.join(components, F.col("rep") == F.col("id"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component")), "named"
    )
    out = rows.select("id", "n", "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    component: Column = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is their component's; each component keeps one document.
    Rows with a null id have no component of their own and stay."""
    linked = ngram_jaccard_components(docs, id_col, text_col, **options)
    dropped = materialise(linked.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__dropped")).distinct(), "near-copies")
    return docs.join(dropped, F.col(id_col).cast("long") == F.col("__dropped"), "left_anti")
