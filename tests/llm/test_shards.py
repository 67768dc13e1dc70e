"""Sharding against plain longest-processing-time scheduling."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from compare import database
from pyspark.sql import functions as F
from test_llm_edges import LONG, SCHEMA, row

from trajq.llm import queries, shards


def plain_loads(texts, n_shards):
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [(0, i) for i in range(n_shards)]
    for size in sorted(groups.values(), reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
    return sorted(heap)


def hold(rows, texts, n_shards):
    """rows (text, shard, slot, size) keep every law but the loads'."""
    of, slots, loads = defaultdict(set), defaultdict(list), Counter({i: 0 for i in range(n_shards)})
    for text, shard, slot, size in rows:
        of[text or ""].add(shard)
        slots[shard].append(slot)
        loads[shard] += size
    assert len(rows) == len(texts) and all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sorted((load, i) for i, load in loads.items())


def test_op13(spark, sf):
    texts = dict(database(sf).sql("SELECT doc_id, text FROM documents").fetchall())
    out = queries.op13_sharding(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None for r in out)
    assert hold([(texts[r.doc_id], r.shard, r.slot, r.size) for r in out], texts, 16) == plain_loads(texts.values(), 16)


def test_many_equal_groups_are_given_as_if_one_by_one():
    draw = random.Random(3)
    for _ in range(200):
        loads = [draw.randint(0, 500) for _ in range(draw.randint(1, 7))]
        fast, slow = shards.Shards(loads), list(loads)
        for _ in range(4):
            count, size = draw.randint(1, 300), draw.randint(1, 30)
            want = [0] * len(slow)
            for _ in range(count):
                i = min(range(len(slow)), key=lambda i: (slow[i], i))
                slow[i] += size
                want[i] += 1
            assert fast.give(count, size) == want


def test_classes_rise_with_the_size_and_are_bounded(spark):
    sizes = [2**i + d for i in range(2, 62) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", shards.size_class(F.col("s")).alias("c")).orderBy("s").collect()
    assert all(a.c <= b.c for a, b in zip(got, got[1:])) and got[-1].c < shards.EXACT + 47 * shards.STEPS
    assert all(r.c == r.s for r in got if r.s < shards.EXACT)


@pytest.mark.parametrize("crowded", [1, 100_000])
def test_a_hot_group_large_groups_and_crowded_sizes(spark, monkeypatch, crowded):
    monkeypatch.setattr(shards, "CROWDED", crowded)
    monkeypatch.setattr(shards, "EXACT", 1 << 10)
    texts = ["hot text"] * 700 + [f"{i:05d}" for i in range(900)] + [f"{i} " + "x" * (1500 + 7 * i) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = [(texts[r.doc_id], r.shard, r.slot, r.size) for r in shards.shard_documents(docs, 5).collect()]
    loads = hold(rows, texts, 5)
    assert [load for load, _ in loads] == [load for load, _ in plain_loads(texts, 5)]  # these classes hold one size each


def test_odd_rows(spark):
    texts = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "a"), (4, LONG), (5, "A")]
    docs = spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(None)).repartition(3)
    out = shards.shard_documents(docs, 3).collect()
    by = defaultdict(set)
    for r in out:
        by[r.text_crc32].add(r.shard)
    assert len(out) == 7 and all(len(s) == 1 for s in by.values()) and len(by) == 4
    assert Counter(r.size for r in out) == Counter([2, 2, 1, 1, 2, len(LONG.encode()) + 1, 2])
    big = next(r for r in out if r.size > 1000)
    assert big.slot == 0 and [r.shard for r in out].count(big.shard) == 1
    assert shards.shard_documents(docs.where("false")).count() == 0
    assert {r.shard for r in shards.shard_documents(docs, 1).collect()} == {0}
