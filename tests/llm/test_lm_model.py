"""The bigram model: its probabilities sum to 1, and scores equal a plain-Python version that reads the same filter."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import words
from pyspark.sql import functions as F

from trajq.llm import lm


def number(word):
    return np.array([xxhash.xxh64_intdigest(word)], np.uint64)


@pytest.fixture(scope="module")
def learnt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("id"), "text", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1).alias("held_out"))
    texts = {r.doc_id: [*words(r.text, lower=True), b"\n"] for r in docs.collect()}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    return docs, texts, train, lm._whole_filter(rows, 500.0)


def probability(model, stored, pairs, before, word):
    def count(key, bloom):
        return float(lm.VALUES[bloom.levels(key)][0])

    alone = (count(number(word), stored.bloom) + 0.5) / (model.mass + 0.5 * (model.types + 1))
    sums = dict(zip(stored.keys.tolist(), stored.sums.tolist()))
    both = count(lm.pair_keys(number(before), number(word)), pairs.bloom)
    return (both + model.kappa * alone) / (sums.get(int(number(before)[0]), 0.0) + model.kappa)


def test_probabilities_sum_to_one(learnt):
    _, _, train, (model, stored, pairs) = learnt
    counts = Counter(w for t in train.values() for w in t)
    assert (model.tokens, model.types) == (sum(counts.values()), len(counts))
    seen = {pair for t in train.values() for pair in zip([b"\n", *t], t)}
    names = [*counts, b"a word that is in no text"]
    every = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    alone = model.alone(stored.bloom.levels(every))
    assert alone.sum() == pytest.approx(1, abs=1e-9)
    wrong, contexts = 0, [b"\n", *(w for w, _ in counts.most_common(49)), *random.Random(1).sample(sorted(counts), 50)]
    for v in contexts:
        context = number(v)
        both = lm.VALUES[pairs.bloom.levels(lm.pair_keys(np.repeat(context, len(every)), every))]
        total = lm._values_at(stored.keys, stored.sums, context)[0]
        taken = np.array([(v, w) not in seen for w in names]) & (both > 0)  # a Bloom filter's false positives
        wrong += int(taken.sum())
        both[taken] = 0
        assert ((both + model.kappa * alone) / (total + model.kappa)).sum() == pytest.approx(1, abs=1e-6)
    assert wrong <= 3  # of two million pairs


def test_scores_equal_a_plain_model(spark, sf, learnt, monkeypatch):
    docs, texts, _, (model, stored, pairs) = learnt
    cache = {}

    def logs(before, word):
        if (before, word) not in cache:
            cache[before, word] = math.log10(probability(model, stored, pairs, before, word))
        return cache[before, word]

    some = sorted(texts, key=lambda i: (len(texts[i]), i))[:60]
    want = {i: sum(logs(b, w) for b, w in zip([b"\n", *texts[i]], texts[i])) for i in some}
    whole = {r.doc_id: tuple(r) for r in lm.score_documents(docs).collect()}
    assert {i: whole[i][-1] for i in some} == pytest.approx(want)
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(lm, "CHUNK", 1 << 14)
    dealt = {r.doc_id: tuple(r) for r in lm.score_documents(docs, broadcast_bytes=0).collect()}
    assert {i: r[:5] for i, r in dealt.items()} == {i: r[:5] for i, r in whole.items()}
    assert {i: r[5] for i, r in dealt.items()} == pytest.approx({i: r[5] for i, r in whole.items()})
    assert {i: r[6] for i, r in dealt.items()} == pytest.approx({i: r[6] for i, r in whole.items()}, rel=1e-4)


def test_long_texts_of_distinct_words(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.getrandbits(40):x}" for _ in range(300_000))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long, "a b", None, "", long])], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.score_documents(docs, broadcast_bytes=0).collect()}
    assert len(rows) == 5 and rows[0].n_tokens == 300_001 and rows[2].n_tokens == rows[3].n_tokens == 1
    assert rows[0].score == rows[4].score and rows[0].score > rows[0].base_score


def test_contexts_with_equal_upper_halves_are_apart(spark):
    """Two words whose hashes share their upper 32 bits: each is followed by its own words, in one filter and in parts."""
    halves, twins = {}, None
    for i in range(1_000_000):
        word = f"w{i}"
        half = xxhash.xxh64_intdigest(word.encode()) >> 32
        if half in halves:
            twins = halves[half], word
            break
        halves[half] = word
    first, second = twins
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 != 1]
    one, other = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    texts = {i: f"{first} sun " * 5 for i in train[:100]} | {i: f"{second} moon " * 5 for i in train[100:]}
    texts |= {one: f"{first} sun", other: f"{first} moon"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    n_first, n_second, tokens, kappa = 500, 5 * (len(train) - 100), 11 * len(train), 500.0
    level = lambda n: float(lm.VALUES[lm._level(np.array([n]))[0]])
    mass = 2 * level(n_first) + 2 * level(n_second) + level(len(train))
    alone = lambda n: (level(n) + 0.5) / (mass + 0.5 * 6)
    after = lambda pair, word, total: math.log10((pair + kappa * alone(word)) / (total + kappa))
    texts_begin = level(100) + level(len(train) - 100)  # the end token before each text's first word
    sun_total, moon_total = level(400) + level(100), level(4 * (len(train) - 100)) + level(len(train) - 100)
    want_one = after(level(100), n_first, texts_begin) + after(level(500), n_first, level(500)) + after(level(100), len(train), sun_total)
    want_other = after(level(100), n_first, texts_begin) + after(0.0, n_second, level(500)) + after(level(len(train) - 100), len(train), moon_total)
    for size in (1 << 30, 0):
        rows = {r.doc_id: r for r in lm.score_documents(docs, broadcast_bytes=size).collect()}
        assert rows[one].train_tokens == tokens
        assert (rows[one].score, rows[other].score) == pytest.approx((want_one, want_other), abs=1e-9)


def test_contexts_go_as_places_among_the_chunks_words(spark, sf):
    """Their ids come back whole, and they take less than half of the ids' eight bytes a pair on the way."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids = lm.WordIds()(texts)[0]
    keys, n, places = lm.distinct_placed_pairs(ids)
    packed = lm._packed_places(places)
    assert (lm._unpacked_places(packed) == places).all() and len(packed) < 4 * len(keys)
    want = lm.distinct_pairs(ids)
    assert (keys == want[0]).all() and (n == want[1]).all() and (lm.distinct_words(ids)[0][places] == want[2]).all()
