"""Language-model scoring keeps every n-gram, however many there are."""

import random
import zlib

import pytest

from trajq.llm.lm import score_documents


def test_the_filter_grows_with_the_input(spark):
    """Words that occur once are stored although the n-grams take many times broadcast_bytes."""
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1][:200]
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    rng = random.Random(1)
    texts = {i: " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000)) for i in train}
    once = [w for i in train[:20] for w in texts[i].split()[:50]]
    docs = spark.createDataFrame([*texts.items(), (held, " ".join(f"never{i}" for i in range(1000))), (held, " ".join(rng.sample(once, 1000)))], "doc_id long, text string")
    dealt = {(r.doc_id, r.n_known): r.score for r in score_documents(docs, broadcast_bytes=1 << 16).collect()}
    # Once and never, 1.5 against 0.5 times the same: log10(3) for each word, less what the filter takes for stored.
    assert dealt[held, 1001] - dealt[held, 1] > 1000 * 0.4
    assert dealt == pytest.approx({(r.doc_id, r.n_known): r.score for r in score_documents(docs, broadcast_bytes=1 << 30).collect()})


def test_pairs_of_rare_words_count(spark):
    """5,000 words are commoner than the 50 whose order is learnt."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    ordered, reverse = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rare, common = [f"s{i}" for i in range(50)], " ".join(f"c{i % 5000}" for i in range(5000 * 4))
    texts = {i: " ".join(rare) for i in train[:60]} | {i: common for i in train[60:80]} | {ordered: " ".join(rare), reverse: " ".join(rare[::-1])}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for size in (1 << 16, 1 << 30):
        rows = {r.doc_id: r for r in score_documents(docs, broadcast_bytes=size).collect()}
        assert rows[ordered].base_score == pytest.approx(rows[reverse].base_score)
        assert rows[ordered].score > rows[reverse].score + 10
