"""Nulls, empty texts, long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import os
import random

import pytest
from brute import components, shingles
from pyspark.sql import functions as F

from trajq.llm import ngram_join, warc
from trajq.llm.chat import conversation_digests, format_conversations, read_turns
from trajq.llm.components import connected_components
from trajq.llm.exact import content_sort_dedup
from trajq.llm.lm import score_documents
from trajq.llm.mixing import mix_sources, sainte_lague, take_mix
from trajq.llm.ngram_join import ngram_jaccard_components, one_per_component
from trajq.llm.packing import default_vocabulary, pack
from trajq.llm.pii import permute_digits, pseudonymise
from trajq.llm.quality import quality_cascade, quality_report
from trajq.llm.toxicity import PRIOR, Grammar, ToxicityModel, fit_toxicity, score_toxicity, training_sample
from trajq.llm.warc import archive_round_trip, read_archives, write_archives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, _norm int, size string"
LONG = "wörd " * 60_000


def row(i, text, source="s"):
    return (i, text, "en", source, None, None, "x", 1, "big")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "A b c d e"), (2, "a B C d e"), (2, "a B C d e"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (None, "a b c d e"), (None, None), (7, "Ä b c d e"), (8, "ä b c d e"), (9, "one")]
    return spark.createDataFrame([row(i, t, None if i in (3, 9) else "s") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, odd, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in content_sort_dedup(odd).collect()), key=str)
    assert got == sorted(
        [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False)]
        + [(i, i, 1, True) for i in (5, 6, 7, 8, 9)],
        key=str,
    )
    assert {r.keep_id for r in content_sort_dedup(odd, keep="min").where("group_size = 4").collect()} == {1}
    carried = content_sort_dedup(odd, carry=True)
    assert carried.select("row.*").columns == odd.columns and carried.where("kept").count() == 7 and carried.where("row.kept is not null").count() == 0
    assert content_sort_dedup(empty).count() == 0


def test_exact_with_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").when(F.col("id") % 3 == 1, "sAME").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = content_sort_dedup(docs)
    assert {(r.keep_id, r.group_size) for r in got.where("group_size > 1").collect()} == {(2998, 2000)}
    assert got.where("kept").count() == 1001


def test_near(spark, odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(odd, words=4, least=85, scale=100).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (None, 0, None), (7, 2, 7), (8, 2, 8), (9, 1, 9)}
    assert ngram_jaccard_components(empty).count() == 0
    assert one_per_component(odd).columns == odd.columns


@pytest.mark.parametrize("small", [{"FREQUENCY_CELLS": 1 << 16, "KEY_CELLS": 1 << 16, "ID_BITS": 1}, {"MOST_FILTERED": 0}])
def test_links_do_not_depend_on_sketch_or_filter(spark, sf, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(ngram_join, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = components({r.doc_id: shingles(r.text, 5) for r in docs.collect()}, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs).collect()} == want


def test_near_among_long_texts_of_distinct_words(spark):
    words = [f"w{i}" for i in range(150_000)]
    near, far = (["x" if i % step == 7 else w for i, w in enumerate(words)] for step in (100, 10))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((words, near, far, words[:75_000]), 1)], "doc_id long, text string")
    want = components({r.doc_id: shingles(r.text, 5) for r in docs.collect()}, 80, 100)
    assert {i: c for i, (_, c) in want.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs).collect()} == want


def test_near_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 8))):
            copy[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(copy)
    for i in range(150, 300):
        texts[i] = " ".join([*base[:40], *(f"y{rng.randrange(10_000)}" for _ in range(100))])
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    for n, least in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs, words=n, least=least).collect()}
        assert got == components({i: shingles(t, n) for i, t in texts.items()}, least, 100)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(200, 230)] + [(7, 7), (60, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in [5, *range(10, 61)]}, **{i: 100 for i in [100, *range(200, 230)]}}


TRAPS = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|", "<\\\\|im_sep|>", "a<", "|b", "\\", "<\\n", "", "<|im_sep|>", "x\n<|im_end|>\ny", None]


def test_chat_round_trip(spark, empty):
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "user", "assistant", "assistant", "we\nird<|", None] * 2, TRAPS))]
    rows += [(None, 0, "assistant", "hi"), (2, None, "user", "last"), (2, 0, "assistant", "first"), (2, 0, "assistant", "first")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = format_conversations(turns)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", read_turns(F.col("formatted")).alias("turns")).collect()}
    assert read == {1: [(r or "", x or "") for _, _, r, x in rows[:12]], None: [("assistant", "hi")], 2: [("assistant", "first")] * 2 + [("user", "last")]}
    digests = {r.conv_id: r for r in conversation_digests(out).collect()}
    for r in out.collect():
        said = "".join(x for role, x in read[r.conv_id] if role == "assistant")
        assert (digests[r.conv_id].loss_chars, digests[r.conv_id].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        masked = [r.formatted[s.start : s.end] for s in r.loss_spans]
        said = [x for role, x in read[r.conv_id] if role == "assistant"]
        assert [m.replace("<\\|", "<|").replace("\\\\", "\\") for m in masked] == said
    assert format_conversations(turns.where("false")).count() == 0 and conversation_digests(out).where("n_turns is null").count() == 0


def test_chat_with_very_many_turns(spark):
    n = 16_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (1 + F.col("id") % 3 % 2).cast("int")).alias("role"), F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    out = format_conversations(turns).first()
    want = [f"é<\\|{i}" for i in range(n) if i % 3 == 1]
    assert [out.formatted[s.start : s.end] for s in out.loss_spans] == want
    assert "loss_spans" in conversation_digests(format_conversations(turns))._jdf.queryExecution().optimizedPlan().toString()


def test_pii(spark, odd, empty):
    assert pseudonymise(empty, "k").count() == 0
    same = pseudonymise(odd, "k")
    assert same.columns[: len(SCHEMA.split(","))] == odd.columns and same.where("text is null").count() == 2 and same.where("n_card > 0").count() == 0
    texts = ["4539578763621486", "4539 5787 6362 1486 x", "4539578763621487", "+1 (017) 555-7713 and +1 (017) 555-7713", "1.2.3.4 256.1.1.1", "2024-02-29 2023-02-29", "a.b@c.de; token = \"" + "9" * 40 + "\"", LONG]
    got = [r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    assert got[0].text == got[1].text.replace(" x", "").replace(" ", "") != texts[0] and got[2].text == texts[2]
    digits = [int(c) for c in got[0].text][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    a, b = got[3].text.split(" and ")
    assert a == b != texts[3][:17] and a.startswith("+1 (") and len(a) == 17
    assert got[4].text.endswith(" 256.1.1.1") and got[4].n_ip == 1 and got[5].n_date == 1 and got[5].text.endswith(" 2023-02-29")
    assert (got[6].n_email, got[6].n_secret) == (1, 1) and "a.b@" not in got[6].text and "9999999999" not in got[6].text
    assert got[7].text == LONG
    every = spark.range(1000).select(permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("y"))
    assert every.distinct().count() == 1000 and every.where("length(y) <> 3").count() == 0


def test_toxicity(spark, odd, empty):
    model = ToxicityModel({"scum": 6.0}, PRIOR)
    scores = {r.doc_id: r.score for r in score_toxicity(odd, model).collect()}
    assert len(set(scores.values())) == 1 and score_toxicity(empty, model).count() == 0
    fitted = fit_toxicity(spark.createDataFrame([], "text string, toxic int"))
    assert fitted.weights == PRIOR and fitted.lexicon == {}


def test_toxic_clauses():
    model, grammar = ToxicityModel({"scum": 6.0}, PRIOR), Grammar({"scum": 6.0})
    score = lambda text: model.score(grammar.features(text))
    direct = score("you scum")
    assert direct > score("you are not scum") and direct > score("he said you scum") and score("SCUM!! SCUM!!") > score("scum")
    # Order: a report or a negation acts on what follows, and a threat needs someone to intend it.
    assert score("you scum he said nothing") == direct > score("he said nothing you scum")
    assert score("scum not you") > score("not scum you") and score("no doubt you scum") == direct
    assert score("I will kill you") > score("they kill time") and score("I will kill you") > score("I will not kill you")
    assert score("scum. You") < score("scum you")


def test_harmless_and_toxic_sentences(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(training_sample(docs, labels))
    harmless = ["I had an idea about the identity of the travel agency. We trade there.", "The tradition of transport and travel is old."]
    texts = [*harmless, "I will kill you", "You Are Trash", "You are trash", "You are not trash", "He said you are trash", "I will not kill you"]
    got = [r.score for r in score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()]
    assert max(got[:2]) < 0.5 and got[3] == got[4] > max(got[5:7]) and got[2] > got[7] and min(got[2:5]) > 0.5
    assert min(model.weights[:-1]) > 0
    scores = score_toxicity(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select("score", "toxic").collect()
    toxic, clean = ([r.score for r in scores if r.toxic == t] for t in (1, 0))
    # Four of the 18 toxic labels are on texts without any insult (shouting, a licence line); the others rank above all clean ones.
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.88 and sum(a > max(clean) for a in toxic) >= len(toxic) - 4


def test_lm(spark, odd, empty):
    rows = score_documents(odd).collect()
    assert len(rows) == 12 and all(r.n_tokens >= 1 and r.score <= 0 and r.base_score <= 0 for r in rows)
    assert score_documents(empty).count() == 0
    few = {(r.doc_id, r.n_tokens, r.n_known): r.base_score for r in score_documents(odd, broadcast_bytes=0).collect()}
    assert few == pytest.approx({(r.doc_id, r.n_tokens, r.n_known): r.base_score for r in rows})


def test_packing(spark, odd, empty):
    rows = pack(odd).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id == 4) == 1 and sorted(r.doc_id for r in rows if r.doc_id in (2, 3)) == [2, 2, 3]
    assert pack(empty).count() == 0
    blank = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" * 300_000)], "doc_id long, text string")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary().replace(".tiktoken", ".json"))
    sizes = {r.doc_id: r.doc_tokens for r in pack(blank).collect()}
    assert sizes == {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in blank.collect()}
    small = pack(odd, size=16, open_windows=2, slack=1).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 16 for r in small)


def test_quality(spark, odd, empty):
    assert quality_report(odd).where("base_failed").count() == 12 and quality_report(empty).count() == 0
    clean = spark.createDataFrame([row(1, " ".join(f"word{i}" for i in range(80))), row(2, "* " * 80), row(3, None)], SCHEMA)
    kept = quality_cascade(clean)
    assert kept.columns == clean.columns and [r.doc_id for r in kept.collect()] == [1] and quality_cascade(empty).count() == 0


def test_mixing(spark, odd, empty):
    rows = mix_sources(odd, block_words=1).collect()
    assert len(rows) == 12 and {(r.doc_id, r.size) for r in rows if r.doc_id in (3, 4, 9)} == {(3, 0), (4, 0), (9, 1)}
    assert {r.source: r.target for r in rows}[None] == 3.0 and mix_sources(empty).count() == 0
    assert take_mix(odd).columns == odd.columns and take_mix(empty).count() == 0
    same = spark.createDataFrame([row(1, "a " * 400), row(1, "a " * 400), row(1, None), row(2, "b " * 1000, "t")], SCHEMA)
    want = sum(round(r.taken / r.size) for r in mix_sources(same).collect() if r.size)
    assert take_mix(same).count() == want and take_mix(same).where("text is null").count() == 0


def seats_by_hand(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        won[max(range(len(votes)), key=lambda j: (votes[j] / (2 * won[j] + 1), -j))] += 1
    return won


def test_mixing_by_hand(spark):
    """All that is taken, seat by seat; the hashes that deal and order the documents come from Spark."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "big" if i % 20 else "small" if i % 40 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix_sources(docs, block_words=4, shard_words=500).collect()}
    hashes = {r.doc_id: (r.a, r.b) for r in docs.select("doc_id", F.xxhash64(F.lit(20), "doc_id").alias("a"), F.xxhash64(F.lit(21), "doc_id").alias("b")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    own = {s: [i for i, _, x in rows if x == s] for s in ("big", "small", None)}
    words = {s: sum(size[i] for i in ids) for s, ids in own.items()}
    blocks = dict(zip(own, seats_by_hand([got[ids[0]].target for ids in own.values()], round(sum(words.values()) / 4))))
    for s, ids in own.items():
        shards = {}
        for i in ids:
            shards.setdefault(hashes[i][0] % max(1, -(-words[s] // 500)), []).append(i)
        names = sorted(shards)
        cells, limit = [sum(size[i] for i in shards[k]) for k in names], min(blocks[s], words[s] * 3 // 4)
        first = seats_by_hand(cells, limit)
        given = [min(q, 3 * c // 4) for q, c in zip(first, cells)]
        left = [3 * c // 4 - g for c, g in zip(cells, given)]
        quota = [g + min(q, x) for g, q, x in zip(given, seats_by_hand(left, min(limit - sum(given), sum(left))), left)]
        for k, q in zip(names, quota):
            want, at = dict.fromkeys(shards[k], 0), 0
            stream = sorted(shards[k], key=lambda i: (hashes[i][1], i))
            for i in stream * 3:
                part = min(size[i], 4 * q - at)
                want[i], at = want[i] + part, at + part
            assert {i: got[i].taken for i in stream} == want


def test_a_small_source_gets_its_target(spark):
    docs = spark.range(1060).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), F.when(F.col("id") < 1000, 1000).otherwise(100)).alias("text"))
    taken = {r.source: (r.t, r.target) for r in mix_sources(docs, shard_words=512, weights=(1, 1)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert taken["b"][1] == 18_000 and abs(taken["b"][0] - 18_000) <= 16 * 12
    assert {r.t for r in mix_sources(docs, weights=(1, 1)).where("source = 'b'").agg(F.sum("taken").alias("t")).collect()} == {18_000}


def test_highest_quotients(spark):
    rng = random.Random(3)
    for _ in range(5):
        votes = [rng.choice((0, 1, 5, 100, 9999)) * rng.random() for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * won[j] + 1), -j))
            won[i] += 1
        parties = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, p int, v double, m long")
        assert [r.seats for r in sainte_lague(parties, ["g"], ["p"], "v", "m", "seats").orderBy("p").collect()] == won


def test_archives_keep_ids_of_text(spark):
    ids = ["a%0Ab", "a%250Db", "", None, "a\nb", "a\r\nb", "100%", "%25", " x ", "é: ü"]
    pages = spark.createDataFrame([(i, None, f"page {n}") for n, i in enumerate(ids)] + [(i, "u", "same " * 300) for i in ids], "page_id string, url string, html string")
    got = archive_round_trip(pages).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted(ids * 2, key=str) and all(r.intact for r in got)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {max(i for i in ids if i is not None)}


def test_archives(spark, tmp_path):
    body = "<p>" + "x" * 2000
    rows = [(1, "http://a/", body), (5, None, body), (5, None, body), (None, "http://b\r\nX: y", body), (3, "u", None), (4, "u", None), (2, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.intact) for r in archive_round_trip(pages).collect()), key=str)
    n = len(body)
    want = [(1, "revisit", 5, n, True), (5, "response", None, n, True), (5, "revisit", 5, n, True), (None, "revisit", 5, n, True), (3, "response", None, 0, True), (4, "response", None, 0, True), (2, "response", None, 1000, True)]
    assert got == sorted(want, key=str)
    assert archive_round_trip(pages.where("false")).count() == 0
    files = []
    for name in ("a", "b"):
        manifest = write_archives(pages, f"file://{tmp_path}/{name}", roll_bytes=300)
        files.append(sorted((r.file, r.file_sha1) for r in manifest.collect()))
        assert read_archives(spark, f"file://{tmp_path}/{name}").count() == 7
        assert not os.path.exists(f"{tmp_path}/{name}/_temporary")
    assert files[0] == files[1] and len(files[0]) > 3


def test_record_ids_are_unique(spark, tmp_path):
    """Repeated rows, a null id beside the id "None", and one id with two payloads; the first date is in another zone's day."""
    rows = [("1", "x" * 2000), ("1", "x" * 2000), ("1", "x" * 2000), ("1", "y"), ("1", "y"), (None, "z"), ("None", "z"), ("0", "x" * 2000)]
    pages = spark.createDataFrame([(i, "u", t, n) for n, (i, t) in enumerate(rows)], "page_id string, url string, html string, n int")
    dated = pages.withColumn("at", F.when(F.col("n") == 7, F.timestamp_seconds(F.lit(1_700_000_000))))
    manifest = write_archives(dated, f"file://{tmp_path}/w", date_col="at")
    heads = []
    for r in manifest.collect():
        with open(f"{tmp_path}/w/{r.file}", "rb") as f:
            heads += [h for h, _ in warc._records(f) if h["WARC-Type"] != "warcinfo"]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) == 8
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and all(ids[h["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[h["WARC-Refers-To"]]["X-Page-Id"] == "1" for h in revisits)
    assert {h["WARC-Date"] for h in heads if h["X-Page-Id"] == "0"} == {"2023-11-14T22:13:20Z"} and {h["WARC-Date"] for h in heads if h["X-Page-Id"] == "1"} == {warc.DATE}
