import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from brute import components, passes_rules, shingles

from trajq.llm.mixing import mix_sources


def test_pipeline(spark, sf):
    """Each stage, on all that the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        given, kept = before.collect(), docs.collect()
        if name == "quality rules":
            want = [r.doc_id for r in given if passes_rules(r.text)]
        elif name == "exact dedup":
            largest = {}
            for r in given:
                key = r.text.encode().lower()
                largest[key] = max(largest.get(key, r.doc_id), r.doc_id)
            want = list(largest.values())
        elif name == "n-gram Jaccard join":
            want = [i for i, (_, c) in components({r.doc_id: shingles(r.text, 5) for r in given}, 80, 100).items() if i == c]
        else:
            # What is taken of each document is held against seats given one by one in test_mixing_by_hand.
            want = [r.doc_id for r in mix_sources(before).collect() if r.size for _ in range(math.floor(r.taken / r.size + 0.5))]
        assert Counter(r.doc_id for r in kept) == Counter(want) and kept, name
        texts = {r.doc_id: r.text for r in given}
        assert all(r.text == texts[r.doc_id] for r in kept), name
    assert_packed(docs.collect(), corpus_pipeline.packing(spark, docs, sf).collect())
    out = corpus_pipeline.run(spark, sf).collect()
    assert_packed(docs.collect(), out)


def assert_packed(docs, pieces):
    """Each id of each copy of a document lies in exactly one piece, and sequences are gapless."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies, texts = Counter(r.doc_id for r in docs), {r.doc_id: r.text for r in docs}
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    covered, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, defaultdict(list)
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes())
        covered[r.doc_id][r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all((n == copies[i]).all() for i, n in covered.items())
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows and columns that clash with the operators' own names; and no rows at all."""
    good = " ".join(f"word{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, size int, row string"
    rows = [(i, t, None, s, 1, "yours", "mine", i, "r") for i, t, s in [(1, good, "a"), (1, good, "a"), (2, good.upper(), None), (None, good + " end", "b"), (3, None, "a"), (4, "", None)]]
    for data, kept in ((rows, [4, 2, 2, None]), ([], [0] * 4)):
        docs = spark.createDataFrame(data, schema)
        for (name, stage), n in zip(corpus_pipeline.STAGES[:-1], kept):
            docs = stage(spark, docs, sf).cache()
            assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
            assert n is None or docs.count() == n, name
            assert docs.where("kept <> 'yours'").count() == 0
        assert corpus_pipeline.packing(spark, docs, sf).count() >= (1 if data else 0)


def test_nothing_is_left_behind(spark, sf):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and len(set(glob.glob(f"{folder}/*")) - before) == 1
