"""Token alignment against plain Python with the tokenizers library and the model's own pieces."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from compare import database
from pyspark.sql import functions as F
from test_llm_edges import LONG, SCHEMA, row
from tokenizers import Tokenizer

from trajq.llm import align, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _byte_chars():
    """Characters of the vocabulary file by byte: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE = _byte_chars()


def a_bytes(i):
    return bytes(BYTE[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(of(i)), i))
        at += len(of(i))
    return out


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    groups, links, sizes = [], [], []
    for text in texts:
        a, b = (spans(A.encode(" " + text, add_special_tokens=False).ids, a_bytes), spans(B.encode(text), b_bytes)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(a_bytes(t[2]) for t in a) != whole or b"".join(b_bytes(t[2]) for t in b) != whole:
            a, b = [], []
        cuts = sorted({t[1] for t in a} & {t[1] for t in b})
        within = {c: ([], []) for c in cuts}
        for side, tokens in enumerate((a, b)):
            for _, end, i in tokens:
                within[cuts[bisect.bisect_left(cuts, end)]][side].append(str(i))
        groups.append([",".join(x) + "|" + ",".join(y) for x, y in within.values()])
        ending = defaultdict(list)
        for _, end, i in b:
            ending[end].append(i)
        links.append([(i, j) for _, end, i in a for j in ending[end]])
        sizes.append((len(a), len(b)))
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(*n, len(g), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest(g)) for n, g, own in zip(sizes, groups, links)]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def values(r):
    return tuple(r[c] for c in FIELDS)


@pytest.mark.parametrize("block,chunk", [(1 << 17, 1 << 20), (3000, 9000)])
def test_op12(spark, sf, monkeypatch, block, chunk):
    monkeypatch.setattr(align, "BLOCK_CHARS", block)
    monkeypatch.setattr(align, "CHUNK_CHARS", chunk)
    texts = dict(database(sf).sql("SELECT doc_id, text FROM documents WHERE length(text) < 4000").fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").repartition(3)
    want = dict(zip(texts, plain(list(texts.values()))))
    got = align.align_tokens(docs).collect()
    assert len(got) == len(texts) and {r.doc_id: values(r) for r in got} == want


def test_the_query_reads_all(spark, sf):
    got = queries.op12_token_alignment(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_links == r.n_groups for r in got)  # no token is empty, so each group ends in one pair


def test_odd_texts(spark):
    texts = ["", None, " ", "\n", "a▁b", "plain <|endoftext|> and <s> </s> <unk> <0x41>", "é😀中　x", "\x00\x01a", " lead", "same text", "same text", "  \t \r\n ", "ﬁ ½ Å", "x" * 5000, "a  b   c    d", LONG[:6000]]
    docs = spark.createDataFrame([row(None if i == 9 else i, t) for i, t in enumerate(texts)], SCHEMA).withColumn("n_a", F.lit("x")).withColumn("chunk", F.lit(1)).repartition(3)
    want = Counter(zip([None if i == 9 else i for i in range(len(texts))], plain(texts)))
    assert Counter((r.doc_id, values(r)) for r in align.align_tokens(docs).collect()) == want
    assert align.align_tokens(docs.where("false")).count() == 0
    assert align.align_tokens(docs.where("doc_id < 2")).select("n_a", "count_sum", "groups_sha256").distinct().count() == 1
    named = align.align_tokens(docs.withColumnRenamed("doc_id", "my id").withColumnRenamed("text", "body"), "my id", "body")
    assert named.columns[0] == "my id" and named.count() == len(texts)


def test_groups_and_overlaps_of_random_cuts():
    draw = random.Random(5)
    for _ in range(200):
        n = draw.randint(1, 40)
        cut = lambda: np.array(sorted({*draw.sample(range(1, n + 1), draw.randint(0, n)), n}))  # noqa: B023, E731
        a, b = cut(), cut()
        both = sorted(set(a.tolist()) & set(b.tolist()))
        a_group, b_group = align.coalesce(a, b)
        assert a_group.tolist() == [sum(c < e for c in both) for e in a.tolist()] and b_group.tolist() == [sum(c < e for c in both) for e in b.tolist()]
        own = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        want = [(i, j) for i, s in enumerate(own(a)) for j, t in enumerate(own(b)) if s[0] < t[1] and t[0] < s[1]]
        assert list(zip(*(x.tolist() for x in align.overlaps(a, b)))) == want


def test_chunks_are_read_a_few_at_a_time(spark, sf, monkeypatch):
    """A task's chunks are many row groups, none larger than the bound and a row; no lazy step is left over them."""
    groups = {}

    def written(df, name, **options):
        out = materialise(df, name, **options)
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
        groups[name] = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in files for i in range(m.num_row_groups)]
        return out

    materialise = align.materialise
    monkeypatch.setattr(align, "materialise", written)
    monkeypatch.setattr(align, "GROUP_BYTES", 40_000, raising=False)
    monkeypatch.setattr(align, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(align, "CHUNK_CHARS", 4000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").coalesce(1).crossJoin(F.broadcast(spark.range(40)))
    got = align.align_tokens(docs)
    for name in ("chunks", "answers"):
        assert sum(n for n, _ in groups[name]) > 30 and max((size for n, size in groups[name] if n > 1), default=0) <= 80_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan and got.count() == docs.count()
