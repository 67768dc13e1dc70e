"""Aligning the tokens of two tokenizers over the same texts."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import give_back, materialise, setting, temporary_tables
from .packing import _encoder, _reference_encoder, default_vocabulary

#: A chunk is whole texts of so many characters together; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20
#: Texts of so many characters together are encoded and aligned at a time.
BLOCK_CHARS = 1 << 17
#: Tables with a row per chunk, which takes about a megabyte, are written in row groups of so many bytes, or one row.
GROUP_BYTES = 1 << 22
#: Bytes of rows that a Python worker gets at a time, and chunks whose answers a task holds before it sorts them instead.
BATCH_BYTES, GROUPS_HELD = "8m", "16"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """Tokens of a byte-level BPE vocabulary file of ranks; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.path, self.encoder = path, _encoder(path)
        self.bytes = [self.encoder.decode_single_token_bytes(i) for i in range(self.encoder.n_vocab)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: str) -> list[int]:
        try:
            return self.encoder.encode_ordinary(text)
        except (ValueError, RuntimeError):  # runs of about a million blanks
            slower = _reference_encoder(self.path.removesuffix(".tiktoken") + ".json")
            before, slower.encode_special_tokens = slower.encode_special_tokens, True
            try:
                return slower.encode(text, add_special_tokens=False).ids
            finally:
                slower.encode_special_tokens = before


class PieceTokens:
    """Tokens of a sentencepiece model: U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@functools.cache
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, numbered from 0, given where tokens end that cover the same bytes.

    All tokens are put in order of their starts; a group breaks where a start reaches the largest end so far.
    """
    starts = np.concatenate([_starts(a_ends), _starts(b_ends)])
    ends = np.concatenate([a_ends, b_ends])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_ends)], group[len(a_ends) :]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all A and B tokens that share a byte, in order: at most one pair a token."""
    first = np.searchsorted(b_ends, _starts(a_ends), "right")
    n = np.searchsorted(_starts(b_ends), a_ends, "left") - first
    i = np.repeat(np.arange(len(a_ends)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _starts(ends: np.ndarray) -> np.ndarray:
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1]
    return starts


class Aligner:
    """Aligns blocks of texts; their bytes are laid end to end, so that one pass does for all of a block."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        # A token's text in the groups' listing, by what comes after it.
        follow = lambda n, ends: [f"{i}{end}" for end in ends for i in range(n)]
        self.names = follow(len(a.bytes), ",|") + follow(len(b.bytes), ",;")

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        whole = " " + text
        data, a, b = whole.encode(), self.a.ids(whole), self.b.ids(text)
        same = b"".join(map(self.b.bytes.__getitem__, b)) == data and b"".join(map(self.a.bytes.__getitem__, a)) == data
        return (a, b) if same else ([], [])

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray]:
        """A column each of what is known of a text by itself, and the links' id pairs (A << 32 | B) of all texts in order."""
        encoded = [self.encode(t) for t in texts]
        n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        a, b = (np.array([i for e in encoded for i in e[k]], np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        a_group, b_group = coalesce(a_ends, b_ends)
        i, j = overlaps(a_ends, b_ends)
        linked = a_ends[i] == b_ends[j]
        i, j = i[linked], j[linked]
        a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        of = np.repeat(np.arange(len(texts)), n_a)
        last = a_from + n_a - 1
        n_groups = np.where(n_a > 0, a_group[last] - a_group[np.minimum(a_from, len(a) - 1)] + 1, 0) if len(a) else n_a
        n_links = np.bincount(of[i], minlength=len(texts)) if len(a) else n_a
        columns = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "groups_sha256": self._digests(a, b, a_group, b_group, n_a, n_b)}
        return columns, a[i] << 32 | b[j]

    def _digests(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        ends = lambda group: np.append(group[1:] != group[:-1], True)[: len(group)]
        names = np.concatenate([a + len(self.a.bytes) * ends(a_group), b + len(self.b.bytes) * ends(b_group) + 2 * len(self.a.bytes)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        names, at, out = names[order].tolist(), 0, []
        for n in (n_a + n_b).tolist():
            listing = "".join(map(self.names.__getitem__, names[at : at + n]))
            out.append(hashlib.sha256(listing[:-1].encode()).hexdigest() if n else "")
            at += n
        return out


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc)
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """Per row of docs, how the tokens of a byte-level BPE (A, over a space and the text) and of a sentencepiece model
    (B, over the text) line up, and how common its links are in the whole of docs.

    Bytes at which tokens of both end cut them into groups; a link is an A and a B token that end together. Texts are
    encoded once. A chunk of texts is written with its distinct id pairs, how often each occurs and the links as
    positions among these. The pairs are counted over all chunks, combined before the shuffle; each chunk then asks once
    for each of its pairs. A pair that all chunks hold is split by AQE: both sides of that join are written tables. The
    largest count per B id, at most a row per id of the vocabulary, is broadcast, and nothing else is. A task holds a few
    chunks at a time, however many are its share: tables of chunks are read by row groups of a few rows, and answers are
    gathered chunk by chunk.

    Returns id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of their B id, ties
    included), count_sum (of the pairs' counts over the links) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`, ids in order).
    A text that is null or empty, or whose tokens don't give its bytes back (as with U+2581 in it), has no tokens: zeros
    and an empty groups_sha256. A long text is encoded at once, at about a hundred bytes of memory a character; repeated
    rows are rows of their own and count each; null ids are kept; an empty table gives no rows; other columns are not
    read, so their names can't clash.
    """
    ship_package(docs.sparkSession)
    a_path, b_path = bytes_path or default_vocabulary(), pieces_path or default_pieces()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    lists = ", ".join(f"{c} array<long>" for c in _COUNTS)
    schema = f"chunk long, doc_id array<{kind}>, {lists}, groups_sha256 array<string>, pairs array<long>, times array<long>, links binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_tokens(a_path), piece_tokens(b_path))
        part, n_chunks = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        pairs: list[np.ndarray] = []
        chars, id_type = 0, None

        def chunk() -> pa.RecordBatch:
            nonlocal n_chunks
            distinct, links, times = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            types = {"doc_id": id_type, "groups_sha256": pa.string()}
            arrays = {"chunk": pa.array([part << 32 | n_chunks], pa.int64())}
            arrays |= {c: pa.array([held[c]], pa.list_(types.get(c, pa.int64()))) for c in ["doc_id", *_COUNTS, "groups_sha256"]}
            arrays |= {"pairs": pa.array([distinct], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64()))}
            arrays["links"] = pa.array([links.astype("<u4").tobytes()], pa.binary())
            n_chunks += 1
            held.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for ids, texts in _blocks(typed()):
            columns, linked = aligner.align(texts)
            for c, values in ({"doc_id": ids} | columns).items():
                held.setdefault(c, []).extend(values)
            pairs.append(linked)
            chars += sum(len(t or "") for t in texts)
            if chars >= CHUNK_CHARS:
                yield chunk()
                chars = 0
        if held:
            yield chunk()
        give_back()

    names = [f"`{id_col}`" if c == "doc_id" else c for c in ["doc_id", *_COUNTS]]
    result = f"{names[0]} {kind}, " + ", ".join(f"{c} long" for c in [*_COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                column = lambda c: batch.column(c)[r]  # noqa: B023, E731
                n = np.array(column("n_links").values)
                codes = np.array(column("answers").values, np.int64) if len(column("answers")) else np.zeros(0, np.int64)
                codes = codes[np.frombuffer(column("links").as_py(), "<u4")]
                edges = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (codes & 1, codes >> 1)]
                added = [pa.array(s[edges[1:]] - s[edges[:-1]], pa.int64()) for s in sums]
                plain = [column(c).values for c in ["doc_id", *_COUNTS]]
                yield pa.RecordBatch.from_arrays([*plain, *added, column("groups_sha256").values], [id_col, *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    spark = docs.sparkSession
    few_rows = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1"}
    with temporary_tables(spark) as made, setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        chunks = materialise(rows.mapInArrow(encode, schema), "chunks", **few_rows)
        once = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        counts = materialise(once.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pairs")
        best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
        codes = materialise(counts.join(best, "b").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("code")), "codes")
        asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
        answers = asked.join(codes.hint("merge"), "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("answers"))
        with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", GROUPS_HELD):
            answers = materialise(answers.select("chunk", F.col("answers.code").alias("answers")), "answers", **few_rows)
        nothing = F.array().cast("array<long>")
        known = chunks.drop("pairs", "times").join(answers.hint("merge"), "chunk", "left").withColumn("answers", F.coalesce("answers", nothing)).drop("chunk")
        aligned = materialise(known.mapInArrow(finish, result), "aligned")
        made.pop()
    return aligned
