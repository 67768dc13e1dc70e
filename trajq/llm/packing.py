"""Packing token sequences into fixed windows with bounded space."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import materialise

#: Leftover windows of so many partitions are merged by one task; each partition leaves one at most.
MERGE_BLOCK = 1024
LEFT_IDS = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@functools.cache
def _reference_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by a byte-level BPE vocabulary file of ranks; the text <|endoftext|> is its one special token.

    The ids equal those of the tokenizers library with the JSON file of the same vocabulary beside it (a test compares
    them). That library takes over where the faster one gives up, on runs of about a million blanks.
    """

    def encode(text: str) -> np.ndarray:
        encoder = _encoder(path)
        try:
            if "<|endoftext|>" in text:
                return np.array(encoder.encode(text, allowed_special="all"), dtype=np.uint32)
            return encoder.encode_to_numpy(text, disallowed_special=())
        except (ValueError, RuntimeError):
            slower = _reference_encoder(path.removesuffix(".tiktoken") + ".json")
            return np.array(slower.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


class OpenWindows:
    """A fixed number of open windows, filled best-fit.

    A piece goes whole into the fullest window that has room. When none has, the fullest is emitted; if its gap is
    wider than `slack` ids, the piece's head fills it first, as documents may be cut anywhere.
    """

    def __init__(self, size: int, most: int, slack: int, emit: Callable[[list, bool], None]):
        self.size, self.most, self.slack, self.emit, self.open = size, most, slack, emit, []

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size])], False)
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            room = [w for w in self.open if w[0] + len(ids) <= self.size]
            if room or len(self.open) < self.most:
                window = max(room, key=lambda w: w[0]) if room else [0, []]
                if not room:
                    self.open.append(window)
                window[0] += len(ids)
                window[1].append((doc, start, ids))
                if window[0] == self.size:
                    self.close(window)
                return
            fullest = max(self.open, key=lambda w: w[0])
            if (gap := self.size - fullest[0]) > self.slack:
                fullest[1].append((doc, start, ids[:gap]))
                start, ids = start + gap, ids[gap:]
            self.close(fullest)

    def close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1], False)

    def finish(self) -> None:
        """Merge the open windows into full ones; at most one partial window is left over."""
        gathered, fill = [], 0
        for window in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids in window[1]:
                while len(ids):
                    part = ids[: self.size - fill]
                    gathered.append((doc, start, part))
                    start, ids, fill = start + len(part), ids[len(part) :], fill + len(part)
                    if fill == self.size:
                        self.emit(gathered, False)
                        gathered, fill = [], 0
        if gathered:
            self.emit(gathered, True)
        self.open = []


def _merge_leftovers(block: pd.DataFrame) -> pd.DataFrame:
    """Whole leftover windows, the longest first, each into the fullest sequence with room. Reads one block's rows."""
    size = int(block["size"].iloc[0])
    lengths = block.groupby("part")["length"].sum().sort_index().sort_values(ascending=False, kind="stable")
    fills: list[int] = []
    where = {}
    for part, n in lengths.items():
        room = [i for i, fill in enumerate(fills) if fill + n <= size]
        if not room:
            fills.append(0)
            room = [len(fills) - 1]
        i = max(room, key=lambda j: fills[j])
        where[part] = (i, fills[i])
        fills[i] += int(n)
    base = LEFT_IDS + int(block["part"].iloc[0]) // MERGE_BLOCK * MERGE_BLOCK
    out = block.assign(sequence_id=[base + where[p][0] for p in block["part"]], offset=[o + where[p][1] for o, p in zip(block["offset"], block["part"])])
    return out[_PIECE_COLUMNS]


_PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    size: int = 1024,
    open_windows: int = 32,
    slack: int = 8,
) -> DataFrame:
    """Tokenise every text, end it with end_id, and pack the ids into sequences of at most `size`.

    Each partition reads its documents once, in order, and holds `open_windows` windows and one document's ids in
    memory, whatever its size; nothing but the pieces' descriptions leaves it. What is left at its end is merged into
    full windows and one partial one, and partial ones of up to MERGE_BLOCK partitions are merged once more.

    Returns a row per piece: doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id and offset. A null or empty text is its end id alone; repeated rows are
    packed each for itself; an empty input gives no rows; other columns are not read, so their names can't clash; a long text's ids
    are held at once. Padding is at most `slack` ids in a sequence, but for
    merged leftovers.
    """
    ship_package(docs.sparkSession)
    encode = byte_bpe(vocabulary or default_vocabulary())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pieces: list[tuple] = []
        n_windows = 0

        def emit(window: list, left: bool) -> None:
            nonlocal n_windows
            offset = 0
            for (doc, total), start, ids in window:
                pieces.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, part << 32 | n_windows, offset, part, left))
                offset += len(ids)
            n_windows += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [()] * 9
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

        names = [*_PIECE_COLUMNS, "part", "left"]
        types: list = []
        windows = OpenWindows(size, open_windows, slack, emit)
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 7, pa.bool_()]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                windows.add((doc, len(ids)), 0, ids)
            if pieces:
                yield flush()
        windows.finish()
        if pieces:
            yield flush()

    described = rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, left boolean")
    packed = materialise(described, "pieces")
    merged = (
        packed.where("left")
        .withColumn("size", F.lit(size))
        .groupBy(F.floor(F.col("part") / MERGE_BLOCK))
        .applyInPandas(_merge_leftovers, packed.select(*_PIECE_COLUMNS).schema)
    )
    return packed.where(~F.col("left")).select(*_PIECE_COLUMNS).unionByName(merged)
