"""Language-model scoring with a log-frequency Bloom filter."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import discard, give_back, materialise, release
from .toxicity import crc_remainder

#: Counts are quantised to powers of the square root of 2.
STEPS = 2.0
MOST_LEVELS = 128
HASHES = 24
#: Bytes of training text for each part of the filter.
PART_BYTES = 1 << 23
#: Characters of text that are counted and scored together, unless one text has more; words whose hashes a task
#: remembers; bytes of a text that are split into words at once.
CHUNK, MOST_CACHED, PIECE = 1 << 22, 1 << 15, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The end token; no word holds white space.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def _level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(STEPS * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


def _level_values() -> np.ndarray:
    """The mean count of each level, in halves; 0 for level 0."""
    out = [0.0]
    for q in range(1, MOST_LEVELS + 1):
        low, high = math.ceil(2 ** ((q - 1) / STEPS) - 1e-9), math.ceil(2 ** (q / STEPS) - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


VALUES = _level_values()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class LogFrequencyBloom:
    """An item of level q is stored as (item, 1) ... (item, q); its level is read by probing upwards until one misses.
    Its bits are half set, so an item that was never stored is taken for one with a chance of 2 ** -HASHES."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # one boolean a bit while in memory

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> LogFrequencyBloom:
        """A filter of a size that these items fill to half the bits."""
        out = cls(np.zeros(64 * max(1, math.ceil(HASHES * int(levels.sum()) / math.log(2) / 64)), bool))
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            for i in range(HASHES):
                out.bits[out._at(keys, level, i)] = True
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, packed: bytes) -> LogFrequencyBloom:
        return cls(np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool))

    def _at(self, keys: np.ndarray, level: int, i: int) -> np.ndarray:
        return (((_mix(keys + np.uint64(level * 0x632BE5AB + i * 0x85EBCA77)) >> HALF) * np.uint64(len(self.bits))) >> HALF).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, MOST_LEVELS + 1):
            for i in range(HASHES):
                live = live[self.bits[self._at(keys[live], level, i)]]
            if not len(live):
                break
            out[live] = level
        return out


class WordIds:
    """Texts to 64-bit hashes of their tokens: words between ASCII white space, A-Z lower-cased, then the end token."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's number of tokens."""
        found, lengths, cache = [np.zeros(0, np.uint64)], [], self.cache
        for text in texts:
            data, at, n = (text or "").encode("utf-8", "surrogatepass").lower(), 0, 1  # bytes.lower() is A-Z only
            while at < len(data):
                space = SPACE.search(data, at + PIECE)
                end = space.start() if space else len(data)
                words = data[at:end].split()
                if len(cache) > MOST_CACHED:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = xxhash.xxh64_intdigest(w)
                found.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                at, n = end, n + len(words)
            found.append(np.full(1, END))
            lengths.append(n)
        return np.concatenate(found), np.array(lengths, np.int64)


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of both whole ids, the context's and the word's."""
    return _mix(_mix(before) + ids)


def _before(ids: np.ndarray) -> np.ndarray:
    """The token before each; an end token precedes the first one of a text, as the texts lie one after another."""
    return np.concatenate((np.full(min(1, len(ids)), END), ids[:-1]))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the filter that a key belongs to; grows with the key. A context is a word, in that word's part."""
    return (((keys >> HALF) * np.uint64(parts)) >> HALF).astype(np.int64)


def _slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, where) of sorted keys."""
    at = _part(keys, parts)
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(at[a]), slice(int(a), int(b))


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], types[t]) for i, (n, t) in enumerate(fields)})


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.decompress(x) for x in column.to_pylist() if x is not None), kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order: the lower halves as they are, the steps between the upper ones byte by byte, as most are small."""
    steps = np.diff(keys >> HALF, prepend=np.uint64(0)).astype("<u4")
    return (keys & LOW).astype("<u4").tobytes() + zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_keys(packed: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(packed[4 * n :]), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) << HALF | np.frombuffer(packed, "<u4", n)


def _packed_places(places: np.ndarray) -> bytes:
    """Numbers in any order, byte by byte, as the upper ones are mostly zero."""
    return zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_places(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, values, len(distinct))


def _values_at(known: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is not among the known ones, which are in order."""
    if not len(known):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, values[at], 0)


@dataclass(frozen=True)
class Pairs:
    """A part of the filter that holds pairs. excess: for the contexts with pairs of inexact levels, what the levels'
    values have in sum beyond the counts. A context is its id, or (chunk, place among the chunk's words) in one number."""

    bloom: LogFrequencyBloom
    contexts: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> Pairs:
        """contexts: each pair's context. Of a pair that comes several times, the first one's stands for all."""
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(which, counts, len(keys))
        levels = _level(counts)
        over = VALUES[levels] - counts
        inexact = over != 0
        return cls(LogFrequencyBloom.of(keys, levels), *_summed(contexts[first[inexact]], over[inexact]))


@dataclass(frozen=True)
class Words:
    """A part of the filter that holds words; beside it, their exact counts, and the sum of each one's pairs as a context."""

    bloom: LogFrequencyBloom
    keys: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, excess: np.ndarray) -> Words:
        """A word is followed by a token as often as it occurs, so its pairs' counts add up to its own. Every context is
        a word that was counted, with its whole id."""
        keys, counts = _summed(keys, counts)
        sums = counts + np.bincount(np.searchsorted(keys, contexts), excess, len(keys))
        return cls(LogFrequencyBloom.of(keys, _level(counts)), keys, counts.astype(np.int64), sums)

    @property
    def mass(self) -> float:
        return float(VALUES[self.bloom.levels(self.keys)].sum())

    def answers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.bloom.levels(keys), _values_at(self.keys, self.counts, keys), _values_at(self.keys, self.sums, keys)


@dataclass(frozen=True)
class Answers:
    """What the filter says of a chunk's distinct words and pairs, in order of their keys."""

    levels: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    pair_levels: np.ndarray


def distinct_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with their numbers, in order. The end token is among them: every text has one."""
    keys, n = np.unique(ids, return_counts=True)
    return keys, n.astype(np.uint32)


def distinct_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with their numbers and contexts, in order."""
    before = _before(ids)
    keys, first, n = np.unique(pair_keys(before, ids), return_index=True, return_counts=True)
    return keys, n.astype(np.uint32), before[first]


def distinct_placed_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with their numbers and the places of their contexts among distinct_words(ids), in order."""
    keys, n, contexts = distinct_pairs(ids)
    return keys, n, np.searchsorted(np.unique(ids), contexts).astype(np.uint32)


@dataclass(frozen=True)
class BigramModel:
    """p(w | v) = (c(v, w) + kappa * p(w)) / (c(v) + kappa) and p(w) = (c(w) + 0.5) / (mass + 0.5 * (types + 1)), the
    counts of w and of (v, w) being those that the filter gives, c(v) the sum of v's pairs and mass the sum of all words. All
    words that were not seen share one place with a count of 0, so both sum to 1."""

    tokens: int
    types: int
    mass: float
    kappa: float

    def alone(self, levels: np.ndarray) -> np.ndarray:
        return (VALUES[levels] + 0.5) / (self.mass + 0.5 * (self.types + 1))

    def score(self, ids: np.ndarray, lengths: np.ndarray, answers: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of each text."""
        words, which = np.unique(ids, return_inverse=True)
        before = np.concatenate((np.searchsorted(words, np.full(min(1, len(ids)), END)), which[:-1]))
        pair = np.unique(pair_keys(_before(ids), ids), return_inverse=True)[1]
        text = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((answers.counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        logs = np.log10((VALUES[answers.pair_levels][pair] + self.kappa * self.alone(answers.levels)[which]) / (answers.sums[before] + self.kappa))
        total = lambda of_tokens: np.bincount(text, of_tokens, len(lengths))
        return total((answers.counts > 0)[which]).astype(np.int64), total(base[which]), total(logs)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some successive rows (id, text, held_out) of one fold at a time."""
    for batch in batches:
        for fold in (False, True):
            rows = batch.filter(pc.equal(batch.column(2), fold))
            ends = np.cumsum(pc.utf8_length(rows.column(1)).fill_null(0).to_numpy().astype(np.int64)) // CHUNK
            cuts = np.flatnonzero(np.diff(ends, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], rows.num_rows]):
                yield rows.slice(int(a), int(b - a))


def _written_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read_batch(written: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(written).read_all().combine_chunks().to_batches()[0]


TOTALS = "types long, tokens long, mass double"
COUNTED = "word boolean, keys binary, counts binary, contexts binary"


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 5,
    held: int = 1,
    broadcast_bytes: int = 1 << 22,
    kappa: float = 500.0,
) -> DataFrame:
    """Score every text by a bigram model learnt from the rows whose crc32(id) mod `modulus` is not `held`.

    All tokens and all pairs of successive tokens of the training rows are counted, and the quantised counts of all are
    stored in a log-frequency Bloom filter. Of up to broadcast_bytes of training text, whose filter is at most about 8
    times that, the filter is one and is broadcast. Beyond, it is dealt into parts of PART_BYTES of text: the distinct n-grams of
    each chunk of texts are sent to their parts, which are built from those of the training chunks and probed for all,
    and the levels come back to the chunk. Scores are the same either way. BigramModel states the probabilities, which
    sum to 1 but for pairs that the filter takes for stored: 2 ** -HASHES of those that are not. base_score is exact:
    words' counts are kept beside the filter. Words, contexts too, are told apart by 64-bit hashes, and pairs by such of
    both: two of n share one with a chance of n^2 / 2^65.

    Returns a row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty
    texts have their end token alone; a null id is in no held-out fold; repeated rows each count and get a row; an
    empty table gives no rows; columns other than the two named are not read, so their names can't clash. A long text
    is one task's work, at some hundred bytes a token.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(crc_remainder(F.col(id_col), modulus) == held, F.lit(False)).alias("held_out"))
    n_bytes = rows.where(~F.col("held_out")).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    if n_bytes <= broadcast_bytes:
        model, words, pairs = _whole_filter(rows, kappa)
        shared = spark.sparkContext.broadcast((words, pairs))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word_ids, (words, pairs) = WordIds(), shared.value
            for some in _chunks(batches):
                tokens, lengths = word_ids(some.column(1).to_pylist())
                answers = Answers(*words.answers(distinct_words(tokens)[0]), pairs.bloom.levels(distinct_pairs(tokens)[0]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(lengths), *map(pa.array, model.score(tokens, lengths, answers))], names)

        scores = rows.mapInArrow(score, schema)
    else:
        model, chunks, answers = _dealt_filter(rows, 1 + n_bytes // PART_BYTES, kappa)

        def score_chunk(some: pa.Table, answers: pa.Table) -> pa.Table:
            answers = answers.sort_by([("pairs", "ascending"), ("part", "ascending")])
            read = Answers(*(_unpacked(answers.column(c), t) for c, t in (("levels", np.uint8), ("counts", np.int64), ("sums", np.float64), ("pair_levels", np.uint8))))
            texts = _read_batch(some.column("texts")[0].as_py())
            tokens, lengths = WordIds()(texts.column(1).to_pylist())
            out = pa.RecordBatch.from_arrays([texts.column(0), texts.column(2), pa.array(lengths), *map(pa.array, model.score(tokens, lengths, read))], names)
            give_back()
            return pa.Table.from_batches([out])

        texts = chunks.select("chunk", "texts").groupBy("chunk")
        scores = materialise(texts.cogroup(answers.groupBy("chunk")).applyInArrow(score_chunk, schema), "scores")
        for table in (chunks, answers):
            discard(table)
    return scores.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def _whole_filter(rows: DataFrame, kappa: float) -> tuple[BigramModel, Words, Pairs]:
    """The filter of a bounded text, in one task, to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds()
        for some in _chunks(batches):
            tokens = word_ids(some.column(1).to_pylist())[0]
            words, pairs = distinct_words(tokens), distinct_pairs(tokens)
            yield _rows(COUNTED, [(True, *(x.tobytes() for x in words), None), (False, *(x.tobytes() for x in pairs))]).to_batches()[0]

    counted = rows.where(~F.col("held_out")).mapInArrow(count, COUNTED).toArrow()

    def column(of_words: bool, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(counted.filter(pc.equal(counted["word"], of_words))[name].to_pylist()), kind)

    pairs = Pairs.of(*(column(False, c, t) for c, t in (("keys", np.uint64), ("counts", np.uint32), ("contexts", np.uint64))))
    words = Words.of(column(True, "keys", np.uint64), column(True, "counts", np.uint32), pairs.contexts, pairs.excess)
    return BigramModel(int(words.counts.sum()), len(words.keys), words.mass, kappa), words, pairs


def _dealt_filter(rows: DataFrame, parts: int, kappa: float) -> tuple[BigramModel, DataFrame, DataFrame]:
    """The model, the chunks of texts, and the filter's answers to each chunk."""
    asked = "chunk long, part long, train boolean, n long, keys binary, counts binary, contexts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, word_ids = TaskContext.get().partitionId() << 32, WordIds()
        for some in _chunks(batches):
            keys, n = distinct_words(word_ids(some.column(1).to_pylist())[0])
            row = (chunk, not some.column(2)[0].as_py(), _packed_keys(keys), _packed(n), len(n), _written_batch(some))
            yield _rows(cuts, [row]).to_batches()[0]
            chunk += 1
        give_back()

    def deal(chunk: int, train: bool, keys: np.ndarray, *counted: np.ndarray) -> pa.RecordBatch:
        """The chunk's keys, by part; their numbers, and places of contexts if they are pairs, too if they are to be counted."""
        pack = (_packed, _packed_places)
        beside = lambda s: [f(x[s]) if train else None for f, x in zip(pack, counted)] + [None] * (2 - len(counted))
        return _rows(asked, [(chunk, p, train, s.stop - s.start, _packed_keys(keys[s]), *beside(s)) for p, s in _slices(keys, parts)]).to_batches()[0]

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds()
        for batch in batches:
            for chunk, train, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield deal(chunk, train, *distinct_placed_pairs(word_ids(_read_batch(texts.as_py()).column(1).to_pylist())[0]))
        give_back()

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield deal(row["chunk"], row["train"], _unpacked_keys(row["keys"], row["n"]), np.frombuffer(zstandard.decompress(row["counts"]), np.uint32))

    def name_contexts(chunk: pa.Table, excess: pa.Table) -> pa.Table:
        """What a chunk's contexts have beyond their counts, by their places, to ids, dealt to the words' parts."""
        if not excess.num_rows:
            return _rows(named, [])
        places, over = _summed(_unpacked(excess.column("places"), np.uint32), _unpacked(excess.column("excess"), np.float64))
        ids = _unpacked_keys(chunk.column("keys")[0].as_py(), chunk.column("n")[0].as_py())[places]
        return _rows(named, [(p, _packed(ids[s]), _packed(over[s])) for p, s in _slices(ids, parts)])

    def keys_of(rows: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *map(_unpacked_keys, rows.column("keys").to_pylist(), rows.column("n").to_pylist())])

    def counted(rows: pa.Table, *columns: tuple) -> tuple[np.ndarray, ...]:
        train = rows.filter(rows.column("train"))
        return keys_of(train), *(_unpacked(train.column(c), t) for c, t in columns)

    def answered(rows: pa.Table, read: Callable[[np.ndarray], tuple]) -> list[tuple]:
        """(chunk, part, answers) for each chunk; every key is looked up once, whatever the number of chunks."""
        keys, which = np.unique(keys_of(rows), return_inverse=True)
        ends = np.cumsum(rows.column("n").to_numpy())
        found = [np.split(x[which], ends[:-1]) for x in read(keys)]
        return [(c, p, *map(_packed, own)) for c, p, *own in zip(rows.column("chunk").to_pylist(), rows.column("part").to_pylist(), *found)]

    def answer_pairs(rows: pa.Table) -> pa.Table:
        """A context is (row, place) here; the first chunk that has a pair hears of what its level has beyond its count."""
        train = rows.filter(rows.column("train"))
        places = [_unpacked_places(x) for x in train.column("contexts").to_pylist()]
        contexts = np.concatenate([np.zeros(0, np.uint64), *(np.uint64(i) << HALF | x for i, x in enumerate(places))])
        pairs = Pairs.of(*counted(rows, ("counts", np.uint32)), contexts)
        excess, chunks_of = {}, train.column("chunk").to_pylist()
        owner = (pairs.contexts >> HALF).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(owner)]):
            excess[chunks_of[owner[a]]] = _packed((pairs.contexts[a:b] & LOW).astype(np.uint32)), _packed(pairs.excess[a:b])
        own = [(*r, *excess.get(r[0], (None, None))) for r in answered(rows, lambda keys: (pairs.bloom.levels(keys),))]
        give_back()
        return _rows(pair_answers, own)

    def answer_words(rows: pa.Table, excess: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows(word_answers, [])
        words = Words.of(*counted(rows, ("counts", np.uint32)), _unpacked(excess.column("contexts"), np.uint64), _unpacked(excess.column("excess"), np.float64))
        own = [(*r, None, None, None) for r in answered(rows, words.answers)]
        return _rows(word_answers, [*own, (None, own[0][1], None, None, None, len(words.keys), int(words.counts.sum()), words.mass)])

    pair_answers = "chunk long, part long, pair_levels binary, places binary, excess binary"
    named = "part long, contexts binary, excess binary"
    word_answers = f"chunk long, part long, levels binary, counts binary, sums binary, {TOTALS}"
    cuts = "chunk long, train boolean, keys binary, counts binary, n long, texts binary"
    chunks = materialise(rows.mapInArrow(cut, cuts), "chunks")
    release(rows.sparkSession)
    of_pairs = materialise(chunks.select("chunk", "train", "texts").mapInArrow(ask_pairs, asked).groupBy("part").applyInArrow(answer_pairs, pair_answers), "pair-answers")
    release(rows.sparkSession)
    placed = of_pairs.where("places is not null").select("chunk", "places", "excess").groupBy("chunk")
    excess = chunks.where("train").select("chunk", "keys", "n").groupBy("chunk").cogroup(placed).applyInArrow(name_contexts, named)
    words = chunks.select("chunk", "train", "keys", "counts", "n").mapInArrow(ask_words, asked).groupBy("part").cogroup(excess.groupBy("part"))
    of_words = materialise(words.applyInArrow(answer_words, word_answers), "word-answers")
    types, tokens, mass = of_words.agg(F.sum("types"), F.sum("tokens"), F.sum("mass")).first()
    words, pairs = (t.where("chunk is not null").drop("types", "tokens", "mass", "places", "excess").withColumn("pairs", F.lit(x)) for t, x in ((of_words, False), (of_pairs, True)))
    answers = materialise(words.unionByName(pairs, allowMissingColumns=True), "answers")
    for table in (of_words, of_pairs):
        discard(table)
    release(rows.sparkSession)
    return BigramModel(tokens or 0, types or 0, mass or 0.0, kappa), chunks, answers
