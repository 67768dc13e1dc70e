"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import materialise

# Closed-class words of the grammar, by language (en, de, fr, es).
TARGETS = "you your yours he she they them their him her these those this people someone du dir ihr sie er tu toi ils elle tú vosotros usted ustedes ellos ella".split()
OBJECTS = "dich euch te vous os".split()
NEGATIONS = "not no never neither nor without nicht kein keine nie ohne ne pas jamais sans aucun no nunca sin ningún".split()
REPORTS = "said says say told called calls wrote quoted reported claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
THREATS = "kill hurt destroy attack shoot stab burn strangle murder töten verletzen tuer frapper brûler matar golpear quemar".split()
SELVES = "i we ich wir je j nous yo nosotros".split()
INTENTS = "will ll shall gonna going want wanna would must wollen werden allons vamos".split()
INTENDING = "werde vais veux voy quiero".split()  # first persons, which need no pronoun
#: What an insult may take on and still be that word: plurals, adverbs, nouns and adjectives of it.
ENDINGS = "s es ly ness ic ish y e n en er".split()

OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, SELF, INTENT, INTENDED, BREAK = SYMBOLS = range(11)
TOKEN = re.compile(r"[^\W\d_]+|[.;!?\n]")


@dataclass(frozen=True)
class Transducer:
    """Reads symbols one by one; step(state, symbol) gives the next state and whether it marks what it reads."""

    name: str
    states: int
    step: Callable[[int, int], tuple[int, bool]]


def within(opens: set[int], words: int) -> Callable[[int, int], tuple[int, bool]]:
    """Marks the symbols that come at most `words` words after one of `opens` in the same clause."""
    return lambda state, symbol: (0 if symbol == BREAK else words if symbol in opens else max(0, state - 1), state > 0)


def after(opens: set[int]) -> Callable[[int, int], tuple[int, bool]]:
    """Marks all symbols of a clause after one of `opens`."""
    return lambda state, symbol: (0 if symbol == BREAK else 1 if symbol in opens else state, state > 0)


def intent(state: int, symbol: int) -> tuple[int, bool]:
    """Marks the three words after a first person's intent: such a verb, or another one within three words of the pronoun.
    States 1 to 3 count down from a pronoun, 4 to 6 from an intent."""
    marks = state > 3
    if symbol == BREAK:
        return 0, marks
    if symbol == INTENDED or (symbol == INTENT and 0 < state < 4):
        return 6, marks
    if symbol == SELF and not marks:
        return 3, marks
    return (0 if state in (0, 1, 4) else state - 1), marks


#: Negation acts on the two words after it, a report on the rest of its clause. An insult looks for a target before it
#: in the clause and in the three words after it. A threat is one if a first person intends it, and someone is its object:
#: the next word, or an object in the three words before it.
PARTS = (
    Transducer("negated", 3, within({NEGATION}, 2)),
    Transducer("reported", 2, after({REPORT})),
    Transducer("targeted", 2, after({TARGET, OBJECT})),
    Transducer("sought", 4, within({INSULT}, 3)),
    Transducer("intended", 7, intent),
    Transducer("aimed", 4, within({OBJECT}, 3)),
    Transducer("struck", 2, within({THREAT}, 1)),
)
#: Arc weights: what a negated and a reported hit still count.
NEGATED, REPORTED = 0.2, 0.4


def compose(parts: tuple[Transducer, ...] = PARTS) -> list[list[tuple[int, tuple[bool, ...]]]]:
    """The product machine: table[state][symbol] is the next state and the mark of each part."""
    states = list(itertools.product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for own in states:
        moves = [[p.step(x, symbol) for p, x in zip(parts, own)] for symbol in SYMBOLS]
        table.append([(number[tuple(to for to, _ in move)], tuple(mark for _, mark in move)) for move in moves])
    return table


#: Path weights of a text's insults, by kind; their share of its words; how sure its threats are one, at full belief.
FEATURES = ("insult", "insult at target", "insults per word", "threat")
#: What the weights of the first three and the bias are drawn to where the labels say little. Weights are never negative.
PRIOR = (1.5, 2.2, 0.5, -3.5)
#: Belief in a threat before any label: as if so many of so many labelled texts with one were toxic.
BELIEVED = (8.0, 10.0)


def bases(word: str) -> Iterator[str]:
    """The word, and what is left of it without an ending."""
    yield word
    for end in ENDINGS:
        if word.endswith(end) and len(word) > len(end) + 3:
            yield word[: -len(end)]


class Grammar:
    """Scores clauses. lexicon: insult to log-odds; forms of one that clean texts hold too have 0."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.table, self.known = lexicon, compose(), {}
        closed = ((THREAT, THREATS), (TARGET, TARGETS), (OBJECT, OBJECTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (SELF, SELVES), (INTENT, INTENTS), (INTENDED, INTENDING))
        self.closed = {w: s for s, words in closed for w in words}

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a word, in any case, and the weight of its arc: an insult's log-odds, 1 for a threat."""
        found = self.known.get(word)
        if found is None:
            own = word.lower()
            weight = next((self.lexicon[w] for w in bases(own) if w in self.lexicon), 0.0)
            symbol = INSULT if weight else self.closed.get(own, OTHER) if own[0].isalpha() else BREAK
            found = symbol, weight if symbol == INSULT else 1.0
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = found
        return found

    def paths(self, text: str | None) -> Iterator[tuple[int, float]]:
        """(0 insult, 1 insult at a target, 2 threat; path weight) of every hit, as its clause reads from left to right."""
        state, insult, threat = 0, None, None
        for token in TOKEN.findall(text or ""):
            symbol, weight = self.symbol(token)
            state, (negated, reported, targeted, sought, intended, aimed, struck) = self.table[state][symbol]
            person = symbol in (TARGET, OBJECT)
            if person and sought and insult is not None:
                insult = (1, insult[1])
            if person and struck and threat is not None:
                yield threat
            threat = None
            if symbol in (INSULT, BREAK) and insult is not None:
                yield insult
                insult = None
            weight *= (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            if symbol == INSULT:
                insult = (int(targeted), weight)
            elif symbol == THREAT and intended:
                if aimed:
                    yield 2, weight
                else:
                    threat = (2, weight)
        if insult is not None:
            yield insult

    def features(self, text: str | None) -> list[float]:
        """log2(1 + sum) of the insults' paths of each kind, whatever their number; 20 times their share of the words, at
        most 1; the weight of the surest threat."""
        sums, hits, threat = [0.0, 0.0], 0, 0.0
        for kind, weight in self.paths(text):
            if kind == 2:
                threat = max(threat, weight)
            else:
                sums[kind] += weight / 3.0
                hits += 1
        words = len((text or "").split()) if hits else 1
        return [*(math.log2(1.0 + x) for x in sums), min(1.0, 20.0 * hits / max(words, 1)), threat]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    weights: tuple[float, ...]  # of the insults' features, then the bias
    belief: float = BELIEVED[0] / BELIEVED[1]  # that a threat is one

    def score(self, features: list[float]) -> float:
        """That the insults are some or the threat is one, taken for independent."""
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, features[:-1]))
        clean = 1.0 - 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))
        return 1.0 - clean * (1.0 - self.belief * features[-1])


def _units(texts: Iterator[str | None], wanted: set[str] | None) -> tuple[set[tuple[str, int]], int]:
    """(word, hash of the word before) of the texts, and how many words there are; of wanted words and forms of these only."""
    found, n = set(), 0
    for text in texts:
        before = ""
        for word in TOKEN.findall(text or ""):
            if not word[0].isalpha():
                continue
            n += 1
            own = word.lower()
            if wanted is None or any(w in wanted for w in bases(own)):
                found.add((own, xxhash.xxh32_intdigest(before)))
            before = own
    return found, n


def _contexts(texts: DataFrame, wanted: set[str] | None, partitions: int) -> tuple[DataFrame, DataFrame]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # a few texts' units at once
            found, n = _units(batch.column(0).to_pylist(), wanted)
            yield pa.RecordBatch.from_arrays([pa.array([None, *(u for u, _ in found)], pa.string()), pa.array([n, *(c for _, c in found)], pa.int64())], ["unit", "context"])

    rows = materialise(texts.mapInArrow(run, "unit string, context long"), "units")
    return rows.where("unit is not null"), rows.where("unit is null")


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", least: float = 16.0, least_odds: float = 3.0, least_contexts: int = 5) -> ToxicityModel:
    """Learn the insult lexicon, the weights and the belief in threats from labelled(text_col, label_col 0/1).

    A word is an insult if the number of distinct words it follows in toxic texts, least_contexts or more, exceeds what
    clean texts let expect: log-odds of least_odds or more, log-likelihood gain of `least` or more. Copies of a text repeat
    the same contexts, so they add nothing. An insult with one of ENDINGS is one too, unless clean texts hold that form at
    lower odds; no other word that shares its beginning is. The weights come from a logistic fit drawn to PRIOR, none of
    them negative; the belief in threats is the share of toxic texts among those with one, drawn to BELIEVED.

    labelled should be a bounded sample, as training_sample gives: the words of its toxic texts, those of them and their
    forms in clean texts, and 4 numbers a row are collected. Null and empty texts have no hits; long texts are read whole;
    rows without a label are left out; without rows the weights are PRIOR; other columns are not read, so their names can't clash.
    """
    ship_package(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).alias("label")).where("label is not null")
    toxic, toxic_n = _contexts(rows.where("label = 1").select("text"), None, 1)
    candidates = toxic.groupBy("unit").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= least_contexts).collect()
    positive = {r.unit: r.n for r in candidates}
    clean, clean_n = _contexts(rows.where("label <> 1").select("text"), set(positive), 1)
    negative = {r.unit: r.n for r in clean.groupBy("unit").agg(F.count_distinct("context").alias("n")).collect()}
    p, n = (float(x.agg(F.sum("context")).first()[0] or 0) + 1.0 for x in (toxic_n, clean_n))
    share, lexicon = p / (p + n), {}
    log_odds = lambda pos, neg: math.log((pos + 0.5) / p) - math.log((neg + 0.5) / n)
    for unit, pos in positive.items():
        neg = negative.get(unit, 0)
        gain = pos * math.log(pos / (share * (pos + neg))) + (neg * math.log(neg / ((1 - share) * (pos + neg))) if neg else 0.0)
        if log_odds(pos, neg) >= least_odds and gain >= least:
            lexicon[unit] = round(log_odds(pos, neg), 4)
    forms = {w for w in negative if w not in lexicon and any(b in lexicon for b in bases(w))}
    lexicon |= {w: 0.0 for w in sorted(forms) if log_odds(positive.get(w, 0), negative[w]) < least_odds}

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    fitted = rows.mapInArrow(featurise, "label int, x array<double>").collect()
    x = np.array([[*r.x[:-1], 1.0] for r in fitted]).reshape(-1, len(PRIOR))
    y = np.array([float(r.label == 1) for r in fitted])
    prior = np.array(PRIOR)
    w, ridge, least = prior.copy(), np.array([1.0] * (len(PRIOR) - 1) + [0.1]), np.array([0.05] * (len(PRIOR) - 1) + [-np.inf])
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, x.T @ (q - y) + ridge * (w - prior))
        after_move = np.maximum(w - 0.5 * move, least)
        done = np.abs(after_move - w).max() < 1e-8
        w = after_move
        if done:
            break
    threatened = [r.label == 1 for r in fitted if r.x[-1] == 1.0 and not r.x[0] + r.x[1]]  # plainly, and for nothing else
    belief = (sum(threatened) + BELIEVED[0]) / (len(threatened) + BELIEVED[1])
    return ToxicityModel(lexicon, tuple(float(v) for v in w), belief)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row per row of docs: id_col, score (0 to 1), predicted (1 if score >= threshold, else 0), matched (the path weights of
    all hits, each kind's as in Grammar.features).

    Only the text is read, whole. Null and empty texts have no clause and get the score of a text without hits; repeated
    rows each get a row; an empty table gives no rows; other columns are not read, so their names can't clash.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            features = [grammar.features(t) for t in batch.column(1).to_pylist()]
            scores = [model.score(x) for x in features]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([x[0] + x[1] + x[-1] for x in features], pa.float64())],
                [id_col, "score", "predicted", "matched"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double, predicted int, matched double")


def crc_remainder(id_col: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", most_rows: int = 12_000, modulus: int = 3, held: int = 1) -> DataFrame:
    """Texts with labels, of rows outside the held-out fold: all of them, or a hash sample of about most_rows labelled ids.
    Repeated rows of docs count once for each different text."""
    train = labels.where(F.col(label_col).isNotNull() & (crc_remainder(F.col(id_col), modulus) != held)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    n = train.count()
    kept = train.where(F.pmod(F.xxhash64(F.lit(4), id_col), F.lit(1_000_000)) < F.lit(1_000_000.0 * min(1.0, most_rows / max(n, 1))))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(kept), id_col)
    return texts.dropDuplicates([id_col, "text"]).select("text", label_col)
