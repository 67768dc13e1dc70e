"""Document quality rules, run as a short-circuit cascade."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq.session import ship_package

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


class TextFeatures:
    """What the rules need to know of one text; each figure is computed on first use. A null text has no words."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() splits at exactly the six ASCII white-space characters
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a 3-word window found twice or more."""
        if self.n_words < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 2_000_000:  # else pair * words would leave 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        repeated = counts[which] > 1
        if not repeated.any():
            return 0
        covered = np.zeros(self.n_words, bool)
        for i in range(3):
            covered[i : i + len(repeated)] |= repeated
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFeatures], bool]


MIN_WORDS = Rule("min_words", lambda x: x.n_words < 50)
REPEATED_WORDS = Rule("repeated_words", lambda x: 100 * x.n_repeat_words > 50 * x.n_words)
BASE_RULES = (MIN_WORDS, REPEATED_WORDS)
#: The rules used in production.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda x: 100 * x.n_symbols > 10 * x.n_words),
    Rule("duplicate_lines", lambda x: x.n_dup_lines >= 4 and 100 * x.n_dup_lines > 30 * len(x.lines)),
    Rule("shouting", lambda x: 100 * x.n_shouts > 30 * x.n_words),
    Rule("word_length", lambda x: not 2 * x.n_words <= x.word_chars <= 15 * x.n_words),
)


def order_rules(docs: DataFrame, rules: Iterable[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000, seed: int = 17) -> list[Rule]:
    """The rules by rejections per second, highest first, as measured on about sample_rows rows.

    The sample sets only the order, and so the cost: the verdict on a document is the same in any order.
    """
    ship_package(docs.sparkSession)
    rules = list(rules)
    n = docs.count()
    if not n:
        return rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for rule in rules:
                    features = TextFeatures(text)  # nothing shared: each rule bears its whole cost
                    began = time.perf_counter()
                    rejected[rule.name] += rule.rejects(features)
                    spent[rule.name] += time.perf_counter() - began
        names = [r.name for r in rules]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[x] * 1.0 for x in names]), pa.array([rejected[x] for x in names], pa.int64())], ["rule", "cost", "rejected"])

    sample = docs.select(F.col(text_col).cast("string")).sample(False, min(1.0, sample_rows / n), seed)
    totals = sample.mapInArrow(measure, "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost"), F.sum("rejected")).collect()
    worth = {name: rejected / max(cost, 1e-9) for name, cost, rejected in totals}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def verdict(features: TextFeatures, ordered: Iterable[Rule]) -> bool:
    """Whether the text passes; the first rule that rejects it ends the cascade."""
    return not any(rule.rejects(features) for rule in ordered)


def quality_cascade(docs: DataFrame, rules: Iterable[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of docs, with all their columns, whose text every rule passes. A null text counts as empty, and so has
    too few words; texts are judged whole; repeated rows are judged each; columns of any name go along; no rows give none."""
    ordered = order_rules(docs, rules, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(TextFeatures(x), ordered) for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def quality_report(docs: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """For every row: id_col, the base figures, base_failed and kept (false if base_failed, else the cascade's verdict).

    Null and empty texts have no words, so base_failed holds; repeated rows each get a row; other columns are ignored; an
    empty table gives no rows. As the figures are columns, each is computed for every text here: the cascade decides
    `kept` but saves work only in quality_cascade, which returns documents.
    """
    ordered = order_rules(docs, rules, text_col, sample_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in counts]
            failed, kept = [], []
            for text in batch.column(1).to_pylist():
                features = TextFeatures(text)
                kept.append(verdict(features, ordered))
                failed.append(any(r.rejects(features) for r in BASE_RULES))
                for column, name in zip(out, counts):
                    column.append(getattr(features, name))
            kept = [k and not f for k, f in zip(kept, failed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [id_col, *counts, "base_failed", "kept"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(report, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean")
