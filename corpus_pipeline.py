"""A corpus pipeline: quality rules, exact duplicates, near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajq.llm.common import delete, materialise, read, temporary_tables
from trajq.llm.exact import content_sort_dedup
from trajq.llm.mixing import take_mix
from trajq.llm.ngram_join import one_per_component
from trajq.llm.packing import pack
from trajq.llm.quality import quality_cascade


#: What holds for every stage but the last: it returns the columns of its input, whatever their names; extra columns
#: go along; repeated rows are rows of their own; an empty table gives an empty table; texts are read whole.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, null and empty texts among them (they have too few words)."""
    return quality_cascade(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the largest doc_id stays; of rows that have both in common, one.
    Null texts equal empty ones; null ids rank last."""
    return content_sort_dedup(docs, carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the smallest doc_id stays. Texts
    without words are linked with nothing and stay, as do rows with a null id."""
    return one_per_component(docs, words=5, least=80, scale=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or up to three times. Texts without words are not taken;
    null sources are one source."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of 1024 ids; a null or empty text is its end id alone."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Shingle links, seeded selection and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        with temporary_tables(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
            own = made.pop()
        if before:
            delete(spark, before)
        before = own
    return docs
