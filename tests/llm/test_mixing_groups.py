"""A source of very many shards: quotas by groups of them, and how these are dealt."""

import pytest
from pyspark.sql import functions as F

from trajq.llm import mixing


@pytest.mark.parametrize("grouped", [3, 1024])
def test_targets_are_met_within_blocks(spark, monkeypatch, grouped):
    monkeypatch.setattr(mixing, "GROUPED", grouped)
    words = F.concat_ws(" ", F.sequence(F.lit(1), F.col("id") % 37 + 1))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, None).otherwise("b").alias("source"), words.cast("string").alias("text"))
    rows = mixing.mix_sources(docs, block_words=8, shard_words=300).collect()
    assert len(rows) == 3000 and all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in ("a", "b", None):
        own = [r for r in rows if r.source == source]
        full = own[0].target == 3 * own[0].source_size  # then each shard holds whole blocks only
        assert abs(sum(r.taken for r in own) - own[0].target) <= (8 * -(-own[0].source_size // 300) if full else 16) and sum(r.size for r in own) == own[0].source_size


def test_no_task_has_a_sources_shards(spark, monkeypatch):
    """20,000 shards of one source: all seats are given, none above a shard's room, in groups of 100."""
    monkeypatch.setattr(mixing, "GROUPED", 100)
    n, most = 20_000, []
    cells = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("shard"), (F.col("id") % 50 * 16).alias("cell_size"), (F.col("id") % 50 * 3).alias("room"), F.lit(700_000).cast("long").alias("seats"))
    own = mixing.quotas_within

    def watched(df, group, *rest):
        most.append(df.groupBy(*group).count().agg(F.max("count")).first()[0])
        return own(df, group, *rest)

    monkeypatch.setattr(mixing, "quotas_within", watched)
    out = mixing.shard_quotas(cells)
    assert out.agg(F.sum("quota"), F.count("*")).first() == (700_000, n) and out.where("quota > room or quota < 0").count() == 0
    assert most == [n // 100, 100]
    share = out.where("cell_size > 0").agg(F.max(F.abs(F.col("quota") - F.col("cell_size") * 700_000 / F.lit(16.0 * 24.5 * n)))).first()[0]
    assert share < 2
