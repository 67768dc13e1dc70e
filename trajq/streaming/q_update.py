"""Q updates on a stream of transitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from trajq import schemas
from trajq.operators.qlearn import q_update
from trajq.session import temporary_tables
from trajq.sources.qstore import Note, load_q, notes, retire, save_q, source_id, versions, write_note

#: Whole versions that are kept.
KEEP = 20


def apply_batch(batch: DataFrame, batch_id: int, path: str, n_actions: int, alpha: float, gamma: float, schema: str, source: str = "", keep: int | None = KEEP) -> None:
    """One round over a micro-batch, from the newest version to the next one.

    Which batch of which source makes a version, and from which parent, is noted in the log before the version is
    written. A batch that comes again finds its note: if its version is whole, or was and has been retired since, nothing
    is left to do; if not, and it is still the newest, it is written again from the same parent. If another source went on
    meanwhile, the batch becomes a new version, as the unfinished one is nobody's parent. Another source, as a new
    checkpoint is, goes on from the newest version. One stream writes to a table at a time.

    The log and the versions are listed, not read: the number of Spark jobs a batch does not grow with them. All but the
    `keep` newest versions are deleted (None keeps all), and the log's notes of these, but each source's newest.
    """
    spark, own = batch.sparkSession, source_id(source)
    log, whole = notes(spark, path), versions(spark, path)
    newest = max(whole, default=-1)
    mine = next((n for n in reversed(log) if (n.batch, n.source) == (batch_id, own)), None)
    if mine and (mine.version in whole or mine.version < min(whole, default=0)):
        return
    if mine is None or mine.version < newest:
        mine = Note(max([*(n.version for n in log), *whole], default=-1) + 1, newest, batch_id, own)
        write_note(spark, path, mine)
    old = load_q(spark, path, mine.parent, schema) if mine.parent >= 0 else spark.createDataFrame([], schema)
    with temporary_tables(spark):
        save_q(q_update(batch, old, n_actions, alpha, gamma), path, mine.version)
    if keep is not None:
        retire(spark, path, keep)


def stream_q_update(
    transitions: DataFrame, path: str, checkpoint: str, n_actions: int = 3, alpha: float = 0.1, gamma: float = 0.95, schema: str = schemas.Q, keep: int | None = KEEP
) -> DataStreamWriter:
    """A writer that keeps a Q-table under path up to date, a version per micro-batch. Start it with .start()."""
    run = lambda batch, batch_id: apply_batch(batch, batch_id, path, n_actions, alpha, gamma, schema, checkpoint, keep)
    return transitions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName("q-update-" + json.dumps(path))
