"""Q-tables over many samples, rounds and saves."""

import pytest
from pyspark.sql import functions as F

from trajq.operators import qlearn as ql
from trajq.operators import transitions as tr
from trajq.plans import adapters
from trajq.session import setting
from trajq.sources.qstore import Note, load_q, notes, source_id, versions, write_note
from trajq.streaming.q_update import apply_batch

TRANSITION = "run_id long, episode_id long, step long, state string, action int, reward double, next_state string, done boolean"
Q = "state string, action int, q double"


def table(df):
    return {(r.state, r.action): round(r.q, 6) for r in df.collect()}


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def steps(spark, sf):
    return tr.build_transitions(adapters.traj(spark, sf)).cache()


def test_jobs_a_batch_do_not_grow_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "q")
    t = spark.createDataFrame([(0, 0, i, "ab"[i % 2], 0, 1.0, "ba"[i % 2], False) for i in range(4)], TRANSITION)
    with setting(spark, "spark.sql.shuffle.partitions", "1"):
        counts = [jobs(spark, f"batch-{i}", lambda i=i: apply_batch(t, i, path, 3, 0.1, 0.9, Q, "one", keep=4)) for i in range(12)]
    assert max(counts[1:]) == min(counts[1:])
    assert versions(spark, path) == [8, 9, 10, 11] and [n.version for n in notes(spark, path)] == [8, 9, 10, 11]
    assert table(load_q(spark, path)) == table(ql.q_iterate(t, rounds=12, gamma=0.9))
    assert jobs(spark, "again", lambda: apply_batch(t, 11, path, 3, 0.1, 0.9, Q, "one", keep=4)) == 0


def test_batches_that_come_again(spark, tmp_path):
    path = str(tmp_path / "q")
    t = spark.createDataFrame([(0, 0, 0, "a", 0, 1.0, "a", False)], TRANSITION)
    run = lambda batch, source: apply_batch(t, batch, path, 3, 0.1, 0.9, Q, source, keep=2)
    run(0, "slow")
    for batch in range(4):
        run(batch, "fast")
    run(0, "slow")  # its version was retired, its note was not
    assert versions(spark, path) == [3, 4]
    write_note(spark, path, Note(5, 4, 1, source_id("slow")))  # died before it wrote a thing
    run(1, "slow")
    assert versions(spark, path) == [4, 5]
    write_note(spark, path, Note(6, 5, 2, source_id("slow")))
    run(4, "fast")  # went on without the unfinished one
    run(2, "slow")
    assert versions(spark, path) == [7, 8]
    assert table(load_q(spark, path)) == table(ql.q_iterate(t, rounds=8, gamma=0.9))


def test_rounds_go_on_under_a_path(spark, steps, tmp_path):
    path = str(tmp_path / "training")
    two = table(ql.q_iterate(steps, rounds=2, path=path))
    assert two == table(ql.q_iterate(steps, rounds=2))
    unreadable = steps.withColumn("reward", F.raise_error(F.lit("transitions are read again")).cast("double"))
    assert table(ql.q_iterate(unreadable, rounds=3, path=path)) == table(ql.q_iterate(steps, rounds=3))
    with pytest.raises(ValueError):
        ql.q_iterate(steps, rounds=3, gamma=0.5, path=path)


def plain_rounds(rows, rounds, alpha=0.1, gamma=0.95, n_actions=3):
    q = {}
    for _ in range(rounds):
        old, best = dict(q), {}
        for s in {s for s, _ in old}:
            seen = [v for (t, _), v in old.items() if t == s]
            best[s] = max(seen) if len(seen) == n_actions else max(*seen, 0.0)
        for _, _, _, s, a, r, n, done in rows:
            q[s, a] = q.get((s, a), 0.0) + alpha * (r + gamma * (0 if done else best.get(n, 0.0)) - q.get((s, a), 0.0))
    return {k: round(v, 6) for k, v in q.items()}


@pytest.mark.parametrize("rounds", [3, 10])
def test_rounds_equal_plain_ones(spark, steps, rounds):
    rows = sorted(tuple(r) for r in steps.select("run_id", "episode_id", "step", "state", "action", "reward", "next_state", "done").collect())
    assert table(ql.q_iterate(steps, rounds=rounds)) == plain_rounds(rows, rounds)


def test_later_rounds_look_at_fewer_steps(spark):
    """A chain of states: a value moves one step back a round, and what is behind it stays as it is."""
    t = spark.createDataFrame([(0, 0, i, f"s{i}", 0, float(i == 8), f"s{i + 1}", i == 8) for i in range(9)], TRANSITION)
    model = ql.q_model(t, alpha=1.0)
    values, looked = ql._start(model, ql.empty_q(t)), []
    for _ in range(12):
        values = ql.materialise(ql._round(values, model, 1, 1.0, 0.5), "values")
        changed = values.groupBy("state").agg(F.max("q").alias("q"), F.max("before").alias("before")).where("q <> before").select(F.col("state").alias("next_state"))
        looked.append(model.join(changed, "next_state").count())
    assert looked == [1] * 8 + [0] * 4
    assert {r.state: r.q for r in values.collect()} == {f"s{i}": 0.5 ** (8 - i) for i in range(9)}


@pytest.mark.parametrize("many", ["runs", "steps"])
def test_one_pair_with_very_many_samples(spark, many):
    """One state and action over 200,000 runs, or in one episode: dealt over tasks, and equal to the recurrence."""
    n = 200_000
    run, step = (F.col("id"), F.lit(0).cast("long")) if many == "runs" else (F.lit(7).cast("long"), F.col("id"))
    t = spark.range(n).select(run.alias("run_id"), F.lit(1).cast("long").alias("episode_id"), step.alias("step"), F.lit("hot").alias("state"), F.lit(1).alias("action"), (F.col("id") % 10).cast("double").alias("reward"), F.lit("x").alias("next_state"), F.lit(False).alias("done"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # the samples here are few bytes
        ranked = ql.later_samples(t)
    assert ranked.agg(F.count("after"), F.count_distinct("after"), F.min("after"), F.max("after")).first() == (n, n, 0, n - 1)
    q = 0.0
    for i in range(n):
        q += 0.001 * (i % 10 - q)
    assert table(ql.q_update(t, ql.empty_q(t), 3, alpha=0.001)) == {("hot", 1): round(q, 6)}
    written = ranked.select("state", "action").inputFiles()
    pieces = spark.read.parquet(*written).groupBy("piece").count().collect()
    assert len(pieces) >= 3 and max(r["count"] for r in pieces) < 0.6 * n
