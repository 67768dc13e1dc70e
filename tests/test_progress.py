"""Milestone progress on streams: run scope, late rows, event time, and other working directories."""

import datetime
import glob
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajq.operators import reward as rw
from trajq.operators import spatial as sp
from trajq.session import scratch_base, setting
from trajq.streaming.progress import GIVEN, TAKEN, packer, processor, stream_progress

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FRAME = "run_id long, episode_id long, step long, ts timestamp, kind string, reward double, done boolean"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def streamed(spark, tmp_path, batches, name, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_progress(stream, sp.rule_dim(spark), **options).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name).collect(), query


def test_run_scope_keeps_each_episodes_return_and_done(spark, tmp_path):
    """Three episodes of two steps."""
    batches = [[(0, e, s, at(10 * e + s), "checkpoint1" if e else None, 1.0, s == 2) for s in (1, 2)] for e in range(3)]
    got, _ = streamed(spark, tmp_path, batches, "scoped", keys=("run_id",))
    assert sorted((r.episode_id, r.step, r.running_return, r.done, r.fired) for r in got) == [(e, s, float(s), s == 2, (e, s) == (1, 1)) for e in range(3) for s in (1, 2)]


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[(0, 0, s, at(s), None, 1.0, False) for s in (1, 2, 3)], [(0, 0, s, at(s), "finish", 9.0, True) for s in (2, 3)] + [(0, 0, 4, at(4), None, 1.0, False)]]
    got, _ = streamed(spark, tmp_path, batches, "late")
    assert sorted((r.step, r.late, r.n_late, r.running_return, r.fired, r.done) for r in got) == [(1, False, 0, 1.0, False, False), (2, False, 0, 2.0, False, False), (2, True, 1, 3.0, False, False), (3, False, 0, 3.0, False, False), (3, True, 2, 3.0, False, False), (4, False, 2, 4.0, False, False)]


@pytest.mark.parametrize("keys", [("run_id",), ("run_id", "episode_id")])
def test_event_time_equals_the_batch_operators(spark, tmp_path, keys):
    """Batches out of order by up to ten minutes; the last one lets all others pass the watermark."""
    kinds = [None, "checkpoint1", "checkpoint2", None, "checkpoint3", "finish"]
    rows = [(run, 10 * run + e, s, at(20 * e + 3 * s + run), kinds[(s + e) % 6], 0.5 * s + e, s == 5) for run in (0, 1) for e in range(4) for s in range(6)]
    shuffled = sorted(rows, key=lambda r: r[3] + datetime.timedelta(minutes=(r[2] * 7 + r[1] * 3) % 10))
    end = [(9, 9, 0, at(100_000), None, 0.0, False)]
    with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "true"):
        got, query = streamed(spark, tmp_path, [shuffled[i : i + 12] for i in range(0, 48, 12)] + [end], "timed" + str(len(keys)), keys=keys, watermark="10 minutes", ttl_ms=3_600_000)
    assert len(got) == 48 and not any(r.late for r in got)
    hits = spark.createDataFrame(rows, FRAME).where("kind is not null")
    want = rw.milestones(hits, sp.rule_dim(spark), list(keys)).collect()
    assert sorted((r.run_id, r.episode_id, r.step, r.stage) for r in got if r.fired) == sorted((r.run_id, r.episode_id, r.step, r.stage) for r in want)
    returns = {}
    for run, e, s, _, _, reward, _ in sorted(rows, key=lambda r: r[:3]):
        returns[run, e, s] = returns.get((run, e, s - 1), 0.0) + reward
    assert {(r.run_id, r.episode_id, r.step): r.running_return for r in got} == returns
    assert all(r.done == (r.step == 5) for r in got)
    kept = query.lastProgress["stateOperators"][0]
    assert kept["numRowsTotal"] <= 4  # only the last row's group is open: it waits


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(0, 0, 1, at(0), None, 1.0, False)], [(0, 0, 2, at(60), None, 1.0, False)], [(0, 0, 3, at(61), None, 1.0, False)], [(0, 0, 9, at(1), None, 50.0, False)], [(0, 1, 1, at(500), None, 1.0, False)]]
    with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "true"):
        got, _ = streamed(spark, tmp_path, batches, "behind", watermark="5 minutes", ttl_ms=86_400_000)
    assert sorted((r.step, r.running_return, r.late) for r in got) == [(1, 1.0, False), (2, 2.0, False), (3, 3.0, False)]


def test_state_partitions_follow_the_table(spark, sf):
    """A small table's stream doesn't open and commit each of many partitions of the state with every batch."""
    from trajq.plans import catalog

    base = scratch_base(spark).removeprefix("file://")
    earlier = set(glob.glob(f"{base}/checkpoint-*"))
    with setting(spark, "spark.sql.shuffle.partitions", "32"):
        assert catalog._progress(spark, sf, keys=("run_id",)).count() == 1000
    (new,) = set(glob.glob(f"{base}/checkpoint-*")) - earlier
    assert len(glob.glob(f"{new}/state/0/[0-9]*")) == spark.sparkContext.defaultParallelism == 4


def test_many_waiting_rows_are_few_values(spark, tmp_path):
    """9,000 rows of one run that all wait: two values, which one batch lets go in order of time."""
    rows = [(0, i % 3, i // 3, at(i * 7919 % 9000), None, 1.0, False) for i in range(9000)]
    rows = [(run, e, s, at(3 * s + e), k, r, d) for run, e, s, _, k, r, d in rows[::-1]]
    with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "true"):
        got, query = streamed(spark, tmp_path, [rows, [(9, 9, 0, at(1_000_000), None, 0.0, False)]], "waiting", keys=("run_id",), watermark="100 days", ttl_ms=3_600_000)
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 5
    assert sorted((r.episode_id, r.step, r.running_return, r.late) for r in got) == [(e, s, s + 1.0, False) for e in range(3) for s in range(3000)]


def test_equals_a_plain_loop(spark, tmp_path):
    """Repeated frames, late rows and several stages, over three batches and both episodes of two runs."""
    draw = random.Random(5)
    kinds = [None, "checkpoint1", "checkpoint2", "checkpoint3", "finish"]
    stages = {r.kind: r.stage for r in sp.rule_dim(spark).collect()}
    batches = []
    for b in range(3):
        steps = [(run, e, s) for run in (0, 1) for e in (0, 1) for s in draw.sample(range(6 * b - 2 * bool(b), 6 * b + 8), 7)]
        batches.append([(run, e, s, at(s), draw.choice(kinds), float(s), s % 5 == 4) for run, e, s in steps for _ in range(draw.choice((1, 1, 2)))])
    got, _ = streamed(spark, tmp_path, batches, "loop", keys=("run_id",))
    want, marks, late_rows, known = [], {}, {}, {}
    for batch in batches:
        new = set()
        for run, e, s, t, kind, reward, done in sorted(batch, key=lambda r: (r[3], r[2], stages.get(r[4], 0), r[1])):
            stage, (last, total, ended) = stages.get(kind, 0), known.get((run, e), (-1, 0.0, False))
            late = s <= last and (run, e, s) not in new
            fired = not late and stage > marks.get(run, 0)
            late_rows[run] = late_rows.get(run, 0) + late
            if not late:
                marks[run] = max(marks.get(run, 0), stage)
                known[run, e] = last, total, ended = s, total + (0.0 if (run, e, s) in new else reward), ended or done
                new.add((run, e, s))
            want.append((run, e, s, stage, fired, total, ended, late, late_rows[run]))
    assert sorted(map(tuple, got)) == sorted(want) and 0 < sum(w[7] for w in want) < len(want) / 2


def test_a_group_is_one_packed_row_a_batch():
    """Interleaved rows of six episodes come to the state as six rows, and none is lost or changed."""
    rows = [{"run_id": i % 2, "episode_id": i % 6, "step": i, "at": 10 * i, "stage": i % 5, "reward": None if i == 7 else i / 2, "done": i > 50} for i in range(60)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.from_numpy_dtype(TAKEN[n])) for n in TAKEN.names]))
    (packed,) = packer(("run_id", "episode_id"))(iter([batch]))
    assert packed.num_rows == 6
    for r in packed.to_pylist():
        own = np.frombuffer(r["rows"], TAKEN)
        want = [x for x in rows if (x["run_id"], x["episode_id"]) == (r["run_id"], r["episode_id"])]
        assert [tuple(x.tolist()) for x in own if x["step"] != 7] == [tuple(x.values()) for x in want if x["step"] != 7] and len(own) == 10
    assert [p.num_rows for p in packer(("run_id",))(iter([batch, batch[:0]]))] == [2, 0]


def test_starts_in_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from trajq.operators import spatial as sp
from trajq.streaming.progress import stream_progress
store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.sql.streaming.stateStore.providerClass", store).config("spark.sql.streaming.noDataMicroBatches.enabled", "false").getOrCreate()
spark.createDataFrame([(0, 0, 1, None, "finish", 2.0, True)], "{FRAME}").write.parquet("in")
rows = stream_progress(spark.readStream.schema("{FRAME}").parquet("in"), sp.rule_dim(spark))
q = rows.writeStream.format("memory").queryName("p").outputMode("update").option("checkpointLocation", "c").trigger(availableNow=True).start()
q.awaitTermination(100)
print("GOT", [tuple(r) for r in spark.table("p").collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "GOT [(0, 0, 1, 4, True, 2.0, True, False, 0)]" in run.stdout, run.stderr[-1500:]


def test_groups_share_the_states_of_few_buckets(spark, tmp_path, capsys):
    """200 episodes in four buckets, over two batches: each bucket has two values, and no shuffle by kind comes before."""
    batches = [[(e % 3, e, s, at(s), "checkpoint1" if s == 2 else None, 1.0, False) for e in range(200) for s in steps] for steps in ((1, 2), (2, 3))]
    got, query = streamed(spark, tmp_path, batches, "shared", buckets=4)
    want = [(e, s, s + 0.0, s == 2, False, 0) for e in range(200) for s in (1, 2)] + [(e, s, float(max(2, s)), False, s == 2, 1) for e in range(200) for s in (2, 3)]
    assert sorted((r.episode_id, r.step, r.running_return, r.fired, r.late, r.n_late) for r in got) == sorted(want)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 8
    query.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


class Store(dict):
    """What a processor's handle gives, in memory: states and timers of one bucket."""

    exists, containsKey, getValue, updateValue, removeKey = dict.__len__, dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.remove, lambda: iter(self.timers)

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store())

    getMapState = getValueState


class Now:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


@pytest.mark.parametrize("keys", [("run_id",), ("run_id", "episode_id")])
def test_a_buckets_groups_expire_one_by_one(keys):
    """Three groups of a bucket; each goes ttl_ms after its own last rows, with its episodes and no others."""

    def take(ms, *rows):
        packed = np.array([(run, run, step, 0, 2, 1.0, False) for run, step in rows], TAKEN).tobytes()
        out = b"".join(r["rows"] for r in p.handleInputRows((0,), iter([{"rows": packed}]), Now(ms)))
        return [(int(r["run_id"]), float(r["running_return"]), bool(r["late"]), bool(r["fired"])) for r in np.frombuffer(out, GIVEN)]

    p, handle = processor(100, False, keys), Handle()
    p.init(handle)
    assert take(1000, (1, 5), (2, 5), (3, 5)) == [(1, 1.0, False, True), (2, 1.0, False, True), (3, 1.0, False, True)] and handle.timers == {1100}
    assert take(1060, (2, 6)) == [(2, 2.0, False, False)] and handle.timers == {1100}
    assert take(1101, (3, 4)) == [(3, 1.0, True, False)] and handle.timers == {1160}  # 1 has gone; 3 came before its timer
    assert take(1102, (1, 1), (2, 7)) == [(1, 1.0, False, True), (2, 3.0, False, False)] and handle.timers == {1201}
    assert list(p.handleExpiredTimer((0,), Now(1202), None)) == [] and handle.timers == {1202}
    assert list(p.handleExpiredTimer((0,), Now(1203), None)) == [] and not handle.timers and not any(handle.states.values())
