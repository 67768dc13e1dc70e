import datetime

import pytest
from pyspark.sql import functions as F

from trajq.operators import qlearn as ql
from trajq.operators import reward as rw
from trajq.operators import spatial as sp
from trajq.operators import tiles as ti
from trajq.operators import transitions as tr
from trajq.session import materialise, setting
from trajq.sources.frames import read_frames, stream_frames, write_episode_log
from trajq.sources.qstore import load_q, save_q, versions
from trajq.sources.tiles import read_tile_grid
from trajq.streaming.progress import stream_progress
from trajq.streaming.q_update import apply_batch, stream_q_update

TRANSITION = "run_id long, episode_id long, step long, state string, action int, reward double, next_state string, done boolean"


def test_maps(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1 2 3\r\n0 9 4")
    (tmp_path / "b.txt").write_bytes(b"2 2 2\n5 x 7\n")
    grid = read_tile_grid(spark, str(tmp_path), ncols=3)
    got = {(r.map_id[-5:], r.pos): (r.code, r.x, r.y) for r in grid.collect()}
    assert got["a.txt", 4] == (9, 32, 32) and got["b.txt", 5] == (7, 64, 32) and len(got) == 12
    assert got["b.txt", 4][0] is None
    kinds = sorted((r.map_id[-5:], r.kind) for r in ti.classify_tiles(grid).collect())
    assert kinds == [("a.txt", "finish"), ("a.txt", "side"), ("a.txt", "track"), ("a.txt", "wall"), ("b.txt", "checkpoint1"), ("b.txt", "checkpoint3"), *[("b.txt", "wall")] * 3]
    coords = {r.map_id[-5:]: r.coords for r in ti.flatten_zone_coords(ti.classify_tiles(grid)).collect()}
    assert coords == {"a.txt": [32.0, 0.0], "b.txt": [0.0, 0.0, 32.0, 0.0, 64.0, 0.0]}


@pytest.mark.parametrize("line_sep", ["\n", " "])
def test_a_large_map_in_splits(spark, tmp_path, line_sep):
    """Some megabytes in splits of a fortieth, lines cut anywhere: the rows of whole-text reading, over several tasks."""
    with open(tmp_path / "big.txt", "w") as f:
        for i in range(40_000):
            f.write(" ".join(str((i * 7 + j) % 9) for j in range(32)) + ("  \n" if i % 5 else "\r\n\r\n"))
        f.write("x 3")
    (tmp_path / "small.txt").write_text("1 2\n3")
    with setting(spark, "spark.sql.files.maxPartitionBytes", "64k"), setting(spark, "spark.sql.files.openCostInBytes", "1k"):
        split = read_tile_grid(spark, str(tmp_path), line_sep=line_sep)
        assert spark.read.text(str(tmp_path), lineSep=line_sep).rdd.getNumPartitions() > 20
        rows = split.select(F.count("*"), F.sum(F.xxhash64(*split.columns).cast("decimal(38,0)")), F.max("pos")).first()
    whole = read_tile_grid(spark, str(tmp_path))
    assert rows == whole.select(F.count("*"), F.sum(F.xxhash64(*whole.columns).cast("decimal(38,0)")), F.max("pos")).first() and rows[0] == 40_000 * 32 + 5


def test_splits_of_many_maps_share_tasks(spark, tmp_path):
    """60 maps of 2 KB, each read in splits: a bounded number of tasks, as the registered query sets it."""
    from trajq.plans import catalog

    spark.range(60 * 960).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp '2024-01-01' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    group = f"maps-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        grid = catalog.QUERIES["read_tile_grid_in_splits"](spark, str(tmp_path))
    finally:
        spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s and s.name and "parallel" not in s.name.lower()) <= 60
    assert grid.count() == 60 * 960 and grid.select(F.countDistinct("map_id", "pos")).first()[0] == 60 * 960


def test_a_bucketed_version_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "q")
    q = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 700).alias("state"), (F.col("id") % 7).cast("int").alias("action"), F.col("id").cast("double").alias("q")).dropDuplicates(["state", "action"])
    save_q(q, path, 3, buckets=8)
    save_q(q.withColumn("q", F.col("q") + 1), path, 4, buckets=8)
    keys = materialise(q.select("state", "action", F.col("q").alias("want")).unionByName(spark.createDataFrame([("none", 1, 0.0)], "state string, action int, want double")), "keys")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found = ql.q_lookup(keys, load_q(spark, path, 3))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(state") == 1
        assert found.where("q <> want").count() == 0 and found.count() == keys.count()
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("q_")]:
        spark.sql(f"DROP TABLE {name}")  # a new application knows the folders only
    assert versions(spark, path) == [3, 4] and load_q(spark, path).join(q.withColumnRenamed("q", "old"), ["state", "action"]).where("q = old + 1").count() == q.count()


def test_q_versions(spark, tmp_path):
    path = str(tmp_path / "q")
    assert load_q(spark, path).count() == 0
    q = spark.createDataFrame([("a", 1, 0.5)], "state string, action int, q double")
    save_q(q, path, 2)
    save_q(q.withColumn("q", F.col("q") + 1), path, 10)
    assert versions(spark, path) == [2, 10]
    assert load_q(spark, path).first().q == 1.5 and load_q(spark, path, 2).first().q == 0.5


def test_episode_log(spark, tmp_path):
    e = spark.createDataFrame([(1, 7, 12.345, 0.98765)], "run_id long, episode_id long, reward double, epsilon double")
    write_episode_log(e, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().run_id == 1
    write_episode_log(e, str(tmp_path / "t"), text=True)
    assert spark.read.text(str(tmp_path / "t")).first().value == "episode 7, reward 12.35, epsilon 0.988"


def test_frames_round_trip(spark, tmp_path):
    row = (1, 2, 3, datetime.datetime(2024, 1, 1), 0.5, "m", 1.0, 2.0, 3.0, 4.0, 5.0, 1)
    from trajq import schemas

    spark.createDataFrame([row], schemas.FRAME).write.parquet(str(tmp_path / "f"))
    assert tuple(read_frames(spark, str(tmp_path / "f")).first())[:3] == (1, 2, 3)
    assert stream_frames(spark, str(tmp_path / "f"), 1).isStreaming


def transitions(spark, sf):
    from trajq.plans import adapters

    return tr.build_transitions(adapters.traj(spark, sf))


def _in_files(df, column, path, n):
    """n files, in order of column, with later modification times later."""
    cuts = df.approxQuantile(column, [i / n for i in range(1, n)], 0.0)
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = df if low is None else df.where(F.col(column) > low)
        (part if high is None else part.where(F.col(column) <= high)).coalesce(1).write.mode("append").parquet(path)


def test_stream_q_update_equals_batches(spark, sf, tmp_path):
    t = transitions(spark, sf)
    _in_files(t, "run_id", str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(TRANSITION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_q_update(stream, str(tmp_path / "q"), str(tmp_path / "c"), gamma=0.0).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert versions(spark, str(tmp_path / "q")) == [0, 1, 2]
    want = {(r.state, r.action): round(r.q, 6) for r in ql.q_update(t, ql.empty_q(t), 3, gamma=0.0).collect()}
    assert {(r.state, r.action): round(r.q, 6) for r in load_q(spark, str(tmp_path / "q")).collect()} == want


def test_replayed_batch_changes_nothing(spark, sf, tmp_path):
    t, path = transitions(spark, sf), str(tmp_path / "q")
    for batch_id in (0, 1, 1):
        apply_batch(t, batch_id, path, 3, 0.1, 0.9, "state string, action int, q double")
    twice = ql.q_iterate(t, rounds=2, gamma=0.9)
    assert {(r.state, r.action): round(r.q, 6) for r in load_q(spark, path).collect()} == {(r.state, r.action): round(r.q, 6) for r in twice.collect()}


def test_a_new_checkpoint_goes_on_from_the_table(spark, sf, tmp_path):
    t, path, q = transitions(spark, sf), str(tmp_path / "q"), "state string, action int, q double"
    for batch_id, source in ((0, "first"), (0, "second"), (0, "second")):
        apply_batch(t, batch_id, path, 3, 0.1, 0.9, q, source)
    assert versions(spark, path) == [0, 1]
    twice = ql.q_iterate(t, rounds=2, gamma=0.9)
    assert {(r.state, r.action): round(r.q, 6) for r in load_q(spark, path).collect()} == {(r.state, r.action): round(r.q, 6) for r in twice.collect()}


@pytest.mark.parametrize("keys", [("run_id", "episode_id"), ("run_id",)])
def test_stream_progress_equals_batch(spark, sf, tmp_path, keys):
    from trajq.plans import adapters

    hits = adapters.stages(spark, sf).select("run_id", "episode_id", "step", "kind")
    frames = adapters.traj(spark, sf).join(hits, ["run_id", "episode_id", "step"], "left").select("run_id", "episode_id", "step", "ts", "kind", "reward", "done")
    by_time = frames.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    _in_files(by_time, "at", str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(by_time.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "progress" + str(len(keys))
    query = stream_progress(stream, sp.rule_dim(spark), keys).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    got = spark.table(name).collect()
    assert len(got) == frames.count() and not any(r.late for r in got)
    want = rw.milestones(adapters.stages(spark, sf), sp.rule_dim(spark), list(keys)).collect()
    assert sorted((r.episode_id, r.step, r.stage) for r in got if r.fired) == sorted((r.episode_id, r.step, r.stage) for r in want)
    ends = {(r.episode_id, r.step) for r in frames.where("done").collect()}
    returns = {(r.episode_id, r.step): round(r.running_return, 6) for r in tr.running_return(adapters.traj(spark, sf)).collect()}
    assert {(r.episode_id, r.step): round(r.running_return, 6) for r in got} == returns
    assert {(r.episode_id, r.step) for r in got if r.done} == ends
