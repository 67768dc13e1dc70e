"""Running values over segments against plain Python, for any width."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajq.operators import motion as mo
from trajq.operators import reward as rw
from trajq.operators import segments as sg
from trajq.operators import spatial as sp
from trajq.operators import transitions as tr
from trajq.plans import adapters
from trajq.session import setting

SCHEMA = "k long, i long, v long"


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    out = [(k, i, draw.choice([None, draw.randint(-9, 9)])) for k in (1, 2, None) for i in draw.sample(range(-30, 60), 40)]
    return spark.createDataFrame(out, SCHEMA).repartition(3), sorted(out, key=lambda r: (str(r[0]), r[1]))


def plain(rows, fold, inclusive, reverse):
    out, so_far, key = {}, None, ()
    for k, i, v in sorted(rows, key=lambda r: (str(r[0]), -r[1] if reverse else r[1])):
        if k != key:
            key, so_far = k, None
        before = so_far
        so_far = so_far if v is None else v if so_far is None else fold(so_far, v)
        out[k, i] = so_far if inclusive else before
    return out


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_scans(spark, rows, width, inclusive, reverse):
    df, data = rows
    scans = {"total": (sg.SUM, lambda x, y: x + y), "most": (sg.MAX, max), "mixed": (sg.XOR, lambda x, y: x ^ y), "latest": (sg.LAST, lambda x, y: y)}
    got = sg.running(df, ["k"], "i", {name: (scan, F.col("v")) for name, (scan, _) in scans.items()}, inclusive, reverse, width).collect()
    assert len(got) == len(data)
    for name, (_, fold) in scans.items():
        assert {(r.k, r.i): r[name] for r in got} == plain(data, fold, inclusive, reverse), name


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours(spark, rows, width, ahead):
    df, data = rows
    got = {(r.k, r.i): r._near and tuple(r._near) for r in sg.neighbour(df, ["k"], "i", ["i", "v"], ahead, width).collect()}
    want, ordered = {}, data[::-1] if ahead else data
    for before, row in zip([None, *ordered], ordered):
        want[row[0], row[1]] = before[1:] if before and before[0] == row[0] else None
    assert got == want


def test_a_long_episode_is_spread_over_tasks(spark):
    """One episode with a third of all frames: its return and transitions, and how its rows are dealt."""
    n, width = 60_000, 1000
    frames = spark.range(n).select(
        F.lit(0).cast("long").alias("run_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 300).cast("long").alias("episode_id"), F.col("id").alias("step"),
        F.col("id").cast("string").alias("obs"), F.lit(1).alias("action"), F.lit(1.0).alias("reward"), (F.col("id") % 9000 == 0).alias("done"),
    )
    got = tr.running_return(frames, width).where("episode_id = 0")
    long = sorted(r.step for r in frames.where("episode_id = 0").collect())
    assert [(r.step, r.running_return) for r in got.orderBy("step").collect()] == [(s, float(i + 1)) for i, s in enumerate(long)]
    before = {r.step: r.state for r in tr.build_transitions(frames, width=width).where("episode_id = 0").collect()}
    assert before == {s: str(p) if p is not None else "<start>" for p, s in zip([None, *long], long)}
    assert tr.cut_after_done(frames, width).where("episode_id = 0").count() == 1
    assert {r.episode_no for r in tr.split_episodes(frames, width).where("episode_id = 0").select("episode_no").distinct().collect()} == set(range(8))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.6 * len(long)


@pytest.mark.parametrize("width", [2, 5])
def test_operators_do_not_depend_on_the_width(spark, sf, width):
    traj, motion = adapters.traj(spark, sf), adapters.motion(spark, sf).drop("event_id", "map_id")
    fired = rw.milestones(adapters.stages(spark, sf), sp.rule_dim(spark), ["run_id", "episode_id"])
    plain = traj.drop("reward", "done", "success")
    rounded = lambda df: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    for f in (tr.build_transitions, lambda df, **w: tr.build_transitions(df, "effect", **w), tr.running_return, tr.cut_after_done):
        assert rounded(f(traj, width=width)) == rounded(f(traj))
    assert rounded(rw.shape_reward(plain, fired, width=width)) == rounded(rw.shape_reward(plain, fired))
    assert rounded(mo.motion_residual(motion, width=width)) == rounded(mo.motion_residual(motion))
