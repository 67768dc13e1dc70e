import datetime
import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajq.functions import scalar
from trajq.operators import episodes as ep
from trajq.operators import qlearn as ql
from trajq.operators import reward as rw
from trajq.operators import spatial as sp
from trajq.operators import tiles as ti
from trajq.operators import transitions as tr
from trajq.plans import catalog

ONE = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, rows):
    return spark.createDataFrame(rows, "map_id string, run_id long, episode_id long, step long, x0 double, y0 double, x1 double, y1 double")


def zones(spark, rows):
    return spark.createDataFrame(rows, "map_id string, zone_id long, kind string, x0 double, y0 double, x1 double, y1 double")


def test_touching_edges_do_not_count(spark):
    f = frames(spark, [("m", 0, 0, 0, 0.0, 0.0, 32.0, 32.0)])
    z = zones(spark, [("m", 1, "wall", 32.0, 0.0, 64.0, 32.0), ("m", 2, "track", 31.9, 0.0, 64.0, 32.0), ("n", 3, "track", 0.0, 0.0, 9.0, 9.0)])
    assert [r.zone_id for r in sp.box_overlap_join(f, z).collect()] == [2]


@ONE
@given(st.lists(st.tuples(*[st.integers(-200, 200)] * 2, *[st.integers(1, 150)] * 2), min_size=1, max_size=12), st.lists(st.tuples(*[st.integers(-200, 200)] * 2, *[st.integers(1, 150)] * 2), min_size=1, max_size=12), st.sampled_from([7.0, 32.0, 500.0]))
def test_overlap_equals_brute_force_for_any_cell(spark, a, b, cell):
    boxes = lambda xs: [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in xs]
    a, b = boxes(a), boxes(b)
    got = sp.box_overlap_join(frames(spark, [("m", 0, 0, i, *x) for i, x in enumerate(a)]), zones(spark, [("m", i, "k", *x) for i, x in enumerate(b)]), cell).collect()
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1])
    assert sorted((r.step, r.zone_id) for r in got) == want


def test_boxes_of_all_sizes(spark):
    """Sides of 1 to 100,000 units and a box a thousand times as large: equal to the theta join, in a few rows a box."""
    import random

    draw = random.Random(4)

    def boxes(n):
        out = []
        for _ in range(n):
            w, h = (10 ** draw.uniform(0, 5) for _ in range(2))
            x, y = (draw.uniform(-50_000, 50_000) for _ in range(2))
            out.append((x, y, x + w, y + h))
        return out

    a, b = boxes(300) + [(-1e8, -1e8, 1e8, 1e8), (5.0, 5.0, 5.0, 5.0)], boxes(300) + [(-200_000.0, -3.0, 200_000.0, 7.0)]
    f, z = frames(spark, [("m", 0, 0, i, *x) for i, x in enumerate(a)]), zones(spark, [("m", i, "k", *x) for i, x in enumerate(b)])
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1])
    assert sorted((r.step, r.zone_id) for r in sp.box_overlap_join(f, z).collect()) == want
    own = z.withColumn("own", sp._level(sp._side(*map(F.col, ("x0", "y0", "x1", "y1"))), 32.0))
    at_home = sp._in_cells(own, F.array("own"), 32.0, [F.col(c) for c in ("x0", "y0", "x1", "y1")]).groupBy("zone_id").count()
    assert at_home.agg(F.max("count")).first()[0] <= 9
    visits = sp._in_cells(own, F.sequence("own", F.lit(8)), 32.0, [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    assert visits.count() <= 12 * z.count()


def test_no_zones_and_no_frames(spark):
    f, z = frames(spark, [("m", 0, 0, 0, 0.0, 0.0, 1.0, 1.0)]), zones(spark, [("m", 0, "k", 0.0, 0.0, 1.0, 1.0)])
    assert sp.box_overlap_join(f, z.where("false")).count() == 0 and sp.box_overlap_join(f.where("false"), z).count() == 0


def test_frame_without_hits_is_kept(spark):
    f = frames(spark, [("m", 0, 0, 0, 0.0, 0.0, 1.0, 1.0)])
    hits = zones(spark, []).select(F.lit(0).cast("long").alias("run_id"), F.lit(0).cast("long").alias("episode_id"), F.lit(0).cast("long").alias("step"), "zone_id", "kind")
    row = sp.surface_state(sp.frame_flags(f, hits)).first()
    assert row.slow and not row.crash and not row.on_track


def test_bounds(spark):
    df = spark.createDataFrame([(960.0, 0.0), (960.001, 0.0), (-0.1, 5.0), (5.0, 960.0)], "x double, y double")
    assert [r[0] for r in df.select(scalar.out_of_bounds(F.col("x"), F.col("y"))).collect()] == [False, True, True, False]


def test_cap_speed_is_two_step(spark):
    cx, cy = scalar.cap_speed(F.col("vx"), F.col("vy"))
    got = spark.createDataFrame([(6.0, 8.0)], "vx double, vy double").select(cx, cy).first()
    assert got[0] == pytest.approx(3.3) and got[1] == pytest.approx(8 * 5.5 / math.hypot(3.3, 8))


def test_epsilon_floor(spark):
    assert spark.range(1).select(scalar.epsilon_at(F.lit(100000))).first()[0] == 0.01


def hits(spark, rows):
    return spark.createDataFrame(rows, "run_id long, episode_id long, step long, ts long, kind string")


def fired(spark, rows, scope=("run_id",)):
    return sorted((r.episode_id, r.step, r.stage) for r in rw.milestones(hits(spark, rows), sp.rule_dim(spark), scope).collect())


def test_milestones(spark):
    assert fired(spark, [(0, 0, 1, 1, "checkpoint2"), (0, 0, 2, 2, "checkpoint1")]) == [(0, 1, 2)]
    assert fired(spark, [(0, 0, 1, 1, "checkpoint3"), (0, 0, 1, 1, "checkpoint1")]) == [(0, 1, 1), (0, 1, 3)]
    assert fired(spark, [(0, 0, 1, 1, "finish"), (0, 0, 2, 2, "checkpoint1"), (0, 0, 3, 3, "finish")]) == [(0, 1, 4)]
    two = [(0, 0, 1, 1, "checkpoint1"), (0, 1, 1, 2, "checkpoint1")]
    assert fired(spark, two) == [(0, 1, 1)]
    assert fired(spark, two, ("run_id", "episode_id")) == [(0, 1, 1), (1, 1, 1)]


def test_reward_at_time_zero_and_forbidden(spark):
    f = spark.createDataFrame([(0, 0, 1, 0.0, False, False), (0, 0, 2, 5.0, True, True)], "run_id long, episode_id long, step long, elapsed double, off_track boolean, forbidden boolean")
    got = rw.shape_reward(f, rw.milestones(hits(spark, [(0, 0, 1, 1, "checkpoint1")]), sp.rule_dim(spark))).orderBy("step").collect()
    assert [(r.reward, r.done, r.success) for r in got] == [(1001.0, True, True), (-151.0, True, False)]


def q_table(spark, rows):
    return spark.createDataFrame(rows, "state string, action int, q double")


def test_policy_ties_and_unseen(spark):
    q = q_table(spark, [("a", 1, 2.0), ("a", 2, 2.0), ("b", 0, -1.0), ("b", 2, -3.0), ("c", 0, -5.0), ("c", 1, -2.0), ("c", 2, -3.0)])
    assert {r.state: r.action for r in ql.greedy_policy(q, ql.action_dim(spark)).collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r.state: r.max_q for r in ql.max_next_q(q, 3).collect()} == {"a": 2.0, "b": 0.0, "c": -2.0}


def sequential(rows, alpha, gamma, q):
    """Online updates in order; rows are (state, action, reward, next_state, done)."""
    q = dict(q)
    for s, a, r, n, done in rows:
        best = 0 if done else max(q.get((n, b), 0.0) for b in range(3))
        q[s, a] = q.get((s, a), 0.0) + alpha * (r + gamma * best - q.get((s, a), 0.0))
    return q


STEP = st.tuples(st.sampled_from("abc"), st.integers(0, 2), st.integers(-5, 5), st.sampled_from("abc"), st.booleans())


@ONE
@given(st.lists(STEP, min_size=1, max_size=30))
def test_update_equals_the_sequential_loop_without_bootstrap(spark, rows):
    data = [(i // 12, i // 5, i, s, a, float(r), n, d) for i, (s, a, r, n, d) in enumerate(rows)]
    t = spark.createDataFrame(data, "run_id long, episode_id long, step long, state string, action int, reward double, next_state string, done boolean")
    old = {("a", 0): 2.0, ("z", 1): 7.0}
    got = ql.q_update(t, q_table(spark, [(s, a, v) for (s, a), v in old.items()]), 3, gamma=0.0)
    want = sequential(rows, 0.1, 0.0, old)
    assert {(r.state, r.action): pytest.approx(r.q) for r in got.collect()} == want


def test_done_does_not_bootstrap(spark):
    t = spark.createDataFrame([(0, 0, 0, "a", 0, 1.0, "b", True), (0, 0, 1, "c", 0, 1.0, "b", False)], "run_id long, episode_id long, step long, state string, action int, reward double, next_state string, done boolean")
    got = {r.state: r.q for r in ql.q_update(t, q_table(spark, [("b", 0, 10.0)]), 3, alpha=1.0, gamma=0.5).collect()}
    assert got == {"a": 1.0, "c": 6.0, "b": 10.0}


def test_transitions_and_episodes(spark):
    f = spark.createDataFrame([(0, 0, i, o, 1, float(i), i == 2) for i, o in enumerate("xyzw")], "run_id long, episode_id long, step long, obs string, action int, reward double, done boolean")
    assert [(r.state, r.next_state) for r in tr.build_transitions(f).orderBy("step").collect()] == [("<start>", "x"), ("x", "y"), ("y", "z"), ("z", "w")]
    assert [(r.state, r.reward, r.next_state) for r in tr.build_transitions(f, "effect").orderBy("step").collect()] == [("x", 1.0, "y"), ("y", 2.0, "z"), ("z", 3.0, "w")]
    assert [r.episode_no for r in tr.split_episodes(f).orderBy("step").collect()] == [0, 0, 0, 1]
    assert tr.cut_after_done(f).count() == 3
    with pytest.raises(ValueError):
        tr.build_transitions(f, "other")


def test_rolling_is_null_until_full(spark):
    e = spark.createDataFrame([(0, i, float(r)) for i, r in enumerate([3, 0, 0, 9])], "run_id long, episode_id long, reward double")
    got = ep.rolling_reward(e).orderBy("episode_id").collect()
    assert [r.rolling for r in got] == [None, None, 1.0, 3.0] and [r.regressed for r in got] == [None, None, True, False]


def test_a_mean_equal_to_the_reward_is_no_regress(spark):
    """79.51 is the mean of 37.32, 121.70 and 79.51; each as any order of adding its parts may leave it."""
    for i, (low, high, reward) in enumerate(itertools.product(*[(math.nextafter(x, 0), x, math.nextafter(x, 999)) for x in (37.32, 121.7, 79.51)])):
        e = spark.createDataFrame([(0, 0, low), (0, 1, high), (0, 2, reward), (0, 3, reward - 1e-6)], "run_id long, episode_id long, reward double")
        if i % 4 == 0:  # seven of them, a tie that goes either way among these
            assert [r.regressed for r in ep.rolling_reward(e).orderBy("episode_id").collect()][2:] == [False, True]
    odd = [1.0, 1.0, float("inf"), 1.0, float("nan"), 1.0]
    e = spark.createDataFrame([(0, i, r) for i, r in enumerate(odd)], "run_id long, episode_id long, reward double")
    assert [r.regressed for r in ep.rolling_reward(e).orderBy("episode_id").collect()] == [None, None, False, True, False, True]


def test_state_key_bins(spark):
    f = spark.createDataFrame([("m", 33.0, 1.0, 2.0, 0.1, 0.2)], "map_id string, x double, y double, heading double, vx double, vy double")
    assert ti.state_key(f, {"x": 32}).first().state_key.asDict() == {"map_id": "m", "x": 1.0, "y": 1.0, "heading": 2.0, "vx": 0.1, "vy": 0.2}


def test_rewards_are_added_in_order(spark, tmp_path):
    """Ties of the mean and the reward fall as the doubles do, by the events' order; 0.1 * 3 / 3 is over 0.1, 0.3 is not."""
    values = {1: [[0.1], [0.1], [0.1]], 2: [[0.3], [0.3], [0.3]], 3: [[1e16, 1.0, -1e16, 1.0], [1.0], [1.0]], 4: [[1.0, 1e16, 1.0, -1e16], [0.0], [0.0]], 5: [[None], [2.0, None], [1.0]]}
    events = [(run, day, v) for run, days in values.items() for day, of in enumerate(days) for v in of]
    rows = [(i, run, datetime.datetime(2024, 1, 1 + day), v) for i, (run, day, v) in enumerate(events)]
    for n, dealt in enumerate((rows, rows[::-1], rows[1::2] + rows[::2])):
        table = spark.createDataFrame(dealt, "event_id long, user_id long, ts timestamp_ntz, value double").repartition(n + 1)
        table.write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = catalog.QUERIES["rolling_reward"](spark, f"{tmp_path}/{n}").orderBy("run_id", "day").collect()
        assert [r.reward for r in got if r.run_id in (3, 4, 5)] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None, 2.0, 1.0]
        assert [r.regressed for r in got if r.day == "2024-01-03"] == [True, False, False, False, True]
