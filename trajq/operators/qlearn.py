"""Q-tables: lookup, update in synchronous rounds, and policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajq import schemas
from trajq.functions import scalar
from trajq.session import delete, materialise, read_table, temporary, temporary_tables, whole_tables, write_table

def action_dim(spark) -> DataFrame:
    return spark.createDataFrame(schemas.ACTIONS, "action int")


def q_lookup(keys: DataFrame, q: DataFrame) -> DataFrame:
    """keys(state, action, …) with q; 0 for unseen pairs."""
    return keys.join(q.select("state", "action", "q"), ["state", "action"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))


def expand_actions(states: DataFrame, actions: DataFrame) -> DataFrame:
    """A row for each state and action: what the result is, so neither side is hinted; Spark broadcasts one that is small."""
    return states.crossJoin(actions)


def max_next_q(q: DataFrame, n_actions: int) -> DataFrame:
    """(state, max_q): the largest q over all actions, unseen ones counting as 0."""
    seen = q.groupBy("state").agg(F.max("q").alias("_max"), F.count(F.lit(1)).alias("_n"))
    return seen.select("state", F.when(F.col("_n") < n_actions, F.greatest("_max", F.lit(0.0))).otherwise(F.col("_max")).alias("max_q"))


def greedy_policy(q: DataFrame, actions: DataFrame) -> DataFrame:
    """(state, action, q): the best action of each state of q; ties go to the lowest, unseen pairs count as 0."""
    full = q_lookup(expand_actions(q.select("state").distinct(), actions), q)
    best = full.groupBy("state").agg(F.min(F.struct((-F.col("q")).alias("cost"), "action")).alias("best"))
    return best.select("state", "best.action", (0.0 - F.col("best.cost")).alias("q"))


def later_samples(transitions: DataFrame, order: Sequence[str] = ("step",)) -> DataFrame:
    """(state, action, reward, next_state, done, after): how many samples of the same state and action come later, in
    order of run, episode and `order`.

    Samples are sorted by range, which deals one state and action over as many tasks as it needs, whether it fills many
    runs or one episode. Each task counts its own; what other tasks hold of a pair is a row a task. The sorted table is
    written, so that both read the same pieces.
    """
    pair = ["state", "action"]
    columns = [*pair, "run_id", "episode_id", *order]
    at = F.monotonically_increasing_id()
    # Written first: a sort by range reads its input twice, the first time for the ranges.
    written = materialise(transitions.select(*columns, "reward", "next_state", "done"), "transitions")
    ranged = written.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = materialise(ranged.select(*pair, "reward", "next_state", "done", at.alias("at"), F.shiftright(at, 33).alias("piece")), "samples")
    onward = Window.partitionBy(*pair).orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = ranged.groupBy(*pair, "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    pieces = pieces.select(*[F.col(c).alias(f"_{c}") for c in [*pair, "piece"]], "first", F.sum("n").over(onward).alias("left"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*pair, "piece"]])
    after = F.col("left") - 1 - (F.col("at") - F.col("first"))
    return ranged.join(pieces, same).select(*pair, "reward", "next_state", "done", after.alias("after"))


def q_model(transitions: DataFrame, alpha: float = 0.1, order: Sequence[str] = ("step",)) -> DataFrame:
    """(state, action, next_state, n, r, w): all that a round needs of the transitions.

    The recurrence q += alpha (target - q) over a pair's n samples unrolls to (1 - alpha)^n q plus the sum of the targets,
    each weighed by alpha (1 - alpha)^after. Weights don't change from round to round, and a target is linear in its next
    state's value: per next state, r sums the weighed rewards and w the weights of values to come. Samples that end an
    episode have none to come and are summed under a null next_state. The table is written, and grows with the distinct
    steps seen, not with the samples.
    """
    with temporary_tables(transitions.sparkSession) as made:
        weight = alpha * F.pow(F.lit(1 - alpha), "after")
        weighed = later_samples(transitions, order).select("state", "action", F.when(~F.col("done"), F.col("next_state")).alias("next_state"), "reward", weight.alias("weight"))
        model = weighed.groupBy("state", "action", "next_state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("reward")).alias("r"), F.sum("weight").alias("w"))
        model = materialise(model, "model")
        made.pop()
    return model


def upsert_q(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's values replacing those of the same state and action, and new's other rows added."""
    fresh = new.select("state", "action", F.col("q").alias("_new"))
    return old.join(fresh, ["state", "action"], "full_outer").select("state", "action", F.coalesce("_new", "q").alias("q"))


def _start(model: DataFrame, q: DataFrame) -> DataFrame:
    """(state, action, q, before, n, r, b): the pairs of q and model, before any round. b sums the weighed values to come;
    it is 0, as all values are before q is looked at."""
    own = model.groupBy("state", "action").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    return own.join(q, ["state", "action"], "full_outer").select(
        "state", "action", *[F.coalesce(c, F.lit(zero)).alias(c) for c, zero in (("q", 0.0), ("n", 0), ("r", 0.0))], F.lit(0.0).alias("before"), F.lit(0.0).alias("b")
    )


def _round(values: DataFrame, model: DataFrame, n_actions: int, alpha: float, gamma: float) -> DataFrame:
    """values after one more round. Only steps into states whose best value has changed are looked at."""
    best = lambda c: F.when(F.count(F.lit(1)) < n_actions, F.greatest(F.max(c), F.lit(0.0))).otherwise(F.max(c))
    changed = values.groupBy(F.col("state").alias("next_state")).agg((best("q") - best("before")).alias("change")).where("change <> 0")
    moved = model.join(changed, "next_state").groupBy("state", "action").agg(F.sum(F.col("w") * F.col("change")).alias("_moved"))
    b = F.col("b") + F.coalesce("_moved", F.lit(0.0))
    new = F.pow(F.lit(1 - alpha), "n") * F.col("q") + F.col("r") + gamma * b
    return values.join(moved, ["state", "action"], "left").select("state", "action", new.alias("q"), F.col("q").alias("before"), "n", "r", b.alias("b"))


def q_update(
    transitions: DataFrame, q: DataFrame, n_actions: int, alpha: float = 0.1, gamma: float = 0.95, order: Sequence[str] = ("step",)
) -> DataFrame:
    """One synchronous round over transitions: the q-table after all of them, targets taken from q as it was.

    An online agent sees its own updates within the pass; here targets are frozen for the round, as in fitted Q
    iteration. Both give the same table when no update of the pass changes a value that a later target reads (all done,
    gamma 0, or next states not updated); otherwise they differ, and need not converge to the same limits.
    """
    model = q_model(transitions, alpha, order)
    return _round(_start(model, q), model, n_actions, alpha, gamma).select("state", "action", "q")


def empty_q(transitions: DataFrame) -> DataFrame:
    return transitions.where("false").select("state", "action", F.lit(0.0).alias("q"))


def q_iterate(
    transitions: DataFrame,
    q: DataFrame | None = None,
    rounds: int = 3,
    n_actions: int = 3,
    alpha: float = 0.1,
    gamma: float = 0.95,
    tol: float | None = None,
    order: Sequence[str] = ("step",),
    path: str | None = None,
) -> DataFrame:
    """q_update repeated; with tol, stops once no value moves by tol.

    Transitions are read once, for the model; a round reads that, and of it only what leads to states whose best value
    changed in the round before. Each round's values are written, so no lineage grows: to the shared scratch folder, or
    under path. A training that is started again with the same path goes on after its last whole round, and reads neither
    transitions nor q again; other settings with that path are an error.
    """
    spark = transitions.sparkSession
    q = empty_q(transitions) if q is None else q
    if path is None:
        model, done = q_model(transitions, alpha, order), 0
        values = _start(model, q)
    else:
        model, values, done = _resume(spark, path, transitions, q, n_actions, alpha, gamma, order)
    before: list[str] = []
    while done < rounds:
        done += 1
        folder = temporary(spark, "q-round") if path is None else f"{path}/round={done}"
        values = write_table(_round(values, model, n_actions, alpha, gamma), folder)
        for old in before:
            delete(spark, old)
        before = [folder]
        if tol is not None:
            moved = values.agg(F.max(F.abs(F.col("q") - F.col("before")))).first()[0]
            if moved is None or moved < tol:
                break
    return values.select("state", "action", "q")


def _resume(spark: SparkSession, path: str, transitions: DataFrame, q: DataFrame, n_actions: int, alpha: float, gamma: float, order: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """The model and the values of a training under path, and how many of its rounds are whole; a new one is begun there."""
    settings = f"{n_actions}_{alpha}_{gamma}_{'-'.join(order)}"
    known = whole_tables(spark, path)
    if "begun" not in known:
        with temporary_tables(spark):
            model = q_model(transitions, alpha, order)
            write_table(model, f"{path}/model")
            write_table(_start(read_table(spark, f"{path}/model"), q), f"{path}/round=0")
        write_table(spark.createDataFrame([(settings,)], "settings string"), f"{path}/begun")
        known = whole_tables(spark, path)
    if (other := read_table(spark, f"{path}/begun").first()[0]) != settings:
        raise ValueError(f"the training under {path} has settings {other}, not {settings}")
    done = max(int(name[6:]) for name in known if name.startswith("round="))
    return read_table(spark, f"{path}/model"), read_table(spark, f"{path}/round={done}"), done


def explore_or_exploit(states: DataFrame, policy: DataFrame, epsilon: Column, n_actions: int, seed: str = "explore", ids: Sequence[str] = schemas.FRAME_KEYS) -> DataFrame:
    """states(state, ids…) with chosen_action: uniform with probability epsilon, else the policy's, or 0 for a state
    that it lacks. The draws are digests of the ids."""
    draw, other = (scalar.uniform_draw(f"{seed}{i}", *[F.col(c) for c in ids]) for i in (1, 2))
    greedy = policy.select("state", F.col("action").alias("_greedy"))
    explores = draw < epsilon
    joined = states.join(greedy, "state", "left")
    chosen = F.when(explores, F.floor(other * n_actions).cast("int")).otherwise(F.coalesce("_greedy", F.lit(0)))
    return joined.withColumns({"explores": explores, "chosen_action": chosen}).drop("_greedy")
