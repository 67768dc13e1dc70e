"""Episode summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq import schemas
from trajq.functions import scalar


def episode_return(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*schemas.EPISODE_KEYS).agg(F.sum("reward").alias("reward"))


def episode_summary(frames: DataFrame) -> DataFrame:
    """frames(…, reward, success, elapsed, done, crash, forbidden) to a row per episode.

    Episodes are numbered within their run in order of their ids; epsilon follows from the number. end_reason is taken
    from the last step: out (forbidden), crash, milestone (done otherwise) or cut.
    """
    last = lambda c: F.max_by(c, "step")
    reason = F.when(last("forbidden"), "out").when(last("crash"), "crash").when(last("done"), "milestone").otherwise("cut")
    summed = frames.groupBy(*schemas.EPISODE_KEYS).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("reward").alias("reward"), last("success").alias("success"), F.max("elapsed").alias("duration"), reason.alias("end_reason")
    )
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("episode_id"))
    return summed.withColumn("epsilon", scalar.epsilon_at(number)).select("run_id", "episode_id", "steps", "reward", "success", "epsilon", "duration", "end_reason")


def ordered_sum(frames: DataFrame, keys: list[str], order: str, value: str = "reward") -> DataFrame:
    """A row per keys with the sum of value, added one after another by order: the same bits however the rows are dealt.
    A group's rows are one task's, which sorts them on disk and holds a sum."""
    by = Window.partitionBy(*keys).orderBy(order, value)
    summed = frames.select(*keys, F.row_number().over(by).alias("n"), F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(value))
    return summed.groupBy(*keys).agg(F.max_by(value, "n").alias(value))


def rolling_reward(episodes: DataFrame, n: int = 3, scope: str = "run_id", order: str = "episode_id", within: float = 1e-12) -> DataFrame:
    """episodes with rolling (mean reward of the last n, null until there are n) and regressed (rolling > reward).

    Rewards are sums of doubles, whose last bits depend on the order in which Spark adds them. So a mean and a reward that
    differ by no more than `within` of the n rewards' mean size are equal, and the episode has not regressed. Where each
    reward has but one value (ordered_sum), within=0 compares the doubles as they are.
    """
    by = Window.partitionBy(scope).orderBy(order)
    last = by.rowsBetween(1 - n, Window.currentRow)
    rolling = F.when(F.row_number().over(by) >= n, F.avg("reward").over(last))
    size = F.avg(F.abs("reward")).over(last)
    same = F.abs(F.col("rolling") - F.col("reward")) <= F.when(size < float("inf"), within * size).otherwise(0.0)
    return episodes.withColumn("rolling", rolling).withColumn("regressed", (F.col("rolling") > F.col("reward")) & ~same)


def format_episodes(episodes: DataFrame) -> DataFrame:
    reward, epsilon = scalar.format_metrics(F.col("reward"), F.col("epsilon"))
    return episodes.withColumns({"reward_text": reward, "epsilon_text": epsilon})
