"""Transitions, running returns and episode bounds.

An episode is cut into segments of steps (see segments.py), so that a long one is no single task's work; all functions take
the `width` of a segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq import schemas

from .segments import SUM, WIDTH, neighbour, running


def build_transitions(frames: DataFrame, lag_mode: str = "logged", start: str = schemas.START_STATE, width: int = WIDTH) -> DataFrame:
    """frames(…, obs, action, reward, done) to transitions.

    logged: the observation of a row is the next_state of its action, and the one before, or `start`, its state.
    effect: the row's observation is the state, and reward, observation and done of the next row are the outcome; an
    episode's last row has none and drops.
    """
    keys = [F.col(c) for c in schemas.FRAME_KEYS]
    if lag_mode == "logged":
        near = neighbour(frames, schemas.EPISODE_KEYS, "step", ["obs"], width=width)
        return near.select(*keys, F.coalesce("_near.obs", F.lit(start)).alias("state"), "action", "reward", F.col("obs").alias("next_state"), "done")
    if lag_mode != "effect":
        raise ValueError(f"lag_mode {lag_mode!r}")
    near = neighbour(frames, schemas.EPISODE_KEYS, "step", ["reward", "obs", "done"], ahead=True, width=width).where("_near is not null")
    return near.select(*keys, F.col("obs").alias("state"), "action", F.col("_near.reward").alias("reward"), F.col("_near.obs").alias("next_state"), F.col("_near.done").alias("done"))


def running_return(frames: DataFrame, width: int = WIDTH) -> DataFrame:
    return running(frames, schemas.EPISODE_KEYS, "step", {"running_return": (SUM, F.col("reward"))}, width=width)


def split_episodes(frames: DataFrame, width: int = WIDTH) -> DataFrame:
    """frames with episode_no: how many rows of the (run, episode) before this one are done."""
    ends = {"episode_no": (SUM, F.col("done").cast("long"))}
    return running(frames, schemas.EPISODE_KEYS, "step", ends, inclusive=False, width=width).withColumn("episode_no", F.coalesce("episode_no", F.lit(0)))


def cut_after_done(frames: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows up to and with the first done one of each episode."""
    return split_episodes(frames, width).where("episode_no = 0").drop("episode_no")
