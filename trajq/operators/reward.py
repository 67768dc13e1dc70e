"""Milestones and shaped rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajq import schemas

from .segments import LAST, WIDTH, running


def milestones(hits: DataFrame, rules: DataFrame, scope_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rule rows that fire, with the frame at which they do: (run_id, episode_id, step, ts, stage, kind, base, bonus,
    terminal). hits needs ts besides the frame keys and kind.

    A stage fires at its first hit in the scope, unless a higher stage was hit before: the mark only rises. Only first
    hits can fire, so each scope is first reduced to a row per stage, combined before the shuffle; the window then
    orders a handful of rows however long the run is.
    """
    staged = hits.join(rules.select("kind", "stage", "base", "bonus", "terminal"), "kind")
    at = F.struct("ts", "step", *[c for c in schemas.EPISODE_KEYS if c not in scope_cols])
    first = staged.groupBy(*scope_cols, "stage", "kind", "base", "bonus", "terminal").agg(F.min(at).alias("at"))
    first = first.select(*scope_cols, "stage", "kind", "base", "bonus", "terminal", "at.*")
    before = Window.partitionBy(*scope_cols).orderBy("ts", "step", "stage").rowsBetween(Window.unboundedPreceding, -1)
    fired = first.withColumn("_mark", F.coalesce(F.max("stage").over(before), F.lit(0))).where("stage > _mark")
    return fired.select(*schemas.FRAME_KEYS, "ts", "stage", "kind", "base", "bonus", "terminal")


def shape_reward(frames: DataFrame, fired: DataFrame, penalty: float = 150.0, width: int = WIDTH) -> DataFrame:
    """frames(…, elapsed, off_track, forbidden) with reward, done and success.

    A fired stage pays base + bonus / elapsed (no bonus at time 0); on the track a frame pays 1, off it -1; a forbidden
    frame costs `penalty` and ends the episode, as does a terminal stage. success turns true when a stage fires and
    false on a forbidden frame, and holds until the next of either in the episode, which is cut into segments of `width` steps.
    """
    keys = schemas.FRAME_KEYS
    won = fired.groupBy(*keys).agg(F.sum("base").alias("_base"), F.sum("bonus").alias("_bonus"), F.bool_or("terminal").alias("_terminal"))
    joined = frames.join(won, keys, "left")
    paid = F.coalesce("_base", F.lit(0.0)) + F.coalesce(F.col("_bonus") / F.nullif(F.col("elapsed"), F.lit(0.0)), F.lit(0.0))
    reward = paid + F.when(F.col("off_track"), -1.0).otherwise(1.0) - F.when(F.col("forbidden"), penalty).otherwise(0.0)
    turn = F.when(F.col("forbidden"), False).when(F.col("_base").isNotNull(), True)
    paid = joined.withColumns({"reward": reward, "done": F.coalesce("_terminal", F.lit(False)) | F.col("forbidden")})
    won = running(paid, schemas.EPISODE_KEYS, "step", {"success": (LAST, turn)}, width=width)
    return won.withColumn("success", F.coalesce("success", F.lit(False))).drop("_base", "_bonus", "_terminal")
