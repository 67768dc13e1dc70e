"""Checks of logged motion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq import schemas
from trajq.functions import scalar

from .segments import WIDTH, neighbour


def motion_residual(frames: DataFrame, width: int = WIDTH) -> DataFrame:
    """frames(…, x, y, heading, vx, vy, action, slow) with rx, ry, rvx, rvy: how far the next frame's position and
    velocity are from those that the motion rule gives for this one; null on an episode's last frame. The next frame is
    looked for in segments of `width` steps."""
    ax, ay = scalar.heading_vector(F.col("heading") + scalar.decode_action(F.col("action"))["heading_delta"])
    vx, vy = scalar.cap_speed(F.col("vx") + ax, F.col("vy") + ay)
    ahead = lambda c: F.col(f"_near.{c}")
    share = 1 - scalar.drag(F.col("slow"))
    near = neighbour(frames, schemas.EPISODE_KEYS, "step", ["x", "y", "vx", "vy"], ahead=True, width=width)
    return near.withColumns(
        {
            "rx": ahead("x") - (F.col("x") + ahead("vx") * share),
            "ry": ahead("y") - (F.col("y") + ahead("vy") * share),
            "rvx": ahead("vx") - vx,
            "rvy": ahead("vy") - vy,
        }
    ).drop("_near")
