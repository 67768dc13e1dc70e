"""Column expressions over frames, tiles and episodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_xy(pos: Column, ncols: int = 32, tile: int = 32) -> tuple[Column, Column]:
    """Pixel x, y of the tile at token index pos, scanning rows of ncols tiles."""
    return (F.pmod(pos, F.lit(ncols)) * tile).cast("int"), (F.floor(pos / ncols) * tile).cast("int")


def out_of_bounds(x: Column, y: Column, width: float = 960.0, height: float = 960.0) -> Column:
    """Whether the point is outside; edges count as inside."""
    return (x < 0) | (x > width) | (y < 0) | (y > height)


def decode_action(action: Column, turn: float = 3.0) -> dict[str, Column]:
    """0 steers left, 2 right, anything else neither."""
    left, right = action == 0, action == 2
    return {"is_left": left, "is_right": right, "heading_delta": F.when(left, turn).when(right, -turn).otherwise(0.0)}


def heading_vector(heading: Column, acceleration: float = 0.25) -> tuple[Column, Column]:
    """Acceleration along a heading in degrees."""
    return F.sin(F.radians(heading)) * acceleration, F.cos(F.radians(heading)) * acceleration


def speed(vx: Column, vy: Column) -> Column:
    return F.hypot(vx, vy)


def cap_speed(vx: Column, vy: Column, most: float = 5.5) -> tuple[Column, Column]:
    """The two-step cap: vx is scaled first, and vy by the norm of the scaled vx with vy, so it isn't a normalisation."""
    over = F.hypot(vx, vy) > most
    scaled = vx * (most / F.hypot(vx, vy))
    return F.when(over, scaled).otherwise(vx), F.when(over, vy * (most / F.hypot(scaled, vy))).otherwise(vy)


def sim_time(ms: Column, started_ms: Column, multiplier: float = 25.0) -> Column:
    """Simulated seconds since started_ms."""
    return (ms - started_ms) * multiplier / 1000.0


def drag(slow: Column, on_slow: float = 0.7) -> Column:
    return F.when(slow, on_slow).otherwise(0.0)


def epsilon_at(episode_no: Column, first: float = 1.0, least: float = 0.01, decay: float = 0.9999) -> Column:
    """Exploration rate of an episode, numbered from 1: decayed before each episode, floored."""
    return F.greatest(F.lit(least), first * F.pow(F.lit(decay), episode_no))


def uniform_draw(seed: str, *ids: Column) -> Column:
    """A number in [0, 1) from a digest of seed and ids: the same in every retry, and in any engine with md5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[i.cast("string") for i in ids]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def format_metrics(reward: Column, epsilon: Column) -> tuple[Column, Column]:
    """Reward with two decimals, epsilon with three."""
    return F.format_string("%.2f", reward), F.format_string("%.3f", epsilon)
