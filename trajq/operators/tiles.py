"""Tile maps: zones, boxes, coordinate vectors and state keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajq import schemas
from trajq.functions import scalar

OBSERVATION = ("x", "y", "heading", "vx", "vy")


def add_tile_xy(grid: DataFrame, ncols: int = 32, tile: int = 32) -> DataFrame:
    x, y = scalar.tile_xy(F.col("pos"), ncols, tile)
    return grid.withColumns({"x": x, "y": y})


def code_dim(spark) -> DataFrame:
    return spark.createDataFrame(schemas.CODES, "code int, kind string")


def classify_tiles(grid: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """grid with the kind of each tile's code; unknown codes and 0 drop. The code table has a row per tile code."""
    codes = code_dim(grid.sparkSession) if codes is None else codes
    return grid.join(codes, "code")


def zone_box(tiles: DataFrame, width: float = 32.0, height: float = 32.0) -> DataFrame:
    """Box with its top left corner at (x, y)."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return tiles.withColumns({"x0": x, "y0": y, "x1": x + width, "y1": y + height})


def entity_box(frames: DataFrame, width: float = 24.0, height: float = 40.0, rotated: bool = False) -> DataFrame:
    """Box centred at (x + 16, y + 16); rotated: the bounding box of the footprint turned by heading degrees."""
    w, h = F.lit(float(width)), F.lit(float(height))
    if rotated:
        sin, cos = F.abs(F.sin(F.radians("heading"))), F.abs(F.cos(F.radians("heading")))
        w, h = width * cos + height * sin, width * sin + height * cos
    cx, cy = F.col("x") + 16, F.col("y") + 16
    return frames.withColumns({"x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2})


def flatten_zone_coords(zones: DataFrame, kind: str = "wall") -> DataFrame:
    """(map_id, coords): [x0, y0, x1, y1, ...] of a kind's tiles in scan order. A map's tiles are few by nature."""
    points = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    coords = F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    return zones.where(F.col("kind") == kind).groupBy("map_id").agg(coords.alias("coords"))


def state_vector(frames: DataFrame, coords: DataFrame) -> DataFrame:
    """frames with state_vector: the five observed numbers, then the map's coordinates (none for a map without)."""
    rest = F.coalesce("coords", F.array().cast("array<double>"))
    own = F.array(*[F.col(c).cast("double") for c in OBSERVATION])
    return frames.join(coords, "map_id", "left").withColumn("state_vector", F.concat(own, rest)).drop("coords")


def state_key(frames: DataFrame, bins: Mapping[str, float] | None = None, columns: Sequence[str] = OBSERVATION) -> DataFrame:
    """frames with state_key, a struct of map_id and the observed numbers: exact, or floor(column / width) by `bins`."""
    bins = bins or {}
    fields = [(F.floor(F.col(c) / bins[c]) if c in bins else F.col(c)).cast("double").alias(c) for c in columns]
    return frames.withColumn("state_key", F.struct("map_id", *fields))
