"""Which zones a frame's box overlaps, and what follows from that."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajq import schemas

KINDS = tuple(kind for _, kind in schemas.CODES)


def _level(side: Column, cell: float) -> Column:
    """The level of the grid at which a box of this side touches two cells an axis at most: cells grow fourfold a level."""
    return F.coalesce(F.greatest(F.lit(0), F.ceil(F.log2(F.nullif(side, F.lit(0.0)) / cell) / 2)), F.lit(0)).cast("int")


def _side(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, y1 - y0)


def _in_cells(boxes: DataFrame, levels: Column, cell: float, box: Sequence[Column]) -> DataFrame:
    """A row for each of `levels` from the box's own up, and each of its cells that the box, without its upper edges, lies in."""
    size = cell * F.pow(F.lit(4.0), F.col("level"))
    low = lambda v: F.floor(v / size).cast("long")
    cells = lambda v, w: F.sequence(low(v), F.greatest(low(v), F.ceil(w / size).cast("long") - 1))
    x0, y0, x1, y1 = box
    leveled = boxes.withColumn("level", F.explode(levels)).where("level >= own").withColumn("home", F.col("level") == F.col("own"))
    return leveled.withColumn("cx", F.explode(cells(x0, x1))).withColumn("cy", F.explode(cells(y0, y1)))


def box_overlap_join(frames: DataFrame, zones: DataFrame, cell: float = 32.0, keep: Sequence[str] = schemas.FRAME_KEYS) -> DataFrame:
    """Pairs of frame and zone whose boxes overlap; touching edges don't count. Boxes have x0 <= x1 and y0 <= y1.

    A box belongs to the level of a hierarchical grid whose cells are as large as it is, where it lies in four cells at
    most, and visits coarser levels, in one to four cells each: a pair meets at the coarser of its two levels, so neither a
    small cell nor a huge box makes many rows. Zones visit the levels up to that of all zones together, frames those that
    have zones; frames are clipped to where the zones are for this. Both are joined by (map, level, cell). A pair that shares several
    cells is kept in the one that holds the lower corner of the intersection, so that no distinct is needed (Dittrich &
    Seeger, 2000). Spark broadcasts the zones if they are small and else shuffles by cell, and AQE splits crowded cells.
    """
    edges = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    owned = zones.select("map_id", "zone_id", "kind", "x0", "y0", "x1", "y1").withColumn("own", _level(_side(*edges), cell))
    lowest, highest = [F.min("x0"), F.min("y0")], [F.max("x1"), F.max("y1")]
    # One row: the zones' extent, its level, and the few levels that have zones.
    all_zones = owned.agg(F.struct(*[c.alias(n) for c, n in zip([*lowest, *highest], ("x0", "y0", "x1", "y1"))], _level(_side(*lowest, *highest), cell).alias("top"), F.collect_set("own").alias("levels")).alias("all_zones"))
    span = all_zones.scalar()
    b = _in_cells(owned, F.sequence(F.col("own"), F.greatest("own", span["top"])), cell, edges).alias("b")
    clipped = {"_x0": F.greatest("x0", span["x0"]), "_y0": F.greatest("y0", span["y0"]), "_x1": F.least("x1", span["x1"]), "_y1": F.least("y1", span["y1"])}
    inside = frames.select("map_id", *keep, "x0", "y0", "x1", "y1").withColumns(clipped).where("_x0 <= _x1 and _y0 <= _y1")
    box = [F.col(c) for c in clipped]
    leveled = inside.withColumn("own", _level(_side(*box), cell))
    a = _in_cells(leveled, F.array_union(F.array("own"), span["levels"]), cell, box).alias("a")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("map_id", "level", "cx", "cy")]
    overlap = (F.col("a.x0") < F.col("b.x1")) & (F.col("a.x1") > F.col("b.x0")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("a.y1") > F.col("b.y0"))
    size = cell * F.pow(F.lit(4.0), F.col("a.level"))
    corner = lambda axis: F.floor(F.greatest(F.col(f"a.{axis}0"), F.col(f"b.{axis}0")) / size) == F.col(f"a.c{axis}")
    on = reduce(lambda x, y: x & y, [*same, F.col("a.home") | F.col("b.home"), overlap, corner("x"), corner("y")])
    return a.join(b, on).select(*[F.col(f"a.{c}").alias(c) for c in keep], F.col("b.zone_id").alias("zone_id"), F.col("b.kind").alias("kind"))


def rule_dim(spark) -> DataFrame:
    return spark.createDataFrame(schemas.RULES, schemas.RULE)


def direction_gate(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits whose velocity along the rule's axis has the rule's sign; kinds without a rule pass. Needs vx and vy."""
    gates = rules.select("kind", "gate_axis", "gate_sign").distinct()
    along = F.when(F.col("gate_axis") == "x", F.col("vx")).when(F.col("gate_axis") == "y", F.col("vy"))
    passes = F.col("gate_axis").isNull() | (along * F.col("gate_sign") > 0)
    return hits.join(gates, "kind", "left").where(passes).drop("gate_axis", "gate_sign")


def union_hits(*hits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, hits)


def frame_flags(frames: DataFrame, hits: DataFrame, kinds: Sequence[str] = KINDS, keys: Sequence[str] = schemas.FRAME_KEYS) -> DataFrame:
    """frames with a boolean on_<kind> for each kind; frames without hits are kept, with all flags false."""
    flags = hits.groupBy(*keys).agg(*[F.bool_or(F.col("kind") == k).alias(f"on_{k}") for k in kinds])
    joined = frames.join(flags, list(keys), "left")
    return joined.withColumns({f"on_{k}": F.coalesce(f"on_{k}", F.lit(False)) for k in kinds})


def surface_state(flags: DataFrame) -> DataFrame:
    """slow unless on the track; crash on a wall."""
    return flags.withColumns({"slow": ~F.col("on_track"), "crash": F.col("on_wall")})
