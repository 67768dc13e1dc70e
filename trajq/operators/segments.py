"""Running values over long ordered groups, without a task that holds a whole group.

A group is cut by its integer order column into segments of a fixed width. Each segment is scanned for itself, a row per
segment carries what came before, and the two are joined by segment, in the partitioning that the scan made already: rows
are shuffled once, and what they come from is computed once.
An order column without repeats in a group bounds a segment by the width, however long the group is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task scans.
WIDTH = 1 << 16


@dataclass(frozen=True)
class Scan:
    """How values of a column are combined in order, and how what came before joins what a segment has so far."""

    fold: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


SUM = Scan(F.sum, lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here))
MAX = Scan(F.max, lambda before, here: F.greatest(before, here))
XOR = Scan(F.bit_xor, lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before.bitwiseXOR(here)))
LAST = Scan(lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before))


def running(
    rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple[Scan, Column]], inclusive: bool = True, reverse: bool = False, width: int = WIDTH
) -> DataFrame:
    """rows with each of columns (name: scan, input): its values up to and with the row in order of `order`, or before it.

    reverse scans from the highest order down. Nulls are passed over; where nothing came yet, the result is null. Rows
    of one order value in a group are taken in any order. Null keys are a group.
    """
    direction = F.col(order).desc() if reverse else F.col(order).asc()
    key = F.struct(*keys, F.floor(F.col(order) / width).alias("_segment"))  # nulls within a struct are equal
    cut = rows.withColumns({"_key": key} | {f"_in_{name}": value for name, (_, value) in columns.items()}).repartition("_key")
    here = Window.partitionBy("_key").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumns({f"_here_{name}": scan.fold(F.col(f"_in_{name}")).over(here) for name, (scan, _) in columns.items()})
    totals = cut.groupBy("_key").agg(*[_total(scan, F.col(f"_in_{name}"), F.col(order), reverse).alias(name) for name, (scan, _) in columns.items()])
    segment = F.col("_key._segment")
    before = Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy(segment.desc() if reverse else segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_key", *[scan.fold(F.col(name)).over(before).alias(f"_before_{name}") for name, (scan, _) in columns.items()])
    joined = local.join(carried, "_key")
    values = {name: scan.join(F.col(f"_before_{name}"), F.col(f"_here_{name}")) for name, (scan, _) in columns.items()}
    return joined.select(*[F.col(c) for c in rows.columns if c not in columns], *[v.alias(name) for name, v in values.items()])


def _total(scan: Scan, value: Column, order: Column, reverse: bool) -> Column:
    """A segment's values combined; for the last one, that at the highest order which is not null."""
    if scan is LAST:
        return (F.min_by if reverse else F.max_by)(value, F.when(value.isNotNull(), order))
    return scan.fold(value)


def neighbour(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], ahead: bool = False, width: int = WIDTH) -> DataFrame:
    """rows with _near, a struct of `columns` of the row before in order (or after it, if ahead), null where there is none.

    Within a segment that is a lag; at its edge it is the last (first) row of the nearest segment that has any.
    """
    return running(rows, keys, order, {"_near": (LAST, F.struct(*columns))}, inclusive=False, reverse=ahead, width=width)
