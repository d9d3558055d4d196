"""Places in a total order, found in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.session import materialize


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order given.

    One shuffle by ranges of ``order``, a count per partition, and the counts of the partitions before added
    to the place within the partition: no task holds more than its range. Rows that are equal in ``order``
    come in an unspecified order among themselves and are spread over partitions like all others; add
    columns to ``order`` to settle them. The result is a stored table.
    """
    columns = df.columns
    held = df.withColumn("_own", F.monotonically_increasing_id())
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = held.repartitionByRange(*keys, F.xxhash64("_own")).sortWithinPartitions(*keys, F.xxhash64("_own"))
    placed = spread.select(*columns, F.monotonically_increasing_id().alias("_at"))
    split = {"_part": F.shiftright("_at", 33), "_within": F.col("_at").bitwiseAND((1 << 33) - 1)}
    stored = materialize(placed, "ranked").withColumns(split)
    # One row per partition of the shuffle.
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    out = stored.join(F.broadcast(offsets), "_part")
    return out.select(*columns, (F.col("_before") + F.col("_within") + 1).alias(name))


def cut_value(df: DataFrame, weight: str, keep: Callable[[int], int]) -> tuple[int, int, Any, int, int]:
    """Where the rows with the largest ``weight`` end: rows, rows to keep, the cut, rows above it and rows at it.

    Rows are counted per value and the values put into ranges of falling order; the ranges before the cut are
    passed over by their sums, and only the range that holds it is looked into.
    """
    counts = df.groupBy(F.col(weight).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    falling = F.col("_value").desc()
    spread = counts.repartitionByRange(falling).sortWithinPartitions(falling).withColumn("_at", F.monotonically_increasing_id())
    values = materialize(spread, "weights").withColumn("_part", F.shiftright("_at", 33))
    # One row per partition of the shuffle.
    sums = sorted(tuple(r) for r in values.groupBy("_part").agg(F.sum("_n")).collect())
    total = sum(n for _, n in sums)
    wanted = max(0, min(total, keep(total)))
    if not wanted:
        return total, 0, None, 0, 0
    above = 0
    for part, n in sums:
        if above + n >= wanted:
            break
        above += n
    here = W.partitionBy("_part").orderBy("_at")
    running = values.where(F.col("_part") == part).withColumn("_until", F.sum("_n").over(here))
    found = running.where(F.col("_until") >= wanted - above).orderBy("_at").first()
    return total, wanted, found["_value"], above + found["_until"] - found["_n"], found["_n"]


def heaviest(df: DataFrame, weight: str, keep: Callable[[int], int], order: Sequence[Column | str]) -> DataFrame:
    """The ``keep(rows)`` rows that come first by falling ``weight`` and then ``order``; they are not sorted.

    All rows above the cut are taken as they are; only rows tied at it are put in order, in parallel. ``weight`` is
    never null. Rows equal in weight and order are chosen among freely.
    """
    total, wanted, cut, above, tied = cut_value(df, weight, keep)
    if wanted == total:
        return df
    if not wanted:
        return df.limit(0)
    if above + tied == wanted:
        return df.where(F.col(weight) >= cut)
    last = ranked(df.where(F.col(weight) == cut), order, "_place").where(F.col("_place") <= wanted - above).drop("_place")
    return df.where(F.col(weight) > cut).unionByName(last)
