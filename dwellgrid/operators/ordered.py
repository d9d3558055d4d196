"""Ordered per-key logic that does not depend on any key being small.

The rows of all keys are put into one order, by key and then within the key, and cut into ranges of about the same
size; where a range begins or ends has nothing to do with keys. Each range is scanned on its own. Only the last
key of a range can go on in the next, so one summary row per range says how that key stands at its end, the
summaries are scanned over the ranges, and what they carry is added to the rows of the first key of each
range. Every key takes this path, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.session import materialize, materialize_buckets


@dataclass(frozen=True)
class Step:
    """One running value.

    ``lag``: ``value`` on the previous row. ``sum``/``max``: over all rows before this one.
    ``last``: latest non-null ``value`` up to and including this row.
    """

    name: str
    kind: str
    value: Column


Scan = Callable[[DataFrame, Sequence[Step]], DataFrame]
PLACE = ("_range", "_at")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` as a stored table with ``_range``, a number without order, and, rising within and over ranges, ``_at``.

    All other columns are the last keys of the order, so only rows equal in everything are open among themselves; a
    number spreads even those over ranges. Without ``ranges`` the session's number of shuffle partitions holds.
    """
    rest = [c for c in df.columns if c not in (*keys, *order)]
    by = [F.col(c) for c in (*keys, *order, *rest, "_own")]
    held = df.withColumn("_own", F.monotonically_increasing_id())
    spread = held.repartitionByRange(ranges, *by) if ranges else held.repartitionByRange(*by)
    buckets = _buckets(df.sparkSession, ranges)
    numbers, partition = F.array(*map(F.lit, _bucket_numbers(df.sparkSession, buckets))), F.spark_partition_id()
    number = F.coalesce(F.get(numbers, partition), -1 - partition.cast("long"))
    placed = spread.sortWithinPartitions(*by).drop("_own").withColumns({"_at": F.monotonically_increasing_id(), "_range": number})
    # A range is in one bucket, so scans over ranges read it as it lies.
    return materialize_buckets(placed, "ordered", "_range", buckets)


def _buckets(spark: SparkSession, ranges: int | None) -> int:
    return ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))


@cache
def _bucket_numbers(spark: SparkSession, buckets: int) -> list[int]:
    """One number for each bucket: ranges named after them share no bucket, and a task sorts one range and not several."""
    # All buckets are met after about ``buckets * log(buckets)`` numbers.
    names = spark.range(buckets * (buckets.bit_length() + 16)).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("_bucket"))
    found = dict(names.agg(F.min("id")).collect())
    return [found.get(b, -1 - b) for b in range(buckets)]


def by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[DataFrame, Scan], DataFrame], ranges: int | None = None
) -> DataFrame:
    """Run ``work`` with a scan over ``keys``, each in ``order`` and then by all other columns. Null keys are keys.

    ``work`` may scan several times and must keep the columns ``PLACE``, unless it ends with ``over_runs``.
    """

    def scan(rows: DataFrame, steps: Sequence[Step]) -> DataFrame:
        return _scan(rows, keys, steps)

    return work(in_ranges(df, keys, order, ranges), scan).drop(*PLACE)


def over_runs(rows: DataFrame, group: Sequence[str], kinds: Mapping[str, tuple[Callable[[str], Column], Column]]) -> DataFrame:
    """Per group an aggregate of ``value`` for each ``name: (kind, value)``, where each group lies side by side in the order.

    A kind, such as the least, is its own merger. Groups are found within the ranges, where the rows lie, and stored; only
    the first and the last of a range can go on in another, and only these are moved and merged.
    """
    valued = rows.select(*PLACE, *group, *[value.alias(name) for name, (_, value) in kinds.items()])
    ends = [F.min("_at").alias("_from"), F.max("_at").alias("_to")]
    aggregates = [kind(name).alias(name) for name, (kind, _) in kinds.items()]
    held = materialize(valued.groupBy("_range", *group).agg(*ends, *aggregates), "runs")
    ranges = held.groupBy("_range").agg(F.min("_from").alias("_low"), F.max("_to").alias("_high"))
    found = held.join(F.broadcast(ranges), "_range")  # one row per range of the shuffle
    at_end = (F.col("_from") == F.col("_low")) | (F.col("_to") == F.col("_high"))
    return found.where(~at_end).select(*group, *kinds).unionByName(found.where(at_end).groupBy(*group).agg(*aggregates))


def by_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    opens: Callable[[DataFrame, Scan], DataFrame],
    kinds: Mapping[str, tuple[Callable[[Column], Column], Column]],
    keep: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per run of a key's rows: the columns of its first row, and for each ``name: (kind, value)`` the least or greatest value.

    ``opens`` adds ``_opens``, 1 where a row begins a run and else 0. It must say the same of a run's first row when the
    runs before it stand for their rows, so that runs found within the ranges can be put together like rows; only those of
    the first and the last key of a range can go on in another, and only these are scanned over the ranges. ``keep`` says
    which whole runs are wanted; the others are not stored. A kind is ``F.min`` or ``F.max``.
    """
    rows = in_ranges(df, keys, order, ranges)
    held = materialize(_runs_within(rows, keys, opens, kinds, keep), "runs-within")
    others = [c for c in rows.columns if c not in (*PLACE, *keys, *kinds)]

    def scan(found: DataFrame, steps: Sequence[Step]) -> DataFrame:
        return _scan(found, keys, steps)

    opened = opens(held.where("_cut"), scan)
    numbered = scan(opened, [Step("_run", "sum", F.col("_opens"))]).withColumn("_run", F.col("_run") + F.col("_opens"))
    first = F.struct("_at", F.struct(*others).alias("_row"))
    merged = over_runs(numbered, [*keys, "_run"], {**{n: (kind, F.col(n)) for n, (kind, _) in kinds.items()}, "_first": (F.min, first)})
    merged = merged.select(*keys, *kinds, "_first._row.*")
    whole = held.where(~F.col("_cut")).drop("_cut", *PLACE)
    return whole.unionByName(merged if keep is None else merged.where(keep))


def _runs_within(rows: DataFrame, keys: Sequence[str], opens, kinds, keep: Column | None) -> DataFrame:
    """Runs as they are within their ranges, and whether they are of a key that another range may hold too (``_cut``).

    All windows have one order. Run numbers only rise, so the greatest pair of run number and value is of the run a row is
    in, and its last row knows the run.
    """
    here = W.partitionBy("_range", *keys).orderBy("_at")
    through, all_ = here.rowsBetween(W.unboundedPreceding, W.currentRow), here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = F.col("_run")

    def scan(found: DataFrame, steps: Sequence[Step]) -> DataFrame:
        inside = _inside(keys)
        return found.select("*", *[(inside[s.kind](s)["v"] if s.kind == "lag" else inside[s.kind](s)).alias(s.name) for s in steps])

    def so_far(kind, value: Column) -> Column:
        if kind is F.max:
            return F.max(F.struct(run, value.alias("v"))).over(through)["v"]
        return F.min(F.struct(-run, value.isNull(), value.alias("v"))).over(through)["v"]

    first = F.when(F.col("_opens") == 1, F.struct(*[c for c in rows.columns if c not in (*keys, *kinds, "_range")]))
    numbered = opens(rows, scan).select(
        *rows.columns, "_opens", F.sum("_opens").over(through).alias("_run"), F.lead("_opens", 1, 1).over(here).alias("_ends"),
        F.min("_at").over(all_).alias("_from"), F.max("_at").over(all_).alias("_to"),
    )
    told = numbered.select(
        "_range", *keys, "_ends", "_from", "_to", F.last(first, ignorenulls=True).over(through).alias("_first"),
        *[so_far(kind, value).alias(name) for name, (kind, value) in kinds.items()],
    )
    sides = rows.groupBy("_range").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    found = told.where(F.col("_ends") == 1).join(F.broadcast(sides), "_range")  # one row per range of the shuffle
    cut = (F.col("_from") == F.col("_low")) | (F.col("_to") == F.col("_high"))
    found = found.select("_range", *keys, *kinds, "_first.*", cut.alias("_cut"))
    return found if keep is None else found.where(F.col("_cut") | keep)


def _inside(keys: Sequence[str]) -> Mapping[str, Callable[[Step], Column]]:
    """Running values within a range."""
    here = W.partitionBy("_range", *keys).orderBy("_at")
    before = here.rowsBetween(W.unboundedPreceding, -1)
    through = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    # Wrapped, so that a null value differs from "no such row in this range".
    return {
        "lag": lambda s: F.lag(F.struct(s.value.alias("v"))).over(here),
        "sum": lambda s: F.coalesce(F.sum(s.value).over(before), F.lit(0)),
        "max": lambda s: F.max(s.value).over(before),
        "last": lambda s: F.last(s.value, ignorenulls=True).over(through),
    }


def _scan(rows: DataFrame, keys: Sequence[str], steps: Sequence[Step]) -> DataFrame:
    inside = _inside(keys)
    local = rows.select(
        "*", F.struct(*keys).alias("_key"),
        *[inside[s.kind](s).alias(f"_in_{i}") for i, s in enumerate(steps)], *[s.value.alias(f"_own_{i}") for i, s in enumerate(steps)],
    )
    carried = _carried(local, steps)
    joined = local.join(F.broadcast(carried), "_range")  # one row per range of the shuffle
    first = F.col("_key").eqNullSafe(F.col("_first"))
    merged = {
        "lag": lambda here, carry: F.coalesce(here, carry)["v"],
        "sum": lambda here, carry: here + F.coalesce(carry, F.lit(0)),
        "max": lambda here, carry: F.greatest(here, carry),
        "last": lambda here, carry: F.coalesce(here, carry),
    }
    outputs = [
        merged[s.kind](F.col(f"_in_{i}"), F.when(first, F.col(f"_carry_{i}"))).alias(s.name) for i, s in enumerate(steps)
    ]
    return joined.select(*rows.columns, *outputs)


def _carried(local: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """``_range, _first`` and, per step, what the ranges before hold of the first key of a range."""
    ends = {
        "lag": lambda here, own: F.struct(own.alias("v")),
        "sum": lambda here, own: here + F.coalesce(own, F.lit(0)),
        "max": lambda here, own: F.greatest(here, own),
        "last": lambda here, own: here,
    }
    state = [ends[s.kind](F.col(f"_in_{i}"), F.col(f"_own_{i}")).alias(f"s{i}") for i, s in enumerate(steps)]
    ranges = local.groupBy("_range").agg(
        F.min("_at").alias("_from"), F.min_by("_key", "_at").alias("_first"), F.max_by(F.struct("_key", *state), "_at").alias("_last")
    )
    # A range asks for its first key before it answers for its last; one row is both, so that rows are scanned once for it.
    turn = F.explode(F.array(F.lit(0), F.lit(1)))
    told = F.col("_turn") == 1
    both = ranges.withColumn("_turn", turn).select(
        "_range", "_from", "_turn", F.when(told, F.col("_last._key")).otherwise(F.col("_first")).alias("_key"),
        *[F.when(told, F.col(f"_last.s{i}")).alias(f"s{i}") for i in range(len(steps))],
    )
    earlier = W.partitionBy("_key").orderBy("_from", "_turn").rowsBetween(W.unboundedPreceding, -1)
    carries = {
        "lag": lambda c: F.last(F.when(told, c), ignorenulls=True).over(earlier),
        "sum": lambda c: F.sum(c).over(earlier),
        "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
    }
    found = both.select(
        "_range", "_turn", F.col("_key").alias("_first"), *[carries[s.kind](F.col(f"s{i}")).alias(f"_carry_{i}") for i, s in enumerate(steps)]
    )
    return found.where("_turn = 0").drop("_turn")
