"""Loads over time by a sweep over the ends of intervals.

An interval adds its load where it begins and takes it away after it ends, so it is two rows whatever its
length. Added up along the clock slots they give, for every stretch in which nothing begins or ends, how much is there.
Distinct vehicles are counted the same way over the merged stays of each vehicle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions.clock import HOUR_MICROS, from_micros, micros

#: Sums that go up and down must come back to zero: fixed-point numbers do.
_EXACT = "decimal(32,12)"
_SUMS = ("_up", "_down", "_kw_up", "_kw_down", "_part", "_in", "_out")


def stretches(
    df: DataFrame, keys: Sequence[str], start: str, end: str, kw: str = "required_kw", vehicle: str = "vehicle", slot_micros: int = HOUR_MICROS
) -> DataFrame:
    """``keys, first, last, vehicles, events, required_kw, demand_kwh`` per run of clock slots that are alike.

    ``first`` and ``last`` number the slots from 1970; the values hold for each slot of the run: the vehicles and
    intervals that touch it, the sum of their power, and their energy in it. Slots that nothing touches
    have no row, nor have intervals without a length. Per key there are at most twice as many rows as slots with an end in them.
    """
    keys = list(keys)
    unit = F.lit(slot_micros)
    power = F.coalesce(F.col(kw), F.lit(0.0))
    begin, stop = micros(start), micros(end)
    first, last = F.floor(begin / unit), F.floor((stop - 1) / unit)

    def rest(slot: Column, at: Column) -> Column:
        """Energy from ``at`` to the end of its slot."""
        return (power * ((slot + 1) * unit - at) / float(HOUR_MICROS)).cast(_EXACT)

    spans = df.where(begin < stop).select(
        *keys, F.col(vehicle).alias("_vehicle"), first.alias("_first"), last.alias("_last"), power.cast(_EXACT).alias("_kw"),
        rest(first, begin).alias("_rest_first"), rest(last, stop).alias("_rest_last"),
    )
    none, zero = F.lit(0).cast("long"), F.lit(0).cast(_EXACT)

    def change(slot, up=none, down=none, kw_up=zero, kw_down=zero, part=zero, into=none, out=none) -> Column:
        values = dict(zip(("_slot", *_SUMS), (slot, up, down, kw_up, kw_down, part, into, out), strict=True))
        return F.struct(*[v.cast("long" if n in ("_slot", "_up", "_down", "_in", "_out") else _EXACT).alias(n) for n, v in values.items()])

    ends = F.array(
        change(F.col("_first"), up=F.lit(1), kw_up=F.col("_kw"), part=F.col("_rest_first")),
        change(F.col("_last"), down=F.lit(1), kw_down=F.col("_kw"), part=-F.col("_rest_last")),
    )
    loads = spans.select(*keys, F.explode(ends).alias("_x")).select(*keys, "_x.*")

    # A vehicle has one row per slot it begins in, so its window is bounded by the clock.
    stays = spans.where(F.col("_vehicle").isNotNull()).groupBy(*keys, "_vehicle", "_first").agg(F.max("_last").alias("_last"))
    own = W.partitionBy(*keys, "_vehicle").orderBy("_first")
    until = F.max("_last").over(own.rowsBetween(W.unboundedPreceding, -1))
    seen = stays.select(*keys, "_first", "_last", until.alias("_until"), F.lead("_first").over(own).alias("_next"))
    opens = F.col("_until").isNull() | (F.col("_first") > F.col("_until"))
    turns = F.array(
        F.when(opens, change(F.col("_first"), into=F.lit(1))),
        F.when(opens & F.col("_until").isNotNull(), change(F.col("_until"), out=F.lit(1))),
        F.when(F.col("_next").isNull(), change(F.greatest("_last", "_until"), out=F.lit(1))),
    )
    vehicles = seen.select(*keys, F.explode(F.filter(turns, lambda x: x.isNotNull())).alias("_x")).select(*keys, "_x.*")

    summed = loads.unionByName(vehicles).groupBy(*keys, "_slot").agg(*[F.sum(c).alias(c) for c in _SUMS])
    # One row per slot of the clock in which something begins or ends.
    along = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_slot")
    through, before = along.rowsBetween(W.unboundedPreceding, W.currentRow), along.rowsBetween(W.unboundedPreceding, -1)

    def running(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    level = summed.select(
        *keys, "_slot", "_part", F.lead("_slot").over(along).alias("_next"),
        *[running(n, through).alias(f"{n}_now") for n in ("_up", "_down", "_kw_up", "_kw_down", "_in", "_out")],
        *[running(n, before).alias(f"{n}_was") for n in ("_down", "_kw_up", "_kw_down", "_out")],
    )

    def run(first: Column, last: Column, vehicles: Column, events: Column, power: Column, energy: Column) -> Column:
        return F.struct(
            first.alias("first"), last.alias("last"), vehicles.alias("vehicles"), events.alias("events"),
            F.round(power.cast("double"), 6).alias("required_kw"), F.round(energy.cast("double"), 6).alias("demand_kwh"),
        )

    c = F.col
    hours = slot_micros / float(HOUR_MICROS)
    after = c("_kw_up_now") - c("_kw_down_now")
    here = run(
        c("_slot"), c("_slot"), c("_in_now") - c("_out_was"), c("_up_now") - c("_down_was"), c("_kw_up_now") - c("_kw_down_was"),
        (c("_kw_up_was") - c("_kw_down_was")).cast("double") * hours + c("_part").cast("double"),
    )
    between = run(
        c("_slot") + 1, c("_next") - 1, c("_in_now") - c("_out_now"), c("_up_now") - c("_down_now"), after, after.cast("double") * hours
    )
    goes_on = (c("_next") > c("_slot") + 1) & (c("_up_now") > c("_down_now"))
    runs = F.filter(F.array(here, F.when(goes_on, between)), lambda x: x.isNotNull())
    return level.select(*keys, F.explode(runs).alias("_x")).select(*keys, "_x.*")


def first_slots(runs: DataFrame, most: int, slot_micros: int = HOUR_MICROS) -> DataFrame:
    """The first ``most`` slots of each run one by one, as ``slot``: later ones repeat them a period on."""
    last = F.least("last", F.col("first") + F.lit(most - 1))
    slots = runs.withColumn("_n", F.explode(F.sequence("first", last)))
    return slots.withColumn("slot", from_micros(F.col("_n") * slot_micros)).drop("_n", "first", "last")
