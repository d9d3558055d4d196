"""Wall-clock arithmetic on zone-free timestamps (the session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.functions.geo import column

HOUR_MICROS = 3_600_000_000
QUARTER_MICROS = HOUR_MICROS // 4


def micros(value) -> Column:
    return F.unix_micros(column(value).cast("timestamp"))


def seconds(value) -> Column:
    return F.unix_seconds(column(value).cast("timestamp"))


def from_micros(value) -> Column:
    return F.timestamp_micros(column(value).cast("long")).cast("timestamp_ntz")


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / float(HOUR_MICROS)


def dwell_minutes(start, end) -> Column:
    """Whole seconds between the two, in minutes, never below zero; null counts as zero."""
    return F.greatest(F.coalesce(seconds(end) - seconds(start), F.lit(0)) / 60.0, F.lit(0.0))


def slot_starts(start, end, slot_micros: int) -> Column:
    """Start of every clock slot the interval touches, as microseconds; empty when it has no length."""
    first = F.floor(micros(start) / slot_micros)
    last = F.floor((micros(end) - 1) / slot_micros)
    steps = F.when(micros(end) > micros(start), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda step: step * slot_micros)


def overlap_hours(start, end, slot, slot_micros: int) -> Column:
    """Hours the interval spends in the slot that starts at ``slot`` microseconds."""
    stop = F.least(micros(end), column(slot) + slot_micros)
    return (stop - F.greatest(micros(start), column(slot))) / float(HOUR_MICROS)
