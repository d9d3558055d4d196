"""Sums along the clock are those of one row per interval and slot."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellgrid.functions.clock import HOUR_MICROS, QUARTER_MICROS
from dwellgrid.operators.sweep import first_slots, stretches

EPOCH = datetime(1970, 1, 1)
SCHEMA = "place string, vehicle string, begin timestamp_ntz, stop timestamp_ntz, required_kw double"


def by_hand(rows, slot_micros):
    found = {}
    unit = timedelta(microseconds=slot_micros)
    for place, vehicle, begin, stop, kw in rows:
        if begin is None or stop is None or stop <= begin:
            continue
        n = (begin - EPOCH) // unit
        while EPOCH + n * unit < stop:
            cell = found.setdefault((place, n), [set(), 0, 0.0, 0.0])
            hours = (min(stop, EPOCH + (n + 1) * unit) - max(begin, EPOCH + n * unit)) / timedelta(hours=1)
            cell[0].add(vehicle)
            cell[1] += 1
            cell[2] += kw or 0.0
            cell[3] += (kw or 0.0) * hours
            n += 1
    return {k: (len(v[0] - {None}), v[1], round(v[2], 6), round(v[3], 6)) for k, v in found.items()}


def intervals(seed, n):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        begin = datetime(2026, 1, 1) + timedelta(minutes=draw.choice((0, 15, 60, draw.randrange(6000))), seconds=draw.choice((0, 0, 7)))
        length = draw.choice((0, 1, 60, 90, 700, 3600, -5, 60 * 24 * 9))
        kw = draw.choice((0.1, 33.3, 590 / 7, 350.0, None))
        rows.append((draw.choice(("a", "a", "b", None)), draw.choice(("v1", "v2", "v3", None)), begin, begin + timedelta(minutes=length), kw))
    return [*rows, ("a", "v1", None, datetime(2026, 1, 1), 1.0), ("a", "v1", datetime(2026, 1, 1), None, 1.0)]


@pytest.mark.parametrize(("seed", "n", "unit"), [(1, 150, HOUR_MICROS), (2, 40, QUARTER_MICROS), (3, 1, HOUR_MICROS), (4, 0, HOUR_MICROS)])
def test_runs_say_what_every_slot_holds(spark, seed, n, unit):
    rows = intervals(seed, n)
    runs = stretches(spark.createDataFrame(rows, SCHEMA), ["place"], "begin", "stop", slot_micros=unit).collect()
    got = {}
    for r in runs:
        for slot in range(r["first"], r["last"] + 1):
            assert (r.place, slot) not in got
            got[r.place, slot] = (r.vehicles, r.events, r.required_kw, r.demand_kwh)
    expected = by_hand(rows, unit)
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, abs=2e-6)


def test_a_long_standstill_is_few_rows(spark):
    rows = [("a", "v", datetime(2026, 1, 1, 7, 30), datetime(2026, 3, 2, 8, 15), 10.0)]
    runs = stretches(spark.createDataFrame(rows, SCHEMA), [], "begin", "stop")
    assert runs.count() == 3
    assert first_slots(runs, 24).count() == 26
    assert runs.agg(F.sum((F.col("last") - F.col("first") + 1) * F.col("demand_kwh"))).first()[0] == pytest.approx(10 * (60 * 24 + 0.75))
