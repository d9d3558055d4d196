"""Ranges cut through keys anywhere: the answers are those of one range, to the last bit, and of plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellgrid.operators import breaks, ingest, power
from dwellgrid.operators.ordered import Step, by_key, in_ranges

START = datetime(2026, 1, 1)


def same(left, right):
    rows = [sorted((tuple(r) for r in df.select(*left.columns).collect()), key=str) for df in (left, right)]
    assert rows[0] == rows[1] and rows[0]


@pytest.fixture(scope="module")
def actions(spark):
    """Two vehicles over a few days; one holds most of the rows, and its first trip half of them."""
    draw = random.Random(7)
    rows = []
    for n in range(400):
        vehicle = "W1" if n % 5 else "W2"
        trip = "T1" if n % 2 else f"T{n % 7}"
        start = START + timedelta(minutes=draw.randrange(0, 60 * 30))
        end = start + timedelta(minutes=draw.choice((0, 5, 40, 90)))
        place = draw.choice("ABC")
        action = draw.choice(("travel", "pause", "wait_after", "unload"))
        rows.append((vehicle, trip, action, start, end, f"Plaats {place}", 52.0 + ord(place) / 100))
    columns = "vehicle_code string, trip_id string, action string, planned_start timestamp_ntz, planned_end timestamp_ntz, address string, lat double"
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def stored_actions(actions):
    ready = ingest.sequence_actions(actions)
    extra = {
        "lon": F.lit(5.0), "plate": F.lit(""), "plate_norm": F.lit(""), "vehicle_class": F.lit("own"),
        "location_id": F.col("address"), "location_name": F.col("address"), "vehicle_type": F.lit(""),
        "dwell_min": F.lit(1.0), "segment_km": F.lit(0.0), "trip_km": F.lit(0.0), "carrier": F.lit(""),
    }
    return ready.withColumns(extra).cache()


def steps():
    kinds = {"lagged": "lag", "summed": "sum", "highest": "max", "latest": "last"}
    return [Step(name, kind, F.col("v")) for name, kind in kinds.items()]


def by_hand(rows):
    """Every step, in Python, over rows ``(key, time, value)``; times repeat, so the value settles the order."""
    out = []
    low = lambda x: (x is not None, x or 0)  # noqa: E731  nulls come first
    for key in {k for k, _, _ in rows}:
        own = sorted(((t, v) for k, t, v in rows if k == key), key=lambda r: (r[0], low(r[1])))
        for i, (t, v) in enumerate(own):
            seen = [x for _, x in own[:i] if x is not None]
            latest = [x for _, x in own[: i + 1] if x is not None]
            out.append((key, t, v, own[i - 1][1] if i else None, sum(seen), max(seen, default=None), latest[-1] if latest else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 2, 13, 60])
@pytest.mark.parametrize("shape", ["one huge key", "many small keys", "equal times", "null keys"])
def test_every_step_of_a_scan(spark, shape, ranges):
    draw = random.Random(3)
    keys = {"one huge key": ["a"] * 50 + ["b"], "many small keys": [f"k{i}" for i in range(90)], "equal times": ["a", "b"], "null keys": [None, None, "a"]}[shape]
    moment = (lambda n: START) if shape == "equal times" else (lambda n: START + timedelta(minutes=n // 2))
    rows = [(draw.choice(keys), moment(n), draw.choice((None, 1, 2, 5))) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int").repartition(4)
    got = by_key(df, ["k"], ["t"], lambda part, scan: scan(part, steps()), ranges)
    assert got.columns == ["k", "t", "v", "lagged", "summed", "highest", "latest"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)


def test_rows_equal_in_everything_are_spread_over_ranges(spark):
    df = spark.range(0, 3000, 1, 4).select(F.lit("a").alias("k"), F.lit(1).alias("t"))
    placed = in_ranges(df, ["k"], ["t"], 8)
    assert placed.groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
    counted = by_key(df, ["k"], ["t"], lambda part, scan: scan(part, [Step("n", "sum", F.lit(1))]), 8)
    assert sorted(r.n for r in counted.collect()) == list(range(3000))


def test_two_scans_in_a_row_carry_through_several_ranges(spark):
    df = spark.range(0, 400, 1, 4).select(F.lit("a").alias("k"), F.col("id").alias("t"))

    def work(rows, scan):
        first = scan(rows, [Step("before", "lag", F.col("t"))])
        return scan(first, [Step("gaps", "sum", F.when(F.col("before").isNull(), 1).otherwise(F.col("t") - F.col("before")))])

    got = by_key(df, ["k"], ["t"], work, 25).orderBy("t").collect()
    assert [r.before for r in got] == [None, *range(399)] and [r.gaps for r in got] == [0, *range(1, 400)]


def test_sequence(actions):
    same(ingest.sequence_actions(actions, ranges=1), ingest.sequence_actions(actions, ranges=30))


def test_stops_are_numbered_among_themselves(actions):
    marked = actions.withColumn("is_travel", F.col("action") == "travel")
    rows = ingest.sequence_actions(marked, ranges=20).collect()
    trips = {(r.vehicle_code, r.trip_date, r.trip_id) for r in rows}
    for trip in trips:
        own = sorted((r for r in rows if (r.vehicle_code, r.trip_date, r.trip_id) == trip), key=lambda r: r.action_seq)
        assert [r.action_seq for r in own] == list(range(len(own)))
        assert [r.stop_seq for r in own if r.is_travel] == list(range(sum(r.is_travel for r in own)))
        assert all(r.stop_seq is None for r in own if not r.is_travel)
        assert [(r.planned_start, r.planned_end, r.address, r.action) for r in own] == sorted((r.planned_start, r.planned_end, r.address, r.action) for r in own)


def test_presence_windows(stored_actions):
    plain = power.presence_windows(stored_actions, ranges=1)
    same(plain, power.presence_windows(stored_actions, ranges=30))
    same(power.merge_presence_windows(plain, ranges=1), power.merge_presence_windows(plain, ranges=7))


def test_shifts(spark):
    draw = random.Random(11)
    rows = []
    clock = START
    for n in range(150):
        vehicle = "V1" if n % 4 else "v2"
        clock += timedelta(minutes=draw.choice((10, 60, 150, 400)))
        end = clock + timedelta(minutes=draw.choice((0, 30, 100, 200)))
        ends = [draw.choice((52.0, 52.1, 52.3)) for _ in range(2)]
        rows.append((vehicle, "", "", clock.date(), f"T{n}", clock, end, ends[0], 5.0, ends[1], 5.0, draw.choice((0.0, 40.1, 90.7))))
    trips = spark.createDataFrame(
        rows,
        "vehicle_code string, plate string, plates string, trip_date date, trip_id string, trip_start timestamp_ntz, "
        "trip_end timestamp_ntz, start_lat double, start_lon double, end_lat double, end_lon double, distance_km double",
    )
    plain = breaks.break_trip_labels(trips, ranges=1)
    assert plain.where("is_reset").count() > 3
    same(plain, breaks.break_trip_labels(trips, ranges=40))
