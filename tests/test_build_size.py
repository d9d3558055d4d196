"""What the stored tables and the steps many queries share cost, seen in their plans and files."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from fixture_data import STOPS_SCHEMA, stop_rows
from pyspark.sql import functions as F

from dwellgrid.operators import breaks, demand, ingest, power, roads, tables
from dwellgrid.operators.ordered import Step, by_key, by_runs, in_ranges, over_runs
from dwellgrid.plans.tables import STORED, TablesOnDemand
from dwellgrid.session import new_folder, shared_folder
from dwellgrid.sources import writers


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_simplify_polyline_makes_the_line_once(spark):
    made = F.sequence(F.lit(1), F.col("n"))
    df = spark.createDataFrame([(1,), (2,), (80,), (81,), (156,), (157,), (1000,), (None,)], "n int")
    thin = df.select("n", roads.simplify_polyline(made).alias("t"))
    assert _plan(thin).count("sequence(1, n") == 1
    for n, t in thin.collect():
        step = -(-n // 78) if n else 0
        assert t == (None if n is None else [i + 1 for i in range(n) if n <= 80 or i % step == 0 or i == n - 1])


def test_scans_over_ranges_move_no_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.lit("wide").alias("w"))
    steps = [Step("before", "sum", F.lit(1))]
    done = by_key(df, ["k"], ["id"], lambda rows, scan: scan(scan(rows, steps), [Step("again", "sum", F.lit(1))]), 4)
    assert {(r.k, r.id, r.before, r.again) for r in done.collect()} == {(i % 7, i, i // 7, i // 7) for i in range(1000)}
    assert "hashpartitioning(_range" not in _plan(done, "executedPlan")


def test_tables_are_stored_when_asked_for(spark):
    folder, rows = new_folder(spark, "on-demand"), spark.createDataFrame(stop_rows(), STOPS_SCHEMA)
    found = TablesOnDemand(lambda: 1 / 0, lambda: ingest.enrich_ze_zone(ingest.prepared_stops(rows)), folder)
    assert found.daily_trips.count() == found.daily_trips.select("trip_id", "trip_date", "vehicle_code").distinct().count() > 0
    assert set(os.listdir(folder)) == {"stops", "daily_trips"} < set(STORED)
    assert all(name.endswith(".zstd.parquet") for _, _, names in os.walk(folder) for name in names if name.startswith("part-"))


def test_numbered_rows_are_not_stored_again(spark):
    columns = ["Wagen Code", "Tripnummer", "Actie soort", "Gepland vanaf (Trip actie)", "Adres", "lat", "lon"]
    raw = spark.createDataFrame([("W1", f"T{i // 3}", "travel", f"01-01-2026 0{i}:00:00", "A", "52", "5") for i in range(6)], columns)

    def stored() -> set[str]:
        return set(os.listdir(f"{shared_folder(spark)}/dwellgrid"))

    spark.range(1).write.parquet(new_folder(spark, "any"))
    before = stored()
    assert sorted((r.trip_id, r.action_seq) for r in ingest.build_route_actions(raw).collect()) == [(f"T{i // 3}", i % 3) for i in range(6)]
    assert sorted(name.split("-")[0] for name in stored() - before) == ["ordered", "typed"]


def test_overnight_locations_gather_no_gaps(spark):
    columns = "depot_id string, vehicle_key string, start_lat double, start_lon double, start_address string, gap_hours double, day_km double"
    rows = [("d", f"v{i}", 52.0, 5.0, "a", float(gap), 10.0) for i, gap in enumerate((6, 7, 9, 30))] + [("e", "v", 52.0, 5.0, "a", None, None)]
    found = tables.overnight_locations(spark.createDataFrame(rows, columns))
    assert {r.depot_id: r.median_gap_hours for r in found.collect()} == {"d": 8.0, "e": 0.0}
    assert "percentile(" not in _plan(found)


def test_vehicles_of_a_selection_read_it_once(spark):
    columns = "vehicle_code string, plates string, plate string, trip_date date, trip_id string, trip_start timestamp_ntz, trip_end timestamp_ntz, "
    columns += "start_lat double, start_lon double, start_address string, distance_km double"
    rows = [(f"W{i % 2}", f"p{i % 2}", None, None, f"T{i}", None, None, 52.0, 5.0, "a", 10.0 * i) for i in range(4)]
    events = demand.road_demand_events(spark.createDataFrame(rows + rows, columns))
    found = demand.selection_vehicles(events, is_road=True)
    assert [(r.codes, r.days, r.total_km, r.p95_km) for r in found.collect()] == [("W1", 2, 40.0, 29.0), ("W0", 2, 20.0, 19.0)]
    assert "trip_id" not in _plan(found) and "distinct" not in _plan(found).lower() and "LogicalRDD" not in _plan(found)


def test_a_task_of_a_scan_holds_one_range_and_rows_are_read_once_for_what_ranges_carry(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), "id")
    held = in_ranges(df, ["k"], ["id"], 16)
    assert held.select("_range").distinct().count() == 16
    per_bucket = held.groupBy(F.pmod(F.hash("_range"), F.lit(16)).alias("b")).agg(F.count_distinct("_range").alias("n"))
    assert [r.n for r in per_bucket.collect()] == [1] * 16
    done = by_key(df, ["k"], ["id"], lambda rows, scan: scan(rows, [Step("before", "sum", F.lit(1))]), 4)
    assert _plan(done).count("Relation ") == 2


def test_shifts_move_trips_only_into_their_order(spark):
    at = datetime(2024, 1, 1)
    rows = [(f"W{i % 3}", f"T{i}", at + timedelta(hours=13 * i), at + timedelta(hours=13 * i + 1), 52.0, 5.0, 52.0, 5.0, 40.0) for i in range(60)]
    columns = "vehicle_code string, trip_id string, trip_start timestamp_ntz, trip_end timestamp_ntz, start_lat double, start_lon double, "
    trips = spark.createDataFrame(rows, columns + "end_lat double, end_lon double, distance_km double")
    for ranges in (1, 4):
        done = breaks.shift_sessions(trips, ranges=ranges)
        plan = _plan(done, "executedPlan")
        assert "hashpartitioning(prev_lat" not in plan and "hashpartitioning(_range" not in plan
        assert {(r.trip_id, r.shift_id, r.is_reset) for r in done.collect()} == {(f"T{i}", i // 3 + 1, i >= 3) for i in range(60)}


def test_runs_are_put_together_where_they_lie(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", F.floor(F.col("id") / 700).alias("run"), (F.col("id") * 7 % 1000).alias("v"))
    kinds = {"least": (F.min, F.col("v")), "most": (F.max, F.col("id")), "odd": (F.bool_or, F.col("v") % 5 == 3)}
    plain = df.groupBy("k", "run").agg(*[kind(value).alias(name) for name, (kind, value) in kinds.items()]).collect()
    for ranges in (1, 3, 50):
        done = by_key(df, ["k"], ["id"], lambda rows, scan: over_runs(rows, ["k", "run"], kinds), ranges)
        assert sorted(map(tuple, done.collect())) == sorted(map(tuple, plain)) and len(plain) == 10


def test_presence_windows_shuffle_only_what_ranges_share(spark):
    at = datetime(2024, 1, 1)
    rows = [(f"W{i % 3}", f"T{i // 9}", i % 9, "pause", at + timedelta(minutes=20 * i), at + timedelta(minutes=20 * i + 15), f"p{i // 40}") for i in range(360)]
    columns = "vehicle_code string, trip_id string, action_seq int, action string, planned_start timestamp_ntz, planned_end timestamp_ntz, location_id string"
    texts = {c: F.lit("") for c in ("plate", "plate_norm", "vehicle_class", "location_name", "address", "vehicle_type")}
    numbers = {c: F.lit(1.0) for c in ("trip_km", "segment_km", "dwell_min", "lat", "lon")}
    actions = spark.createDataFrame(rows, columns).withColumns({**texts, **numbers, "trip_date": F.to_date("planned_start")})
    for make in (power.presence_windows, lambda a, ranges: power.merge_presence_windows(power.presence_windows(a, 1), ranges=ranges)):
        found = [make(actions, ranges=ranges) for ranges in (1, 5)]
        assert "Window" not in _plan(found[1])
        assert sorted(map(tuple, found[0].collect()), key=str) == sorted(map(tuple, found[1].collect()), key=str)


def test_runs_of_a_key_over_many_ranges(spark):
    draw = random.Random(3)
    rows = [(k, b, b + draw.choice((0, 1, 2, 3, 90)), f"{k}{i}") for k, n in (("a", 400), ("b", 3), (None, 40)) for i in range(n) for b in [draw.randrange(3 * n)]]
    rows += [("a", 5, 700, "long"), ("c", 1, None, "no end"), ("c", 2, 3, "end")]
    df = spark.createDataFrame(rows, "k string, b int, e int, name string")
    expected = []
    for key in {k for k, *_ in rows}:
        until = None
        for _, b, e, name in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2], r[3])):
            if until is None or b > until + 1:
                expected.append([key, b, e, name, b, False])
            run = expected[-1]
            until = max((x for x in (until, e) if x is not None), default=None)
            run[2] = max((x for x in (run[2], e) if x is not None), default=None)
            run[4], run[5] = min(run[4], b), run[5] or b % 5 == 0

    def opens(rows, scan):
        seen = scan(rows, [Step("_until", "max", F.col("e"))])
        return seen.withColumn("_opens", F.when(F.col("b") <= F.col("_until") + 1, 0).otherwise(1))

    kinds = {"e": (F.max, F.col("e")), "least": (F.min, F.col("b")), "five": (F.max, F.col("b") % 5 == 0)}
    columns = ["k", "b", "e", "name", "least", "five"]
    for ranges in (1, 3, 50):
        found = by_runs(df, ["k"], ["b", "e"], opens, kinds, ranges=ranges).select(columns)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected), key=str) and len(expected) > 5
        kept = by_runs(df, ["k"], ["b", "e"], opens, kinds, F.col("e") > 100, ranges).select(columns)
        assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in expected if r[2] and r[2] > 100), key=str)


def test_windows_are_not_repeated_for_distinct_counts(spark):
    at = datetime(2024, 1, 1)
    rows = [(f"w{i % 4}", f"v{i % 4}", "own" if i % 4 else "charter", at.date(), f"t{i // 2}", f"P{i % 3}", float(i % 2), 10.0 * i, at, at + timedelta(hours=1 + i)) for i in range(12)]
    rows += [(None, "x", "own", at.date(), None, "p0", 0.0, 20.0, at, at + timedelta(hours=2))]
    columns = "vehicle_key string, vehicle_code string, vehicle_class string, trip_date date, trip_id string, location_id string, lat double, "
    windows = spark.createDataFrame(rows, columns + "dwell_min double, planned_start timestamp_ntz, planned_end timestamp_ntz")
    windows = windows.withColumns({"lon": F.lit(0.0), "location_name": F.lower("location_id"), "address": F.lit("")})
    daily = power.power_daily_metrics(windows)
    assert "Expand" not in _plan(daily)
    assert [tuple(r)[1:7] for r in daily.collect()] == [(4, 3, 1, 6, 13, 52.3)]
    places = {r.location_id: r for r in power.power_location_profile(windows, power.Power(top_locations=None)).collect()}
    assert {p: (r.vehicles, r.own, r.charter, r.trips, r.events, r.lat, r.lon, r["name"]) for p, r in places.items()} == {
        "P0": (4, 3, 1, 4, 5, 1.0, 0.0, "p0"), "P1": (4, 3, 1, 4, 4, 1.0, 0.0, "p1"), "P2": (4, 3, 1, 4, 4, 1.0, 0.0, "p2")
    }
    cells = {(r.location_id, r.hour): (r.vehicles, r.required_kw) for r in power.hourly_power_profile(windows).collect()}
    loads, all_ = power.place_loads(windows), power.Power(top_locations=None)
    profile = power.power_location_profile(windows, all_, loads=loads)
    for asked in (all_, power.Power(top_locations=2)):
        plain, given = power.power_heatmap(windows, asked), power.power_heatmap(windows, asked, loads, profile)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, given.collect()))
    assert cells == {(r.location_id, r.hour): (r.vehicles, r.required_kw) for r in power.hourly_power_profile(windows, loads=loads).collect()}


def test_the_focus_report_measures_its_places_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(f"W{i}", f"T{i}", i, "pause", at, at + timedelta(hours=2 + i), f"p{i % 2}") for i in range(4)]
    columns = "vehicle_code string, trip_id string, action_seq int, action string, planned_start timestamp_ntz, planned_end timestamp_ntz, location_id string"
    texts = {c: F.lit("") for c in ("plate", "plate_norm", "location_name", "address", "vehicle_type")}
    numbers = {c: F.lit(1.0) for c in ("trip_km", "segment_km", "dwell_min", "lat", "lon")}
    fixed = {"vehicle_class": F.lit("own"), "trip_date": F.to_date("planned_start")}
    actions = spark.createDataFrame(rows, columns).withColumns({**texts, **numbers, **fixed})

    def stored() -> int:
        folder = f"{shared_folder(spark)}/dwellgrid"
        return sum(name.startswith("places-") for name in os.listdir(folder)) if os.path.exists(folder) else 0

    before = stored()
    writers.export_focus_report(actions, f"{tmp_path}/report", ["nowhere"], "-")
    assert stored() - before == 1
