"""Known answers on the small fixture."""

from __future__ import annotations

from datetime import date, datetime
from math import asin, cos, radians, sin, sqrt

import pytest
from fixture_data import CHARGER_SCHEMA, CHARGERS, EDGES, HEAT, STOPS_SCHEMA, stop_rows

from dwellgrid.operators import roads
from dwellgrid.params import Breaks, ChargerFilter, Filter, Road, Scenario
from dwellgrid.plans import questions
from dwellgrid.plans.tables import build_from_stops, open_tables
from dwellgrid.session import new_folder
from dwellgrid.sources import readers

DEPOT = "auto:52.000:5.000"
SCENARIO = Scenario(kwh_per_km=1.0, capacity_kwh=200)
FAR_ROAD = Road(53.0, 6.0, 51.9, 4.5, 100)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    spark.createDataFrame(stop_rows(), STOPS_SCHEMA).write.parquet(f"{root}/stops")
    spark.createDataFrame(CHARGERS, CHARGER_SCHEMA).write.parquet(f"{root}/chargers")
    edges = spark.createDataFrame(EDGES, "lat1 double, lon1 double, lat2 double, lon2 double, n_wagens int, n_passes int")
    heat = spark.createDataFrame(HEAT, "lat double, lon double, weight double")
    for variant in readers.VARIANTS:
        edges.write.parquet(f"{root}/edges-{variant}")
        heat.write.parquet(f"{root}/heat-{variant}")
    (root / "zones.csv").write_text("pc6,ze_zone,ze_startdatum\n1234AB,Test ZE-zone,2025-01-01\n")
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, folder):
    zones = readers.scan_ze_zones(spark, f"{folder}/zones.csv")
    return build_from_stops(readers.scan_stops_parquet(spark, f"{folder}/stops"), new_folder(spark, "golden"), zones)


@pytest.fixture(scope="module")
def chargers(spark, folder):
    return readers.scan_chargers(spark, f"{folder}/chargers")


@pytest.fixture(scope="module")
def edges(spark, folder):
    return readers.scan_road_variants(spark, {v: f"{folder}/edges-{v}" for v in readers.VARIANTS})


@pytest.fixture(scope="module")
def heat(spark, folder):
    return readers.scan_road_heat(spark, {v: f"{folder}/heat-{v}" for v in readers.VARIANTS})


def one(parts, name):
    rows = parts[name].collect()
    assert len(rows) == 1
    return rows[0]


def test_metadata(tables):
    parts = questions.metadata(tables)
    totals = one(parts, "totals")
    assert (totals.stop_count, totals.min_date, totals.max_date) == (20, date(2026, 1, 1), date(2026, 1, 3))
    values = {(r.kind, r.value) for r in parts["values"].collect()}
    assert {("carrier_type", "eigen"), ("carrier_type", "charter"), ("ze_zone", "Test ZE-zone")} <= values


def test_summary(tables):
    own = one(questions.summary(tables, Filter(carrier_types=("eigen",))), "summary")
    assert (own.stops, own.trips, own.total_km, own.own_km_pct) == (12, 5, 600.0, 100.0)
    late = one(questions.summary(tables, Filter(date_from=date(2026, 1, 2))), "summary")
    assert (late.stops, late.trips, late.total_km) == (17, 8, 1030.0)


def test_summary_of_nothing_is_zero(tables):
    nothing = one(questions.summary(tables, Filter(vehicle_codes=("nobody",))), "summary")
    assert tuple(nothing) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_zero_emission_zones(tables):
    inside = one(questions.summary(tables, Filter(ze_mode="in")), "summary")
    assert (inside.stops, inside.trips, inside.vehicles) == (7, 5, 2)
    outside = one(questions.summary(tables, Filter(ze_mode="out")), "summary")
    assert (outside.stops, outside.trips) == (13, 9)
    zone = one(questions.dashboard(tables, flt=Filter(ze_mode="in")), "ze_zones")
    assert (zone.zone, zone.start_date, zone.stops) == ("Test ZE-zone", "2025-01-01", 7)


def test_road_map(edges, heat):
    parts = questions.road_map(edges, heat, Filter(road_threshold=1))
    lines = parts["lines"].collect()
    joined = [line for line in lines if line.raw_segments >= 2]
    assert [line.raw_segments for line in joined] == [2]
    assert "richting" in joined[0].direction and joined[0].road_name and joined[0].length_km > 0
    assert len(joined[0].coordinates) >= 3
    assert parts["heat"].count() == 1


def test_road_map_threshold(edges, heat):
    busy = questions.road_map(edges, heat, Filter(road_threshold=6))
    line = one(busy, "lines")
    assert (line.passes, line.raw_segments) == (7, 1)
    assert busy["heat"].count() == 0
    hidden = questions.road_map(edges, heat, Filter(road_threshold=8))
    assert hidden["lines"].count() == 0 and hidden["heat"].count() == 0


def test_road_map_refuses_filters_without_a_table(edges, heat):
    parts = questions.road_map(edges, heat, Filter(vehicle_codes=("W1",)))
    assert parts["lines"].count() == 0


@pytest.mark.parametrize(
    ("flt", "names"),
    [
        (ChargerFilter(min_power_kw=150, access=("Publiek",)), ["Publieke HPC"]),
        (ChargerFilter(350, 4, access=("Publiek", "Privaat")), ["Dedicated Depot", "Publieke HPC"]),
        (ChargerFilter(350, 8, access=("Publiek", "Privaat")), ["Publieke HPC"]),
        (ChargerFilter(400, only_dedicated=True, access=("Privaat",)), ["Dedicated Depot"]),
    ],
)
def test_chargers(chargers, flt, names):
    assert [r.name for r in questions.charger_map(chargers, flt)["chargers"].collect()] == names


def test_overnight_ranking(tables, chargers):
    depot = one(questions.overnight_ranking(tables, chargers, min_vehicles=1, scenario=SCENARIO), "locations")
    assert (depot.depot_id, depot.unique_vehicles, depot.p95_day_km) == (DEPOT, 1, 180.0)
    assert depot.total_mwh == depot.shortage_mwh == 0.2
    half = [sin(radians(d) / 2) ** 2 for d in (0.1, 0.1)]
    km = 2 * 6371 * asin(sqrt(half[0] + cos(radians(52.0)) * cos(radians(52.1)) * half[1]))
    assert depot.nearest_charger_km == round(km, 1)
    alone = one(questions.overnight_ranking(tables, None, min_vehicles=1), "locations")
    assert alone.nearest_charger_km == -1.0
    assert questions.overnight_ranking(tables, chargers)["locations"].count() == 0


def test_depot_selection(tables):
    parts = questions.depot_selection(tables, DEPOT, scenario=SCENARIO)
    summary = one(parts, "summary")
    assert summary.trips == 1 and summary.recommendation == "Publieke laadvraag: 0.2 MWh in dit scenario."
    assert one(parts, "distances").p95 == 180.0
    assert parts["heat"].count() > 0
    window = one(parts, "busy_windows")
    assert window.time_slot == "18:00" and window.demand_kwh == window.shortage_kwh == 200.0
    hours = parts["hourly"].collect()
    assert len(hours) == 24
    assert (hours[18].vehicles, hours[18].required_kw) == (1, 17.0)
    week = {(r.day_label, r.hour): r for r in parts["weekly"].collect()}
    assert len(week) == 168
    cell = week["Donderdag", 18]
    assert (cell.vehicles, cell.required_kw, cell.codes, cell.plates) == (1, 17.0, ["W1"], [])
    assert week["Zondag", 3].vehicles == 0 and week["Zondag", 3].required_kw == 0
    slot = next(r for r in parts["slot_vehicles"].collect() if r.slot == datetime(2026, 1, 1, 18))
    assert (slot.vehicle_code, slot.plate, slot.required_kw, slot.demand_kwh) == ("W1", "-", 17.0, 200.0)
    assert (slot.standing_hours, slot.window) == (12.0, "18:00-06:00")
    vehicle = one(parts, "vehicles")
    assert (vehicle.days, vehicle.avg_day_km, vehicle.avg_kwh_per_day) == (1, 180.0, 180.0)
    assert (vehicle.avg_standing_hours, vehicle.required_kw) == (12.0, 17.0)


def test_empty_depot_selection(tables):
    parts = questions.depot_selection(tables, "nowhere")
    assert one(parts, "summary").recommendation == "Geen laadvraag in deze selectie."
    assert one(parts, "distances").n == 0
    assert one(parts, "totals").required_plugs_at_peak == 0
    assert len(parts["weekly"].collect()) == 168 and parts["distribution"].count() == 0


def test_stop_selection(tables):
    parts = questions.stop_selection(tables, 52.0, 5.0, 0.5, scenario=SCENARIO)
    assert one(parts, "summary").trips == 1
    assert one(parts, "distances").p95 == 180.0
    assert (52.2, 5.2) in {(r.lat, r.lon) for r in parts["heat"].collect()}
    hour = parts["hourly"].collect()[18]
    assert (hour.vehicles, hour.required_kw) == (1, 17.0)


def test_road_selection(tables):
    parts = questions.charging_scenario(tables, "road", road=FAR_ROAD, scenario=Scenario(kwh_per_km=1.0))
    summary = one(parts, "summary")
    assert summary.trips == 2 and "corridor" in summary.recommendation
    assert one(parts, "distances").p95 >= 120
    daily = one(parts, "daily_distances")
    assert (daily.n, daily.p95) == (1, 280.0)
    buckets = parts["daily_distribution"].collect()
    assert len(buckets) == 15
    assert (buckets[0].from_km, buckets[0].to_km, buckets[-1].from_km, buckets[-1].to_km) == (0, 50, 700, 750)
    assert [(b.from_km, b.to_km, b.trips) for b in buckets if b.trips] == [(250, 300, 1)]
    vehicle = one(parts, "vehicles")
    assert (vehicle.codes, vehicle.passages) == ("W2", 2)
    assert parts["heat"].count() > 0


def test_break_demand(tables):
    one_km = Breaks(kwh_per_km=1.0, top_percent=100, min_visits=3)
    parts = questions.break_demand_map(tables, one_km)
    lines = parts["lines"].collect()
    assert any(line.passages > 0 and line.total_kwh > 0 and line.peak_mw > 0 for line in lines)
    top = questions.break_demand_map(tables, Breaks(kwh_per_km=1.0, top_percent=1, min_visits=3))["lines"].collect()
    assert 0 < len(top) < len(lines)
    assert {line.passages for line in top} == {max(line.passages for line in lines)}
    assert sum(r.n for r in parts["diagnostics"].collect() if r.reason != "reset") == 9
    assert questions.break_demand_map(tables, Breaks(top_percent=0))["lines"].count() == 0


def test_break_demand_is_capped_by_the_battery(tables):
    breaks = Breaks(kwh_per_km=10.0, capacity_kwh=200, target_soc_pct=80)
    rows = questions.break_demand_detail(tables, FAR_ROAD, breaks)["vehicles"].collect()
    assert rows and all(r.demand_kwh <= 160 and r.required_kw <= 213.4 for r in rows)


def test_break_hours_cover_the_day(tables):
    parts = questions.break_demand_detail(tables, FAR_ROAD, Breaks(kwh_per_km=1.0))
    hours = parts["hours"].collect()
    assert [r.hour for r in hours] == list(range(24))
    assert any(r.required_kw > 0 and r.vehicles > 0 and r.demand_kwh > 0 for r in hours)
    assert one(parts, "totals").peak_mw == max(r.required_mw for r in hours)


def test_shift_resets_only_at_reset_locations(tables):
    near = questions.break_demand_detail(tables, Road(52.0, 5.0, 52.02, 5.02, 3), Breaks(kwh_per_km=1.0, min_visits=3))
    rows = near["vehicles"].collect()
    assert [r.vehicle_code for r in rows].count("W3") == 1
    assert all(3.5 <= r.drive_hours <= 4.5 for r in rows)
    customer = questions.break_demand_detail(tables, Road(52.6, 5.6, 53.0, 6.0, 5), Breaks(kwh_per_km=1.0, min_visits=3))
    assert any(r.vehicle_code == "W4" and 130 < r.km_since_shift_start <= 270 for r in customer["vehicles"].collect())


def test_power_questions_run_on_prepared_stops(tables):
    parts = questions.power_diagnostics(tables)
    assert one(parts, "totals").total == 0
    assert questions.power_profiles(tables)["locations"].count() == 0


def test_stored_tables_open_again(spark, tables):
    folder = new_folder(spark, "again")
    stops = tables.stops.drop("ze_zone", "ze_start_date", "in_zez")
    build_from_stops(stops, folder)
    again = open_tables(spark, folder)
    assert again.daily_trips.count() == 9
    assert one(questions.summary(again, Filter(ze_mode="in")), "summary").stops == 0


def test_simplify_polyline(spark):
    sizes = (2, 80, 81, 157, 400)
    rows = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, points array<int>")
    thin = {r.n: r.t for r in rows.select("n", roads.simplify_polyline("points").alias("t")).collect()}
    assert thin[2] == [0, 1] and thin[80] == list(range(80))
    for n in (81, 157, 400):
        step = -(-n // 78)
        assert thin[n] == [0, *range(step, n - 1, step), n - 1]
