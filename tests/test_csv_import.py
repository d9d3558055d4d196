"""Raw trip files through the whole ingest."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from fixture_data import (
    DUTCH_PLACES,
    DUTCH_TRIPS,
    FOCUS,
    GENERIC_LINES,
    POWER_ACTIONS,
    POWER_PLACES,
    TRIP_HEADER,
    csv_text,
)
from pyspark.sql import functions as F

from dwellgrid.operators import fleet, ingest
from dwellgrid.params import Filter, Power, Scenario
from dwellgrid.plans import questions
from dwellgrid.plans.tables import build_from_csv
from dwellgrid.session import new_folder
from dwellgrid.sources import readers, writers


def places(spark, rows):
    return spark.createDataFrame(rows, "query string, lat double, lon double")


@pytest.fixture(scope="module")
def dutch(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dutch") / "trips.csv"
    path.write_text(csv_text(TRIP_HEADER, DUTCH_TRIPS))
    raw = readers.scan_trip_csv(spark, [str(path)])
    return build_from_csv(raw, new_folder(spark, "dutch"), places(spark, DUTCH_PLACES))


@pytest.fixture(scope="module")
def power(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("power") / "trips.csv"
    path.write_text(csv_text(TRIP_HEADER, POWER_ACTIONS))
    raw = readers.scan_trip_csv(spark, [str(path)])
    return build_from_csv(raw, new_folder(spark, "power"), places(spark, POWER_PLACES))


def test_dutch_headers(dutch):
    totals = questions.metadata(dutch)["totals"].first()
    assert (totals.stop_count, totals.min_date, totals.max_date) == (5, date(2026, 1, 1), date(2026, 1, 2))
    own = questions.summary(dutch, Filter(carrier_types=("eigen",)))["summary"].first()
    assert (own.stops, own.trips, own.total_km) == (5, 2, 300.5)
    by_plate = questions.summary(dutch, Filter(vehicle_codes=("11BZX8",)))["summary"].first()
    assert (by_plate.stops, by_plate.total_km) == (5, 300.5)


def test_dutch_overnight(dutch):
    scenario = Scenario(kwh_per_km=1.0, capacity_kwh=200)
    depot = questions.overnight_ranking(dutch, None, min_vehicles=1, scenario=scenario)["locations"].first()
    assert (depot.depot_id, depot.p95_day_km) == ("auto:52.000:5.000", 180.0)
    detail = questions.depot_selection(dutch, depot.depot_id)
    assert [r.plates for r in detail["vehicles"].collect()] == ["11-BZX-8"]


def test_english_headers_with_coordinates(spark, tmp_path):
    (tmp_path / "routes.csv").write_text("\n".join(GENERIC_LINES) + "\n")
    raw = readers.scan_trip_csv(spark, [str(tmp_path / "routes.csv")])
    tables = build_from_csv(raw, new_folder(spark, "generic"))
    totals = questions.metadata(tables)["totals"].first()
    assert (totals.stop_count, totals.min_date) == (2, date(2026, 2, 1))
    summary = questions.summary(tables)["summary"].first()
    assert (summary.trips, summary.total_km) == (1, 42.0)
    actions = tables.route_actions.orderBy("action_seq").collect()
    assert [(a.vehicle_class, a.plate, a.plate_norm) for a in actions] == [("own", "AB-12-CD", "AB12CD")] * 2


def test_files_are_joined_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wagencode,trip_id\nW1,T1\n")
    (tmp_path / "b.csv").write_text("trip_id,adres\nT2,\n")
    raw = readers.scan_trip_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    rows = {(r.wagencode, r.trip_id, r.adres, r.filename.rsplit("/")[-1]) for r in raw.collect()}
    assert rows == {("W1", "T1", None, "a.csv"), (None, "T2", None, "b.csv")}


def test_one_folder_has_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wagencode,trip_id\nW1,T1\n")
    (tmp_path / "b.csv").write_text("trip_id,wagencode\nT2,W2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.scan_trip_csv(spark, [str(tmp_path)]).collect()


def test_coordinates_or_a_lookup_are_needed(spark):
    raw = spark.createDataFrame([("W1", "T1", "2026-01-01")], "wagencode string, trip_id string, trip_date string")
    with pytest.raises(ValueError, match="geocode"):
        ingest.build_stops(raw)


def test_presence_and_merge(power):
    own = questions.power_profiles(
        power, Filter(date_from=date(2026, 1, 1), date_to=date(2026, 1, 2)), Power(vehicle_classes=("own",))
    )
    place = own["locations"].collect()
    assert len(place) == 1
    assert FOCUS in place[0].address
    assert (place[0].peak_kw, place[0].own, place[0].charter) == (182.0, 1, 0)
    hours = {r.hour: r for r in own["hourly"].collect()}
    assert len(hours) == 24
    assert {h for h, r in hours.items() if r.required_kw == 182.0 and r.vehicles == 1} == {22, 23, 0, 1}
    assert any(r.hour == 23 and r.required_kw == 182.0 for r in own["heatmap"].collect())


def test_power_location(power):
    place = "auto:52.030:5.080"
    parts = questions.power_location(power, place, power=Power(vehicle_classes=("own",), scenario_years=(2027, 2030)))
    slot = next(r for r in parts["slot_vehicles"].collect() if r.slot == datetime(2026, 1, 1, 23))
    assert (slot.vehicle_code, slot.plate, slot["class"]) == ("001", "11-BZX-8", "own")
    assert (slot.demand_kwh, slot.required_kw, slot.standing_hours) == (590.0, 182.0, 3.25)
    assert parts["hourly"].where("hour = 23").first().date == date(2026, 1, 1)
    assert parts["daily"].count() == parts["top_days"].count() == 1
    scenarios = parts["scenarios"].collect()
    assert [r.year for r in scenarios] == [2027] * 24 + [2030] * 24 and {r.mode for r in scenarios} == {"linear"}


@pytest.mark.parametrize(("limit", "peak"), [(400, 400.0), (1500, 787.0)])
def test_vehicle_limits_cap_power(power, limit, peak):
    parts = questions.power_profiles(power, power=Power(vehicle_classes=("charter",), max_vehicle_kw=limit))
    assert [(r.address, r.peak_kw) for r in parts["locations"].collect()] == [("Depot B", peak)]


def test_power_diagnostics(power):
    parts = questions.power_diagnostics(power)
    assert parts["routes_without_wait"].first().n == 1
    assert {r["class"]: (r.vehicles, r.events) for r in parts["classes"].collect()} == {"own": (2, 4), "charter": (1, 1)}


def test_focus_report(spark, power, tmp_path):
    chosen = writers.export_focus_report(power.route_actions, f"{tmp_path}/report", ["Verzonnenweg"], "-").first()
    assert chosen.is_focus and chosen.address == FOCUS
    hourly = spark.read.option("header", True).csv(f"{tmp_path}/report/hourly_profile")
    assert hourly.columns == writers.HOURLY_COLUMNS and hourly.count() == 24
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/scenarios").count() == 48
    assert spark.read.parquet(f"{tmp_path}/report/heatmap_parquet").count() == 24


def test_focus_is_found_below_the_top_and_the_heatmap_is_whole(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(f"W{i}", f"T{i}", "pause", at, datetime(2026, 1, 1 + i // 20, 2 + i % 20), f"p{i:02}", f"Straat {i:02}") for i in range(60)]
    columns = "vehicle_code string, trip_id string, action string, planned_start timestamp_ntz, planned_end timestamp_ntz, location_id string, address string"
    texts = {c: F.lit("") for c in ("plate", "plate_norm", "location_name", "vehicle_type")}
    numbers = {c: F.lit(1.0) for c in ("trip_km", "segment_km", "dwell_min", "lat", "lon")}
    fixed = {"vehicle_class": F.lit("own"), "trip_date": F.to_date("planned_start"), "action_seq": F.lit(0)}
    actions = spark.createDataFrame(rows, columns).withColumns({**texts, **numbers, **fixed})
    chosen = writers.export_focus_report(actions, f"{tmp_path}/report", ["straat 59"], "-").first()
    assert (chosen.is_focus, chosen.location_id) == (True, "p59")
    cells = spark.read.parquet(f"{tmp_path}/report/heatmap_parquet")
    assert cells.count() == 60 * 24 == spark.read.option("header", True).csv(f"{tmp_path}/report/heatmap_csv").count()
    power = Power(vehicle_classes=("own",), top_locations=7)
    chosen = writers.export_focus_report(actions, f"{tmp_path}/short", ["straat 59"], "-", power=power).first()
    assert (chosen.is_focus, chosen.location_id) == (True, "p59")
    assert spark.read.parquet(f"{tmp_path}/short/heatmap_parquet").count() == 7 * 24


def test_unknown_addresses_stay_in_actions_only(spark):
    rows = [("W1", "T1", "travel", "01-01-2026 08:00", "Nergens 1"), ("W1", "T1", "Administrative", "x", "Nergens 1")]
    columns = ["Wagen Code", "Tripnummer", "Actie soort", "Gepland vanaf (Trip actie)", "Adres"]
    raw = spark.createDataFrame(rows, columns)
    lookup = places(spark, [("Elders", 52.0, 5.0)])
    actions = ingest.build_route_actions(raw, lookup).collect()
    assert [a.location_id for a in actions] == ["unknown_location:Nergens 1"]
    assert actions[0].planned_start == actions[0].planned_end == datetime(2026, 1, 1, 8)
    assert ingest.build_stops(raw, lookup).count() == 0


def test_zone_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("PC6,ze_zone,in_zero_emissie_zone\n1234 ab,B,ja\n1234AB,A,Ja\n9999ZZ,C,nee\n,D,ja\n")
    zones = readers.scan_ze_zones(spark, str(tmp_path / "z.csv"))
    assert sorted((r.pc6, r.ze_zone) for r in zones.collect()) == [("1234AB", "A"), ("1234AB", "B")]
    assert [tuple(r) for r in ingest.dedupe_ze_zones(zones).collect()] == [("1234AB", "A", "")]


def test_charter_bases(spark, tmp_path, dutch):
    base = '"Teststraat 1","Utrecht","Nederland"'
    (tmp_path / "v.csv").write_text(
        "Voertuig: Wagencode,Type voertuig,Brandstoftype,Inzet type,Standplaats: Adres,Standplaats: Plaats,Standplaats: Land\n"
        f"CHAR01,Trekker + Oplegger,Diesel,Vast,{base}\nCHAR02,Bakwagen,Diesel,Flex,{base}\n"
    )
    (tmp_path / "d.csv").write_text(f"Standplaats: Adres,Standplaats: Plaats,Standplaats: Land,Aantal wagens\n{base},2\n")
    vehicles = readers.scan_charter_vehicles(spark, str(tmp_path / "v.csv"))
    depots = readers.scan_charter_depots(spark, str(tmp_path / "d.csv"))
    lookup = places(spark, [("teststraat 1, utrecht, nederland", 52.09, 5.12)])
    parts = questions.charter_bases(dutch, depots, vehicles, lookup)
    depot = parts["depots"].first()
    assert (depot.depot_id, depot.vehicles) == ("charter-fleet:Teststraat 1, Utrecht, Nederland", 2)
    assert (depot.lat, depot.lon, depot.matched_in_trips) == (52.09, 5.12, 0)
    assert {(r.fleet_no, r.location_type) for r in parts["vehicles"].collect()} == {("CHAR01", "Vast"), ("CHAR02", "Flex")}


def test_fleet_bases_need_coordinates(spark, tmp_path, dutch):
    (tmp_path / "d.csv").write_text("Opstapplaats,Type locatie\nScB Stad,Brieven\nscb stad,Brieven\nTotaal,\n")
    (tmp_path / "v.csv").write_text(
        "Vlootnummer,Kenteken,Regio,Opstapplaats,Type locatie,Merk,Soort voertuig,Soort brandstof\n"
        "001,TEST-01,Noord,ScB Stad,Brieven,Merk,Trekker,Elektrisch\n"
    )
    depots = readers.scan_fleet_depots(spark, str(tmp_path / "d.csv"))
    vehicles = readers.scan_fleet_vehicles(spark, str(tmp_path / "v.csv"))
    assert vehicles.first().plate_norm == "TEST01"
    without = questions.fleet_bases(dutch, depots, vehicles, places(spark, [("elders", 1.0, 1.0)]))
    assert without["depots"].count() == 0
    found = questions.fleet_bases(dutch, depots, vehicles, places(spark, [("SCB STAD", 52.0, 5.0)]))
    depot = found["depots"].first()
    assert (depot.vehicles, depot.matched_in_trips) == (1, 1)
    vehicle = found["vehicles"].first()
    assert (vehicle.trips_in_data, vehicle.km_in_data) == (2, 300.5)
    assert fleet.fleet_trip_stats(dutch.stops).where(F.col("code") == "001").count() == 1
