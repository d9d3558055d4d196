"""Every operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acceptance.dataset import Dataset, dataset
from dwellgrid.functions import clock, geo, text
from dwellgrid.operators import aggregates, demand, fleet, ingest, nearest, overview, roads, tables
from dwellgrid.operators import breaks as brk
from dwellgrid.operators import filters as flt
from dwellgrid.operators import power as pwr
from dwellgrid.params import Breaks, ChargerFilter, Filter, Power, Road, Scenario
from dwellgrid.plans import questions
from dwellgrid.session import materialize, new_folder
from dwellgrid.sources import writers

ROAD = Road(52.1, 5.0, 52.2, 5.1, 5.0)
NEAR_ROAD = Road(52.1, 5.0, 52.2, 5.1, 3.0)
DEPOT = "auto:52.000:5.000"
SOME = Filter(
    date_from=date(2024, 1, 5), date_to=date(2024, 1, 20), carrier_types=("eigen", "charter"), min_dwell_min=15.0
)
IN_ZONE, OUT_OF_ZONE = Filter(ze_mode="in"), Filter(ze_mode="out")
VEHICLES = ("W1", "nl 7 x", "NL-11-X", "W30")
TRIP = ["vehicle_code", "trip_date", "trip_id"]
EVERY_LOCATION = Power(top_locations=None)
CHERRY_PICK = Power(scenario_mode="cherry-pick", scenario_years=(2026, 2027, 2030, 2035))

Query = Callable[[Dataset], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def six(*names: str) -> list[Column]:
    """Columns that two engines compute a last digit apart."""
    return [F.round(F.col(name), 6).alias(name) for name in names]


def blank(df: DataFrame, *names: str) -> DataFrame:
    return df.select([F.coalesce(text.quoted(name), F.lit("")).alias(name) for name in names])


# --- sources -----------------------------------------------------------------------------------


@query
def scan_trip_csv(d):
    address = F.coalesce("Adres", "stop_address", F.lit("")).alias("address")
    names = {
        "Wagen Code": "vehicle_code", "Tripnummer": "trip_id", "Voertuig Type Eigenaar": "carrier",
        "Actie soort": "action", "Gepland vanaf (Trip actie)": "starts", "Gepland tot (Trip actie)": "ends",
        "Gerealizeerd Kenteken": "plate", "Totale Afstand (KM)": "trip_km", "afstand_km": "segment_km",
    }
    return d.raw.select([F.coalesce(text.quoted(k), F.lit("")).alias(v) for k, v in names.items()] + [address])


@query
def scan_stops_parquet(d):
    dutch = {v: k for k, v in ingest.STOP_COLUMNS.items()}
    bare = d.tables.stops.drop("plate", "plate_norm", "vehicle_type", "pc6", "ze_zone", "ze_start_date", "in_zez")
    path = new_folder(d.spark, "stops-parquet")
    bare.withColumnsRenamed({k: v for k, v in dutch.items() if k in bare.columns}).write.parquet(path)
    from dwellgrid.sources.readers import scan_stops_parquet as scan

    return scan(d.spark, path).select(
        *TRIP, "stop_seq", "action", "location_name", "address", "planned_start", "planned_end", "segment_km",
        "trip_km", "dwell_min", "lat", "lon", "plate", "plate_norm", "vehicle_type", "pc6",
    )


@query
def scan_road_variants(d):
    return d.edges


@query
def scan_road_heat(d):
    return d.heat.select("variant", "lat", *six("lon"), "weight")


@query
def scan_chargers(d):
    return d.chargers


@query
def scan_geocode(d):
    typed = ingest.geocode_join(ingest.resolve_columns(d.raw), d.geocode)
    return typed.groupBy("address", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_ze_zones(d):
    seen = d.tables.stops.groupBy("pc6").agg(F.count(F.lit(1)).alias("n"))
    return d.zones.join(seen, "pc6")


@query
def scan_fleet_tables(d):
    return d.fleet_vehicles


@query
def scan_fleet_depots(d):
    return d.fleet_depots


# --- ingest ------------------------------------------------------------------------------------


@query
def resolve_columns(d):
    return ingest.resolve_columns(d.raw)


@query
def parse_timestamp(d):
    """Each event's time in every accepted layout, and in one that is not."""
    whole = F.date_trunc("second", "ts")
    layouts = [
        "d-M-yyyy H:mm:ss", "dd-MM-yyyy HH:mm", "d/M/yyyy H:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss",
        "yyyy-M-d H:mm", "d-M-yyyy", "d/M/yyyy", "yyyy-MM-dd", "yyyy.MM.dd",
    ]
    texts = F.array(*[F.struct(F.lit(i).alias("layout"), F.date_format(whole, p).alias("t")) for i, p in enumerate(layouts)])
    rows = d.table("events").select("event_id", F.explode(texts).alias("_x")).select("event_id", "_x.*")
    return rows.select("event_id", "layout", text.parse_timestamp(F.lit(""), F.concat(F.lit(" "), "t")).alias("parsed"))


@query
def parse_decimal(d):
    price = F.col("l_extendedprice")
    comma = F.translate(F.format_number(price, 2), ",.", ".,")
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        text.parse_decimal(comma).alias("from_comma"),
        text.parse_decimal(F.format_string(" %.2f ", price)).alias("from_dot"),
        text.parse_decimal(F.col("l_returnflag")).alias("from_text"),
    )


@query
def normalize_plate(d):
    typed = ingest.resolve_columns(d.raw)
    return typed.select("vehicle_code", text.normalize_plate(F.concat(F.lit(" "), F.lower("plate"))).alias("plate_norm")).distinct()


@query
def classify_carrier(d):
    typed = ingest.resolve_columns(d.raw)
    kind = text.classify_carrier("carrier_type_raw", "carrier")
    dutch = text.classify_carrier("location_name", "carrier", "eigen", "charter", "onbekend")
    return typed.groupBy("carrier", kind.alias("vehicle_class"), dutch.alias("carrier_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def travel_filter(d):
    return ingest.resolve_columns(ingest.travel_filter(d.raw)).select("vehicle_code", "trip_id", "action", "planned_start")


@query
def geocode_join(d):
    typed = ingest.geocode_join(ingest.resolve_columns(d.raw), d.geocode)
    return typed.select("vehicle_code", "trip_id", "planned_start", "address", "lat", "lon")


@query
def valid_row_filter(d):
    """Rows without a plate lose their vehicle first, so that there is something to drop."""
    typed = ingest.resolve_columns(d.raw).withColumn("vehicle_code", F.when(F.col("plate") != "", F.col("vehicle_code")).otherwise(""))
    return ingest.valid_row_filter(typed).select("vehicle_code", "trip_id", "planned_start", "action")


@query
def sequence_actions(d):
    rows = ingest.sequence_actions(ingest.resolve_columns(d.raw))
    return rows.select(*TRIP, "action_seq", "action", "address", "planned_start")


@query
def location_id(d):
    a = d.tables.route_actions
    return a.groupBy(geo.location_id("lat", "lon", "address").alias("location_id")).agg(F.count(F.lit(1)).alias("n"))


@query
def dwell_minutes(d):
    a = d.tables.route_actions
    return a.select(
        *TRIP, "action_seq",
        clock.dwell_minutes("planned_start", "planned_end").alias("dwell_min"),
        clock.dwell_minutes("planned_end", "planned_start").alias("backwards"),
        clock.dwell_minutes("planned_start", F.lit(None).cast("timestamp_ntz")).alias("open"),
    )


@query
def build_route_actions(d):
    return d.tables.route_actions


@query
def build_stops(d):
    return d.tables.stops.drop("ze_zone", "ze_start_date", "in_zez")


@query
def route_actions_from_stops(d):
    return ingest.route_actions_from_stops(d.tables.stops)


@query
def extract_pc6(d):
    a = d.tables.route_actions
    return a.select("address", text.extract_pc6("address").alias("pc6")).distinct()


@query
def dedupe_ze_zones(d):
    """Every stop claims a zone for its postcode, named after its date."""
    claims = d.tables.stops.select(
        F.lower("pc6").alias("pc6"),
        F.concat(F.lit("Zone "), F.col("trip_date").cast("string")).alias("ze_zone"),
        F.col("trip_id").alias("ze_start_date"),
    )
    return ingest.dedupe_ze_zones(claims)


@query
def enrich_ze_zone(d):
    return d.tables.stops.select(*TRIP, "stop_seq", "pc6", "ze_zone", "ze_start_date", "in_zez")


@query
def backfill_columns(d):
    bare = d.tables.stops.drop("plate", "trip_km", "in_zez")
    defaults = {"plate": F.lit(""), "trip_km": F.lit(0.0), "in_zez": F.lit(False), "lat": F.lit(0.0)}
    return ingest.backfill_columns(bare, defaults).select(*TRIP, "stop_seq", "plate", "trip_km", "in_zez", "lat")


# --- derived tables ------------------------------------------------------------------------------


@query
def daily_trips(d):
    return tables.daily_trips(d.tables.stops)


@query
def vehicle_days(d):
    return tables.vehicle_days(d.tables.daily_trips)


@query
def overnight_candidates(d):
    found = tables.overnight_candidates(d.tables.vehicle_days)
    return found.select(*[c for c in found.columns if c not in ("gap_hours", "end_start_km")], *six("gap_hours", "end_start_km"))


@query
def overnight_home_location(d):
    home = tables.overnight_home_location(tables.overnight_candidates(d.tables.vehicle_days))
    return home.select("vehicle_key", "depot_id", "events", "last_seen", *six("median_gap_hours"), "rn")


@query
def overnight_events(d):
    o = d.tables.overnight_events
    return o.select("vehicle_code", "trip_date", "vehicle_key", "depot_id", "prev_end_time", "day_start", "day_km", *six("gap_hours"))


@query
def overnight_locations(d):
    found = d.tables.overnight_locations
    return found.select(
        "depot_id", *six("lat", "lon"), "address", "events", "unique_vehicles",
        *six("median_gap_hours", "p95_day_km", "total_day_km", "confidence"),
    )


@query
def road_selection_index(d):
    found = tables.road_selection_index(d.tables.daily_trips)
    return found.select(*TRIP, "start_lat", "start_lon", "end_lat", "end_lon", *six("mid_lat", "mid_lon"), "distance_km")


@query
def first_last_stop(d):
    return tables.first_last_stop(d.tables.stops)


@query
def previous_day_end(d):
    found = tables.previous_day_end(d.tables.vehicle_days)
    return found.select("vehicle_code", "trip_date", "prev_end_time", "prev_end_lat", "prev_end_lon", "prev_end_address")


# --- filters -----------------------------------------------------------------------------------


@query
def filter_stops(d):
    kept = flt.filter_stops(d.tables.stops, Filter(**{**SOME.__dict__, "ze_mode": "in"}))
    return kept.select(*TRIP, "stop_seq", "carrier_type", "dwell_min", "ze_zone")


@query
def filter_date_range(d):
    return flt.filter_date_range(d.tables.daily_trips, SOME).select(*TRIP, "distance_km")


@query
def filter_in_list(d):
    return flt.filter_in_list(d.tables.daily_trips, "carrier", ("Overig", "Eigen Vervoer")).select(*TRIP, "carrier")


@query
def filter_vehicle(d):
    return flt.filter_vehicle(d.tables.daily_trips, VEHICLES).select(*TRIP, "plate")


@query
def filter_ze_stops(d):
    return flt.filter_ze_stops(d.tables.stops, "out").select(*TRIP, "stop_seq", "pc6")


@query
def filter_ze_trips(d):
    inside = flt.filter_ze_trips(d.tables.daily_trips, d.tables.stops, "in", flt.TRIP_KEY)
    outside = flt.filter_ze_trips(d.tables.daily_trips, d.tables.stops, "out", flt.TRIP_KEY)
    return inside.select(*TRIP, F.lit("in").alias("mode")).unionByName(outside.select(*TRIP, F.lit("out").alias("mode")))


@query
def filter_daily_trips(d):
    kept = flt.filter_daily_trips(d.tables.daily_trips, d.tables.stops, Filter(**{**SOME.__dict__, "ze_mode": "out"}))
    return kept.select(*TRIP, "distance_km")


@query
def filter_overnight(d):
    kept = flt.filter_overnight(d.tables.overnight_events, d.tables.stops, Filter(**{**SOME.__dict__, "ze_mode": "in"}))
    return kept.select("vehicle_code", "trip_date", "depot_id", "day_km")


@query
def filter_within_radius(d):
    kept = flt.filter_within_radius(d.tables.overnight_events, 52.201, 5.102, 1.0, SOME)
    return kept.select("vehicle_code", "trip_date", "depot_id", "day_km")


@query
def filter_road_selection(d):
    return flt.filter_road_selection(d.tables.road_selection_index, ROAD, SOME).select(*TRIP, "distance_km")


@query
def filter_power_actions(d):
    kept = flt.filter_power_actions(d.tables.route_actions, SOME, only_charge_windows=True)
    return kept.select(*TRIP, "action_seq", "action", "vehicle_class")


@query
def filter_chargers(d):
    return flt.filter_chargers(d.chargers, ChargerFilter(min_power_kw=200, min_connectors=3, only_dedicated=True)).select("id", "name")


@query
def filter_near_segment(d):
    near = flt.filter_near_segment(_break_events(d), NEAR_ROAD)
    return near.select("vehicle_code", "break_start", *six("break_lat", "break_lon"))


@query
def road_variant_choice(d):
    """Edges per variant that answers a filter; the narrower filter has none."""
    low, high = date(2024, 1, 1), date(2024, 1, 31)
    asked = {
        "all": Filter(), "own": Filter(carrier_types=("eigen",)), "charter": Filter(carrier_types=("charter",)),
        "both": Filter(carrier_types=("charter", "eigen")), "later": Filter(date_from=date(2024, 1, 2)),
        "long": Filter(min_dwell_min=5),
    }
    parts = [flt.road_variant(d.edges, f, low, high).withColumn("asked", F.lit(name)) for name, f in asked.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.groupBy("asked", "variant").agg(F.count(F.lit(1)).alias("edges"))


# --- totals and rankings -------------------------------------------------------------------------


@query
def metadata(d):
    return overview.metadata(d.tables.stops)


@query
def metadata_values(d):
    return overview.metadata_values(d.tables.stops)


@query
def summary(d):
    return overview.summary(d.tables.stops, d.tables.daily_trips, SOME)


@query
def stop_heat(d):
    return overview.stop_heat(d.tables.stops)


@query
def stop_markers(d):
    return overview.stop_markers(d.tables.stops, SOME)


@query
def top_stops(d):
    return overview.top_stops(d.tables.stops)


@query
def ze_zone_summary(d):
    return overview.ze_zone_summary(d.tables.stops)


@query
def chargers_ranked(d):
    return overview.chargers_ranked(d.chargers, ChargerFilter(min_power_kw=100))


@query
def nearest_charger(d):
    """Every distinct place on the roads to its nearest public charger."""
    edges = d.edges.select("lat1", "lon1").distinct()
    places = edges.select(
        F.format_string("%.2f:%.2f", "lat1", "lon1").alias("depot_id"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")
    )
    return nearest.nearest_charger(places, d.chargers).select("depot_id", *six("nearest_charger_km"))


@query
def overnight_location_ranking(d):
    return demand.overnight_location_ranking(d.tables.overnight_events, d.tables.stops, d.chargers, min_vehicles=1)


@query
def selected_day_heat(d):
    chosen = d.tables.overnight_events.where(F.col("depot_id") == DEPOT)
    return demand.selected_day_heat(d.tables.stops, chosen)


@query
def selected_trip_heat(d):
    chosen = flt.filter_road_selection(d.tables.road_selection_index, ROAD, Filter())
    return demand.selected_trip_heat(d.tables.stops, chosen)


@query
def daily_distance_of_selection(d):
    chosen = flt.filter_road_selection(d.tables.road_selection_index, ROAD, Filter())
    return demand.daily_distance_of_selection(d.tables.vehicle_days, chosen)


def _events(d: Dataset) -> DataFrame:
    return demand.overnight_demand_events(d.tables.overnight_events)


def _road_events(d: Dataset) -> DataFrame:
    return demand.road_demand_events(flt.filter_road_selection(d.tables.road_selection_index, ROAD, Filter()))


@query
def distance_statistics(d):
    return demand.distance_statistics(_events(d))


@query
def distance_distribution(d):
    return demand.distance_distribution(d.tables.daily_trips)


@query
def fixed_distance_distribution(d):
    return demand.fixed_distance_distribution(d.tables.vehicle_days)


@query
def selection_vehicles(d):
    return demand.selection_vehicles(_events(d))


@query
def selection_vehicles_road(d):
    return demand.selection_vehicles(_road_events(d), is_road=True)


@query
def selection_summary(d):
    return demand.selection_summary(_events(d))


@query
def busy_windows(d):
    return demand.busy_windows(_events(d))


@query
def charging_totals(d):
    return demand.charging_totals(_events(d))


@query
def required_kw(d):
    loads = demand.event_loads(_events(d)).select("vehicle_code", "trip_date", F.lit("depot").alias("kind"), *six("required_kw"))
    roads_kw = demand.event_loads(_road_events(d), is_road=True)
    return loads.unionByName(roads_kw.select("vehicle_code", "trip_date", F.lit("road").alias("kind"), *six("required_kw")))


@query
def hour_slots(d):
    slots = demand.hour_slots(_events(d))
    return slots.select("vehicle_code", "trip_date", "slot", *six("overlap_hours"))


@query
def hourly_demand_profile(d):
    return demand.hourly_demand_profile(_events(d))


@query
def weekly_demand_profile(d):
    weekly = demand.weekly_demand_profile(_events(d))
    return weekly.withColumns({"plates": F.array_join("plates", ","), "codes": F.array_join("codes", ",")})


@query
def slot_vehicle_demand(d):
    return demand.slot_vehicle_demand(_events(d))


@query
def peak_slot_vehicles(d):
    return demand.peak_slot_vehicles(_events(d))


# --- selections ----------------------------------------------------------------------------------


def _together(parts: dict[str, DataFrame]) -> DataFrame:
    """Summary, totals and spread of a selection in one row."""
    totals = parts["totals"].select(F.struct("events", "shortage_mwh", "peak_mw", "required_plugs_at_peak").alias("_t"))
    spread = parts["daily_distances"].select(F.struct("n", "avg_km", "stddev_km", "p50", "p75", "p90", "p95").alias("_d"))
    row = parts["summary"].withColumns({"_t": totals.scalar(), "_d": spread.scalar()})
    return row.select(
        "trips", "unique_vehicles", "total_km", "total_mwh", "avg_gap_hours", "_t.events", "_t.shortage_mwh",
        "_t.peak_mw", "_t.required_plugs_at_peak", F.col("_d.n").alias("days"), "_d.avg_km", "_d.stddev_km",
        "_d.p50", "_d.p75", "_d.p90", "_d.p95",
    )


@query
def depot_selection(d):
    return _together(questions.depot_selection(d.tables, DEPOT))


@query
def stop_selection(d):
    return _together(questions.stop_selection(d.tables, 52.101, 5.102, 1.0))


@query
def road_selection(d):
    return _together(questions.road_selection(d.tables, ROAD))


@query
def charging_scenario(d):
    road = _together(questions.charging_scenario(d.tables, "road", road=ROAD, scenario=Scenario(kwh_per_km=2.0)))
    depot = _together(questions.charging_scenario(d.tables, "depot", DEPOT, scenario=Scenario(capacity_kwh=1000.0)))
    return road.withColumn("kind", F.lit("road")).unionByName(depot.withColumn("kind", F.lit("depot")))


# --- power ---------------------------------------------------------------------------------------


def _windows(d: Dataset) -> DataFrame:
    return pwr.power_windows(d.tables.route_actions)


WINDOW = ["vehicle_code", "vehicle_key", "vehicle_class", "trip_date", "trip_id", "location_id", "location_name"]


@query
def presence_windows(d):
    found = pwr.presence_windows(d.tables.route_actions)
    return found.select(*WINDOW, "action_seq", "planned_start", "planned_end", *six("dwell_min", "distance_km"))


@query
def merge_presence_windows(d):
    return _windows(d).select(*WINDOW, "planned_start", "planned_end", *six("dwell_min"))


@query
def power_location_profile(d):
    return pwr.power_location_profile(_windows(d), EVERY_LOCATION)


@query
def power_daily_metrics(d):
    return pwr.power_daily_metrics(_windows(d))


@query
def top_power_days(d):
    return pwr.top_power_days(pwr.power_daily_metrics(_windows(d)))


@query
def hourly_power_profile(d):
    return pwr.hourly_power_profile(_windows(d))


@query
def power_heatmap(d):
    return pwr.power_heatmap(_windows(d))


@query
def power_slot_vehicles(d):
    return pwr.power_slot_vehicles(_windows(d))


@query
def scenario_profiles(d):
    return pwr.scenario_profiles(_windows(d), Power(scenario_years=(2026, 2027, 2031, 2040)))


@query
def scenario_profiles_cherry_pick(d):
    return pwr.scenario_profiles(_windows(d), CHERRY_PICK)


@query
def power_diagnostics(d):
    return pwr.power_diagnostics(d.tables.route_actions)


@query
def routes_without_wait(d):
    return pwr.routes_without_wait(d.tables.route_actions, SOME)


@query
def vehicle_class_counts(d):
    return pwr.vehicle_class_counts(d.tables.route_actions)


@query
def fleet_match_count(d):
    return pwr.fleet_match_count(d.tables.route_actions, d.fleet_vehicles)


# --- breaks --------------------------------------------------------------------------------------


def _break_trips(d: Dataset) -> DataFrame:
    return brk.break_trips(d.tables.daily_trips, d.tables.stops)


def _labelled(d: Dataset) -> DataFrame:
    return brk.break_trip_labels(_break_trips(d))


def _break_events(d: Dataset) -> DataFrame:
    return brk.break_events(_labelled(d))


@query
def break_trips(d):
    return _break_trips(d).select(*TRIP, "plates", "trip_start", "trip_end", "start_lat", "end_lat", "distance_km")


@query
def reset_locations(d):
    return brk.reset_locations(_break_trips(d)).select(*six("lat", "lon"))


@query
def shift_sessions(d):
    return brk.shift_sessions(_break_trips(d)).select(*TRIP, "shift_id", "shift_start", "is_reset")


@query
def shift_progress(d):
    return brk.shift_progress(brk.shift_sessions(_break_trips(d))).select(*TRIP, "plausible", *six("drive_before", "km_before"))


@query
def break_trip_labels(d):
    return _labelled(d).select(*TRIP, "reason")


@query
def break_events(d):
    return _break_events(d).select(
        "vehicle_code", "plate", "shift_start", "break_start", "drive_hours", "bearing_bucket", "direction",
        *six("km_since_shift_start", "demand_kwh", "required_kw", "break_lat", "break_lon"),
    )


@query
def break_diagnostics(d):
    return brk.break_diagnostics(_labelled(d))


@query
def quarter_slots(d):
    return brk.quarter_slots(_break_events(d)).select("vehicle_code", "break_start", "slot_start", *six("overlap_hours"))


@query
def break_quarter_profile(d):
    return brk.break_quarter_profile(_break_events(d))


@query
def break_hourly_profile(d):
    return brk.break_hourly_profile(_break_events(d))


@query
def break_demand_lines(d):
    return brk.break_demand_lines(materialize(_break_events(d), "breaks"), Breaks(top_percent=100))


@query
def break_demand_detail(d):
    return brk.break_demand_detail(materialize(_break_events(d), "breaks"), NEAR_ROAD)


@query
def break_vehicles(d):
    return brk.break_vehicles(_break_events(d), NEAR_ROAD).drop("route_quality")


# --- roads ---------------------------------------------------------------------------------------


def _full(d: Dataset) -> DataFrame:
    return d.edges.where(F.col("variant") == "full")


def _chains(d: Dataset) -> DataFrame:
    return roads.contract_road_chains(roads.enrich_road_edges(_full(d)))


@query
def top_road_edges(d):
    return roads.top_road_edges(_full(d))


@query
def road_heat(d):
    return roads.road_heat(d.heat.where(F.col("variant") == "full"), Filter(road_top_percent=5)).select("lat", *six("lon"), "weight")


@query
def enrich_road_edges(d):
    found = roads.enrich_road_edges(_full(d))
    return found.select("lat1", "lon1", "lat2", "lon2", "n_passes", "bucket", "start_key", "end_key", *six("bearing", "length_km"))


@query
def contract_road_chains(d):
    return _chains(d).select("lat1", "lon1", "lat2", "lon2", "bucket", "n_passes", "chain_id", "pos")


@query
def split_road_chains(d):
    return roads.split_road_chains(_chains(d)).select("lat1", "lon1", "lat2", "lon2", "chain_id", "pos", "segment_no")


@query
def road_lines(d):
    return roads.road_map(_full(d)).withColumn("coordinates", F.to_json("coordinates"))


@query
def simplify_polyline(d):
    """The straight line of every trip with a point per kilometre, thinned out."""
    thin = roads.simplify_polyline(F.sequence(F.lit(0), F.floor("distance_km").cast("int")))
    return _of_trips(d, points=F.array_join(F.transform(thin, lambda p: p.cast("string")), ","))


@query
def infer_road_name(d):
    return roads.infer_road_name(_full(d).select("lat1", "lon1", "lat2", "lon2"))


@query
def dashboard_roads(d):
    return roads.dashboard_roads(materialize(roads.road_map(_full(d)), "lines")).drop("coordinates")


@query
def corridors(d):
    return roads.corridors(materialize(roads.road_map(_full(d)), "lines"))


@query
def search_road_lines(d):
    lines = materialize(roads.road_map(_full(d)), "lines")
    return roads.search_road_lines(lines, "wegvlak", "length", descending=False).drop("coordinates")


@query
def snap_to_road(d):
    lines = brk.break_demand_lines(materialize(_break_events(d), "breaks"), Breaks(top_percent=100))
    return roads.snap_to_road(lines, materialize(roads.road_map(_full(d)), "lines")).withColumn("coordinates", F.to_json("coordinates"))


# --- fleet ---------------------------------------------------------------------------------------


@query
def fleet_trip_stats(d):
    return fleet.fleet_trip_stats(d.tables.stops)


@query
def fleet_depots(d):
    return fleet.fleet_depots(d.fleet_depots, d.fleet_vehicles, d.fleet_geocode, fleet.fleet_trip_stats(d.tables.stops))


@query
def fleet_depot_vehicles(d):
    return fleet.fleet_depot_vehicles(
        d.fleet_depots, d.fleet_vehicles, d.fleet_geocode, fleet.fleet_trip_stats(d.tables.stops)
    )


@query
def charter_fleet_depots(d):
    return fleet.charter_fleet_depots(
        d.charter_depots, d.charter_vehicles, d.charter_geocode, fleet.fleet_trip_stats(d.tables.stops)
    )


@query
def charter_fleet_depot_vehicles(d):
    return fleet.charter_fleet_depot_vehicles(
        d.charter_depots, d.charter_vehicles, d.charter_geocode, fleet.fleet_trip_stats(d.tables.stops)
    ).select("depot_id", "fleet_no", "region", "location_type", "kind", "fuel", "trips_in_data", "km_in_data")


# --- sinks ---------------------------------------------------------------------------------------


def _read_csv(d: Dataset, path: str, schema: str) -> DataFrame:
    return d.spark.read.option("header", True).schema(schema).csv(path)


@query
def sink_hourly_csv(d):
    windows, path = _windows(d), new_folder(d.spark, "hourly")
    names = pwr.power_location_profile(windows, EVERY_LOCATION).select("location_id", "name", "address")
    writers.sink_hourly_csv(pwr.hourly_power_profile(windows).join(names, "location_id"), path)
    return _read_csv(
        d, path, "location_id string, name string, address string, hour int, vehicles bigint, events bigint, "
        "required_kw double, required_mw double",
    )


@query
def sink_daily_csv(d):
    path = new_folder(d.spark, "daily")
    writers.sink_daily_csv(pwr.power_daily_metrics(_windows(d)), path)
    return _read_csv(
        d, path, "date date, unique_vehicles bigint, own_vehicles bigint, charter_vehicles bigint, trips bigint, "
        "events bigint, avg_dwell_min double, peak_kw double",
    )


@query
def sink_scenario_csv(d):
    path = new_folder(d.spark, "scenarios")
    writers.sink_scenario_csv(pwr.scenario_profiles(_windows(d)), path)
    return _read_csv(
        d, path, "year int, mode string, scale_factor double, hour int, vehicles bigint, events bigint, "
        "required_kw double, required_mw double",
    )


HEATMAP = "location_id string, location_name string, hour int, vehicles bigint, required_kw double, required_mw double"


@query
def sink_heatmap_csv(d):
    path = new_folder(d.spark, "heatmap")
    writers.sink_heatmap_csv(pwr.power_heatmap(_windows(d)), path)
    return _read_csv(d, path, HEATMAP)


@query
def sink_heatmap_parquet(d):
    path = new_folder(d.spark, "heatmap-parquet")
    writers.sink_heatmap_parquet(pwr.power_heatmap(_windows(d)), path)
    return d.spark.read.parquet(path)


@query
def export_focus_report(d):
    """The whole report for own vehicles; its hourly file is read back."""
    path = new_folder(d.spark, "report")
    writers.export_focus_report(d.tables.route_actions, path, words=("Adres 6 1006",), alias="-")
    return _read_csv(
        d, f"{path}/hourly_profile", "location_id string, name string, address string, hour int, vehicles bigint, "
        "events bigint, required_kw double, required_mw double",
    )


@query
def geojson_features(d):
    """Stop markers as features; coordinates and counts are read back from the text."""
    path = new_folder(d.spark, "features")
    writers.sink_geojson(overview.stop_markers(d.tables.stops), "stops", path)
    value = F.col("value")
    return d.spark.read.text(path).select(
        F.get_json_object(value, "$.type").alias("type"),
        F.get_json_object(value, "$.geometry.type").alias("shape"),
        F.get_json_object(value, "$.geometry.coordinates[0]").cast("double").alias("lon"),
        F.get_json_object(value, "$.geometry.coordinates[1]").cast("double").alias("lat"),
        F.get_json_object(value, "$.properties.weight").cast("bigint").alias("weight"),
        F.get_json_object(value, "$.properties.label").alias("label"),
        F.get_json_object(value, "$.properties.stops").cast("bigint").alias("stops"),
        F.get_json_object(value, "$.properties.trips").cast("bigint").alias("trips"),
    )


# --- scalars -------------------------------------------------------------------------------------

ENDS = ("start_lat", "start_lon", "end_lat", "end_lon")


def _of_trips(d: Dataset, **columns: Column) -> DataFrame:
    return d.tables.daily_trips.select(*TRIP, *[value.alias(name) for name, value in columns.items()])


@query
def haversine_km(d):
    return _of_trips(d, km=F.round(geo.haversine_km(*ENDS), 6))


@query
def bearing_degrees(d):
    return _of_trips(d, bearing=F.round(geo.bearing_degrees(*ENDS), 6))


@query
def direction_bucket(d):
    return _of_trips(d, bucket=geo.direction_bucket(F.round(geo.bearing_degrees(*ENDS), 6)))


@query
def compass_direction(d):
    return _of_trips(d, direction=geo.compass_direction(geo.direction_bucket(F.round(geo.bearing_degrees(*ENDS), 6))))


@query
def project_point(d):
    point = geo.project_point("start_lat", "start_lon", F.col("distance_km") % 360.0, 0.75)
    return _of_trips(d, lat=point["lat"], lon=point["lon"])


@query
def point_segment_km(d):
    return _of_trips(d, km=F.round(geo.point_segment_km(52.13, 5.07, *ENDS), 6))


@query
def interpolate(d):
    return _of_trips(d, lat=F.round(geo.interpolate("start_lat", "end_lat", F.col("distance_km") / 1000.0), 6))


@query
def coordinate_key(d):
    return _of_trips(d, key=geo.coordinate_key("start_lat", geo.interpolate("start_lon", "end_lon", 0.3)))


@query
def quantile_linear(d):
    points = {"p10": 0.10, "p50": 0.50, "p95": 0.95, "p100": 1.0}
    found = aggregates.quantiles(d.tables.daily_trips, ["carrier_type"], "distance_km", points)
    return found.select("carrier_type", *six(*points))


@query
def mode_text(d):
    return aggregates.mode_text(d.tables.route_actions, ["location_id"], "location_name", "name")


@query
def mode_value(d):
    return aggregates.mode_value(d.tables.route_actions, ["vehicle_code"], "address", "address")


@query
def distinct_list(d):
    return d.tables.daily_trips.groupBy("vehicle_code", "trip_date").agg(aggregates.distinct_list("start_address").alias("addresses"))


@query
def vehicle_group_key(d):
    return _of_trips(d, key=text.vehicle_group_key(F.concat(F.lit(" , "), "plates", F.lit(",Z")), "vehicle_code"))


@query
def compact_list(d):
    firsts = aggregates.first_values(d.tables.daily_trips, ["carrier"], "vehicle_code", "codes", 3)
    return firsts.select("carrier", text.compact_list("codes", "codes_count", 3).alias("shown"))


@query
def weekday_label(d):
    return _of_trips(d, day_index=F.weekday("trip_start"), label=text.weekday_label(F.weekday("trip_start")))


@query
def recommendation(d):
    mwh = F.col("distance_km") * 10.0
    return _of_trips(d, depot=text.recommendation(mwh, mwh, False), road=text.recommendation(mwh - 2000.0, mwh, True))


@query
def standplaats_key(d):
    land = F.when(F.col("stops") > 1, " ").otherwise("België")
    return _of_trips(d, key=text.standplaats_key(F.concat(F.lit(" "), "start_address"), "carrier", land))


@query
def bankers_round(d):
    """Halves and quarters, so that ties occur."""
    value = F.col("distance_km") / 4.0
    return _of_trips(d, whole=geo.bankers_round(value, 0), tenth=geo.bankers_round(value, 1))


@query
def vehicle_key(d):
    return _of_trips(d, key=text.vehicle_key("plate_norm", "vehicle_code"))


def queries():
    """Name to callable over a session and a folder of driver tables."""

    def bound(function: Query):
        return lambda spark, folder: function(dataset(spark, folder))

    return {name: bound(function) for name, function in QUERIES.items()}
