"""One function per question; each returns its parts as DataFrames by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators import breaks as brk
from dwellgrid.operators import demand, fleet, overview, roads
from dwellgrid.operators import power as pwr
from dwellgrid.operators.filters import (
    filter_depot,
    filter_overnight,
    filter_road_selection,
    filter_within_radius,
    road_variant,
)
from dwellgrid.params import Breaks, ChargerFilter, Filter, Power, Road, Scenario
from dwellgrid.plans.tables import Tables
from dwellgrid.session import materialize
from dwellgrid.sources import writers

Parts = dict[str, DataFrame]


def metadata(t: Tables) -> Parts:
    return {"totals": overview.metadata(t.stops), "values": overview.metadata_values(t.stops)}


def summary(t: Tables, flt: Filter = Filter()) -> Parts:
    return {"summary": overview.summary(t.stops, t.daily_trips, flt)}


def stop_map(t: Tables, flt: Filter = Filter()) -> Parts:
    return {"heat": overview.stop_heat(t.stops, flt), "markers": overview.stop_markers(t.stops, flt)}


def road_map(edges: DataFrame, heat: DataFrame, flt: Filter = Filter(), min_date=None, max_date=None) -> Parts:
    chosen = road_variant(edges, flt, min_date, max_date)
    points = road_variant(heat, flt, min_date, max_date)
    return {"lines": roads.road_map(chosen, flt), "heat": roads.road_heat(points, flt)}


def charger_map(chargers: DataFrame, flt: ChargerFilter = ChargerFilter()) -> Parts:
    return {"chargers": overview.chargers_ranked(chargers, flt)}


def overnight_ranking(
    t: Tables, chargers: DataFrame | None, flt: Filter = Filter(), min_vehicles: int = 5, scenario: Scenario = Scenario()
) -> Parts:
    ranking = demand.overnight_location_ranking(
        t.overnight_events, t.stops, chargers, flt, min_vehicles, scenario
    )
    return {"locations": ranking}


def _selection(events: DataFrame, heat: DataFrame, scenario: Scenario, is_road: bool) -> Parts:
    # One sweep over the events serves the totals and all profiles.
    runs = materialize(demand.load_stretches(demand.event_loads(events, scenario, is_road)), "runs")
    return {
        "summary": demand.selection_summary(events, scenario, is_road),
        "distances": demand.distance_statistics(events),
        "distribution": demand.distance_distribution(events),
        "heat": heat,
        "vehicles": demand.selection_vehicles(events, scenario, is_road),
        "busy_windows": demand.busy_windows(events, scenario, is_road),
        "totals": demand.charging_totals(events, scenario, is_road, runs),
        "hourly": demand.hourly_demand_profile(events, scenario, is_road, runs),
        "weekly": demand.weekly_demand_profile(events, scenario, is_road, runs=runs),
        "slot_vehicles": demand.peak_slot_vehicles(events, scenario, is_road, runs),
    }


def _chosen(rows: DataFrame) -> DataFrame:
    """Stored once: every part of a selection reads the chosen rows, none searches the tables again."""
    return materialize(rows, "chosen")


def depot_selection(t: Tables, depot_id: str, flt: Filter = Filter(), scenario: Scenario = Scenario()) -> Parts:
    chosen = _chosen(filter_overnight(filter_depot(t.overnight_events, depot_id), t.stops, flt))
    events = demand.overnight_demand_events(chosen)
    parts = _selection(events, demand.selected_day_heat(t.stops, chosen), scenario, is_road=False)
    return {**parts, "daily_distances": parts["distances"], "daily_distribution": parts["distribution"]}


def stop_selection(
    t: Tables, lat: float, lon: float, radius_km: float = 0.5, flt: Filter = Filter(), scenario: Scenario = Scenario()
) -> Parts:
    chosen = _chosen(filter_within_radius(t.overnight_events, lat, lon, radius_km, flt))
    events = demand.overnight_demand_events(chosen, "trip_date")
    parts = _selection(events, demand.selected_day_heat(t.stops, chosen), scenario, is_road=False)
    return {**parts, "daily_distances": parts["distances"], "daily_distribution": parts["distribution"]}


def road_selection(t: Tables, road: Road, flt: Filter = Filter(), scenario: Scenario = Scenario()) -> Parts:
    chosen = _chosen(filter_road_selection(t.road_selection_index, road, flt))
    events = demand.road_demand_events(chosen)
    days = demand.daily_distance_of_selection(t.vehicle_days, chosen)
    return {
        **_selection(events, demand.selected_trip_heat(t.stops, chosen), scenario, is_road=True),
        "daily_distances": demand.distance_statistics(days, "day_km"),
        "daily_distribution": demand.fixed_distance_distribution(days),
    }


def charging_scenario(
    t: Tables,
    kind: str,
    depot_id: str = "",
    road: Road | None = None,
    flt: Filter = Filter(),
    scenario: Scenario = Scenario(),
) -> Parts:
    """A road when one is selected, else a depot."""
    if kind.lower() == "road" and road is not None:
        return road_selection(t, road, flt, scenario)
    return depot_selection(t, depot_id, flt, scenario)


def _break_trips(t: Tables, breaks: Breaks, flt: Filter) -> tuple[DataFrame, DataFrame]:
    labelled = materialize(brk.break_trip_labels(brk.break_trips(t.daily_trips, t.stops, flt), breaks), "break-trips")
    return labelled, brk.break_events(labelled, breaks)


def break_demand_map(t: Tables, breaks: Breaks = Breaks(), flt: Filter = Filter()) -> Parts:
    labelled, events = _break_trips(t, breaks, flt)
    return {"lines": brk.break_demand_lines(events, breaks), "diagnostics": brk.break_diagnostics(labelled)}


def break_demand_detail(t: Tables, road: Road, breaks: Breaks = Breaks(), flt: Filter = Filter()) -> Parts:
    labelled, events = _break_trips(t, breaks, flt)
    near = brk.filter_near_segment(events, road)
    length = breaks.normalized().break_h
    return {
        "totals": brk.break_demand_detail(events, road, length),
        "quarters": brk.break_quarter_profile(near, length),
        "hours": brk.break_hourly_profile(near, length),
        "vehicles": brk.break_vehicles(events, road),
        "diagnostics": brk.break_diagnostics(labelled),
    }


def power_profiles(t: Tables, flt: Filter = Filter(), power: Power = Power()) -> Parts:
    windows = pwr.power_windows(t.route_actions, flt, power)
    locations = materialize(pwr.power_location_profile(windows, power), "power-locations")
    shown = locations.select(F.lower("location_id").alias("_place"))
    top = windows.join(shown, F.lower("location_id") == F.col("_place"), "left_semi")
    return {
        "locations": locations,
        "hourly": pwr.hourly_power_profile(top, power),
        "heatmap": pwr.power_heatmap(top, power),
        "scenarios": pwr.scenario_profiles(top, power),
    }


def power_location(t: Tables, location_id: str, flt: Filter = Filter(), power: Power = Power()) -> Parts:
    # The place is chosen after the windows are formed: it must not change where a stay ends.
    every = pwr.power_windows(t.route_actions, flt, power)
    windows = materialize(every.where(F.lower("location_id") == location_id.strip().lower()), "power-location")
    daily = pwr.power_daily_metrics(windows, power)
    return {
        "profile": pwr.power_location_profile(windows, power, 1),
        "hourly": pwr.hourly_power_profile(windows, power),
        "slot_vehicles": pwr.power_slot_vehicles(windows, power),
        "daily": daily,
        "top_days": pwr.top_power_days(daily),
        "scenarios": pwr.scenario_profiles(windows, power),
    }


def power_diagnostics(t: Tables, fleet_vehicles: DataFrame | None = None, flt: Filter = Filter()) -> Parts:
    parts = {
        "totals": pwr.power_diagnostics(t.route_actions, flt),
        "routes_without_wait": pwr.routes_without_wait(t.route_actions, flt),
        "classes": pwr.vehicle_class_counts(t.route_actions, flt),
    }
    if fleet_vehicles is not None:
        parts["fleet_matched"] = pwr.fleet_match_count(t.route_actions, fleet_vehicles)
    return parts


def power_export(t: Tables, path: str) -> Parts:
    return {"location": writers.export_focus_report(t.route_actions, path)}


def dashboard(t: Tables, edges: DataFrame | None = None, flt: Filter = Filter(), min_date=None, max_date=None) -> Parts:
    parts = {
        "top_stops": overview.top_stops(t.stops, flt),
        "ze_zones": overview.ze_zone_summary(t.stops, flt),
    }
    if edges is not None:
        lines = materialize(roads.road_map(road_variant(edges, flt, min_date, max_date), flt), "road-lines")
        parts |= {"roads": roads.dashboard_roads(lines), "corridors": roads.corridors(lines)}
    return parts


def fleet_bases(t: Tables, depots: DataFrame, vehicles: DataFrame, geocode: DataFrame) -> Parts:
    stats = fleet.fleet_trip_stats(t.stops)
    return {
        "depots": fleet.fleet_depots(depots, vehicles, geocode, stats),
        "vehicles": fleet.fleet_depot_vehicles(depots, vehicles, geocode, stats),
    }


def charter_bases(t: Tables, depots: DataFrame, vehicles: DataFrame, geocode: DataFrame) -> Parts:
    stats = fleet.fleet_trip_stats(t.stops)
    return {
        "depots": fleet.charter_fleet_depots(depots, vehicles, geocode, stats),
        "vehicles": fleet.charter_fleet_depot_vehicles(depots, vehicles, geocode, stats),
    }
