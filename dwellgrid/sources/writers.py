"""Sinks: profiles as CSV or parquet folders, and map features as one JSON document per line."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.power import (
    hourly_power_profile,
    place_loads,
    power_daily_metrics,
    power_heatmap,
    power_location_profile,
    power_windows,
    scenario_profiles,
)
from dwellgrid.params import Filter, Power
from dwellgrid.session import materialize

FOCUS_POWER = Power(vehicle_classes=("own",), top_locations=None, scenario_years=(2027, 2030))

HOURLY_COLUMNS = ["location_id", "name", "address", "hour", "vehicles", "events", "required_kw", "required_mw"]
DAILY_COLUMNS = [
    "date", "unique_vehicles", "own_vehicles", "charter_vehicles", "trips", "events", "avg_dwell_min", "peak_kw",
]
SCENARIO_COLUMNS = ["year", "mode", "scale_factor", "hour", "vehicles", "events", "required_kw", "required_mw"]
HEATMAP_COLUMNS = ["location_id", "location_name", "hour", "vehicles", "required_kw", "required_mw"]


def _write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def sink_hourly_csv(profile: DataFrame, path: str) -> None:
    _write_csv(profile, HOURLY_COLUMNS, path)


def sink_daily_csv(daily: DataFrame, path: str) -> None:
    names = {"vehicles": "unique_vehicles", "own": "own_vehicles", "charter": "charter_vehicles"}
    _write_csv(daily.withColumnsRenamed(names), DAILY_COLUMNS, path)


def sink_scenario_csv(scenarios: DataFrame, path: str) -> None:
    _write_csv(scenarios, SCENARIO_COLUMNS, path)


def sink_heatmap_csv(heatmap: DataFrame, path: str) -> None:
    _write_csv(heatmap, HEATMAP_COLUMNS, path)


def sink_heatmap_parquet(heatmap: DataFrame, path: str) -> None:
    heatmap.select(*HEATMAP_COLUMNS).write.parquet(path)


def focus_location(locations: DataFrame, words: Sequence[str], alias: str) -> DataFrame:
    """The location whose name or address holds one of the words, or whose name is part of the alias, else the one with the highest peak; one row."""
    named = F.contains(F.upper(F.lit(alias)), F.upper("name"))
    for word in words:
        named = named | F.upper("address").contains(word.upper()) | F.upper("name").contains(word.upper())
    order = [named.desc(), F.desc("peak_kw"), F.desc("vehicles"), F.upper("name"), "location_id"]
    return locations.withColumn("is_focus", named).orderBy(*order).limit(1)


def export_focus_report(
    actions: DataFrame, path: str, words: Sequence[str], alias: str, flt: Filter = Filter(), power: Power = FOCUS_POWER
) -> DataFrame:
    """Write the profiles of the focus location and the heatmap of all; returns the chosen location.

    Every location is a candidate, however low its peak. ``top_locations`` shortens the heatmap, not the choice.
    """
    windows = power_windows(actions, flt, power)
    loads = place_loads(windows, power)
    every = replace(power, top_locations=None)
    profile = materialize(power_location_profile(windows, every, loads=loads), "focus-profile")
    chosen = materialize(focus_location(profile, words, alias), "focus")
    place = chosen.select(F.lower("location_id").alias("_place"))
    # What every file reads several times is stored, and so is the heatmap, which goes into two files.
    here = windows.join(place, F.lower("location_id") == F.col("_place"), "left_semi")
    here = materialize(here, "focus-windows")
    hourly = hourly_power_profile(here, power, loads.join(place, "_place", "left_semi"))
    hourly = materialize(hourly.join(chosen.select("location_id", "name", "address"), "location_id"), "focus-hours")
    heatmap = materialize(power_heatmap(windows, power, loads, profile), "heatmap")
    sink_hourly_csv(hourly.orderBy("hour"), f"{path}/hourly_profile")
    sink_daily_csv(power_daily_metrics(here, power), f"{path}/daily_metrics")
    sink_scenario_csv(scenario_profiles(here, power), f"{path}/scenarios")
    sink_heatmap_csv(heatmap, f"{path}/heatmap_csv")
    sink_heatmap_parquet(heatmap, f"{path}/heatmap_parquet")
    return chosen


def _feature(properties: list[Column], geometry: Column) -> Column:
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return F.to_json(shape).alias("feature")


def _point() -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))


def _line(coordinates: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))


def _ends() -> Column:
    return F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))


def _path() -> Column:
    return F.transform("coordinates", lambda p: F.array(p["lon"], p["lat"]))


def _named(**columns: str) -> list[Column]:
    return [F.col(source).alias(name) for name, source in columns.items()]


def geojson_features(df: DataFrame, kind: str) -> DataFrame:
    """One GeoJSON feature per row; ``kind`` names the layer."""
    line = _path() if "coordinates" in df.columns else _ends() if "lat1" in df.columns else None
    if kind == "heat":
        return df.select(_feature([F.col("weight")], _point()))
    if kind == "stops":
        label = F.coalesce(F.nullif("name", F.lit("")), "address").alias("label")
        return df.select(_feature([*_named(weight="unique_vehicles"), label, F.col("stops"), F.col("trips")], _point()))
    if kind == "roads":
        properties = _named(
            segmentId="segment_id", roadName="road_name", weight="passes", vehicles="unique_vehicles", passes="passes",
            direction="direction", bearing="bearing", lengthKm="length_km", rawSegments="raw_segments",
            radiusKm="radius_km",
        )
        return df.select(_feature(properties, _line(line)))
    if kind == "breaks":
        properties = _named(
            segmentId="segment_id", weight="passages", peakMw="peak_mw", totalKwh="total_kwh", vehicles="vehicles",
            passages="passages", direction="direction", radiusKm="radius_km",
        )
        return df.select(_feature(properties, _line(line)))
    if kind == "chargers":
        label = F.coalesce(F.nullif("name", F.lit("")), F.lit("Laadlocatie")).alias("label")
        address = F.trim(F.concat(F.col("address"), F.lit(", "), F.col("postcode"), F.lit(" "), F.col("town")))
        properties = [
            F.col("id"), label, F.col("operator"), address.alias("address"),
            *_named(maxPowerKw="max_power_kw", connectors="connectors", access="access", dedicated="dedicated",
                    twentyfourSeven="open_24_7", connectorType="connector_type"),
        ]
        return df.select(_feature(properties, _point()))
    if kind == "overnight":
        label = F.coalesce(F.nullif("address", F.lit("")), "depot_id").alias("label")
        properties = [
            F.col("depot_id").alias("depotId"), label,
            *_named(weight="unique_vehicles", events="events", totalMwh="total_mwh",
                    publicDemandMwh="shortage_mwh", recommendation="recommendation"),
        ]
        return df.select(_feature(properties, _point()))
    if kind == "depots":
        properties = _named(
            depotId="depot_id", name="name", regio="region", typeLocatie="location_type", vehicles="vehicles",
            matchedInTrips="matched_in_trips",
        )
        return df.select(_feature(properties, _point()))
    raise ValueError(f"unknown layer {kind}")


def sink_geojson(df: DataFrame, kind: str, path: str) -> None:
    """Features as lines of text, which any number of tasks can write."""
    geojson_features(df, kind).write.text(path)
