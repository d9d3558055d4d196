"""Fleet lists: home bases, their vehicles, and what the trips know about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.text import blank_to_null, standplaats_key, text_or_empty

TOTAL_ROW = "TOTAAL"


def fleet_trip_stats(stops: DataFrame) -> DataFrame:
    """Trips and kilometres per vehicle code; a trip's own distance goes before that of its parts."""
    code = F.trim("vehicle_code")
    trip_km = F.when(F.max("trip_km") > 0, F.max("trip_km")).otherwise(F.sum(F.coalesce("segment_km", F.lit(0.0))))
    trips = stops.where(code != "").groupBy(code.alias("code"), "trip_id").agg(trip_km.alias("_km"))
    return trips.groupBy("code").agg(
        F.count(F.lit(1)).alias("trips"), F.coalesce(F.sum("_km"), F.lit(0.0)).alias("km")
    )


def own_depots(depots: DataFrame) -> DataFrame:
    """Depots by name, unique ignoring case, without the row of totals."""
    name = F.trim("name")
    named = depots.where((name != "") & (F.upper(name) != TOTAL_ROW))
    first = F.min(F.struct(name.alias("name"), F.trim(text_or_empty("location_type")).alias("location_type")))
    return (
        named.groupBy(F.upper(name).alias("_key"))
        .agg(first.alias("_depot"))
        .select("_key", "_depot.name", F.lit("").alias("region"), "_depot.location_type")
    )


def own_vehicles(vehicles: DataFrame) -> DataFrame:
    return vehicles.where((F.trim("plate") != "") & (F.trim("depot") != "")).withColumn(
        "_key", F.upper(F.trim("depot"))
    )


def charter_depots(depots: DataFrame) -> DataFrame:
    """Charter bases are their address; its place is their region."""
    known = depots.where(blank_to_null("address").isNotNull() & blank_to_null("place").isNotNull())
    name = standplaats_key("address", "place", "country")
    return (
        known.groupBy(F.upper(name).alias("_key"))
        .agg(F.min(F.struct(name.alias("name"), F.trim("place").alias("region"))).alias("_depot"))
        .select("_key", "_depot.name", "_depot.region", F.lit("Charterstandplaats").alias("location_type"))
    )


def charter_vehicles(vehicles: DataFrame) -> DataFrame:
    known = vehicles.where(
        blank_to_null("fleet_no").isNotNull()
        & blank_to_null("address").isNotNull()
        & blank_to_null("place").isNotNull()
    )
    base = standplaats_key("address", "place", "country")
    return known.select(
        F.trim("fleet_no").alias("fleet_no"),
        F.lit("").alias("plate"),
        F.lit("").alias("plate_norm"),
        F.trim("place").alias("region"),
        base.alias("depot"),
        F.coalesce(F.trim("location_type"), F.lit("Charterstandplaats")).alias("location_type"),
        F.lit("").alias("brand"),
        F.trim(text_or_empty("kind")).alias("kind"),
        F.trim(text_or_empty("fuel")).alias("fuel"),
        F.upper(base).alias("_key"),
    )


def _matched(vehicles: DataFrame, stats: DataFrame) -> DataFrame:
    seen = stats.groupBy(F.upper("code").alias("_code")).agg(
        F.max(F.struct("trips", "km")).alias("_stats")
    )
    joined = vehicles.withColumn("_code", F.upper(F.trim(text_or_empty("fleet_no")))).join(seen, "_code", "left")
    return joined.select(
        *vehicles.columns,
        F.coalesce("_stats.trips", F.lit(0)).alias("trips_in_data"),
        F.coalesce("_stats.km", F.lit(0.0)).alias("km_in_data"),
    )


def _located(depots: DataFrame, geocode: DataFrame) -> DataFrame:
    """Depots with coordinates; the others cannot be shown and are dropped."""
    places = geocode.groupBy(F.upper(F.trim("query")).alias("_key")).agg(F.min(F.struct("lat", "lon")).alias("_at"))
    known = (F.col("_at.lat") != 0) & (F.col("_at.lon") != 0)
    return depots.join(places, "_key").where(known).select(*depots.columns, "_at.lat", "_at.lon")


def _summarised(depots: DataFrame, vehicles: DataFrame, prefix: str) -> DataFrame:
    counts = vehicles.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_vehicles"), F.count_if(F.col("trips_in_data") > 0).alias("_matched")
    )
    return (
        depots.join(counts, "_key", "left")
        .select(
            F.concat(F.lit(prefix), "name").alias("depot_id"),
            "name", "region", "location_type", "lat", "lon",
            F.coalesce("_vehicles", F.lit(0)).alias("vehicles"),
            F.coalesce("_matched", F.lit(0)).alias("matched_in_trips"),
        )
        .orderBy(F.desc("vehicles"), F.upper("name"))
    )


def _listed(depots: DataFrame, vehicles: DataFrame, prefix: str) -> DataFrame:
    at = depots.select("_key", F.concat(F.lit(prefix), "name").alias("depot_id"))
    return vehicles.join(at, "_key").drop("_key").select("depot_id", *[c for c in vehicles.columns if c != "_key"])


def fleet_depots(depots: DataFrame, vehicles: DataFrame, geocode: DataFrame, stats: DataFrame) -> DataFrame:
    """Own depots with their number of vehicles and how many of those the trips know."""
    return _summarised(_located(own_depots(depots), geocode), _matched(own_vehicles(vehicles), stats), "fleet:")


def fleet_depot_vehicles(depots: DataFrame, vehicles: DataFrame, geocode: DataFrame, stats: DataFrame) -> DataFrame:
    """The vehicles of each depot, one row each: a depot can have any number of them."""
    return _listed(_located(own_depots(depots), geocode), _matched(own_vehicles(vehicles), stats), "fleet:")


def charter_fleet_depots(depots: DataFrame, vehicles: DataFrame, geocode: DataFrame, stats: DataFrame) -> DataFrame:
    located = _located(charter_depots(depots), geocode)
    return _summarised(located, _matched(charter_vehicles(vehicles), stats), "charter-fleet:")


def charter_fleet_depot_vehicles(
    depots: DataFrame, vehicles: DataFrame, geocode: DataFrame, stats: DataFrame
) -> DataFrame:
    located = _located(charter_depots(depots), geocode)
    return _listed(located, _matched(charter_vehicles(vehicles), stats), "charter-fleet:")
