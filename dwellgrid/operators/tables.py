"""Derived tables: trips, vehicle days, overnight standstills and the road selection index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions.clock import seconds
from dwellgrid.functions.geo import haversine_km, location_id
from dwellgrid.functions.text import text_or_empty, vehicle_key
from dwellgrid.operators.aggregates import distinct_list, mode_value, quantiles
from dwellgrid.operators.filters import DAY_KEY, TRIP_KEY, not_administrative

MIN_GAP_HOURS = 6.0
MAX_GAP_HOURS = 72.0
MAX_MOVE_KM = 0.5


def _fleet_columns():
    """Modal carrier, type and plate, and the list of plates.

    These keep one counter per distinct value of a trip or a vehicle day, never its rows.
    """
    return [
        F.coalesce(F.mode("carrier", True), F.lit("")).alias("carrier"),
        F.coalesce(F.mode("carrier_type", True), F.lit("")).alias("carrier_type"),
        F.coalesce(F.mode(F.nullif("plate", F.lit("")), True), F.lit("")).alias("plate"),
        F.coalesce(F.mode(F.nullif("plate_norm", F.lit("")), True), F.lit("")).alias("plate_norm"),
        distinct_list("plate").alias("plates"),
    ]


def _valid_stops(stops: DataFrame) -> DataFrame:
    present = [F.col(name).isNotNull() for name in ("lat", "lon", "trip_id", "vehicle_code")]
    kept = not_administrative()
    for condition in present:
        kept = kept & condition
    return stops.where(kept)


def _stop_ends():
    # First by start with unknown times last; last by start as well, not by end.
    place = F.struct("lat", "lon", text_or_empty("address").alias("address"), "planned_start", "planned_end", "stop_seq")
    unknown_last = F.struct(
        F.col("planned_start").isNull(), F.col("planned_start"), F.col("planned_end").isNull(),
        F.col("planned_end"), F.col("stop_seq"),
    )
    latest = F.struct("planned_start", "planned_end", "stop_seq")
    return F.min_by(place, unknown_last).alias("_first"), F.max_by(place, latest).alias("_last")


def first_last_stop(stops: DataFrame) -> DataFrame:
    """First and last stop of every trip."""
    first, last = _stop_ends()
    return (
        _valid_stops(stops)
        .groupBy(*TRIP_KEY)
        .agg(first, last)
        .select(
            *TRIP_KEY,
            F.col("_first.stop_seq").alias("first_seq"),
            F.col("_first.planned_start").alias("first_start"),
            F.col("_first.address").alias("first_address"),
            F.col("_last.stop_seq").alias("last_seq"),
            F.col("_last.planned_start").alias("last_start"),
            F.col("_last.address").alias("last_address"),
        )
    )


def daily_trips(stops: DataFrame) -> DataFrame:
    """One row per vehicle, date and trip, in a single aggregation with partial results per task."""
    first, last = _stop_ends()
    grouped = (
        _valid_stops(stops)
        .groupBy(*TRIP_KEY)
        .agg(
            *_fleet_columns(),
            F.min("planned_start").alias("trip_start"),
            F.max("planned_end").alias("trip_end"),
            first,
            last,
            F.greatest(
                F.coalesce(F.sum("segment_km"), F.lit(0.0)), F.coalesce(F.max("trip_km"), F.lit(0.0))
            ).alias("distance_km"),
            F.count(F.lit(1)).alias("stops"),
        )
    )
    return grouped.where(F.col("trip_start").isNotNull() & F.col("trip_end").isNotNull()).select(
        "vehicle_code", "carrier", "carrier_type", "plate", "plate_norm", "plates", "trip_date", "trip_id",
        "trip_start", "trip_end",
        F.col("_first.lat").alias("start_lat"),
        F.col("_first.lon").alias("start_lon"),
        F.col("_first.address").alias("start_address"),
        F.col("_last.lat").alias("end_lat"),
        F.col("_last.lon").alias("end_lon"),
        F.col("_last.address").alias("end_address"),
        "distance_km",
        "stops",
    )


def vehicle_days(trips: DataFrame) -> DataFrame:
    """One row per vehicle and date: begins with its first trip, ends with the one that ends last."""
    start = F.min_by(F.struct("start_lat", "start_lon", "start_address"), F.struct("trip_start", "trip_id"))
    end = F.max_by(F.struct("end_lat", "end_lon", "end_address"), F.struct("trip_end", "trip_id"))
    return (
        trips.groupBy(*DAY_KEY)
        .agg(
            *_fleet_columns(),
            F.min("trip_start").alias("day_start"),
            F.max("trip_end").alias("day_end"),
            start.alias("_start"),
            end.alias("_end"),
            F.sum("distance_km").alias("day_km"),
            F.count(F.lit(1)).alias("trips"),
        )
        .select(
            "vehicle_code", "carrier", "carrier_type", "plate", "plate_norm", "plates", "trip_date",
            "day_start", "day_end", "_start.*", "_end.*", "day_km", "trips",
        )
    )


def previous_day_end(days: DataFrame) -> DataFrame:
    """Where and when the vehicle's previous day ended.

    The input has one row per vehicle and date, so a window never holds more rows than the calendar
    has days, however many trips a vehicle made.
    """
    before = W.partitionBy("vehicle_code").orderBy("trip_date")
    previous = F.lag(F.struct("day_end", "end_lat", "end_lon", "end_address")).over(before)
    return days.withColumn("_previous", previous).select(
        *days.columns,
        F.col("_previous.day_end").alias("prev_end_time"),
        F.col("_previous.end_lat").alias("prev_end_lat"),
        F.col("_previous.end_lon").alias("prev_end_lon"),
        F.col("_previous.end_address").alias("prev_end_address"),
    )


def overnight_candidates(
    days: DataFrame,
    min_gap_h: float = MIN_GAP_HOURS,
    max_gap_h: float = MAX_GAP_HOURS,
    max_km: float = MAX_MOVE_KM,
) -> DataFrame:
    """Days that start where the previous one ended, after a standstill of plausible length."""
    gap = (seconds("day_start") - seconds("prev_end_time")) / 3600.0
    moved = haversine_km("prev_end_lat", "prev_end_lon", "start_lat", "start_lon")
    return (
        previous_day_end(days)
        .withColumn("vehicle_key", vehicle_key("plate_norm", "vehicle_code"))
        .withColumn("depot_id", location_id("start_lat", "start_lon", F.lit(None).cast("string")))
        .withColumn("gap_hours", gap)
        .withColumn("end_start_km", moved)
        .where(F.col("gap_hours").between(min_gap_h, max_gap_h) & (F.col("end_start_km") <= max_km))
    )


def overnight_home_location(candidates: DataFrame) -> DataFrame:
    """The one place a vehicle counts as its home: most nights, then most recent, then longest.

    The median keeps a counter per distinct gap; gaps are whole seconds between 6 and 72 hours, so
    there are at most 237,601 of them in any group.
    """
    places = candidates.groupBy("vehicle_key", "depot_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("trip_date").alias("last_seen"),
        F.coalesce(F.percentile("gap_hours", 0.5), F.lit(0.0)).alias("median_gap_hours"),
    )
    rank = F.struct(-F.col("events"), -F.unix_date("last_seen"), -F.col("median_gap_hours"), F.col("depot_id"))
    best = F.min_by(F.struct("depot_id", "events", "last_seen", "median_gap_hours"), rank)
    return places.groupBy("vehicle_key").agg(best.alias("_best")).select("vehicle_key", "_best.*", F.lit(1).alias("rn"))


def overnight_events(candidates: DataFrame, home: DataFrame) -> DataFrame:
    return candidates.join(home.select("vehicle_key", "depot_id"), ["vehicle_key", "depot_id"], "left_semi")


def overnight_locations(events: DataFrame) -> DataFrame:
    """Per home location: how many vehicles and nights, how long and how far."""
    key = ["depot_id"]
    totals = events.groupBy(*key).agg(
        F.avg("start_lat").alias("lat"),
        F.avg("start_lon").alias("lon"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("vehicle_key").alias("unique_vehicles"),
        F.coalesce(F.sum("day_km"), F.lit(0.0)).alias("total_day_km"),
    )
    vehicles_share = F.least(F.lit(1.0), F.col("unique_vehicles") / 25.0)
    events_share = F.least(F.lit(1.0), F.col("events") / 100.0)
    return (
        totals.join(mode_value(events, key, "start_address", "_address"), key, "left")
        .join(quantiles(events, key, "gap_hours", {"median_gap_hours": 0.5}), key, "left")
        .join(quantiles(events, key, "day_km", {"p95_day_km": 0.95}), key, "left")
        .select(
            "depot_id",
            "lat",
            "lon",
            F.coalesce("_address", F.lit("")).alias("address"),
            "events",
            "unique_vehicles",
            F.coalesce("median_gap_hours", F.lit(0.0)).alias("median_gap_hours"),
            F.coalesce("p95_day_km", F.lit(0.0)).alias("p95_day_km"),
            "total_day_km",
            (vehicles_share * 0.6 + events_share * 0.4).alias("confidence"),
        )
    )


def road_selection_index(trips: DataFrame) -> DataFrame:
    """Trips that go somewhere, with the middle of the line between their ends."""
    ends = ("start_lat", "start_lon", "end_lat", "end_lon")
    known = F.lit(True)
    for name in ends:
        known = known & F.col(name).isNotNull()
    stays = (F.col("start_lat") == F.col("end_lat")) & (F.col("start_lon") == F.col("end_lon"))
    return trips.where(known & ~stays).select(
        "vehicle_code", "plate", "plate_norm", "plates", "trip_date", "trip_id",
        ((F.col("start_lat") + F.col("end_lat")) / 2.0).alias("mid_lat"),
        ((F.col("start_lon") + F.col("end_lon")) / 2.0).alias("mid_lon"),
        "carrier", "carrier_type", "trip_start", "trip_end", "start_lat", "start_lon", "start_address",
        "end_lat", "end_lon", "end_address", "distance_km",
    )
