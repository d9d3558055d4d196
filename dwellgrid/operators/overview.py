"""Totals, map layers and rankings over stops, trips and chargers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import bankers_round
from dwellgrid.operators.aggregates import mode_value
from dwellgrid.operators.filters import (
    filter_chargers,
    filter_daily_trips,
    filter_stops,
)
from dwellgrid.params import ChargerFilter, Filter, within

CELL = ["lat", "lon"]


def first_rows(ranked: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a ranking, all of them for None."""
    return ranked if within("limit", limit, 1) is None else ranked.limit(limit)


def to_cells(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.round("lat", 3), "lon": F.round("lon", 3)})


def metadata(stops: DataFrame) -> DataFrame:
    located = stops.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.agg(
        F.count(F.lit(1)).alias("stop_count"),
        F.count_distinct("trip_id").alias("trip_count"),
        F.count_distinct("vehicle_code").alias("vehicle_count"),
        F.min("trip_date").alias("min_date"),
        F.max("trip_date").alias("max_date"),
    )


def metadata_values(stops: DataFrame) -> DataFrame:
    """The values one can filter by, as rows of kind and value."""
    zones = stops.where(F.col("in_zez") & (F.col("ze_zone") != "")).select(F.col("ze_zone").alias("value"))
    kinds = {
        "carrier_type": stops.select(F.col("carrier_type").alias("value")),
        "carrier": stops.select(F.col("carrier").alias("value")),
        "vehicle_code": stops.select(F.col("vehicle_code").alias("value")),
        "ze_zone": zones,
    }
    parts = [
        values.where(F.col("value").isNotNull()).distinct().select(F.lit(kind).alias("kind"), "value")
        for kind, values in kinds.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.orderBy("kind", "value")


def summary(stops: DataFrame, trips: DataFrame, flt: Filter = Filter()) -> DataFrame:
    """One row: stop counts from the stops, kilometres from the trips."""
    by_stop = filter_stops(stops, flt).agg(
        F.count(F.lit(1)).alias("stops"),
        F.count_distinct("trip_id").alias("trips"),
        F.count_distinct("vehicle_code").alias("vehicles"),
        (F.coalesce(F.sum("dwell_min"), F.lit(0.0)) / 60.0).alias("dwell"),
    )
    km = F.col("distance_km")
    by_trip = filter_daily_trips(trips, stops, flt).agg(
        F.struct(
            F.coalesce(F.sum(km), F.lit(0.0)).alias("total"),
            F.coalesce(F.avg(km), F.lit(0.0)).alias("mean"),
            F.coalesce(F.sum(F.when(F.col("carrier_type") == "eigen", km)), F.lit(0.0)).alias("own"),
            F.coalesce(F.sum(F.when(F.col("carrier_type") == "charter", km)), F.lit(0.0)).alias("charter"),
        ).alias("_km")
    )
    both = by_stop.withColumn("_km", by_trip.scalar())

    def percent(part: str):
        share = 100.0 * F.col(f"_km.{part}") / F.nullif(F.col("_km.total"), F.lit(0.0))
        return F.coalesce(bankers_round(share, 1), F.lit(0.0))

    return both.select(
        "stops",
        "trips",
        "vehicles",
        bankers_round(F.col("_km.total"), 1).alias("total_km"),
        bankers_round(F.col("_km.mean"), 1).alias("avg_trip_km"),
        bankers_round("dwell", 1).alias("dwell_hours"),
        percent("own").alias("own_km_pct"),
        percent("charter").alias("charter_km_pct"),
    )


def stop_heat(stops: DataFrame, flt: Filter = Filter(), limit: int | None = None) -> DataFrame:
    weight = F.greatest(F.coalesce(F.sum("dwell_min"), F.lit(0.0)), F.count(F.lit(1)).cast("double"))
    cells = to_cells(filter_stops(stops, flt)).groupBy(*CELL).agg(weight.alias("weight"))
    return first_rows(cells.orderBy(F.desc("weight"), *CELL), limit)


def _cell_statistics(stops: DataFrame, flt: Filter) -> DataFrame:
    cells = to_cells(filter_stops(stops, flt))
    totals = cells.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("stops"),
        F.count_distinct("vehicle_code").alias("vehicles"),
        F.count_distinct("trip_id").alias("trips"),
        F.coalesce(F.sum("dwell_min"), F.lit(0.0)).alias("_dwell"),
        F.coalesce(F.avg("dwell_min"), F.lit(0.0)).alias("_mean_dwell"),
    )
    return (
        totals.join(mode_value(cells, CELL, "location_name", "_name"), CELL, "left")
        .join(mode_value(cells, CELL, "address", "_address"), CELL, "left")
        .withColumns({"name": F.coalesce("_name", F.lit("")), "address": F.coalesce("_address", F.lit(""))})
    )


def stop_markers(stops: DataFrame, flt: Filter = Filter()) -> DataFrame:
    ranked = _cell_statistics(stops, flt).orderBy(F.desc("vehicles"), F.desc("stops"), *CELL)
    return first_rows(ranked, flt.normalized().marker_top_n).select(
        *CELL,
        "name",
        "address",
        F.col("vehicles").alias("unique_vehicles"),
        "stops",
        "trips",
        bankers_round("_mean_dwell", 1).alias("avg_dwell_min"),
    )


def top_stops(stops: DataFrame, flt: Filter = Filter(), limit: int | None = None) -> DataFrame:
    ranked = _cell_statistics(stops, flt).orderBy(F.desc("vehicles"), F.desc("_dwell"), *CELL)
    return first_rows(ranked, limit).select(
        *CELL,
        "name",
        "address",
        "stops",
        "vehicles",
        "trips",
        bankers_round(F.col("_dwell") / 60.0, 1).alias("dwell_hours"),
        bankers_round("_mean_dwell", 1).alias("avg_dwell_min"),
    )


def ze_zone_summary(stops: DataFrame, flt: Filter = Filter(), limit: int | None = None) -> DataFrame:
    ranked = (
        filter_stops(stops, flt)
        .where(F.col("in_zez"))
        .groupBy(F.col("ze_zone").alias("zone"), F.col("ze_start_date").alias("start_date"))
        .agg(
            F.count(F.lit(1)).alias("stops"),
            F.count_distinct("trip_id").alias("trips"),
            F.count_distinct("vehicle_code").alias("vehicles"),
        )
        .orderBy(F.desc("stops"), "zone", "start_date")
    )
    return first_rows(ranked, limit)


def chargers_ranked(chargers: DataFrame, flt: ChargerFilter = ChargerFilter(), limit: int | None = None) -> DataFrame:
    ranked = filter_chargers(chargers, flt)
    return first_rows(ranked.orderBy(F.desc("max_power_kw"), F.desc("connectors"), "name", "id"), limit)
