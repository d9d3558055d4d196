"""Charging demand of a selection: events, loads, profiles and vehicle rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import HOUR_MICROS, from_micros, micros, overlap_hours, slot_starts
from dwellgrid.functions.geo import bankers_round
from dwellgrid.functions.text import (
    compact_list,
    recommendation,
    split_plates,
    vehicle_group_key,
    weekday_label,
)
from dwellgrid.operators.aggregates import first_values, mode_value, quantiles
from dwellgrid.operators.filters import DAY_KEY, TRIP_KEY, filter_overnight, not_administrative
from dwellgrid.operators.nearest import nearest_charger
from dwellgrid.operators.overview import first_rows, to_cells
from dwellgrid.operators.sweep import first_slots, stretches
from dwellgrid.params import Filter, Scenario, clamp
from dwellgrid.session import materialize

BUCKET_KM = 50
FIXED_BUCKETS = 15


# --- events ------------------------------------------------------------------------------------


def overnight_demand_events(overnight: DataFrame, selection: Column | str = "depot_id") -> DataFrame:
    """Overnight standstills as demand events: from the day's end to the next day's start."""
    selection = F.col(selection) if isinstance(selection, str) else selection
    return overnight.select(
        "vehicle_code",
        F.coalesce("plates", "plate", F.lit("")).alias("plates"),
        "trip_date",
        selection.cast("string").alias("selection_id"),
        F.col("prev_end_time").alias("start_time"),
        F.col("day_start").alias("end_time"),
        F.col("start_lat").alias("lat"),
        F.col("start_lon").alias("lon"),
        F.coalesce("start_address", F.lit("")).alias("address"),
        F.greatest(F.coalesce("day_km", F.lit(0.0)), F.lit(0.0)).alias("distance_km"),
        F.greatest(F.coalesce("gap_hours", F.lit(0.0)), F.lit(0.0)).alias("gap_hours"),
    )


def road_demand_events(index: DataFrame) -> DataFrame:
    """Trips on a road as demand events; they do not stand still."""
    return index.select(
        "vehicle_code",
        F.coalesce("plates", "plate", F.lit("")).alias("plates"),
        "trip_date",
        F.col("trip_id").alias("selection_id"),
        F.col("trip_start").alias("start_time"),
        F.col("trip_end").alias("end_time"),
        F.col("start_lat").alias("lat"),
        F.col("start_lon").alias("lon"),
        F.coalesce("start_address", F.lit("")).alias("address"),
        F.greatest(F.coalesce("distance_km", F.lit(0.0)), F.lit(0.0)).alias("distance_km"),
        F.lit(0.0).alias("gap_hours"),
    ).distinct()


def demand_kwh(scenario: Scenario, is_road: bool) -> Column:
    return F.col("distance_km") * scenario.kwh_per_km if is_road else F.lit(float(scenario.capacity_kwh))


def required_kw(scenario: Scenario, is_road: bool) -> Column:
    """A road needs the energy at once; a depot has the standstill to deliver it."""
    demand = demand_kwh(scenario, is_road)
    if is_road:
        return demand
    return F.when(F.col("gap_hours") > 0, demand / F.col("gap_hours")).otherwise(demand)


def event_loads(events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False) -> DataFrame:
    """Events with their energy, power, start-hour label and vehicle."""
    scenario = scenario.normalized()
    return events.withColumns(
        {
            "time_slot": F.coalesce(F.date_format("start_time", "HH:00"), F.lit("00:00")),
            "demand_kwh": demand_kwh(scenario, is_road),
            "required_kw": required_kw(scenario, is_road),
            "vehicle": F.upper(vehicle_group_key("plates", "vehicle_code")),
        }
    )


def hour_slots(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """One row per clock hour the interval touches, with the hours spent in it."""
    slots = df.withColumn("_slot", F.explode(slot_starts(start, end, HOUR_MICROS)))
    hours = overlap_hours(start, end, "_slot", HOUR_MICROS)
    return slots.withColumn("overlap_hours", hours).withColumn("slot", from_micros("_slot")).drop("_slot")


# --- joins with other tables ---------------------------------------------------------------------


def selected_heat(stops: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Stops of the selected days or trips, counted per cell."""
    chosen = selection.select(*keys).distinct()
    visible = stops.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & not_administrative())
    return (
        to_cells(visible.join(chosen, keys, "left_semi"))
        .groupBy("lat", "lon")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .orderBy(F.desc("weight"), "lat", "lon")
    )


def selected_day_heat(stops: DataFrame, events: DataFrame) -> DataFrame:
    return selected_heat(stops, events, DAY_KEY)


def selected_trip_heat(stops: DataFrame, trips: DataFrame) -> DataFrame:
    return selected_heat(stops, trips, TRIP_KEY)


def daily_distance_of_selection(days: DataFrame, selection: DataFrame) -> DataFrame:
    """Kilometres of each whole day on which a selected trip took place."""
    chosen = selection.select(*DAY_KEY).distinct()
    return days.join(chosen, DAY_KEY, "left_semi").select(*DAY_KEY, F.coalesce("day_km", F.lit(0.0)).alias("day_km"))


def overnight_location_ranking(
    overnight: DataFrame,
    stops: DataFrame,
    chargers: DataFrame | None = None,
    flt: Filter = Filter(),
    min_vehicles: int = 5,
    scenario: Scenario = Scenario(),
) -> DataFrame:
    """Home locations by the energy their vehicles need."""
    key = ["depot_id"]
    scenario = scenario.normalized()
    limit = flt.normalized().marker_top_n
    events = filter_overnight(overnight, stops, flt)
    totals = events.groupBy(*key).agg(
        F.avg("start_lat").alias("lat"),
        F.avg("start_lon").alias("lon"),
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("vehicle_key").alias("unique_vehicles"),
        F.coalesce(F.percentile("gap_hours", 0.5), F.lit(0.0)).alias("median"),
    )
    ranked = (
        totals.withColumn("mwh", F.col("events") * F.lit(float(scenario.capacity_kwh)) / 1000.0)
        .where(F.col("unique_vehicles") >= clamp(min_vehicles, 1, 1_000))
        .orderBy(F.desc("mwh"), F.desc("unique_vehicles"), "depot_id")
    )
    shown = first_rows(ranked, limit)
    shown = (
        shown.join(mode_value(events, key, "start_address", "_address"), key, "left")
        .join(quantiles(events, key, "day_km", {"p95": 0.95}), key, "left")
    )
    if chargers is None:
        shown = shown.withColumn("nearest_charger_km", F.lit(-1.0))
    else:
        shown = shown.join(nearest_charger(shown.select("depot_id", "lat", "lon"), chargers), key, "left")
    # The joins lose the order.
    return shown.orderBy(F.desc("mwh"), F.desc("unique_vehicles"), "depot_id").select(
        "depot_id",
        bankers_round("lat", 6).alias("lat"),
        bankers_round("lon", 6).alias("lon"),
        F.coalesce("_address", F.lit("")).alias("address"),
        "unique_vehicles",
        "events",
        bankers_round("median", 1).alias("median_gap_hours"),
        bankers_round(F.coalesce("p95", F.lit(0.0)), 1).alias("p95_day_km"),
        bankers_round("mwh", 1).alias("total_mwh"),
        bankers_round("mwh", 1).alias("shortage_mwh"),
        bankers_round("nearest_charger_km", 1).alias("nearest_charger_km"),
        recommendation("mwh", "mwh", is_road=False).alias("recommendation"),
    )


# --- distributions -----------------------------------------------------------------------------


def distance_statistics(values: DataFrame, value: str = "distance_km") -> DataFrame:
    """One row: count, mean, spread and quantiles of the non-negative values; zeros when there are none."""
    kept = values.where(F.col(value) >= 0)
    totals = kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("avg_km"),
        F.stddev_pop(value).alias("stddev_km"),
    )
    points = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    picked = quantiles(kept, [], value, points).agg(F.struct(*[F.max(p).alias(p) for p in points]).alias("_q"))
    rounded = [F.coalesce(bankers_round(c, 1), F.lit(0.0)).alias(c) for c in ("avg_km", "stddev_km")]
    quantile_columns = [F.coalesce(bankers_round(F.col(f"_q.{p}"), 1), F.lit(0.0)).alias(p) for p in points]
    return totals.withColumn("_q", picked.scalar()).select("n", *rounded, *quantile_columns)


def distance_distribution(values: DataFrame, value: str = "distance_km") -> DataFrame:
    """Trips per 50 km, without empty buckets; the last bucket includes its upper end."""
    kept = values.where(F.col(value) >= 0)
    highest = kept.agg(F.greatest(F.lit(1), F.ceil(F.max(value) / BUCKET_KM))).scalar()
    bucket = F.floor(F.col(value) / BUCKET_KM)
    counted = kept.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("trips"))
    last = F.least(F.col("_bucket"), highest - 1)
    merged = counted.groupBy(last.alias("_bucket")).agg(F.sum("trips").alias("trips"))
    return merged.select(
        (F.col("_bucket") * BUCKET_KM).cast("int").alias("from_km"),
        ((F.col("_bucket") + 1) * BUCKET_KM).cast("int").alias("to_km"),
        "trips",
    ).orderBy("from_km")


def fixed_distance_distribution(values: DataFrame, value: str = "day_km") -> DataFrame:
    """Trips per 50 km in 15 buckets, zeros included; the last bucket is open."""
    bucket = F.least(F.floor(F.col(value) / BUCKET_KM), F.lit(FIXED_BUCKETS - 1)).alias("_bucket")
    counted = values.where(F.col(value) >= 0).groupBy(bucket).agg(F.count(F.lit(1)).alias("_trips"))
    every = values.sparkSession.range(FIXED_BUCKETS).select(F.col("id").alias("_bucket"))
    return every.join(counted, "_bucket", "left").select(
        (F.col("_bucket") * BUCKET_KM).cast("int").alias("from_km"),
        ((F.col("_bucket") + 1) * BUCKET_KM).cast("int").alias("to_km"),
        F.coalesce("_trips", F.lit(0)).alias("trips"),
    ).orderBy("from_km")


# --- per vehicle and totals ----------------------------------------------------------------------


def selection_vehicles(
    events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False, limit: int | None = None
) -> DataFrame:
    """The vehicles by the energy they need, the first ``limit`` of them or all.

    The loads are stored, because totals, quantiles and lists read them: a selection made distinct is shuffled once.
    """
    key = ["vehicle"]
    rate = scenario.normalized().kwh_per_km
    loads = event_loads(events, scenario, is_road)
    loads = materialize(loads.select("vehicle", "vehicle_code", "plates", "distance_km", "gap_hours", "required_kw"), "loads")
    totals = loads.groupBy(*key).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("distance_km").alias("_km"),
        F.avg("distance_km").alias("_mean_km"),
        F.avg(F.col("distance_km") * rate).alias("_mean_kwh"),
        F.avg("gap_hours").alias("_mean_gap"),
    )
    plates = loads.select("vehicle", F.explode(split_plates("plates")).alias("plate"))
    joined = (
        totals.join(quantiles(loads, key, "distance_km", {"_p95_km": 0.95}), key, "left")
        .join(quantiles(loads, key, "required_kw", {"_p95_kw": 0.95}), key, "left")
        .join(first_values(loads, key, "vehicle_code", "_codes", 3), key, "left")
        .join(first_values(plates, key, "plate", "_plates", 4), key, "left")
    )
    rows = joined.select(
        "vehicle",
        compact_list("_codes", "_codes_count", 3).alias("codes"),
        compact_list("_plates", "_plates_count", 4).alias("plates"),
        "days",
        F.col("days").alias("passages"),
        bankers_round("_km", 1).alias("total_km"),
        bankers_round("_mean_km", 1).alias("avg_day_km"),
        bankers_round("_p95_km", 1).alias("p95_km"),
        bankers_round("_mean_kwh", 1).alias("avg_kwh_per_day"),
        bankers_round(F.col("_km") * rate / 1000.0, 2).alias("total_mwh"),
        bankers_round("_mean_gap", 1).alias("avg_standing_hours"),
        bankers_round("_p95_kw", 0).alias("required_kw"),
    )
    return first_rows(rows.orderBy(F.desc("total_mwh"), F.desc("p95_km"), "vehicle"), limit).drop("vehicle")


def selection_summary(events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False) -> DataFrame:
    totals = event_loads(events, scenario, is_road).agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct("vehicle").alias("unique_vehicles"),
        F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("_km"),
        (F.coalesce(F.sum("demand_kwh"), F.lit(0.0)) / 1000.0).alias("_mwh"),
        F.coalesce(F.avg("gap_hours"), F.lit(0.0)).alias("_gap"),
    )
    return totals.select(
        "trips",
        "unique_vehicles",
        bankers_round("_km", 1).alias("total_km"),
        bankers_round("_mwh", 1).alias("total_mwh"),
        bankers_round("_gap", 1).alias("avg_gap_hours"),
        recommendation("_mwh", "_mwh", is_road).alias("recommendation"),
    )


def busy_windows(events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False) -> DataFrame:
    """The 12 start hours with most demand; nothing is deliverable yet, so all of it is shortage."""
    return (
        event_loads(events, scenario, is_road)
        .groupBy("time_slot")
        .agg(
            F.count(F.lit(1)).alias("events"),
            bankers_round(F.sum("demand_kwh"), 0).alias("demand_kwh"),
            F.lit(0.0).alias("deliverable_kwh"),
            bankers_round(F.sum("demand_kwh"), 0).alias("shortage_kwh"),
            bankers_round(F.sum("required_kw") / 1000.0, 2).alias("required_mw"),
        )
        .orderBy(F.desc("shortage_kwh"), F.desc("required_mw"), "time_slot")
        .limit(12)
    )


def charging_totals(
    events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False, runs: DataFrame | None = None
) -> DataFrame:
    """Energy, the weekly peak and how many plugs that peak takes."""
    plug = scenario.normalized().kw_per_plug
    totals = event_loads(events, scenario, is_road).agg(
        F.count(F.lit(1)).alias("events"),
        (F.coalesce(F.sum("demand_kwh"), F.lit(0.0)) / 1000.0).alias("_mwh"),
    )
    peak = (load_stretches(event_loads(events, scenario, is_road)) if runs is None else runs).agg(
        F.coalesce(F.max(bankers_round(F.col("required_kw") / 1000.0, 2)), F.lit(0.0))
    )
    return totals.withColumn("_peak", peak.scalar()).select(
        "events",
        bankers_round("_mwh", 1).alias("total_mwh"),
        bankers_round("_mwh", 1).alias("shortage_mwh"),
        bankers_round("_peak", 2).alias("peak_mw"),
        F.ceil(F.round(F.col("_peak") * 1000.0 / plug, 9)).cast("int").alias("required_plugs_at_peak"),
    )


# --- profiles over time --------------------------------------------------------------------------


def load_stretches(loads: DataFrame) -> DataFrame:
    """Vehicles, events, energy and power per run of clock hours that are alike.

    The totals and profiles below take it as ``runs`` where it is stored, and work it out otherwise.
    """
    return stretches(loads, [], "start_time", "end_time")


def _cell_columns(*leading: str) -> list:
    empty = {"vehicles": F.lit(0), "events": F.lit(0)}
    kw = F.coalesce("_best.required_kw", F.lit(0.0))
    return [
        *leading,
        *[F.coalesce(f"_best.{name}", zero).alias(name) for name, zero in empty.items()],
        bankers_round(F.coalesce("_best.demand_kwh", F.lit(0.0)), 0).alias("demand_kwh"),
        bankers_round(kw, 0).alias("required_kw"),
        bankers_round(kw / 1000.0, 2).alias("required_mw"),
    ]


def hourly_demand_profile(
    events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False, runs: DataFrame | None = None
) -> DataFrame:
    """Per hour of the day the dated hour with most vehicles, then most power; 24 rows."""
    slots = first_slots(load_stretches(event_loads(events, scenario, is_road)) if runs is None else runs, 24)
    order = F.struct("vehicles", "required_kw", -micros("slot"))
    best = F.max_by(F.struct("vehicles", "events", "demand_kwh", "required_kw"), order)
    peaks = slots.groupBy(F.hour("slot").alias("hour")).agg(best.alias("_best"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(peaks, "hour", "left").select(*_cell_columns("hour")).orderBy("hour")


def weekly_peaks(runs: DataFrame) -> DataFrame:
    """Per weekday and hour the dated hour (``slot``) with most power, then most vehicles; at most 168 rows."""
    order = F.struct("required_kw", "vehicles", -micros("slot"))
    best = F.max_by(F.struct("slot", "vehicles", "events", "demand_kwh", "required_kw"), order).alias("_best")
    slots = first_slots(runs, 168)
    return slots.groupBy(F.weekday("slot").alias("day_index"), F.hour("slot").alias("hour")).agg(best)


def in_slots(loads: DataFrame, peaks: DataFrame) -> DataFrame:
    """Each load once for every one of the chosen slots that it touches, as ``slot``."""
    chosen = peaks.agg(F.coalesce(F.collect_set(micros("_best.slot")), F.array().cast("array<bigint>"))).scalar()
    begin, stop = micros("start_time"), micros("end_time")
    listed = loads.where(begin < stop).withColumn("_chosen", chosen)
    touched = F.filter("_chosen", lambda s: (s + HOUR_MICROS > begin) & (s < stop))
    return listed.withColumn("_slot", F.explode(touched)).withColumn("slot", from_micros("_slot")).drop("_chosen", "_slot")


def weekly_demand_profile(
    events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False, listed: int = 40, runs: DataFrame | None = None
) -> DataFrame:
    """Per weekday and hour the dated hour with most power, then most vehicles; 168 rows.

    Each shows the first ``listed`` plates and codes; ``peak_slot_vehicles`` has all of them as rows.
    """
    loads = event_loads(events, scenario, is_road)
    peaks = weekly_peaks(materialize(load_stretches(loads), "runs") if runs is None else runs)
    touched = in_slots(loads, peaks)
    plates = touched.select("slot", F.explode(split_plates("plates")).alias("plate"))
    plate_lists = first_values(plates, ["slot"], "plate", "plates", listed).drop("plates_count")
    code_lists = first_values(touched, ["slot"], "vehicle_code", "codes", listed).drop("codes_count")
    full = (
        peaks.withColumn("slot", F.col("_best.slot"))
        .join(plate_lists, "slot", "left")
        .join(code_lists, "slot", "left")
        .drop("slot")
    )
    cells = events.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("day_index"), (F.col("id") % 24).cast("int").alias("hour")
    )
    none = F.array().cast("array<string>")
    return (
        cells.join(full, ["day_index", "hour"], "left")
        .withColumn("day_label", weekday_label("day_index"))
        .select(
            *_cell_columns("day_index", "day_label", "hour"),
            F.coalesce("plates", none).alias("plates"),
            F.coalesce("codes", none).alias("codes"),
        )
        .orderBy("day_index", "hour")
    )


def _vehicles_of_slots(slots: DataFrame) -> DataFrame:
    """Per slot and vehicle: every event that touches the slot counts with its full energy."""
    plate = F.coalesce(F.get(split_plates("plates"), F.lit(0)), F.lit("-"))
    return (
        slots.groupBy("slot", "vehicle")
        .agg(
            F.min("vehicle_code").alias("vehicle_code"),
            F.min(plate).alias("plate"),
            bankers_round(F.sum("demand_kwh"), 0).alias("demand_kwh"),
            bankers_round(F.sum("required_kw"), 0).alias("required_kw"),
            bankers_round(F.max("gap_hours"), 1).alias("standing_hours"),
            F.concat_ws(
                "-", F.date_format(F.min("start_time"), "HH:mm"), F.date_format(F.max("end_time"), "HH:mm")
            ).alias("window"),
        )
        .drop("vehicle")
    )


def slot_vehicle_demand(events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False) -> DataFrame:
    """The vehicles of every dated hour; one row per hour that a vehicle stands."""
    return _vehicles_of_slots(hour_slots(event_loads(events, scenario, is_road)))


def peak_slot_vehicles(
    events: DataFrame, scenario: Scenario = Scenario(), is_road: bool = False, runs: DataFrame | None = None
) -> DataFrame:
    """The dated hour that each weekday and hour of the weekly profile shows, with all its vehicles."""
    loads = event_loads(events, scenario, is_road)
    peaks = weekly_peaks(load_stretches(loads) if runs is None else runs)
    rows = _vehicles_of_slots(in_slots(loads, peaks))
    # A slot is one weekday and hour, so no lookup is needed.
    return rows.select(F.weekday("slot").alias("day_index"), F.hour("slot").alias("hour"), *rows.columns)
