"""Where drivers must take their break, and what charging there would ask of a road."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import (
    HOUR_MICROS,
    QUARTER_MICROS,
    from_micros,
    micros,
    overlap_hours,
    slot_starts,
)
from dwellgrid.functions.geo import (
    bankers_round,
    bearing_degrees,
    compass_direction,
    coordinate_key,
    direction_bucket,
    haversine_km,
    interpolate,
    project_point,
)
from dwellgrid.operators.filters import filter_daily_trips, filter_near_segment
from dwellgrid.operators.nearest import cell, neighbours
from dwellgrid.operators.ordered import Scan, Step, by_key
from dwellgrid.operators.ranking import heaviest
from dwellgrid.params import Breaks, Filter, Road, clamp
from dwellgrid.session import materialize

ROUTE_QUALITY = "laag: lineaire ritprogressie"
HALF_LINE_KM = 0.75
RESET_VEHICLES = 5
MM_PER_KM = 1_000_000
REASONS = ("included", "invalid", "implausible_speed", "before_window", "after_window")


def break_trips(trips: DataFrame, stops: DataFrame, flt: Filter = Filter()) -> DataFrame:
    """Trips whose two ends are known."""
    kept = filter_daily_trips(trips, stops, flt)
    for name in ("start_lat", "start_lon", "end_lat", "end_lon"):
        kept = kept.where(F.col(name).isNotNull())
    return kept.select(
        "vehicle_code", "plate", "plates", "trip_date", "trip_id", "trip_start", "trip_end",
        "start_lat", "start_lon", "end_lat", "end_lon",
        F.greatest(F.coalesce("distance_km", F.lit(0.0)), F.lit(0.0)).alias("distance_km"),
    )


def reset_locations(trips: DataFrame, min_visits: int = 20) -> DataFrame:
    """Cells many vehicles begin or end in, or ``min_visits`` trips."""
    ends = F.explode(
        F.array(
            F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
            F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")),
        )
    )
    visits = trips.select(F.upper("vehicle_code").alias("_vehicle"), ends.alias("_end")).select(
        "_vehicle", bankers_round("_end.lat", 3).alias("lat"), bankers_round("_end.lon", 3).alias("lon")
    )
    cells = visits.groupBy(coordinate_key("lat", "lon").alias("_cell")).agg(
        F.count_distinct("_vehicle").alias("_vehicles"),
        F.count(F.lit(1)).alias("_visits"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
    )
    return cells.where((F.col("_vehicles") >= RESET_VEHICLES) | (F.col("_visits") >= min_visits)).select("lat", "lon")


def _near_resets(moves: DataFrame, resets: DataFrame, radius_km: float) -> DataFrame:
    """Distinct moves whose two ends lie within the radius of one and the same reset location.

    Reset locations are repeated into the cells around their own, so a move looks in one cell; the
    semi join stops at its first match.
    """
    size = radius_km / 111.0

    def lon_size(x: Column) -> Column:
        # Wide enough for the radius anywhere in the row of cells; near a pole the row is one cell.
        edge = (F.abs(x) + 2) * size
        return F.when(edge > 89.0, 400.0).otherwise(size / F.cos(F.radians(edge)))

    spread = (
        resets.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        .withColumn("_x", F.explode(neighbours("_lat", size)))
        .withColumn("_y", F.explode(neighbours("_lon", lon_size(F.col("_x")))))
    )
    placed = moves.withColumn("_x", cell("prev_lat", size)).withColumn(
        "_y", cell("prev_lon", lon_size(F.col("_x")))
    )
    close = (
        (placed["_x"] == spread["_x"])
        & (placed["_y"] == spread["_y"])
        & (haversine_km("prev_lat", "prev_lon", "_lat", "_lon") <= radius_km)
        & (haversine_km("start_lat", "start_lon", "_lat", "_lon") <= radius_km)
    )
    return placed.join(spread, close, "left_semi").drop("_x", "_y")


def break_trip_labels(
    trips: DataFrame, breaks: Breaks = Breaks(), resets: DataFrame | None = None, ranges: int | None = None
) -> DataFrame:
    """Trips with their shift, the driving before them in it, and why they count or not."""
    breaks = breaks.normalized()
    progress = shift_progress(shift_sessions(trips, resets, breaks, ranges), breaks)
    before = F.col("drive_before")
    after = before + F.col("drive_hours")
    reason = (
        F.when(~F.col("usable"), "invalid")
        .when(~F.col("plausible"), "implausible_speed")
        .when(after < breaks.window_start_h, "before_window")
        .when(before > breaks.window_end_h, "after_window")
        .otherwise("included")
    )
    return progress.withColumn("reason", reason)


def shift_sessions(
    trips: DataFrame, resets: DataFrame | None = None, breaks: Breaks = Breaks(), ranges: int | None = None
) -> DataFrame:
    """Number the shifts of each vehicle.

    A shift ends at a standstill of ``reset_gap_h`` hours at a reset location. That depends only on
    a trip and the one before it, so shifts are a running count, and the driving before a trip is the
    vehicle's running total minus what it was when the shift began. Kilometres count in whole millimetres.
    """
    breaks = breaks.normalized()
    keys, order = ["_vehicle"], ["trip_start", "_trip"]
    named = trips.withColumns({"_vehicle": F.upper("vehicle_code"), "_trip": F.upper("trip_id")})
    worked = F.greatest(micros("trip_end") - micros("trip_start"), F.lit(0))
    speed = F.col("distance_km") / F.nullif(worked / float(HOUR_MICROS), F.lit(0.0))
    usable = (worked > 0) & (F.col("distance_km") > 0)
    named = named.withColumns({"_worked": worked, "usable": usable}).withColumn(
        "plausible", F.coalesce(F.col("usable") & (speed <= breaks.max_kmh), F.lit(False))
    )
    resets = materialize(reset_locations(trips, breaks.min_visits) if resets is None else resets, "resets")
    counted = F.col("plausible")
    millimetres = F.round(F.col("distance_km") * MM_PER_KM).cast("long")
    move = ["prev_lat", "prev_lon", "start_lat", "start_lon"]

    def shifts(rows: DataFrame, scan: Scan) -> DataFrame:
        previous = F.struct("trip_end", "end_lat", "end_lon")
        seen = scan(
            rows,
            [
                Step("_previous", "lag", previous),
                # Whole microseconds and millimetres add up exactly; hours and kilometres would not.
                Step("_drive_total", "sum", F.when(counted, F.col("_worked")).otherwise(F.lit(0))),
                Step("_mm_total", "sum", F.when(counted, millimetres).otherwise(F.lit(0))),
            ],
        )
        gap = (micros("trip_start") - micros("_previous.trip_end")) / float(HOUR_MICROS)
        seen = seen.withColumns(
            {
                "_rested": F.coalesce(gap >= breaks.reset_gap_h, F.lit(False)),
                "prev_lat": F.col("_previous.end_lat"),
                "prev_lon": F.col("_previous.end_lon"),
            }
        )
        # Places repeat far more than trips do: each pair of places is looked up once. Stored, so that Spark knows how few
        # pairs there are and takes them to the trips, which then stay in their ranges.
        moves = seen.where("_rested").select(*move).distinct()
        near = materialize(_near_resets(moves, resets, breaks.reset_radius_km), "near").withColumn("_near", F.lit(True))
        flagged = seen.join(near, move, "left").withColumn(
            "is_reset", F.col("_rested") & F.coalesce("_near", F.lit(False))
        )
        opens = F.col("_previous").isNull() | F.col("is_reset")
        start = F.when(opens, F.struct("trip_start", "_drive_total", "_mm_total"))
        numbered = scan(
            flagged.withColumn("_opens", F.when(opens, 1).otherwise(0)),
            [Step("_shift", "last", start), Step("_shifts", "sum", F.col("_opens"))],
        )
        return numbered.select(
            *rows.columns,
            (F.col("_shifts") + F.col("_opens")).cast("int").alias("shift_id"),
            F.col("_shift.trip_start").alias("shift_start"),
            "is_reset",
            (F.col("_drive_total") - F.col("_shift._drive_total")).alias("_drive_in_shift"),
            ((F.col("_mm_total") - F.col("_shift._mm_total")) / float(MM_PER_KM)).alias("_km_in_shift"),
        )

    return by_key(named, keys, order, shifts, ranges).drop("_vehicle", "_trip")


def shift_progress(sessions: DataFrame, breaks: Breaks = Breaks()) -> DataFrame:
    """Hours driven and kilometres made in the shift before each trip; only plausible trips count."""
    return sessions.withColumns(
        {
            "drive_before": F.col("_drive_in_shift") / float(HOUR_MICROS),
            "km_before": F.col("_km_in_shift"),
            "drive_hours": F.col("_worked") / float(HOUR_MICROS),
        }
    ).drop("_drive_in_shift", "_km_in_shift", "_worked")


def break_events(labelled: DataFrame, breaks: Breaks = Breaks()) -> DataFrame:
    """The moment and place within each included trip at which the break window opens."""
    breaks = breaks.normalized()
    window_start, window_end = F.lit(breaks.window_start_h), F.lit(breaks.window_end_h)
    before = F.col("drive_before")
    target = F.least(window_end, F.greatest(window_start, before))
    waited = F.greatest(F.lit(0.0), target - before)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (target - before) / F.col("drive_hours")))
    cap = breaks.capacity_kwh * breaks.target_soc_pct / 100.0
    energy = F.least(F.col("km_since_shift_start") * breaks.kwh_per_km, F.lit(cap))
    plate = F.coalesce(F.nullif(F.trim("plates"), F.lit("")), "plate")
    return (
        labelled.where(F.col("reason") == "included")
        .withColumns({"_target": target, "_waited": waited, "_progress": progress})
        .withColumn("km_since_shift_start", F.col("km_before") + F.col("distance_km") * F.col("_progress"))
        .withColumn("demand_kwh", energy)
        .withColumn("_bucket", direction_bucket(bearing_degrees("start_lat", "start_lon", "end_lat", "end_lon")))
        .select(
            "vehicle_code",
            plate.alias("plate"),
            "shift_start",
            from_micros(micros("trip_start") + F.round(F.col("_waited") * HOUR_MICROS).cast("long")).alias(
                "break_start"
            ),
            bankers_round("_target", 3).alias("drive_hours"),
            "km_since_shift_start",
            "demand_kwh",
            (F.col("demand_kwh") / breaks.break_h).alias("required_kw"),
            interpolate("start_lat", "end_lat", "_progress").alias("break_lat"),
            interpolate("start_lon", "end_lon", "_progress").alias("break_lon"),
            F.col("start_lat").alias("trip_start_lat"),
            F.col("start_lon").alias("trip_start_lon"),
            F.col("end_lat").alias("trip_end_lat"),
            F.col("end_lon").alias("trip_end_lon"),
            F.col("_bucket").alias("bearing_bucket"),
            compass_direction("_bucket").alias("direction"),
            F.lit(ROUTE_QUALITY).alias("route_quality"),
        )
    )


def break_diagnostics(labelled: DataFrame) -> DataFrame:
    """Trips per reason, and how often a shift was reset; reasons that do not occur count zero."""
    counts = [F.count_if(F.col("reason") == reason).alias(reason) for reason in REASONS]
    counted = labelled.agg(*counts, F.count_if("is_reset").alias("reset"))
    pairs = [F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in counted.columns]
    return counted.select(F.explode(F.array(*pairs)).alias("_x")).select("_x.*")


def _vehicle() -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim("plate"), F.lit("")), "vehicle_code"))


def quarter_slots(events: DataFrame, break_h: float = 0.75) -> DataFrame:
    """One row per quarter of an hour the break touches."""
    length = int(max(0.25, break_h) * HOUR_MICROS)
    ending = events.withColumn("_end", from_micros(micros("break_start") + length))
    slots = ending.withColumn("_slot", F.explode(slot_starts("break_start", "_end", QUARTER_MICROS)))
    return slots.withColumn("overlap_hours", overlap_hours("break_start", "_end", "_slot", QUARTER_MICROS)).withColumn(
        "slot_start", from_micros("_slot")
    ).drop("_slot", "_end")


def break_quarter_profile(events: DataFrame, break_h: float = 0.75) -> DataFrame:
    kw = F.sum("required_kw")
    return (
        quarter_slots(events, break_h)
        .groupBy("slot_start")
        .agg(
            F.count_distinct(_vehicle()).alias("vehicles"),
            bankers_round(kw, 1).alias("required_kw"),
            bankers_round(kw / 1000.0, 3).alias("required_mw"),
            bankers_round(F.sum(F.col("required_kw") * F.col("overlap_hours")), 1).alias("demand_kwh"),
        )
        .orderBy("slot_start")
    )


def break_hourly_profile(events: DataFrame, break_h: float = 0.75) -> DataFrame:
    """Per hour of the day: the highest quarter, and everything that falls in the hour; 24 rows."""
    loads = quarter_slots(events, break_h).withColumn("hour", F.hour("slot_start"))
    event = F.struct("vehicle_code", "plate", "break_start")
    totals = loads.groupBy("hour").agg(
        F.count_distinct(_vehicle()).alias("_vehicles"),
        F.count_distinct(event).alias("_events"),
        F.sum(F.col("required_kw") * F.col("overlap_hours")).alias("_kwh"),
    )
    slots = loads.groupBy("hour", "slot_start").agg(F.sum("required_kw").alias("_kw"))
    peaks = slots.groupBy("hour").agg(F.max("_kw").alias("_kw"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    kw = F.coalesce("_kw", F.lit(0.0))
    return (
        hours.join(totals, "hour", "left")
        .join(peaks, "hour", "left")
        .select(
            "hour",
            F.coalesce("_vehicles", F.lit(0)).alias("vehicles"),
            F.coalesce("_events", F.lit(0)).alias("events"),
            bankers_round(F.coalesce("_kwh", F.lit(0.0)), 1).alias("demand_kwh"),
            bankers_round(kw, 1).alias("required_kw"),
            bankers_round(kw / 1000.0, 3).alias("required_mw"),
        )
        .orderBy("hour")
    )


def break_demand_lines(events: DataFrame, breaks: Breaks = Breaks()) -> DataFrame:
    """Road lines drawn through the cells breaks fall in, busiest first."""
    breaks = breaks.normalized()
    lat, lon = bankers_round("break_lat", 3), bankers_round("break_lon", 3)
    segment = F.format_string("pauze:%d:%.3f:%.3f", F.col("bearing_bucket"), lat, lon)
    keyed = events.withColumn("segment_id", segment)
    totals = keyed.groupBy("segment_id").agg(
        F.first("bearing_bucket").alias("_bucket"),
        F.avg("break_lat").alias("_lat"),
        F.avg("break_lon").alias("_lon"),
        bankers_round(F.sum("demand_kwh"), 1).alias("total_kwh"),
        F.count_distinct(_vehicle()).alias("vehicles"),
        F.count(F.lit(1)).alias("passages"),
    )
    slots = quarter_slots(keyed, breaks.break_h).groupBy("segment_id", "slot_start").agg(
        F.sum("required_kw").alias("_kw")
    )
    peaks = slots.groupBy("segment_id").agg(bankers_round(F.max("_kw") / 1000.0, 3).alias("peak_mw"))
    bearing = F.col("_bucket") * 45.0
    back = project_point("_lat", "_lon", (bearing + 180.0) % 360.0, HALF_LINE_KM)
    ahead = project_point("_lat", "_lon", bearing, HALF_LINE_KM)
    lines = (
        totals.where(F.col("passages") >= breaks.threshold)
        .join(peaks, "segment_id")
        .withColumns({"_from": back, "_to": ahead})
        .select(
            "segment_id",
            F.col("_from.lat").alias("lat1"),
            F.col("_from.lon").alias("lon1"),
            F.col("_to.lat").alias("lat2"),
            F.col("_to.lon").alias("lon2"),
            compass_direction("_bucket").alias("direction"),
            "peak_mw",
            "total_kwh",
            "vehicles",
            "passages",
            F.lit(float(round(clamp(breaks.reset_radius_km, 0.2, 20), 2))).alias("radius_km"),
        )
    )
    share = max(0, breaks.top_percent)
    order = [F.desc("peak_mw"), F.desc("total_kwh"), "segment_id"]
    kept = heaviest(materialize(lines, "break-lines"), "passages", lambda rows: ceil(rows * share / 100.0), order)
    return kept.orderBy(F.desc("passages"), *order)


def break_demand_detail(events: DataFrame, road: Road, break_h: float = 0.75) -> DataFrame:
    """Totals of the breaks near a road."""
    near = filter_near_segment(events, road)
    peak = break_quarter_profile(near, break_h).agg(F.coalesce(F.max("required_mw"), F.lit(0.0))).scalar()
    totals = near.agg(
        bankers_round(F.coalesce(F.sum("demand_kwh"), F.lit(0.0)), 1).alias("total_kwh"),
        F.count_distinct(_vehicle()).alias("vehicles"),
        F.count(F.lit(1)).alias("passages"),
    )
    return totals.withColumn("peak_mw", peak).select("peak_mw", "total_kwh", "vehicles", "passages")


def break_vehicles(events: DataFrame, road: Road) -> DataFrame:
    """The vehicles that take their break near a road, in order of time."""
    return (
        filter_near_segment(events, road)
        .select(
            "vehicle_code",
            "plate",
            "shift_start",
            "break_start",
            bankers_round("drive_hours", 2).alias("drive_hours"),
            bankers_round("km_since_shift_start", 1).alias("km_since_shift_start"),
            bankers_round("demand_kwh", 1).alias("demand_kwh"),
            bankers_round("required_kw", 1).alias("required_kw"),
            "route_quality",
        )
        .orderBy("break_start", F.upper("vehicle_code"))
    )
