"""Power a location needs: presence windows, hourly profiles, diagnostics and future scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import hours_between, micros
from dwellgrid.functions.geo import bankers_round
from dwellgrid.functions.text import text_or_empty, vehicle_key
from dwellgrid.operators.aggregates import mode_text
from dwellgrid.operators.demand import hour_slots
from dwellgrid.operators.filters import CHARGE_WINDOW_ACTIONS, TRIP_KEY, filter_power_actions
from dwellgrid.operators.ordered import Scan, Step, by_runs
from dwellgrid.operators.overview import first_rows
from dwellgrid.operators.ranking import ranked
from dwellgrid.operators.sweep import first_slots, stretches
from dwellgrid.params import Filter, Power
from dwellgrid.session import materialize

MERGE_GAP_MINUTES = 5
WINDOW_COLUMNS = [
    "vehicle_code", "vehicle_key", "plate", "vehicle_class", "trip_date", "trip_id", "action_seq", "action",
    "location_id", "location_name", "address", "vehicle_type", "distance_km", "planned_start", "planned_end",
    "dwell_min", "lat", "lon",
]


def power_events(actions: DataFrame) -> DataFrame:
    """Route actions in the shape the presence windows work on."""
    km = F.greatest(F.coalesce("trip_km", F.lit(0.0)), F.coalesce("segment_km", F.lit(0.0)), F.lit(0.0))
    name = F.coalesce(F.nullif("location_name", F.lit("")), "address", "location_id")
    derived = {
        "vehicle_key": vehicle_key("plate_norm", "vehicle_code"),
        "plate": text_or_empty("plate"),
        "location_name": name,
        "address": text_or_empty("address"),
        "vehicle_type": text_or_empty("vehicle_type"),
        "distance_km": km,
        "dwell_min": F.greatest(F.coalesce("dwell_min", F.lit(0.0)), F.lit(0.0)),
        "lat": F.coalesce("lat", F.lit(0.0)),
        "lon": F.coalesce("lon", F.lit(0.0)),
    }
    return actions.withColumns(derived).select(*WINDOW_COLUMNS)


def _minutes(start: str, end: str) -> Column:
    return hours_between(start, end) * 60.0


def presence_windows(actions: DataFrame, ranges: int | None = None) -> DataFrame:
    """Uninterrupted stays of a vehicle at one place within a trip that allow charging.

    Consecutive actions at one place are one stay. The stay counts when any action in it is a charge
    window, and begins when the vehicle arrives: at the end of a travel action.
    """
    keys, order = ["vehicle_key", "trip_date", "trip_id"], ["planned_start", "action_seq"]
    # The end comes last, so that it settles the order only of rows that are equal in all a stay shows of its first one.
    columns = [*[c for c in WINDOW_COLUMNS if c not in ("planned_end", "dwell_min")], "planned_end"]
    usable = power_events(actions).select(*columns).where(F.col("planned_end") > F.col("planned_start"))
    place = F.lower("location_id")
    arrival = F.when(F.lower("action") == "travel", F.col("planned_end")).otherwise(F.col("planned_start"))

    def moves(rows: DataFrame, scan: Scan) -> DataFrame:
        seen = scan(rows, [Step("_place_before", "lag", place)])
        return seen.withColumn("_opens", F.when(F.col("_place_before") == place, 0).otherwise(1))

    kinds = {
        "_arrival": (F.min, arrival),
        "planned_end": (F.max, F.col("planned_end")),
        "_charges": (F.max, F.lower("action").isin(*CHARGE_WINDOW_ACTIONS)),
    }
    counts = F.col("_charges") & (F.col("planned_end") > F.col("_arrival"))
    stays = by_runs(usable, keys, order, moves, kinds, counts, ranges).withColumn("planned_start", F.col("_arrival"))
    return stays.withColumn("dwell_min", _minutes("planned_start", "planned_end")).select(*WINDOW_COLUMNS)


def merge_presence_windows(
    windows: DataFrame, gap_min: float = MERGE_GAP_MINUTES, ranges: int | None = None
) -> DataFrame:
    """Join windows of a vehicle at a place that overlap or follow within ``gap_min`` minutes."""
    keys = ["_vehicle", "_place"]
    order = ["planned_start", "planned_end", "trip_date", "trip_id", "action_seq", "vehicle_code"]
    identity = F.when(
        F.trim("vehicle_key") == "", F.concat_ws("|", "vehicle_code", "plate")
    ).otherwise(F.col("vehicle_key"))
    named = windows.drop("dwell_min").withColumns({"_vehicle": F.lower(identity), "_place": F.lower("location_id")})
    gap = int(gap_min * 60_000_000)

    def parts(rows: DataFrame, scan: Scan) -> DataFrame:
        seen = scan(rows, [Step("_until", "max", F.col("planned_end"))])
        follows = micros("planned_start") <= micros("_until") + gap
        return seen.withColumn("_opens", F.when(follows, 0).otherwise(1))

    kinds = {"_begin": (F.min, F.col("planned_start")), "planned_end": (F.max, F.col("planned_end"))}
    merged = by_runs(named, keys, order, parts, kinds, ranges=ranges).withColumn("planned_start", F.col("_begin"))
    return merged.withColumn("dwell_min", _minutes("planned_start", "planned_end")).select(*WINDOW_COLUMNS)


def power_windows(actions: DataFrame, flt: Filter = Filter(), power: Power = Power()) -> DataFrame:
    """Filtered actions as merged presence windows; the filter comes first and so shapes the stays.

    Stored, because every profile reads the windows several times.
    """
    return materialize(merge_presence_windows(presence_windows(filter_power_actions(actions, flt, power))), "power-windows")


def window_kw(power: Power) -> Column:
    """Battery over standstill, held to what the vehicle accepts."""
    hours = F.greatest(hours_between("planned_start", "planned_end"), F.col("dwell_min") / 60.0)
    accepted = F.least(F.lit(float(power.max_vehicle_kw)), F.lit(float(power.capacity_kwh)) / hours)
    return F.when(hours > 0, accepted).otherwise(F.lit(0.0))


def _loaded(windows: DataFrame, power: Power) -> DataFrame:
    return windows.withColumn("required_kw", window_kw(power.normalized())).withColumn("vehicle", F.upper("vehicle_key"))


def load_stretches(windows: DataFrame, keys: list[str], power: Power) -> DataFrame:
    """What every profile reads: vehicles, windows and power per key and run of clock hours that are alike."""
    return stretches(_loaded(windows, power), keys, "planned_start", "planned_end")


def _hourly(windows: DataFrame, keys: list[str], power: Power) -> DataFrame:
    return _busiest(load_stretches(windows, keys, power), keys)


def _busiest(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and hour of the day the dated hour with most power, then most vehicles."""
    slots = first_slots(loads, 24)
    order = F.struct("required_kw", "vehicles", -micros("slot"))
    best = F.max_by(F.struct("vehicles", "events", "required_kw", F.col("slot").cast("date").alias("date")), order)
    return slots.groupBy(*keys, F.hour("slot").alias("hour")).agg(best.alias("_best"))


def _hourly_cells(cells: DataFrame, peaks: DataFrame, keys: list[str], *others: str) -> DataFrame:
    kw = bankers_round(F.coalesce("_best.required_kw", F.lit(0.0)), 0)
    return cells.join(peaks, [*keys, "hour"], "left").select(
        *keys,
        *others,
        "hour",
        F.coalesce("_best.vehicles", F.lit(0)).alias("vehicles"),
        F.coalesce("_best.events", F.lit(0)).alias("events"),
        kw.alias("required_kw"),
        bankers_round(kw / 1000.0, 2).alias("required_mw"),
        F.col("_best.date").alias("date"),
    )


def hours_of(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def _by_place(windows: DataFrame) -> DataFrame:
    return windows.withColumn("_place", F.lower("location_id"))


def place_loads(windows: DataFrame, power: Power = Power()) -> DataFrame:
    """The stretches of every place, stored: peaks and hours of places both come from them."""
    return materialize(load_stretches(_by_place(windows), ["_place"], power), "place-loads")


def hourly_power_profile(windows: DataFrame, power: Power = Power(), loads: DataFrame | None = None) -> DataFrame:
    """24 rows per location, zeros included; ``loads`` are the ``place_loads`` of these or more windows, if already there."""
    placed = _by_place(windows)
    busiest = _hourly(placed, ["_place"], power) if loads is None else _busiest(loads, ["_place"])
    places = placed.select("_place", "location_id").distinct().groupBy("_place").agg(F.min("location_id").alias("location_id"))
    cells = _hourly_cells(hours_of(places.select("_place")), busiest, ["_place"])
    return cells.join(places, "_place").select("location_id", *[c for c in cells.columns if c != "_place"])


def _presence(windows: DataFrame, key: str) -> DataFrame:
    """Per key who was present, for how long and where.

    Vehicles and trips are told apart by a grouping each, and what is left of both is added up with the counts and sums;
    distinct counts in one aggregation would repeat every row for each of them.
    """
    vehicle = F.upper("vehicle_key")
    present = windows.where(vehicle.isNotNull()).groupBy(key, vehicle.alias("_vehicle")).agg(
        *[F.coalesce(F.max(F.col("vehicle_class") == kind), F.lit(False)).alias(f"_{kind}") for kind in ("own", "charter")]
    )
    trips = windows.where(F.col("trip_id").isNotNull()).select(key, F.upper("trip_id").alias("_trip")).distinct()
    apart = {
        "vehicles": present.groupBy(key).agg(F.count(F.lit(1)).alias("vehicles"), *[F.count_if(f"_{k}").alias(k) for k in ("own", "charter")]),
        "trips": trips.groupBy(key).agg(F.count(F.lit(1)).alias("trips")),
    }

    def known(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name))

    measured = {"lat": known("lat"), "lon": known("lon"), "dwell": F.col("dwell_min")}
    sums = [f(value).alias(f"_{n}_{name}") for name, value in measured.items() for n, f in (("sum", F.sum), ("n", F.count))]
    rows = windows.groupBy(key, "location_id").agg(F.count(F.lit(1)).alias("events"), *sums)
    for found in apart.values():
        rows = rows.unionByName(found, allowMissingColumns=True)
    added = [c for c in rows.columns if c not in (key, "location_id")]
    totals = rows.groupBy(key).agg(F.min("location_id").alias("location_id"), *[F.sum(c).alias(c) for c in added])

    def mean(name: str) -> Column:
        return F.when(F.col(f"_n_{name}") > 0, F.col(f"_sum_{name}") / F.col(f"_n_{name}"))

    return totals.select(
        key,
        "location_id",
        *[bankers_round(F.coalesce(mean(name), F.lit(0.0)), 6).alias(name) for name in ("lat", "lon")],
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("vehicles", "own", "charter", "trips")],
        "events",
        bankers_round(mean("dwell"), 1).alias("avg_dwell_min"),
    )


def _peak(loads: DataFrame, key: str) -> DataFrame:
    return loads.groupBy(key).agg(bankers_round(F.max("required_kw"), 0).alias("peak_kw"))


def power_location_profile(
    windows: DataFrame, power: Power = Power(), top_n: int | None = None, loads: DataFrame | None = None
) -> DataFrame:
    """Locations by peak power; the top ``top_n``, or as many as the arguments ask for.

    Names and addresses are counted only for the locations that can be among them. ``loads`` are the ``place_loads`` of
    the windows, if already there.
    """
    power = power.normalized()
    limit = power.top_locations if top_n is None else top_n
    placed = _by_place(windows)
    key = ["_place"]

    totals = _presence(placed, "_place")
    loads = load_stretches(placed, key, power) if loads is None else loads
    measured = totals.join(_peak(loads, "_place"), key, "left").withColumn("peak_kw", F.coalesce("peak_kw", F.lit(0.0)))
    measured = materialize(measured, "places")
    by = [F.desc("peak_kw"), F.desc("vehicles")]
    last = first_rows(measured.orderBy(*by), limit).agg(F.min(F.struct("peak_kw", "vehicles"))).scalar()
    shown = measured.where(F.struct("peak_kw", "vehicles") >= last)
    named = placed.join(shown.select("_place"), key, "left_semi")
    ranked = (
        shown.join(mode_text(named, key, "location_name", "_name"), key, "left")
        .join(mode_text(named, key, "address", "_address"), key, "left")
        .select(
            "location_id",
            F.coalesce("_name", F.lit("")).alias("name"),
            F.coalesce("_address", F.lit("")).alias("address"),
            "lat", "lon", "vehicles", "own", "charter", "trips", "events", "avg_dwell_min", "peak_kw",
        )
    )
    return top_places(ranked, limit)


def top_places(profile: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of a location profile in its order, or all of them."""
    return first_rows(profile.orderBy(F.desc("peak_kw"), F.desc("vehicles"), F.upper("name"), "location_id"), limit)


def power_daily_metrics(windows: DataFrame, power: Power = Power()) -> DataFrame:
    """Per trip date: who was present, and the peak of that day's windows."""
    dated = windows.withColumnRenamed("trip_date", "date")
    totals = _presence(dated, "date").drop("location_id", "lat", "lon")
    peaks = _peak(load_stretches(dated, ["date"], power), "date")
    return totals.join(peaks, "date", "left").withColumn("peak_kw", F.coalesce("peak_kw", F.lit(0.0))).orderBy("date")


def top_power_days(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.desc("peak_kw"), F.desc("vehicles"), "date").limit(10)


def power_heatmap(
    windows: DataFrame, power: Power = Power(), loads: DataFrame | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """24 hours of each of the top locations; ``loads`` and the ``profile`` of all places of the windows, if already there."""
    loads = place_loads(windows, power) if loads is None else loads
    if profile is None:
        top = power_location_profile(windows, power, loads=loads)
    else:
        top = top_places(profile, power.normalized().top_locations)
    top = top.select(
        "location_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "address").alias("location_name")
    )
    top = materialize(top, "top-places")
    places = _by_place(top).select("_place")
    shown = _by_place(windows).join(places, "_place", "left_semi").drop("_place")
    hourly = hourly_power_profile(shown, power, loads.join(places, "_place", "left_semi"))
    return hourly.join(top, "location_id").select(
        "location_id", "location_name", "hour", "vehicles", "required_kw", "required_mw"
    )


def power_slot_vehicles(windows: DataFrame, power: Power = Power()) -> DataFrame:
    """Per location, dated hour and vehicle: every window it touches counts with the full battery."""
    power = power.normalized()
    slots = _by_place(hour_slots(_loaded(windows, power), "planned_start", "planned_end"))
    slots = slots.withColumn("_hours", hours_between("planned_start", "planned_end"))
    return (
        slots.groupBy("_place", "slot", "vehicle")
        .agg(
            F.min("location_id").alias("location_id"),
            F.min("vehicle_code").alias("vehicle_code"),
            F.min(F.coalesce(F.nullif(F.trim("plate"), F.lit("")), F.lit("-"))).alias("plate"),
            F.min("vehicle_class").alias("class"),
            bankers_round(F.count(F.lit(1)) * F.lit(float(power.capacity_kwh)), 0).alias("demand_kwh"),
            bankers_round(F.sum("required_kw"), 0).alias("required_kw"),
            bankers_round(F.max("_hours"), 3).alias("standing_hours"),
            F.concat_ws(
                "-", F.date_format(F.min("planned_start"), "HH:mm"), F.date_format(F.max("planned_end"), "HH:mm")
            ).alias("window"),
        )
        .drop("_place", "vehicle")
    )


def scenario_profiles(windows: DataFrame, power: Power = Power()) -> DataFrame:
    """Hourly profile per future year, scaled to the electric vehicles expected by then.

    The cherry-pick mode first keeps the longest windows, one per expected vehicle, and then scales too: the windows are
    ranked once, and each goes to the years that expect at least as many.
    """
    power = power.normalized()
    inflow = {i.year: max(0, i.tractors + i.box_trucks) for i in power.inflows}
    years = F.array(
        *[F.struct(F.lit(y).alias("year"), F.lit(inflow.get(y, 0)).alias("expected")) for y in dict.fromkeys(power.scenario_years)]
    )
    present = windows.agg(F.greatest(F.count_distinct(F.upper("vehicle_key")), F.lit(1))).scalar()
    hours = windows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"), F.lit("all").alias("_all"))
    cells = hours.withColumn("_year", F.explode(years)).select("hour", "_all", "_year.*")
    if power.scenario_mode == "cherry-pick":
        order = [F.desc("dwell_min"), "planned_start", "vehicle_code", "trip_id", "action_seq"]
        most = max([inflow.get(y, 0) for y in power.scenario_years], default=0)
        places = ranked(windows, order, "_rank").where(F.col("_rank") <= most)
        taken = places.withColumn("_year", F.explode(F.filter(years, lambda y: y["expected"] >= F.col("_rank"))))
        keys = ["year"]
        peaks = _hourly(taken.withColumn("year", F.col("_year.year")), keys, power)
    else:
        keys = ["_all"]
        peaks = _hourly(windows.withColumn("_all", F.lit("all")), keys, power)
    shown = _hourly_cells(cells, peaks, keys, "expected", *[c for c in ("year", "_all") if c not in keys])
    scale = bankers_round(F.least(F.lit(1.0), F.col("expected").cast("double") / present), 4)
    factor = F.col("scale_factor")
    return shown.withColumn("scale_factor", scale).select(
        "year",
        F.lit(power.scenario_mode).alias("mode"),
        "scale_factor",
        "hour",
        F.ceil(F.round(F.col("vehicles") * factor, 9)).alias("vehicles"),
        F.ceil(F.round(F.col("events") * factor, 9)).alias("events"),
        bankers_round(F.col("required_kw") * factor, 0).alias("required_kw"),
        bankers_round(F.col("required_kw") * factor / 1000.0, 2).alias("required_mw"),
    ).orderBy("year", "hour")


# --- diagnostics ---------------------------------------------------------------------------------


def power_diagnostics(actions: DataFrame, flt: Filter = Filter()) -> DataFrame:
    missing = F.col("location_id").startswith("unknown_location:") | F.col("lat").isNull() | F.col("lon").isNull()
    return filter_power_actions(actions, flt).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("action").isin(*CHARGE_WINDOW_ACTIONS)).alias("charge_window"),
        F.count_if(missing).alias("missing_location"),
        F.count_if(F.col("vehicle_class") == "unknown").alias("unknown_class"),
    )


def routes_without_wait(actions: DataFrame, flt: Filter = Filter()) -> DataFrame:
    """Trips without any charge window. One pass: a trip needs no join with itself for this."""
    waits = F.bool_or(F.col("action").isin(*CHARGE_WINDOW_ACTIONS)).alias("_waits")
    trips = filter_power_actions(actions, flt).groupBy(*TRIP_KEY).agg(waits)
    return trips.agg(F.count_if(~F.col("_waits")).alias("n"))


def vehicle_class_counts(actions: DataFrame, flt: Filter = Filter()) -> DataFrame:
    return (
        filter_power_actions(actions, flt)
        .groupBy(F.col("vehicle_class").alias("class"))
        .agg(
            F.count_distinct(vehicle_key("plate_norm", "vehicle_code")).alias("vehicles"),
            F.count(F.lit(1)).alias("events"),
        )
        .orderBy("class")
    )


def fleet_match_count(actions: DataFrame, fleet_vehicles: DataFrame) -> DataFrame:
    """Vehicles seen in the actions that the fleet list knows, by fleet number or plate."""
    seen = actions.select(vehicle_key("plate_norm", "vehicle_code").alias("_key")).distinct()
    numbers = fleet_vehicles.select(F.trim("fleet_no").alias("_key"))
    known = numbers.unionByName(fleet_vehicles.select(F.col("plate_norm").alias("_key"))).where(F.col("_key") != "")
    return seen.join(known.distinct(), "_key", "left_semi").agg(F.count(F.lit(1)).alias("n"))
