"""Row filters shared by all questions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.geo import haversine_km, point_segment_km
from dwellgrid.params import ChargerFilter, Filter, Power, Road, vehicle_classes

# Actions during which a vehicle stands still and could charge.
CHARGE_WINDOW_ACTIONS = ("wait_task_available", "wait_after", "wait_action", "pause")

TRIP_KEY = ["vehicle_code", "trip_date", "trip_id"]
DAY_KEY = ["vehicle_code", "trip_date"]
KM_PER_LATITUDE = 111.0


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def not_administrative(action="action") -> Column:
    return ~F.lower(F.coalesce(F.col(action), F.lit(""))).contains("administrative")


def date_range(flt: Filter, column: str = "trip_date") -> list[Column]:
    bounds = []
    if flt.date_from is not None:
        bounds.append(F.col(column) >= F.lit(flt.date_from))
    if flt.date_to is not None:
        bounds.append(F.col(column) <= F.lit(flt.date_to))
    return bounds


def in_list(column: str, values) -> list[Column]:
    return [F.col(column).isin(*values)] if values else []


def vehicle_in(values) -> list[Column]:
    """A vehicle matches by its code, its plate as written, or its plate without punctuation."""
    raw = list(dict.fromkeys(v.strip() for v in values if v and v.strip()))
    if not raw:
        return []
    plates = [p for p in dict.fromkeys("".join(c for c in v.upper() if c.isalnum()) for v in raw) if p]
    match = F.col("vehicle_code").isin(*raw) | F.col("plate").isin(*raw)
    return [match | F.col("plate_norm").isin(*plates) if plates else match]


def ze_stop(mode: str) -> list[Column]:
    inside = F.coalesce(F.col("in_zez"), F.lit(False))
    return {"in": [inside], "out": [~inside]}.get(mode, [])


def filter_date_range(df: DataFrame, flt: Filter, column: str = "trip_date") -> DataFrame:
    return df.where(_all(date_range(flt, column)))


def filter_in_list(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(_all(in_list(column, values)))


def filter_vehicle(df: DataFrame, values) -> DataFrame:
    return df.where(_all(vehicle_in(values)))


def filter_ze_stops(stops: DataFrame, mode: str) -> DataFrame:
    return stops.where(_all(ze_stop(mode)))


def filter_ze_trips(df: DataFrame, stops: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Rows with some stop inside (or some stop outside) a zone; a trip can qualify for both."""
    if mode not in ("in", "out"):
        return df
    # Reduced to distinct keys before the join, so a key with many stops does not weigh on it.
    matching = filter_ze_stops(stops, mode).select(*keys).distinct()
    return df.join(matching, keys, "left_semi")


def _common(flt: Filter) -> list[Column]:
    return [
        *date_range(flt),
        *in_list("carrier_type", flt.carrier_types),
        *in_list("carrier", flt.carriers),
        *vehicle_in(flt.vehicle_codes),
    ]


def filter_stops(stops: DataFrame, flt: Filter) -> DataFrame:
    flt = flt.normalized()
    conditions = [F.col("lat").isNotNull(), F.col("lon").isNotNull(), not_administrative()]
    if flt.min_dwell_min > 0:
        conditions.append(F.coalesce(F.col("dwell_min"), F.lit(0.0)) >= flt.min_dwell_min)
    return stops.where(_all([*conditions, *_common(flt), *ze_stop(flt.ze_mode)]))


def filter_daily_trips(daily_trips: DataFrame, stops: DataFrame, flt: Filter) -> DataFrame:
    flt = flt.normalized()
    kept = daily_trips.where(_all([F.col("distance_km") >= 0, *_common(flt)]))
    return filter_ze_trips(kept, stops, flt.ze_mode, TRIP_KEY)


def filter_overnight(overnight: DataFrame, stops: DataFrame, flt: Filter) -> DataFrame:
    flt = flt.normalized()
    kept = overnight.where(_all([F.col("day_km") >= 0, *_common(flt)]))
    return filter_ze_trips(kept, stops, flt.ze_mode, DAY_KEY)


def _box(lat: str, lon: str, mid_lat: float, mid_lon: float, radius_km: float, lon_floor_km: float) -> list[Column]:
    """Plain range predicates around a point, which reach the scan before the exact distance."""
    from math import cos, radians

    lat_span = radius_km / KM_PER_LATITUDE
    lon_span = radius_km / max(lon_floor_km, KM_PER_LATITUDE * cos(radians(mid_lat)))
    return [
        F.col(lat).between(mid_lat - lat_span, mid_lat + lat_span),
        F.col(lon).between(mid_lon - lon_span, mid_lon + lon_span),
    ]


def _around(lat: str, lon: str, mid_lat: float, mid_lon: float, radius_km: float) -> list[Column]:
    """Ranges that hold every point within the radius, twice as wide as that; near a pole or the date line latitudes only."""
    from math import cos, radians

    span = 2 * radius_km / KM_PER_LATITUDE
    found = [F.col(lat).between(mid_lat - span, mid_lat + span)]
    if abs(mid_lat) + span < 89.0:
        wide = span / cos(radians(abs(mid_lat) + span))
        if abs(mid_lon) + wide < 180.0:
            found.append(F.col(lon).between(mid_lon - wide, mid_lon + wide))
    return found


def filter_within_radius(overnight: DataFrame, lat: float, lon: float, radius_km: float, flt: Filter) -> DataFrame:
    """Overnight events that start within a radius; the zone mode plays no part here."""
    flt = flt.normalized()
    lat, lon = max(-90.0, min(lat, 90.0)), max(-180.0, min(lon, 180.0))
    radius_km = max(0.1, min(radius_km, 5.0))
    return overnight.where(
        _all(
            [
                F.col("day_km") >= 0,
                *_around("start_lat", "start_lon", lat, lon, radius_km),
                haversine_km("start_lat", "start_lon", lat, lon) <= radius_km,
                *_common(flt),
            ]
        )
    )


def filter_depot(overnight: DataFrame, depot_id: str) -> DataFrame:
    """Overnight events of one home location. Its id names a cell of places, which the scan can look for."""
    depot_id = depot_id.strip()
    conditions = [F.col("depot_id") == depot_id]
    if cell := re.fullmatch(r"auto:(-?\d+\.\d{3}):(-?\d+\.\d{3})", depot_id):
        for name, middle in zip(("start_lat", "start_lon"), map(float, cell.groups()), strict=True):
            conditions.append(F.col(name).between(middle - 0.001, middle + 0.001))
    return overnight.where(_all(conditions))


def filter_road_selection(index: DataFrame, road: Road, flt: Filter) -> DataFrame:
    """Trips whose midpoint lies near the midpoint of the selected segment."""
    flt, road = flt.normalized(), road.for_selection()
    return index.where(
        _all(
            [
                *_box("mid_lat", "mid_lon", road.mid_lat, road.mid_lon, road.radius_km, 20.0),
                haversine_km("mid_lat", "mid_lon", road.mid_lat, road.mid_lon) <= road.radius_km,
                *_common(flt),
            ]
        )
    )


def filter_power_actions(
    actions: DataFrame, flt: Filter, power: Power = Power(), only_charge_windows: bool = False
) -> DataFrame:
    """Actions with a length; class defaults to the carrier types asked for."""
    flt = flt.normalized()
    conditions = [
        F.col("planned_start").isNotNull(),
        F.col("planned_end").isNotNull(),
        F.col("planned_end") > F.col("planned_start"),
        *date_range(flt),
    ]
    if only_charge_windows:
        conditions.append(F.col("action").isin(*CHARGE_WINDOW_ACTIONS))
    if flt.min_dwell_min > 0:
        conditions.append(F.coalesce(F.col("dwell_min"), F.lit(0.0)) >= flt.min_dwell_min)
    classes = vehicle_classes(power.vehicle_classes)
    if not classes:
        english = {"eigen": "own", "onbekend": "unknown"}
        classes = tuple(english.get(kind.lower(), kind) for kind in flt.carrier_types)
    conditions += in_list("vehicle_class", classes)
    conditions += in_list("carrier", flt.carriers)
    conditions += vehicle_in(flt.vehicle_codes)
    return actions.where(_all(conditions))


def filter_chargers(chargers: DataFrame, flt: ChargerFilter) -> DataFrame:
    flt = flt.normalized()
    conditions = [
        F.col("lat").isNotNull(),
        F.col("lon").isNotNull(),
        F.coalesce(F.col("max_power_kw"), F.lit(0.0)) >= flt.min_power_kw,
        F.coalesce(F.col("connectors"), F.lit(0)) >= flt.min_connectors,
    ]
    if flt.only_dedicated:
        conditions.append(F.col("dedicated") == "Ja")
    return chargers.where(_all([*conditions, *in_list("access", flt.access)]))


def filter_near_segment(events: DataFrame, road: Road) -> DataFrame:
    """Break events within a radius of a road segment."""
    road = road.for_break_detail()
    km = point_segment_km("break_lat", "break_lon", road.lat1, road.lon1, road.lat2, road.lon2)
    return events.where(km <= road.radius_km)


def road_variant_choice(flt: Filter, min_date=None, max_date=None) -> str | None:
    """Which precomputed road table answers the filter; None when none does."""
    types = flt.normalized().carrier_types
    narrower = (flt.date_from and min_date and flt.date_from > min_date) or (
        flt.date_to and max_date and flt.date_to < max_date
    )
    if flt.carriers or flt.vehicle_codes or flt.min_dwell_min > 0 or narrower:
        return None
    return {(): "full", ("eigen",): "eigen", ("charter",): "charter"}.get(types)


def road_variant(roads: DataFrame, flt: Filter, min_date=None, max_date=None) -> DataFrame:
    """Rows of the variant that answers the filter, or none."""
    variant = road_variant_choice(flt, min_date, max_date)
    return roads.where(F.lit(False) if variant is None else F.col("variant") == variant)
