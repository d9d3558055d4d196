"""From raw text rows to typed stops and route actions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import dwell_minutes
from dwellgrid.functions.geo import location_id
from dwellgrid.functions.text import (
    blank_to_null,
    classify_carrier,
    extract_pc6,
    normalize_pc6,
    normalize_plate,
    parse_decimal,
    quoted,
    resolve_column,
    resolve_text,
    resolve_timestamp,
    text_or_empty,
)
from dwellgrid.operators.filters import TRIP_KEY
from dwellgrid.operators.ordered import Scan, Step, by_key
from dwellgrid.session import materialize

# Accepted headers per field, in order of preference.
VEHICLE = ("Wagen Code", "wagencode", "wagen_code", "vehicle_id", "vehicle_code", "voertuig", "truck_id")
CARRIER = ("Voertuig Type Eigenaar", "vervoerder", "carrier", "carrier_name", "transporteur")
CARRIER_TYPE = ("vervoerder_type", "carrier_type", "transport_type")
VEHICLE_TYPE = ("Wagentype Omschrijving", "wagentype_omschrijving", "vehicle_type", "truck_type")
TRIP = ("Tripnummer", "trip_id", "rit_id", "ritnummer", "route_id")
ACTION = ("Actie soort", "actie", "action", "action_type")
ADDRESS = ("Adres", "adres", "address", "location_address", "stop_address", "locatie", "location")
LOCATION_NAME = ("locatie_naam", "location_name", "name", "naam", "Adres", "adres", "address")
PLATE = ("Gerealizeerd Kenteken", "kenteken", "license_plate", "licence_plate", "plate")
PLANNED_START = (
    "Gepland vanaf (Trip actie)", "planned_start", "start_time", "starttijd", "Starttijd Trip", "trip_start",
    "trip_date", "date", "datum",
)
PLANNED_END = (
    "Gepland tot (Trip actie)", "planned_end", "end_time", "eindtijd", "Eindtijd Trip", "trip_end",
    "Gepland vanaf (Trip actie)", "planned_start", "trip_date", "date", "datum",
)
TRIP_KM = ("Totale Afstand (KM)", "afstand_km_trip", "trip_distance_km", "trip_km", "distance_km", "afstand_km")
SEGMENT_KM = ("afstand_km", "segment_km", "leg_km")
LATITUDE = ("lat", "latitude", "breedtegraad", "y")
LONGITUDE = ("lon", "lng", "longitude", "lengtegraad", "x")
TRAVEL_COLUMN = "Actie soort"

# Dutch column names of prepared tables and their names here.
STOP_COLUMNS = {
    "wagencode": "vehicle_code",
    "vervoerder": "carrier",
    "vervoerder_type": "carrier_type",
    "acties": "action",
    "locatie_naam": "location_name",
    "adres": "address",
    "gepland_start": "planned_start",
    "gepland_eind": "planned_end",
    "afstand_km": "segment_km",
    "afstand_km_trip": "trip_km",
    "kenteken": "plate",
    "kenteken_norm": "plate_norm",
    "wagentype_omschrijving": "vehicle_type",
    "ze_startdatum": "ze_start_date",
}


def _is_travel(name: str) -> Column:
    return F.lower(F.trim(text_or_empty(quoted(name)))) == "travel"


def travel_filter(raw: DataFrame) -> DataFrame:
    """Only travel rows, when the raw data names its actions in the expected column."""
    name = resolve_column(raw.columns, TRAVEL_COLUMN)
    return raw if name is None else raw.where(_is_travel(name))


def resolve_columns(raw: DataFrame, *extra: Column) -> DataFrame:
    """Raw text columns, whatever their headers, as one fixed set of typed columns."""
    names = raw.columns
    lat, lon = resolve_column(names, *LATITUDE), resolve_column(names, *LONGITUDE)
    has_position = lat is not None and lon is not None
    return raw.select(
        F.trim(resolve_text(names, *CARRIER)).alias("carrier"),
        F.trim(resolve_text(names, *CARRIER_TYPE)).alias("carrier_type_raw"),
        F.trim(resolve_text(names, *VEHICLE)).alias("vehicle_code"),
        F.trim(resolve_text(names, *VEHICLE_TYPE)).alias("vehicle_type"),
        F.trim(resolve_text(names, *TRIP)).alias("trip_id"),
        F.trim(resolve_text(names, *ACTION)).alias("action"),
        F.trim(resolve_text(names, *LOCATION_NAME)).alias("location_name"),
        F.trim(resolve_text(names, *ADDRESS)).alias("address"),
        F.upper(F.trim(resolve_text(names, *PLATE))).alias("plate"),
        normalize_plate(resolve_text(names, *PLATE)).alias("plate_norm"),
        resolve_timestamp(names, *PLANNED_START).alias("planned_start"),
        resolve_timestamp(names, *PLANNED_END).alias("planned_end"),
        parse_decimal(resolve_text(names, *TRIP_KM)).alias("trip_km"),
        parse_decimal(resolve_text(names, *SEGMENT_KM)).alias("segment_km"),
        *(
            [parse_decimal(quoted(lat)).alias("lat"), parse_decimal(quoted(lon)).alias("lon")]
            if has_position
            else []
        ),
        *extra,
    )


def valid_row_filter(typed: DataFrame) -> DataFrame:
    return typed.where((F.col("vehicle_code") != "") & (F.col("trip_id") != "") & F.col("planned_start").isNotNull())


def geocode_join(typed: DataFrame, geocode: DataFrame | None) -> DataFrame:
    """Own coordinates when the data carries them, else those of the exact address.

    The lookup is joined without a broadcast hint: its size picks the strategy, and an address that
    holds a large share of the rows is split by the adaptive skew join.
    """
    if "lat" in typed.columns:
        return typed
    if geocode is None:
        raise ValueError("the data has no coordinates and there is no geocode lookup")
    known = geocode.select(
        F.col("query").cast("string").alias("address"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
    )
    return typed.join(known, "address", "left")


def sequence_actions(typed: DataFrame, ranges: int | None = None) -> DataFrame:
    """Number the rows of a trip from 0, all of them (``action_seq``) and the stops among them (``stop_seq``).

    The order is start, end, address and action, and then every other column, so that it is total. Stops share one
    action, which therefore does not tell them apart: one scan numbers both. ``stop_seq`` is null on other
    rows, and without ``is_travel`` every row is a stop.
    """
    lowered = typed.withColumn("_action", F.lower("action")).withColumn("trip_date", F.col("planned_start").cast("date"))
    stop = F.col("is_travel") if "is_travel" in typed.columns else F.lit(True)
    dated = lowered.withColumns({"_open": F.col("planned_end").isNull(), "_stop": F.coalesce(stop, F.lit(False))})
    order = ["planned_start", "_open", "planned_end", "address", "_action"]

    def number(rows: DataFrame, scan: Scan) -> DataFrame:
        stops = F.when(F.col("_stop"), 1).otherwise(0)
        return scan(rows, [Step("action_seq", "sum", F.lit(1)), Step("stop_seq", "sum", stops)])

    numbered = by_key(dated, TRIP_KEY, order, number, ranges)
    stop_seq = F.when(F.col("_stop"), F.col("stop_seq").cast("int"))
    return numbered.withColumns({"action_seq": F.col("action_seq").cast("int"), "stop_seq": stop_seq}).drop("_open", "_stop", "_action")


def typed_rows(raw: DataFrame, geocode: DataFrame | None = None) -> DataFrame:
    """Usable raw rows with types and places; ``is_travel`` marks those that are stops."""
    name = resolve_column(raw.columns, TRAVEL_COLUMN)
    travel = F.lit(True) if name is None else _is_travel(name)
    return valid_row_filter(geocode_join(resolve_columns(raw, travel.alias("is_travel")), geocode))


def numbered_rows(raw: DataFrame, geocode: DataFrame | None = None) -> DataFrame:
    """Typed and numbered rows. The raw text is parsed once and the rows are put in order once, both stored; the numbers are
    worked out where the rows are read, as most questions start from actions or from stops and not from both.
    """
    return sequence_actions(materialize(typed_rows(raw, geocode), "typed"))


def route_actions(numbered: DataFrame) -> DataFrame:
    """Every action of every trip, also where its place is unknown."""
    rows = numbered.withColumn("action", F.lower("action"))
    unknown = F.lit("unknown_location")
    address = blank_to_null("address")
    return rows.select(
        "vehicle_code",
        "carrier",
        classify_carrier("carrier_type_raw", "carrier").alias("vehicle_class"),
        "trip_date",
        "trip_id",
        "action_seq",
        "action",
        F.coalesce(blank_to_null("location_name"), F.col("address"), unknown).alias("location_name"),
        F.coalesce(address, unknown).alias("address"),
        location_id("lat", "lon", address).alias("location_id"),
        "planned_start",
        "planned_end",
        dwell_minutes("planned_start", "planned_end").alias("dwell_min"),
        F.coalesce("segment_km", F.lit(0.0)).alias("segment_km"),
        F.coalesce("trip_km", F.lit(0.0)).alias("trip_km"),
        "lat",
        "lon",
        "plate",
        "plate_norm",
        "vehicle_type",
    )


def travel_stops(numbered: DataFrame) -> DataFrame:
    """Travel stops with a known place. Numbering comes first, so gaps mark dropped stops."""
    rows = numbered.where("is_travel")
    padded = F.lpad(F.col("stop_seq").cast("string"), 2, "0")
    stops = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "vehicle_code",
        "carrier",
        classify_carrier("carrier_type_raw", "carrier", "eigen", "charter", "onbekend").alias("carrier_type"),
        "trip_date",
        "trip_id",
        "stop_seq",
        "action",
        F.coalesce(blank_to_null("location_name"), F.col("address")).alias("location_name"),
        "address",
        "planned_start",
        "planned_end",
        F.coalesce("segment_km", F.lit(0.0)).alias("segment_km"),
        F.coalesce("trip_km", F.lit(0.0)).alias("trip_km"),
        dwell_minutes("planned_start", "planned_end").alias("dwell_min"),
        "lat",
        "lon",
        "plate",
        "plate_norm",
        F.concat_ws("-", "trip_id", padded).alias("trip_stop_nr"),
        "vehicle_type",
    )
    return extract_pc6_column(stops)


def build_route_actions(raw: DataFrame, geocode: DataFrame | None = None) -> DataFrame:
    """Raw rows to route actions."""
    return route_actions(numbered_rows(raw, geocode))


def build_stops(raw: DataFrame, geocode: DataFrame | None = None) -> DataFrame:
    """Raw rows to stops."""
    return travel_stops(numbered_rows(raw, geocode))


def route_actions_from_stops(stops: DataFrame) -> DataFrame:
    """Route actions when only prepared stops exist."""
    stops = backfill_columns(
        stops, {"plate": F.lit(""), "plate_norm": F.lit(""), "vehicle_type": F.lit(""), "trip_km": F.lit(0.0)}
    )
    kind, unknown = text_or_empty("carrier_type"), F.lit("unknown_location")
    return stops.select(
        "vehicle_code",
        text_or_empty("carrier").alias("carrier"),
        F.when(kind == "eigen", "own").when(kind == "charter", "charter").otherwise("unknown").alias("vehicle_class"),
        F.col("trip_date").cast("date").alias("trip_date"),
        "trip_id",
        F.coalesce(F.col("stop_seq").cast("int"), F.lit(0)).alias("action_seq"),
        F.lower(text_or_empty("action")).alias("action"),
        F.coalesce("location_name", "address", unknown).alias("location_name"),
        F.coalesce("address", unknown).alias("address"),
        location_id("lat", "lon", "address").alias("location_id"),
        "planned_start",
        "planned_end",
        dwell_minutes("planned_start", "planned_end").alias("dwell_min"),
        F.coalesce("segment_km", F.lit(0.0)).alias("segment_km"),
        F.coalesce("trip_km", F.lit(0.0)).alias("trip_km"),
        "lat",
        "lon",
        text_or_empty("plate").alias("plate"),
        text_or_empty("plate_norm").alias("plate_norm"),
        text_or_empty("vehicle_type").alias("vehicle_type"),
    )


def backfill_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are missing."""
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})


def prepared_stops(df: DataFrame) -> DataFrame:
    """Prepared stops under English names, with optional columns filled in."""
    renamed = df.select([quoted(name).alias(STOP_COLUMNS.get(name, name)) for name in df.columns])
    midnight = F.col("trip_date").cast("timestamp_ntz")
    filled = backfill_columns(
        renamed,
        {
            "planned_start": midnight,
            "planned_end": midnight,
            "segment_km": F.lit(0.0),
            "trip_km": F.lit(0.0),
            "plate": F.lit(""),
            "plate_norm": F.lit(""),
            "vehicle_type": F.lit(""),
        },
    )
    typed = filled.withColumns(
        {
            **{name: F.col(name).cast("double") for name in ("lat", "lon", "segment_km", "trip_km", "dwell_min")},
            **{name: F.col(name).cast("timestamp_ntz") for name in ("planned_start", "planned_end")},
            **{name: F.col(name).cast("string") for name in ("vehicle_code", "trip_id", "carrier", "carrier_type")},
            "trip_date": F.col("trip_date").cast("date"),
            "stop_seq": F.coalesce(F.col("stop_seq").cast("int"), F.lit(0)),
        }
    )
    return extract_pc6_column(typed)


def extract_pc6_column(stops: DataFrame) -> DataFrame:
    return stops.withColumn("pc6", extract_pc6("address"))


def dedupe_ze_zones(zones: DataFrame) -> DataFrame:
    """One zone per postcode, the first by name."""
    first = F.min(F.struct("ze_zone", "ze_start_date")).alias("_zone")
    return (
        zones.groupBy(normalize_pc6("pc6").alias("pc6"))
        .agg(first)
        .where(F.col("pc6") != "")
        .select("pc6", "_zone.ze_zone", "_zone.ze_start_date")
    )


def enrich_ze_zone(stops: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Zone, start date and in_zez per stop, by the postcode in its address."""
    blank = F.lit("")
    if zones is None:
        return stops.withColumns({"ze_zone": blank, "ze_start_date": blank, "in_zez": F.lit(False)})
    lookup = dedupe_ze_zones(zones).withColumn("in_zez", F.lit(True))
    bare = stops.drop("ze_zone", "ze_start_date", "in_zez")
    return bare.join(lookup, "pc6", "left").select(
        *bare.columns,
        F.coalesce("ze_zone", blank).alias("ze_zone"),
        F.coalesce("ze_start_date", blank).alias("ze_start_date"),
        F.coalesce("in_zez", F.lit(False)).alias("in_zez"),
    )
