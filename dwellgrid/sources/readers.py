"""Scans: every input of the engine as a DataFrame under English column names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions.text import (
    normalize_pc6,
    normalize_plate,
    quoted,
    text_or_empty,
)
from dwellgrid.operators.ingest import prepared_stops
from dwellgrid.sources.quoted import breaks_inside_quotes, scan_quoted_csv

VARIANTS = ("full", "eigen", "charter")

# Charger columns and their names here.
CHARGER_TEXTS = {
    "name": "name",
    "operator": "operator",
    "address": "address",
    "town": "town",
    "postcode": "postcode",
    "toegankelijkheid": "access",
    "twentyfour_seven": "open_24_7",
    "dedicated": "dedicated",
    "ccs_mcs": "connector_type",
}

# Headers of the fleet lists, by the name used here, in order of preference.
DEPOT_HEADERS = {"name": ("opstapplaats",), "location_type": ("type_locatie",)}
VEHICLE_HEADERS = {
    "fleet_no": ("vloot-______nummer", "vlootnummer", "vloot-nummer", "vloot-_nummer", "vloot"),
    "plate": ("kenteken",),
    "region": ("regio",),
    "depot": ("opstapplaats",),
    "location_type": ("type_locatie", "type___________________locatie:"),
    "brand": ("merk",),
    "kind": ("soort_voertuig", "soort____________voertuig:"),
    "fuel": ("soort_brandstof", "soort_____________________brandstof:"),
}
BASE_HEADERS = {
    "address": ("standplaats:_adres", "standplaats_adres"),
    "place": ("standplaats:_plaats", "standplaats_plaats"),
    "country": ("standplaats:_land", "standplaats_land"),
}
CHARTER_VEHICLE_HEADERS = {
    "fleet_no": ("voertuig:_wagencode", "voertuig_wagencode", "wagencode"),
    "kind": ("type_voertuig",),
    "fuel": ("brandstoftype",),
    "location_type": ("inzet_type",),
    **BASE_HEADERS,
}


def _csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text, and ``filename``; an empty field is null, quoted or not.

    Spark's reader splits files at any line end, so files with line breaks inside quotes go another way.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("multiLine", False)
        # A file whose header differs from the others in its folder is an error, not shifted columns.
        .option("enforceSchema", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    names = raw.columns
    if breaks_inside_quotes(spark, paths):
        raw = scan_quoted_csv(spark, paths, names)
    else:
        raw = raw.select("*", F.input_file_name().alias("filename"))
    return raw.select(*[F.nullif(quoted(name), F.lit("")).alias(name) for name in names], "filename")


def scan_trip_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Trip files as text columns, joined by header name, with the file each row came from.

    Files with the same header are best passed as one folder: each path is one header.
    """
    parts = [_csv(spark, path) for path in paths]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def scan_stops_parquet(spark: SparkSession, path: str) -> DataFrame:
    return prepared_stops(spark.read.parquet(path))


def scan_road_variants(spark: SparkSession, edge_paths: dict[str, str]) -> DataFrame:
    """Precomputed edges of each variant."""
    parts = [
        spark.read.parquet(path).select(
            F.lit(variant).alias("variant"),
            "lat1", "lon1", "lat2", "lon2",
            F.col("n_wagens").cast("int").alias("n_vehicles"),
            F.col("n_passes").cast("int").alias("n_passes"),
        )
        for variant, path in edge_paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def scan_road_heat(spark: SparkSession, heat_paths: dict[str, str]) -> DataFrame:
    """Precomputed heat points of each variant."""
    parts = [
        spark.read.parquet(path).select(
            F.lit(variant).alias("variant"), "lat", "lon", F.col("weight").cast("double").alias("weight")
        )
        for variant, path in heat_paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def scan_chargers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    texts = [text_or_empty(source).alias(name) for source, name in CHARGER_TEXTS.items()]
    by_name = dict(zip(CHARGER_TEXTS.values(), texts, strict=True))
    return raw.select(
        F.col("LocatieID").cast("long").alias("id"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        *[by_name[name] for name in ("name", "operator", "address", "town", "postcode")],
        F.coalesce(F.col("max_power_kw").cast("double"), F.lit(0.0)).alias("max_power_kw"),
        F.coalesce(F.col("n_connectors").cast("long"), F.lit(0)).alias("connectors"),
        *[by_name[name] for name in ("access", "open_24_7", "dedicated", "connector_type")],
    )


def scan_geocode(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        F.col("query").cast("string").alias("query"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
    )


def scan_ze_zones(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Zones per postcode; with an 'in zone' column present, only the rows that say yes."""
    raw = _with_normal_headers(_csv(spark, paths))
    if "in_zero_emissie_zone" in raw.columns:
        raw = raw.where(F.lower(text_or_empty("in_zero_emissie_zone")) == "ja")
    start = F.trim(text_or_empty("ze_startdatum")) if "ze_startdatum" in raw.columns else F.lit("")
    zones = raw.select(
        normalize_pc6("pc6").alias("pc6"), F.trim(text_or_empty("ze_zone")).alias("ze_zone"), start.alias("ze_start_date")
    )
    return zones.where((F.col("pc6") != "") & (F.col("ze_zone") != ""))


def _with_normal_headers(df: DataFrame) -> DataFrame:
    return df.select([quoted(name).alias(name.strip().lower().replace(" ", "_")) for name in df.columns])


def _pick(df: DataFrame, headers: dict[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Columns found by part of their header, '' (null for optional keys) when absent."""
    normal = _with_normal_headers(df)
    chosen = {}
    for name, candidates in headers.items():
        found = (h for c in candidates for h in normal.columns if c in h)
        header = next(found, None)
        if header is None and name in required:
            raise ValueError(f"no column for {name} among {normal.columns}")
        chosen[name] = F.lit(None).cast("string") if header is None else F.trim(text_or_empty(quoted(header)))
    return normal.select([value.alias(name) for name, value in chosen.items()])


def scan_fleet_depots(spark: SparkSession, path: str) -> DataFrame:
    return _pick(_csv(spark, path), DEPOT_HEADERS, ["name"])


def scan_fleet_vehicles(spark: SparkSession, path: str) -> DataFrame:
    picked = _pick(_csv(spark, path), VEHICLE_HEADERS, ["plate", "depot"])
    filled = picked.select([text_or_empty(name).alias(name) for name in picked.columns])
    return filled.withColumn("plate_norm", normalize_plate("plate"))


def scan_charter_depots(spark: SparkSession, path: str) -> DataFrame:
    return _pick(_csv(spark, path), BASE_HEADERS, ["address", "place"])


def scan_charter_vehicles(spark: SparkSession, path: str) -> DataFrame:
    return _pick(_csv(spark, path), CHARTER_VEHICLE_HEADERS, ["fleet_no", "address", "place"])
