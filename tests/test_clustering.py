"""Stored tables keep neighbours together, and searches around a place skip the rest."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dwellgrid.functions.geo import haversine_km, z_cell
from dwellgrid.operators.filters import filter_depot, filter_road_selection, filter_within_radius
from dwellgrid.params import Filter, Road
from dwellgrid.plans import tables
from dwellgrid.session import new_folder

ROWS = 60_000


@pytest.fixture(scope="module")
def events(spark):
    place = [F.rand(seed) * span + low for seed, span, low in ((1, 3.0, 50.5), (2, 3.5, 3.5))]
    rows = spark.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("V"), F.col("id")).alias("vehicle_code"), F.lit(None).cast("string").alias("plate_norm"), *[c.alias(n) for c, n in zip(place, ("start_lat", "start_lon"))],
        F.lit(10.0).alias("day_km"), F.lit("x").alias("carrier"), F.lit("eigen").alias("carrier_type"),
        F.format_string("note %s", F.sha2(F.col("id").cast("string"), 256)).alias("note"), F.expr("date'2026-01-01' + cast(id % 2 as int)").alias("trip_date"),
    )
    depot = F.format_string("auto:%.3f:%.3f", F.round("start_lat", 3), F.round("start_lon", 3))
    return rows.withColumns({"depot_id": depot, "mid_lat": F.col("start_lat"), "mid_lon": F.col("start_lon")}).cache()


def rows_read(df):
    """Rows that the scan hands on after it has skipped row groups and pages."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    plan = execution.executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark, events):
    before, tables.ROW_GROUP_BYTES = tables.ROW_GROUP_BYTES, 1 << 18
    try:
        clustered = tables.store(events, new_folder(spark, "clustered"), ("start_lat", "start_lon"), "depot_id")
    finally:
        tables.ROW_GROUP_BYTES = before
    path = new_folder(spark, "scattered")
    events.write.option("parquet.block.size", 1 << 18).partitionBy("trip_date").parquet(path)
    return clustered, spark.read.schema(events.schema).parquet(path)


def searches(table, lat, lon, depot):
    return {
        "radius": filter_within_radius(table, lat, lon, 3.0, Filter()),
        "road": filter_road_selection(table, Road(lat, lon, lat + 0.02, lon + 0.02, 2.0), Filter()),
        "depot": filter_depot(table, depot),
    }


def test_searches_read_few_row_groups(stored, events):
    """On average: a place on a seam of the curve reads more than others."""
    read = {}
    spots = events.select("start_lat", "start_lon", "depot_id").where("vehicle_code in ('V7', 'V77', 'V777', 'V7777', 'V17', 'V171')").collect()
    for spot in spots:
        found, plain = (searches(t, *spot) for t in stored)
        for name in found:
            read.setdefault(name, []).append((rows_read(found[name]), rows_read(plain[name])))
            assert sorted(map(str, found[name].collect())) == sorted(map(str, plain[name].collect())) != [], name
    assert len(spots) == 6
    for name, counts in read.items():
        assert sum(c for c, _ in counts) <= sum(p for _, p in counts) / 5, (name, counts)


def test_a_date_still_reads_one_folder(stored):
    assert rows_read(stored[0].where("trip_date = date'2026-01-02'").select("note")) == ROWS / 2


def test_cells_on_the_curve(spark):
    draw = random.Random(2)
    spots = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(200)] + [(None, 5.0), (-90.0, -180.0), (90.0, 180.0)]
    df = spark.createDataFrame(spots, "lat double, lon double").withColumn("z", z_cell("lat", "lon"))
    for lat, lon, z in df.collect():
        if lat is None:
            assert z is None
            continue
        row, col = int((lat + 90) / 0.01 // 1), int((lon + 180) / 0.01 // 1)
        assert z == sum(((col >> i) & 1) << (2 * i) | ((row >> i) & 1) << (2 * i + 1) for i in range(20))


@pytest.mark.parametrize(("lat", "lon"), [(52.1, 5.1), (0.0, 179.99), (89.97, 10.0), (-60.0, -179.999)])
def test_the_box_cuts_nothing_that_the_distance_keeps(spark, lat, lon):
    draw = random.Random(9)
    spots = [(max(-90.0, min(90.0, lat + draw.uniform(-0.1, 0.1))), (lon + draw.uniform(-0.2, 0.2) * draw.choice((1, 1, 400)) + 180) % 360 - 180) for _ in range(1500)]
    df = spark.createDataFrame(spots, "start_lat double, start_lon double").withColumns(
        {"day_km": F.lit(1.0), "trip_date": F.current_date(), "carrier": F.lit(""), "carrier_type": F.lit(""), "vehicle_code": F.lit(""), "plate_norm": F.lit("")}
    )
    near = df.where(haversine_km("start_lat", "start_lon", lat, lon) <= 5.0).count()
    assert filter_within_radius(df, lat, lon, 5.0, Filter()).count() == near > 20
