"""Nearest-neighbour joins on a grid, so that no point is compared with every other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions.geo import EARTH_RADIUS_KM, column, haversine_km
from dwellgrid.session import materialize

# Cell sizes in degrees; each cell lies in one of the next size.
CELL_SIZES = (0.05, 0.25, 1.25, 6.25)
SLACK_KM = 1e-6
PUBLIC_ACCESS = ("Publiek", "Semi-publiek")


def cell(value, size) -> Column:
    return F.floor(column(value) / column(size)).cast("long")


def neighbours(value, size) -> Column:
    own = cell(value, size)
    return F.array(own - 1, own, own + 1)


def nearest_km(points: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """``key`` and the distance to the nearest target; points without any target are left out.

    Points look in the cells around their own, finest cells first. A distance found is final when
    nothing outside those cells can be closer; only the other points go on to the next cell size.
    """
    places = materialize(
        targets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        .distinct(),
        "nearest-targets",
    )
    open_points = materialize(points.select(key, "lat", "lon"), "nearest-points")
    found: list[DataFrame] = []
    for size in CELL_SIZES:
        around = places.withColumn("_x", F.explode(neighbours("_lat", size))).withColumn(
            "_y", F.explode(neighbours("_lon", size))
        )
        here = open_points.withColumns({"_x": cell("lat", size), "_y": cell("lon", size)})
        measured = here.join(around, ["_x", "_y"]).groupBy(key, "lat", "lon").agg(
            F.min(haversine_km("lat", "lon", "_lat", "_lon")).alias("km")
        )
        measured = materialize(measured, "nearest")
        # Distance to the closest meridian or parallel a full cell away; no shortcut across the date line.
        clear = EARTH_RADIUS_KM * F.asin(F.sin(F.radians(F.lit(size))) * F.cos(F.radians("lat")))
        final = (F.col("km") <= clear) & (F.abs("lon") < 180.0 - size)
        found.append(measured.where(final).select(key, "km"))
        # Cheap to repeat: both sides are stored, and there are only a few cell sizes.
        open_points = open_points.join(found[-1], key, "left_anti")
        if open_points.isEmpty():
            break
    else:
        found.append(_far_km(open_points, key, places))
    return reduce(DataFrame.unionByName, found)


def _far_km(points: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """The same for points with no target in the cells around them, over occupied cells from coarse to fine.

    A cell stands for its targets by one of them and the largest distance from it to another. What a point is
    away from the nearest such target bounds its answer, and cells that cannot hold a nearer one are left out.
    """
    sizes = CELL_SIZES[::-1]
    names = [(f"_x{n}", f"_y{n}") for n in range(len(sizes))]
    # Held to the globe, so that there are at most 1,800 cells of the coarsest size.
    lat, lon = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), "_lat")), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), "_lon"))
    placed = places
    for (x, y), size in zip(names, sizes, strict=True):
        placed = placed.withColumns({x: cell(lat, size), y: cell(lon, size)})
    placed = materialize(placed, "nearest-cells")

    def occupied(level: int) -> DataFrame:
        own = [name for pair in names[: level + 1] for name in pair]
        heads = placed.groupBy(*own).agg(F.min(F.struct("_lat", "_lon")).alias("_head"))
        reach = F.max(haversine_km("_head._lat", "_head._lon", "_lat", "_lon")).alias("_reach")
        return placed.join(heads, own).groupBy(*own, "_head").agg(reach)

    point = [key, "lat", "lon"]
    away = haversine_km("lat", "lon", "_head._lat", "_head._lon")
    least = F.min("_away").over(W.partitionBy(*point))
    roots = occupied(0).agg(F.collect_list(F.struct(*names[0], "_head", "_reach"))).scalar()
    open_ = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    open_ = open_.withColumn("_cell", F.explode(roots)).select(*point, "_cell.*")
    for level in range(len(sizes)):
        if level:
            own = [name for pair in names[:level] for name in pair]
            open_ = open_.join(occupied(level), own)
        near = open_.withColumn("_away", away).withColumn("_least", least)
        kept = near.where(F.col("_away") - F.col("_reach") <= F.col("_least") + SLACK_KM)
        open_ = materialize(kept.select(*point, *[name for pair in names[: level + 1] for name in pair]), "nearest-open")
    measured = open_.join(placed, [name for pair in names for name in pair]).groupBy(*point)
    return measured.agg(F.min(haversine_km("lat", "lon", "_lat", "_lon")).alias("km")).select(key, "km")


def nearest_charger(depots: DataFrame, chargers: DataFrame) -> DataFrame:
    """Distance from each depot to the closest charger anyone may use, -1 when there is none."""
    public = chargers.where(F.col("access").isin(*PUBLIC_ACCESS))
    nearest = nearest_km(depots, "depot_id", public)
    return (
        depots.select("depot_id")
        .join(nearest, "depot_id", "left")
        .select("depot_id", F.coalesce("km", F.lit(-1.0)).alias("nearest_charger_km"))
    )
