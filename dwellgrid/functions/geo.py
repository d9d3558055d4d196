"""Distances, directions and projections on plain latitude/longitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32

# Direction labels per 45 degree bucket, starting at north.
DIRECTION_LABELS = (
    "richting noorden",
    "richting noordoosten",
    "richting oosten",
    "richting zuidoosten",
    "richting zuiden",
    "richting zuidwesten",
    "richting westen",
    "richting noordwesten",
)


def column(value) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def bankers_round(value, digits: int) -> Column:
    """Half-to-even rounding of the scaled value, after dropping the noise of summation order."""
    scale = 10.0**digits
    return F.rint(F.round(column(value), 9) * scale) / scale


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(column, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def bearing_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360 with 0 at north."""
    phi1, phi2 = F.radians(column(lat1)), F.radians(column(lat2))
    turn = F.radians(column(lon2)) - F.radians(column(lon1))
    east = F.sin(turn) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(turn)
    return (F.degrees(F.atan2(east, north)) + 360.0) % 360.0


def direction_bucket(bearing) -> Column:
    return F.floor(((column(bearing) + 22.5) % 360.0) / 45.0).cast("int")


def compass_direction(bucket) -> Column:
    labels = F.array(*[F.lit(label) for label in DIRECTION_LABELS])
    return F.element_at(labels, column(bucket).cast("int") + 1)


def project_point(lat, lon, bearing, km) -> Column:
    """The point ``km`` away along ``bearing``, as ``struct(lat, lon)`` with six decimals."""
    lat1, lon1 = F.radians(column(lat)), F.radians(column(lon))
    heading, angle = F.radians(column(bearing)), column(km) / EARTH_RADIUS_KM
    lat2 = F.asin(F.sin(lat1) * F.cos(angle) + F.cos(lat1) * F.sin(angle) * F.cos(heading))
    lon2 = lon1 + F.atan2(
        F.sin(heading) * F.sin(angle) * F.cos(lat1),
        F.cos(angle) - F.sin(lat1) * F.sin(lat2),
    )
    return F.struct(
        bankers_round(F.degrees(lat2), 6).alias("lat"),
        bankers_round(F.degrees(lon2), 6).alias("lon"),
    )


def point_segment_km(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Planar distance from a point to a segment; a segment without length is a point."""
    lat, lon, lat1, lon1, lat2, lon2 = map(column, (lat, lon, lat1, lon1, lat2, lon2))
    km_per_lon = F.greatest(F.lit(1.0), KM_PER_DEGREE * F.cos(F.radians((lat + lat1 + lat2) / 3.0)))
    # Everything relative to the first end of the segment.
    dx, dy = (lon2 - lon1) * km_per_lon, (lat2 - lat1) * KM_PER_DEGREE
    px, py = (lon - lon1) * km_per_lon, (lat - lat1) * KM_PER_DEGREE
    squared = dx * dx + dy * dy
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / F.nullif(squared, F.lit(0.0))))
    gap_x, gap_y = px - share * dx, py - share * dy
    return F.when(squared <= 0, haversine_km(lat, lon, lat1, lon1)).otherwise(F.sqrt(gap_x * gap_x + gap_y * gap_y))


def interpolate(start, end, progress) -> Column:
    start, end = column(start), column(end)
    return start + (end - start) * column(progress)


def coordinate_key(lat, lon) -> Column:
    return F.format_string("%.5f:%.5f", bankers_round(lat, 5), bankers_round(lon, 5))


def z_cell(lat, lon, degrees: float = 0.01) -> Column:
    """Number of the cell of ``degrees`` on a curve that keeps neighbours together: the bits of row and column by turns."""

    def spread(value: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
        return value

    row = F.floor((column(lat) + 90.0) / degrees).cast("long")
    col = F.floor((column(lon) + 180.0) / degrees).cast("long")
    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def location_id(lat, lon, address) -> Column:
    """Cell of about 100 m, or the address when there are no coordinates."""
    lat, lon = column(lat), column(lon)
    rounded = F.round(lat, 3), F.round(lon, 3)
    written = F.format_string("auto:%.3f:%.3f", *rounded)
    # The same text, written faster; what rounds to zero keeps its sign above.
    plain = [(F.abs(x) >= 0.001) & (F.abs(x) < 1e6) for x in rounded]
    digits = [x.cast("decimal(9,3)").cast("string") for x in rounded]
    known = F.when(plain[0] & plain[1], F.concat(F.lit("auto:"), digits[0], F.lit(":"), digits[1])).otherwise(written)
    unknown = F.concat(F.lit("unknown_location:"), F.coalesce(column(address), F.lit("missing")))
    return F.when(lat.isNull() | lon.isNull(), unknown).otherwise(known)
