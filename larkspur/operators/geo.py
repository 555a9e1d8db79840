"""Points, distances, boxes and Morton codes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6_371_000.0
M_PER_DEGREE = EARTH_M * math.pi / 180


def lat_lon(point: Column, t: T.DataType) -> tuple[Column, Column]:
    """Latitude and longitude of a struct {lat, lon|lng} or an array [lat, lon]."""
    if isinstance(t, T.ArrayType):
        return F.try_element_at(point, F.lit(1)).cast("double"), F.try_element_at(point, F.lit(2)).cast("double")
    names = t.fieldNames()
    return point["lat"].cast("double"), point["lon" if "lon" in names else "lng"].cast("double")


def geo_distance(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle metres (haversine)."""
    a1, a2 = F.radians(lat), math.radians(to_lat)
    dlat, dlon = F.lit(a2) - a1, F.radians(F.lit(to_lon) - lon)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * math.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_bbox(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Within a box, edges included; min_lon > max_lon is a box across the antimeridian."""
    wide = (lon >= min_lon) & (lon <= max_lon) if min_lon <= max_lon else (lon >= min_lon) | (lon <= max_lon)
    return (lat >= min_lat) & (lat <= max_lat) & wide


def envelope(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """A box that holds a circle: min_lat, min_lon, max_lat, max_lon, wrapping at the antimeridian."""
    dlat = radius_m / M_PER_DEGREE
    low, high = max(lat - dlat, -90.0), min(lat + dlat, 90.0)
    # the meridians touch the circle at its widest, which lies poleward of its centre
    reach = math.sin(min(radius_m / EARTH_M, math.pi / 2))
    squeeze = math.cos(math.radians(lat))
    if low <= -90 or high >= 90 or reach >= squeeze:
        return low, -180.0, high, 180.0
    dlon = math.degrees(math.asin(reach / squeeze))
    west, east = lon - dlon, lon + dlon
    return low, west + 360 if west < -180 else west, high, east - 360 if east > 180 else east


def within(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, radius_m: float) -> DataFrame:
    """Rows within a radius. The circle's box comes first, as plain comparisons that the scan can skip by."""
    box = geo_bbox(F.col(lat), F.col(lon), *envelope(to_lat, to_lon, radius_m))
    return df.where(box).where(geo_distance(F.col(lat), F.col(lon), to_lat, to_lon) <= radius_m)


def nearest_points(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, k: int, pk: str) -> DataFrame:
    d = geo_distance(F.col(lat), F.col(lon), to_lat, to_lon)
    return df.withColumn("_distance", d).where("_distance is not null").orderBy(F.col("_distance").asc(), F.col(pk).asc()).limit(k)


def _spread(x: Column) -> Column:
    # Binary digits read to base 4 move to the even places. x stands here once: masks and shifts would name it 32 times.
    return F.conv(F.bin(x), 4, 10).cast("long")


def morton(lat: Column, lon: Column) -> Column:
    """Z-order code: 32 bits of latitude on even places, of longitude on odd ones (as a signed long)."""

    def part(c: Column, low: float, high: float) -> Column:
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low))) * float(2**32 - 1)).cast("long")

    return _spread(part(lat, -90.0, 90.0)).bitwiseOR(F.shiftleft(_spread(part(lon, -180.0, 180.0)), 1))


def indexed(df: DataFrame, lat: str, lon: str, path: str) -> DataFrame:
    """`df` written in order of its Morton codes (`_z`), so that a box's ranges of codes prune files and row groups."""
    z = morton(F.col(lat), F.col(lon)).bitwiseXOR(F.lit(-(2**63)))  # signed order of unsigned codes
    df.withColumn("_z", z).repartitionByRange("_z").sortWithinPartitions("_z").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(path)
    return df.sparkSession.read.parquet(path)


def scan(index: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of an indexed() table within a box (min_lat, min_lon, max_lat, max_lon), which may cross the antimeridian."""
    min_lat, min_lon, max_lat, max_lon = box
    halves = [box] if min_lon <= max_lon else [(min_lat, min_lon, max_lat, 180.0), (min_lat, -180.0, max_lat, max_lon)]
    near = None
    for half in halves:
        for a, b in cover(half):
            one = F.col("_z").between(a - 2**63, b - 2**63)
            near = one if near is None else near | one
    return index.where(near).where(geo_bbox(F.col(lat), F.col(lon), *box)).drop("_z")


def covered(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point's Morton code is in the cover of a box that does not wrap. The code is worked out once a row: within
    a lambda or a chain of ranges it would be for each range."""
    ranges = F.array(*(F.struct(F.lit(a - 2**63).alias("a"), F.lit(b - 2**63).alias("b")) for a, b in cover(box)))
    z = morton(lat, lon).bitwiseXOR(F.lit(-(2**63)))  # signed order of unsigned codes
    return F.exists(F.array(z), lambda z: F.exists(ranges, lambda r: z.between(r["a"], r["b"])))


def cover(box: tuple[float, float, float, float], most: int = 32) -> list[tuple[int, int]]:
    """At most `most` ranges of Morton codes (unsigned, both ends included) that hold a box that does not wrap.

    Quadrants are split, largest first, as long as the ranges fit; what straddles the edge stays whole.
    """
    min_lat, min_lon, max_lat, max_lon = box

    def cell(v: float, low: float, high: float) -> int:
        return round(min(1.0, max(0.0, (v - low) / (high - low))) * (2**32 - 1))

    y0, y1, x0, x1 = cell(min_lat, -90, 90), cell(max_lat, -90, 90), cell(min_lon, -180, 180), cell(max_lon, -180, 180)
    done: list[tuple[int, int]] = []
    todo = [(32, 0, 0)]  # size in bits, lowest latitude and longitude cell

    def code(y: int, x: int) -> int:
        return sum(((y >> i & 1) << 2 * i) | ((x >> i & 1) << 2 * i + 1) for i in range(32))

    while todo:
        todo.sort()
        bits, y, x = todo.pop()
        last = (1 << bits) - 1
        if y > y1 or y + last < y0 or x > x1 or x + last < x0:
            continue
        inside = y >= y0 and y + last <= y1 and x >= x0 and x + last <= x1
        if inside or bits == 0 or len(done) + len(todo) + 4 > most:
            done.append((code(y, x), code(y + last, x + last)))
            continue
        half = 1 << (bits - 1)
        todo += [(bits - 1, y + a, x + b) for a in (0, half) for b in (0, half)]
    out: list[list[int]] = []
    for a, b in sorted(done):
        if out and a == out[-1][1] + 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
