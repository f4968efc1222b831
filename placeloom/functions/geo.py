"""Distances on a sphere and grid cells for range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
#: Metres of a degree of latitude on that sphere.
DEGREE = RADIUS * math.pi / 180


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def lat_cell(lat: Column, metres: float) -> Column:
    return F.floor(lat / (metres / DEGREE)).cast("long")


def columns_of(row: Column, metres: float) -> Column:
    """How many cells go round the globe in a row of latitude cells: fewer towards the poles, one where a pole is within `metres`.

    All cells of a row have one width: no point within `metres` of a point of the row, in whatever row, differs more in longitude.
    """
    height = metres / DEGREE
    edge = F.greatest(F.abs(row * height), F.abs((row + 1) * height))
    width = F.degrees(F.asin(F.lit(math.sin(math.radians(height))) / F.cos(F.radians(edge))))
    return F.when(edge + height >= 90, 1).otherwise(F.greatest(F.floor(360 / width * (1 - 1e-9)), F.lit(1))).cast("long")


def lon_cell(lon: Column, row: Column, metres: float) -> Column:
    """Cell of a longitude in a row of latitude cells, from 0 at 180 degrees west; 180 degrees east is that again."""
    n = columns_of(row, metres)
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).cast("long")


def near_cells(lat: Column, lon: Column, metres: float) -> Column:
    """(row, column) of the cells that hold all points within `metres`: three rows, up to three columns in each, round the globe."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    rows = F.transform(around, lambda k: lat_cell(lat, metres) + k)
    beside = lambda r: F.array_distinct(F.transform(around, lambda k: F.pmod(lon_cell(lon, r, metres) + k, columns_of(r, metres))))
    return F.flatten(F.transform(rows, lambda r: F.transform(beside(r), lambda c: F.struct(r.alias("row"), c.alias("column")))))


def touched_cells(lat: Column, lon: Column, metres: float) -> Column:
    """(row, column) of the cells of twice `metres` that hold all points within `metres`: four, about, for the nine of `near_cells`.

    Half a cell of a row is no narrower than what points within `metres` of one in it can differ in longitude.
    """
    size, half = 2 * metres, 0.5 * (1 + 1e-9)
    rows = F.array_distinct(F.array(*[lat_cell(lat + d * metres / DEGREE * (1 + 1e-9), size) for d in (-1, 1)]))

    def beside(row: Column) -> Column:
        n = columns_of(row, size)
        at = F.pmod(lon + 180, F.lit(360.0)) / 360 * n
        return F.array_distinct(F.array(*[F.pmod(F.floor(at + d * half).cast("long"), n) for d in (-1, 1)]))

    return F.flatten(F.transform(rows, lambda r: F.transform(beside(r), lambda c: F.struct(r.alias("row"), c.alias("column")))))


def within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, metres: float, left_more: tuple[str, ...] = (), right_more: tuple[str, ...] = (), keys: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """(left_id, right_id, metres) of points within a distance, from (id, lat, lon) on both sides; with `more` columns of them, and equal `keys`, where asked.

    A range join as an equi-join on grid cells: the left points are put into the nine cells around them,
    the exact distance is checked afterwards, where the latitudes allow it. `wide`: into about four cells of twice the size, less to shuffle and more to check. Both sides are shuffled: neither passes the driver, whatever Spark takes its size for.
    """
    size, cells = (2 * metres, touched_cells) if wide else (metres, near_cells)
    placed = right.where("lat is not null and lon is not null").withColumn("row", lat_cell(F.col("lat"), size))
    placed = placed.select(F.col(right_id), *keys, *right_more, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "row", lon_cell(F.col("lon"), F.col("row"), size).alias("column"))
    looking = left.where("lat is not null and lon is not null").select(left_id, *keys, *left_more, "lat", "lon", F.inline(cells(F.col("lat"), F.col("lon"), metres)))
    met = looking.join(placed.hint("merge"), ["row", "column", *keys]).where(F.abs(F.col("lat2") - F.col("lat")) <= metres / DEGREE * 1.01).withColumn("metres", metres_between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return met.where(F.col("metres") <= metres).select(left_id, right_id, *left_more, *right_more, "metres")
