"""Nearest places of many origins: a k nearest neighbours join over grid cells of several sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.geo import lat_cell, lon_cell, metres_between, near_cells
from placeloom.operators.reads import public_times
from placeloom.operators.skew import shuffled, tiled_join
from placeloom.sources.files import shared_folder

#: Sizes of cells in metres: from a street block by fours to the whole globe.
SIZES = (*(250.0 * 4**j for j in range(8)), 21_000_000.0)


def _cells(lat: Column, lon: Column) -> Column:
    """The cell of a point at each size."""
    rows = [lat_cell(lat, m) for m in SIZES]
    return F.array(*[F.struct(F.lit(i).alias("size"), r.alias("row"), lon_cell(lon, r, m).alias("column")) for i, (r, m) in enumerate(zip(rows, SIZES, strict=True))])


def _around(size: Column, lat: Column, lon: Column) -> Column:
    """The cells of one size that hold all points within that size."""
    out = near_cells(lat, lon, SIZES[-1])
    for i, m in enumerate(SIZES[:-1]):
        out = F.when(size == i, near_cells(lat, lon, m)).otherwise(out)
    return out


def nearest_each(origins: DataFrame, places: DataFrame, origin: str, place: str, k: int) -> DataFrame:
    """(origin, place, metres, rank) of the k nearest places of each origin, ties by the smaller place id.

    origins and places: their id, lat, lon; ids are unique and points without coordinates take no part. Each origin begins
    with the smallest cells of which the nine around it hold k places, so it meets few places where they are dense and
    searches far where they are not. It is done when its k-th distance lies within what those cells surely hold, which
    is the case at the next size at the latest but near the poles; the others go on with larger cells. Of places at
    one point only the k with the smallest ids can be near anything. No pair of all origins and places is made.
    """
    spark = places.sparkSession
    at = Window.partitionBy("lat2", "lon2").orderBy(place)
    points = places.where("lat is not null and lon is not null").select(place, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    points = points.withColumn("n", F.row_number().over(at)).where(F.col("n") <= k).drop("n")
    placed = _kept(points.select(place, "lat2", "lon2", F.inline(_cells(F.col("lat2"), F.col("lon2")))), "placed")
    least = min(k, placed.where("size = 0").count())
    counts = placed.groupBy("size", "row", "column").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(len(SIZES) - 1))).alias("size")
    looking = origins.where("lat is not null and lon is not null").select(origin, "lat", "lon")
    around = looking.select("*", sizes).select(origin, "lat", "lon", "size", F.inline(_around(F.col("size"), F.col("lat"), F.col("lon"))))
    held = around.join(shuffled(counts), ["size", "row", "column"]).groupBy(origin, "lat", "lon", "size").agg(F.sum("n").alias("n"))
    todo = _kept(held.where(F.col("n") >= least).groupBy(origin, "lat", "lon").agg(F.min("size").alias("size")), "todo")
    done, order = None, Window.partitionBy(origin).orderBy("metres", place)
    for _ in SIZES:
        cells = todo.select(origin, "lat", "lon", "size", F.inline(_around(F.col("size"), F.col("lat"), F.col("lon"))))
        met = tiled_join(cells, placed, ["size", "row", "column"], F.col(origin), F.col(place))
        met = met.withColumn("metres", metres_between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
        first = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = first.groupBy(origin, "lat", "lon", "size").agg(F.sort_array(F.collect_list(F.struct("rank", place, "metres"))).alias("found"))
        reach = F.get(F.array(*[F.lit(m) for m in SIZES]), F.col("size"))
        sure = (F.col("size") == len(SIZES) - 1) | ((F.size("found") >= least) & (F.element_at("found", -1)["metres"] <= reach))
        near = _kept(near.withColumn("sure", sure), "near")
        part = near.where("sure").select(origin, F.inline("found"))
        done = part if done is None else done.unionByName(part)
        todo = near.where("not sure").select(origin, "lat", "lon", (F.col("size") + 1).alias("size"))
        if todo.isEmpty():
            break
    return done.select(origin, place, "metres", "rank")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back: later rounds don't work earlier ones out again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def times_near_each(near: DataFrame, occurrences: DataFrame, sources: DataFrame, day: str) -> DataFrame:
    """Public times of a day at the nearest places of every origin: `near` of nearest_each joined by place."""
    return public_times(occurrences, sources, day, day).join(shuffled(near), "place_id")
