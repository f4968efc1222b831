"""Reads of the published directory: filters, latest version, times, due sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.geo import within
from placeloom.functions.text import compact_postcode, normalise_city
from placeloom.functions.times import slot_order

PUBLIC = "public_redistribution_allowed"


def public_only(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("policy") == PUBLIC)


def list_places(places: DataFrame, city: str | None = None, postcode_prefix: str | None = None, text: str | None = None, columns: tuple[str, ...] = ("name",), status: str | None = "active") -> DataFrame:
    """Places of a status with the city, a postcode prefix and a text in one of the columns (LIKE wildcards count)."""
    found = places
    if status is not None:
        found = found.where(F.col("status") == status)
    if city is not None:
        found = found.where(normalise_city(F.col("city")) == city.lower())
    if postcode_prefix is not None:
        found = found.where(F.upper("postcode").like(postcode_prefix.upper() + "%"))
    if text is not None:
        test = F.lit(False)
        for c in columns:
            test = test | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        found = found.where(test)
    return found


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order: a top-k, not a full sort, as long as offset + limit is small."""
    return df.orderBy(*order).limit(offset + limit).offset(offset)


def candidate_scope(candidates: DataFrame, source_id: int | None = None, place_id: int | None = None, from_date: str | None = None, to_date: str | None = None, status: str | None = None) -> DataFrame:
    found = candidates
    for name, value in (("source_id", source_id), ("place_id", place_id), ("status", status)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if from_date is not None:
        found = found.where(F.col("slot_date") >= F.lit(from_date).cast("date"))
    if to_date is not None:
        found = found.where(F.col("slot_date") <= F.lit(to_date).cast("date"))
    return found


def latest_version(versions: DataFrame, version: str | None = None) -> DataFrame:
    """The version of that name, else the published one with the latest date (then creation): one row."""
    if version is not None:
        return versions.where(F.col("version") == version).orderBy("version_id").limit(1)
    published = versions.where(F.col("status") == "published")
    return published.orderBy(F.desc_nulls_last("published_on"), F.desc("created_on"), "version_id").limit(1)


def public_times(occurrences: DataFrame, sources: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Occurrences of public sources in a date range; the range reaches the scan."""
    dated = candidate_scope(occurrences, from_date=from_date, to_date=to_date)
    return dated.join(public_only(sources).select("source_id"), "source_id", "left_semi")


def time_order(place: str = "place_id") -> list[Column]:
    return [F.col(place), F.col("slot_date"), slot_order(F.col("slot")), F.col("session_no")]


def due_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Sources that are due: those of the assignments, or where these give none, website sources by their metadata.

    By assignment: enabled, active, next_run unset or not after as_of. By metadata: enabled website sources whose
    next_fetch_at is unset, can't be read or isn't after as_of.
    """
    due = F.col("next_run").isNull() | (F.col("next_run") <= F.lit(as_of).cast("date"))
    assigned = sources.where(F.col("enabled") & (F.col("assignment") == "active") & due)
    at = F.col("next_fetch_at").try_cast("timestamp_ntz")
    later = F.coalesce(at > F.lit(as_of).cast("timestamp_ntz"), F.lit(False))
    by_metadata = sources.where(F.col("enabled") & (F.col("source_type") == "website") & ~later)
    none = assigned.agg((F.count(F.lit(1)) == 0).alias("none")).select("none").scalar()
    return assigned.unionByName(by_metadata.where(none))


def missing_website(places: DataFrame) -> DataFrame:
    """Places with a postcode and no website."""
    return places.where((F.coalesce("website", F.lit("")) == "") & compact_postcode(F.col("postcode")).isNotNull())


def place_details(places: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Places with their sorted aliases and their public sources; aggregated before the joins, so each joins one row a place."""
    names = aliases.groupBy("place_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    origin = public_only(sources).groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source_type"))).alias("origin"))
    joined = places.join(names, "place_id", "left").join(origin, "place_id", "left")
    return joined.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; ties are the order's matter."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("row number", number).where(F.col("row number") == 1).drop("row number")


def evidence_value(key: str) -> Column:
    """A value of the evidence's JSON as text; null if it is missing."""
    return F.get_json_object("evidence", f"$.{key}")


def nearest(places: DataFrame, lat: float, lon: float, metres: float, limit: int) -> DataFrame:
    """(place_id, metres) of the active places within a distance, the nearest first (ties by id), `limit` at most."""
    one = places.sparkSession.range(1).select(F.lit(0).alias("origin"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    found = within(one, places.where("status = 'active'"), "origin", "place_id", metres)
    return found.orderBy("metres", "place_id").limit(limit).select("place_id", "metres")


def nearby_times(near: DataFrame, occurrences: DataFrame, sources: DataFrame, day: str) -> DataFrame:
    """Public times of a day at the places of `nearest`, a frame that its limit bounds."""
    return public_times(occurrences, sources, day, day).join(F.broadcast(near), "place_id")


def crawled_places(places: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Active places with an approved candidate of a website source."""
    website = sources.where("source_type = 'website'").select("source_id")
    crawled = candidates.where("status = 'approved'").join(website, "source_id", "left_semi").select("place_id")
    return places.where("status = 'active'").join(crawled, "place_id", "left_semi")


def candidate_context(candidates: DataFrame, sources: DataFrame, places: DataFrame) -> DataFrame:
    """candidates with source_type, policy and place_status; those without source or place stay."""
    joined = candidates.join(sources.select("source_id", "source_type", "policy"), "source_id", "left")
    return joined.join(places.select("place_id", F.col("status").alias("place_status")), "place_id", "left")


def next_versions(versions: DataFrame) -> DataFrame:
    """(day, next_version) for each day that versions named day.N have."""
    day, number = (F.substring_index("version", ".", k) for k in (1, -1))
    last = versions.groupBy(day.alias("day")).agg(F.max(number.try_cast("int")).alias("n"))
    return last.select("day", F.concat("day", F.lit("."), (F.col("n") + 1).cast("string")).alias("next_version"))


def weekly_grid(occurrences: DataFrame, monday: str) -> DataFrame:
    """(slot, day0 ... day6) of a week: sorted session=minutes lists, empty where there is none."""
    week = occurrences.where(F.date_trunc("week", "slot_date").cast("date") == F.lit(monday).cast("date"))
    pair = lambda x: F.concat(x["session_no"].cast("string"), F.lit("="), x["main_min"].cast("string"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_no", "main_min"))), pair), ",")
    grid = week.withColumn("day", F.weekday("slot_date")).groupBy("slot").pivot("day", list(range(7))).agg(cell)
    return grid.select("slot", *[F.coalesce(F.col(str(d)), F.lit("")).alias(f"day{d}") for d in range(7)])
