"""Intake of contributions: timetable rows, new places, corrections and claims. Contact details stay private."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.times import minutes_error, minutes_of, slot_of

#: Columns of a contribution that no read or export shows.
PRIVATE = ("name", "email")


def schedule_error() -> Column:
    """Why a submitted row (slot_date, slot, main_time, start_time, session_no) is rejected; null if it is good."""
    missing = minutes_of(F.col("main_time")).isNull()
    return (
        F.when(F.col("slot_date").isNull(), "missing date").when(slot_of(F.col("slot")).isNull(), "unsupported slot")
        .when(missing, "invalid time").when(minutes_error(F.col("start_time")).isNotNull(), "invalid start time")
        .when(F.coalesce("session_no", F.lit(1)) < 1, "invalid session")
    )


def schedule_rows(rows: DataFrame) -> DataFrame:
    """Submitted rows (submission, place_id, ...) as candidates with `error`: community source, pending, policy unknown."""
    return rows.select(
        "submission", "place_id", F.concat(F.lit("schedule-"), F.col("submission").cast("string")).alias("external_id"),
        F.lit("community").alias("source_type"), F.lit("unknown").alias("policy"), "slot_date", slot_of(F.col("slot")).alias("slot"),
        minutes_of(F.col("main_time")).alias("main_min"), minutes_of(F.col("start_time")).alias("start_min"),
        F.coalesce("session_no", F.lit(1)).alias("session_no"), F.lit("pending").alias("status"), schedule_error().alias("error"),
    )


def intake(rows: DataFrame) -> DataFrame:
    """(submission, accepted, rejected, first_error) of schedule_rows."""
    good = F.col("error").isNull()
    return rows.groupBy("submission").agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.min("error").alias("first_error"))


def new_places(submissions: DataFrame) -> DataFrame:
    """Submitted places (submission, name, ...) as records to resolve: community source, policy unknown, not public; blank names are left out."""
    kept = submissions.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    key = F.concat(F.lit("place-"), F.col("submission").cast("string"))
    return kept.withColumns({"external_id": key, "source_type": F.lit("community"), "policy": F.lit("unknown"), "public": F.lit(False)})


def appended(existing: DataFrame, submissions: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Corrections or claims with those of `submissions` for known places added, pending and with contact private.

    A key that is there already isn't added again.
    """
    fresh = submissions.join(places.select("place_id"), "place_id", "left_semi").join(existing.select(key), key, "left_anti")
    fresh = fresh.withColumns({"status": F.lit("pending"), "contact": F.struct(*PRIVATE)}).drop(*PRIVATE)
    return existing.unionByName(fresh.select(*existing.columns))


def public_view(rows: DataFrame) -> DataFrame:
    """rows without any contact."""
    return rows.drop("contact", *PRIVATE)
