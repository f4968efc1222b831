"""Coverage, identity and feed reports: one conditional aggregate a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.times import in_window, slot_order

STALE_DAYS = 30


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """(grouping, value, n) of each column's values, all in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("n"))


def stale(as_of: str, days: int = STALE_DAYS) -> Column:
    return F.coalesce(F.col("last_seen") < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(True))


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames beside each other, as scalar subqueries of the first."""
    first, rest = frames[0], frames[1:]
    return first.select("*", *[f.select(c).scalar().alias(c) for f in rest for c in f.columns])


def coverage(
    places: DataFrame, sources: DataFrame, occurrences: DataFrame, candidates: DataFrame,
    reviews: DataFrame, corrections: DataFrame, claims: DataFrame, as_of: str,
) -> DataFrame:
    """One row: totals, active places, published ones with their percentage, gaps, candidates and open items."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    active = F.col("status") == "active"
    one = places.agg(
        F.count(F.lit(1)).alias("places"), F.count_if(active).alias("active"), F.count_if(active & empty("postcode")).alias("no_postcode"),
        F.count_if(active & F.col("lat").isNull()).alias("no_coordinates"), F.count_if(active & empty("website")).alias("no_website"),
    )
    two = occurrences.agg(F.countDistinct("place_id").alias("published"))
    three = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(stale(as_of)).alias("stale_sources"))
    four = candidates.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "approved").alias("approved"))
    open_ = lambda df, name: df.agg(F.count_if(F.col("status") == "pending").alias(name))
    items = [open_(reviews, "pending_reviews"), open_(corrections, "open_corrections"), open_(claims, "open_claims")]
    joined = beside(one, two, three, four, *items)
    return joined.withColumn("published_pct", F.when(F.col("active") > 0, F.round(100.0 * F.col("published") / F.col("active"), 1)).otherwise(0.0))


def source_overlap(sources: DataFrame) -> DataFrame:
    """(label, n): sets of source types that places have, as sorted a+b."""
    label = F.array_join(F.array_sort(F.collect_set("source_type")), "+")
    return sources.where("place_id is not null").groupBy("place_id").agg(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def duplicate_buckets(places: DataFrame, key: list[str], limit: int | None = 25) -> DataFrame:
    """Buckets of places that aren't duplicates yet and share a key, the largest first."""
    found = places.where("status <> 'duplicate'").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("place_id")).alias("ids")).where("n > 1")
    return found.orderBy(F.desc("n"), *[F.col(k).asc_nulls_last() for k in key]).limit(limit) if limit else found


# Reasons that allow a result without rows; they may stand within a longer one, in any case.
EMPTY_REASONS = ("jumuah_only", "awaiting ocr", "image target — awaiting ocr", "pdf target — awaiting parser")
#: Dates from which times can look calculated.
CALCULATED_DATES = 7


def plausibility(rows: DataFrame, as_of: str, results: DataFrame | None = None) -> DataFrame:
    """Flags of each source's slot rows: outside windows, days out of order, no near date, other years, calculated-looking times.

    Times look calculated if every row's start is its time, there are CALCULATED_DATES dates or more, and the (slot, time)
    pairs that stand on half of the dates at least hold more than half of the rows. results (source_id, reason), if
    given, are all runs: a source without rows is empty_refused unless its reason is one of EMPTY_REASONS.

    Aggregates by (source, date, slot), by (source, slot, time) and by source, all of which combine before their
    shuffle; the order within a day is a lag over at most six rows. The threshold of the pairs is the source's own,
    so their counts are joined to it, one row a source.
    """
    today = F.lit(as_of).cast("date")
    daily = rows.groupBy("source_id", "slot_date", "slot").agg(F.min("main_min").alias("first"))
    order = Window.partitionBy("source_id", "slot_date").orderBy(slot_order(F.col("slot")))
    daily = daily.where("slot <> 'jumuah'").withColumn("back", F.col("first") < F.lag("first").over(order))
    days = daily.groupBy("source_id", "slot_date").agg(F.coalesce(F.max("back"), F.lit(False)).alias("disordered"))
    by_day = days.groupBy("source_id").agg(F.count_if("disordered").alias("days_disordered"))
    same = F.coalesce(F.col("main_min") == F.col("start_min"), F.lit(False))
    by_row = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~in_window(F.col("main_min"), F.col("slot"))).alias("outside_window"),
        F.coalesce(F.max(F.col("slot_date").between(F.date_sub(today, 1), F.date_add(today, 31))), F.lit(False)).alias("has_near_date"),
        F.min(F.year("slot_date") != F.year(today)).alias("other_year"), F.min(same).alias("all_same"), F.countDistinct("slot_date").alias("dates"),
    )
    pairs = rows.groupBy("source_id", "slot", "main_min").agg(F.count(F.lit(1)).alias("c"))
    frequent = pairs.join(by_row.where(F.col("all_same") & (F.col("dates") >= CALCULATED_DATES)).select("source_id", "dates"), "source_id")
    repeated = frequent.where(2 * F.col("c") >= F.col("dates")).groupBy("source_id").agg(F.sum("c").alias("repeated"))
    out = by_row.join(by_day, "source_id", "left").join(repeated, "source_id", "left")
    out = out.withColumn("calculated", F.coalesce(2 * F.col("repeated") > F.col("rows"), F.lit(False))).drop("all_same", "dates", "repeated")
    if results is None:
        return out
    reason = F.lower(F.coalesce("reason", F.lit("")))
    allowed = F.exists(F.array(*[F.lit(r) for r in EMPTY_REASONS]), lambda r: F.contains(reason, r))
    every = results.select("source_id", allowed.alias("allowed")).join(out, "source_id", "left")
    return every.withColumns({"rows": F.coalesce("rows", F.lit(0)), "empty_refused": F.col("rows").isNull() & ~F.col("allowed")}).drop("allowed")


def sections(df: DataFrame, **columns: Column) -> DataFrame:
    """(section, value, n): counts of the values of each column that aren't null, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("section"), c.cast("string").alias("value")) for k, c in columns.items()])
    rows = df.select(F.inline(pairs)).where("value is not null")
    return rows.groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))


def partner_report(sources: DataFrame, candidates: DataFrame, corrections: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(section, value, n) of a partner feed's sources.

    total and linked; counts by policy and candidate_status; ids (n = 1 a source) of stale sources, not seen for
    `days`, and of missing_recent ones, unlinked or without a slot from as_of on; open_corrections, of each linked
    place once for each of its sources.
    """
    linked = F.when(F.col("place_id").isNotNull(), "all")
    old = F.when(stale(as_of, days), F.col("external_id"))
    out = sections(sources, total=F.lit("all"), linked=linked, policy=F.col("policy"), stale=old)
    own = candidates.join(sources.select("source_id"), "source_id", "left_semi")
    recent = own.where(F.col("slot_date") >= F.lit(as_of).cast("date")).select("source_id").distinct()
    missing = sources.join(recent.withColumn("recent", F.lit(True)), "source_id", "left")
    missing = missing.where("place_id is null or recent is null")
    pending = corrections.where("status = 'pending'").join(sources.select("place_id"), "place_id")
    parts = [sections(own, candidate_status=F.col("status")), sections(missing, missing_recent=F.col("external_id"))]
    for part in [*parts, sections(pending, open_corrections=F.lit("all"))]:
        out = out.unionByName(part)
    return out


def discovery_report(sources: DataFrame, places: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """(section, value, n) of a discovery feed's sources: country, policy, record_class, ids that are stale or lack a field.

    The country is the place's, else that of the metadata, else unknown. pending_reviews counts those of the sources.
    """
    facts = places.select("place_id", F.col("country").alias("place_country"), "lat", "lon", "postcode", F.lit(True).alias("placed"))
    rows = sources.join(facts, "place_id", "left")
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    country = F.coalesce(known(F.col("place_country")), known(F.col("metadata")["country"]), F.lit("unknown"))
    where = lambda test: F.when(F.coalesce(test, F.lit(False)), F.col("external_id"))
    out = sections(
        rows, total=F.lit("all"), linked=F.when(F.col("place_id").isNotNull(), "all"), country=country, policy=F.col("policy"),
        record_class=F.coalesce(known(F.col("metadata")["record_class"]), F.lit("unknown")), stale=where(stale(as_of)),
        missing_coordinates=where(F.col("placed") & (F.col("lat").isNull() | F.col("lon").isNull())),
        missing_postcode=where(F.col("placed") & known(F.col("postcode")).isNull()),
    )
    pending = reviews.where("status = 'pending'").join(sources.select("source_id"), "source_id")
    return out.unionByName(sections(pending, pending_reviews=F.lit("all")))


# Reasons that excuse a result without rows, wherever they stand in it.
EMPTY_REASONS = ("jumuah_only", "awaiting ocr", "pdf target — awaiting parser")


def result_contract(rows: DataFrame, runs: DataFrame, contract: str) -> DataFrame:
    """What is wrong with the result of each run (run_id, reason), of its rows (run_id, slot_date, slot, session_no, evidence).

    Counts: rows, duplicates (keys with more than one row), wrong_contract, gate_failed; empty_without_reason and
    empty_not_allowed (no rows, and a reason that isn't an allowed one).
    """
    value = lambda k: F.get_json_object("evidence", f"$.{k}")
    wrong = ~value("contract").eqNullSafe(F.lit(contract))
    passed = F.coalesce(value("gate_passed") == "true", F.lit(False))
    keys = rows.groupBy("run_id", "slot_date", "slot", "session_no")
    keys = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(~passed).alias("failed"))
    sums = keys.groupBy("run_id").agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("duplicates"),
        F.sum("wrong").alias("wrong_contract"), F.sum("failed").alias("gate_failed"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "duplicates", "wrong_contract", "gate_failed")]
    out = runs.select("run_id", "reason").join(sums, "run_id", "left").select("run_id", "reason", *counts)
    empty, reason = F.col("rows") == 0, F.coalesce("reason", F.lit(""))
    allowed = F.lower(reason).rlike("|".join(EMPTY_REASONS))
    flags = {"empty_without_reason": empty & (reason == ""), "empty_not_allowed": empty & (reason != "") & ~allowed}
    return out.withColumns(flags).drop("reason")
