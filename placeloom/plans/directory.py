"""Queries of reads, windows, validation, publication and freshness."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions import geo
from placeloom.functions.times import SLOTS, slot_order
from placeloom.operators import contributions, extract, publish, reads, versions
from placeloom.plans.frames import AS_OF
from placeloom.plans.registry import define, query
from placeloom.plans.scalar import haversine_sql
from placeloom.sources.files import kept, shared_folder

PUB = "policy = 'public_redistribution_allowed'"
DAY = f"DATE '{AS_OF}'"
ORD = "CASE slot WHEN 'fajr' THEN 1 WHEN 'dhuhr' THEN 2 WHEN 'asr' THEN 3 WHEN 'maghrib' THEN 4 WHEN 'isha' THEN 5 ELSE 6 END"


@query("c01_public_policy", "sources", f"SELECT source_id, source_type FROM sources WHERE {PUB}")
def c01(sources):
    return reads.public_only(sources).select("source_id", "source_type")


@query("c02_list_places", "places", "SELECT place_id, name, (SELECT count(*) FROM places WHERE status = 'active' AND upper(postcode) LIKE 'B%' AND name ILIKE '%hall%') AS total FROM places WHERE status = 'active' AND upper(postcode) LIKE 'B%' AND name ILIKE '%hall%' ORDER BY name, place_id LIMIT 20 OFFSET 5")
def c02(places):
    found = reads.list_places(places, postcode_prefix="b", text="hall")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return reads.page(found, [F.col("name"), F.col("place_id")], 5, 20).select("place_id", "name").withColumn("total", total.scalar())


@query("c03_admin_search", "places", "SELECT place_id, name, status FROM places WHERE status = 'needs_review' AND (name ILIKE '%city 1%' OR postcode ILIKE '%city 1%' OR city ILIKE '%city 1%')")
def c03(places):
    return reads.list_places(places, text="city 1", columns=("name", "postcode", "city"), status="needs_review").select("place_id", "name", "status")


@query("c04_candidate_scope", "candidates", "SELECT candidate_id, slot_date::VARCHAR AS slot_date FROM candidates WHERE status = 'pending' AND slot_date >= DATE '2024-01-10' AND slot_date <= DATE '2024-01-20' ORDER BY candidates.slot_date DESC, candidate_id LIMIT 50")
def c04(candidates):
    found = reads.candidate_scope(candidates, status="pending", from_date="2024-01-10", to_date="2024-01-20")
    return reads.page(found, [F.desc("slot_date"), F.col("candidate_id")], 0, 50).select("candidate_id", F.col("slot_date").cast("string").alias("slot_date"))


@query("c05_json_predicates", "candidates", "SELECT candidate_id, json_extract_string(evidence, '$.contract') AS contract, coalesce(json_extract_string(evidence, '$.gate_passed') = 'true', false) AS passed FROM candidates WHERE coalesce(json_extract_string(evidence, '$.contract'), '') <> ''")
def c05(candidates):
    value = reads.evidence_value
    return candidates.where(F.coalesce(value("contract"), F.lit("")) != "").select("candidate_id", value("contract").alias("contract"), F.coalesce(value("gate_passed") == "true", F.lit(False)).alias("passed"))


@query("c06_latest_version", "versions", "SELECT version_id, version, format FROM (SELECT * FROM versions WHERE status = 'published' ORDER BY published_on DESC NULLS LAST, created_on DESC, version_id LIMIT 1) CROSS JOIN (VALUES ('csv'), ('ndjson')) f(format)")
def c06(versions):
    return reads.latest_version(versions).select("version_id", "version", F.explode(F.array(F.lit("csv"), F.lit("ndjson"))).alias("format"))


@query("c07_place_times", ("previous", "sources"), f"SELECT place_id, slot_date::VARCHAR AS slot_date, slot, session_no::INT AS session_no, main_min FROM previous WHERE place_id BETWEEN 3 AND 9 AND slot_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' AND source_id IN (SELECT source_id FROM sources WHERE {PUB})")
def c07(previous, sources):
    found = reads.public_times(previous.where(F.col("place_id").between(3, 9)), sources, "2024-01-05", "2024-01-11")
    return found.select("place_id", F.col("slot_date").cast("string").alias("slot_date"), "slot", "session_no", "main_min")


@query("c08_due_sources", "sources", f"SELECT source_id FROM sources WHERE enabled AND assignment = 'active' AND (next_run IS NULL OR next_run <= {DAY})")
def c08(sources):
    return reads.due_sources(sources.withColumn("next_fetch_at", F.lit(None).cast("string")), AS_OF).select("source_id")


define("metadata_sources", ("sources",), """
SELECT source_id, source_type, enabled, 'disabled' AS assignment, next_run, CASE source_id DIV 3 % 4 WHEN 0 THEN NULL
 WHEN 1 THEN 'soon' WHEN 2 THEN '2024-01-30 08:00:00' ELSE '2024-02-09 08:00:00' END AS next_fetch_at FROM @sources""")


@query("c08_due_by_metadata", "metadata_sources", f"SELECT source_id FROM metadata_sources WHERE enabled AND source_type = 'website' AND NOT coalesce(TRY_CAST(next_fetch_at AS TIMESTAMP) > {DAY}, false)")
def c08b(metadata_sources):
    return reads.due_sources(metadata_sources, AS_OF).select("source_id")


@query("c09_missing_website", "places", "SELECT place_id FROM places WHERE coalesce(website, '') = '' AND postcode IS NOT NULL")
def c09(places):
    return reads.missing_website(places).select("place_id")


@query("c10_place_detail", ("places", "aliases", "sources"), f"""
SELECT p.place_id, coalesce((SELECT string_agg(alias, '|' ORDER BY alias) FROM (SELECT DISTINCT alias FROM aliases a
 WHERE a.place_id = p.place_id)), '') AS aliases, coalesce(s.origin, '') AS origin
FROM places p LEFT JOIN (SELECT place_id, string_agg(source_id || ':' || source_type, '|'
 ORDER BY source_id) AS origin FROM sources WHERE {PUB} GROUP BY place_id) s USING (place_id)
 WHERE p.status = 'active'""")
def c10(places, aliases, sources):
    found = reads.place_details(places.where("status = 'active'"), aliases, sources)
    origin = F.array_join(F.transform(F.coalesce("origin", F.array().cast("array<struct<source_id:bigint,source_type:string>>")), lambda x: F.concat(x["source_id"].cast("string"), F.lit(":"), x["source_type"])), "|")
    return found.select("place_id", F.array_join("aliases", "|").alias("aliases"), origin.alias("origin"))


@query("g01_latest_run", "candidates", "SELECT source_id, run_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY main_min DESC NULLS LAST, candidate_id DESC) AS n FROM candidates) WHERE n = 1")
def g01(candidates):
    return reads.latest_per_key(candidates, ["source_id"], [F.desc_nulls_last("main_min"), F.desc("candidate_id")]).select("source_id", "run_id", "candidate_id")


_KEYS5 = "place_id, source_id, slot_date, slot, session_no"


@query("g02_candidate_upsert", "candidates", f"""
WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS5} ORDER BY candidate_id DESC) AS n
 FROM candidates WHERE status IN ('pending', 'approved') AND candidate_id % 3 <> 0) WHERE n = 1)
SELECT i.candidate_id, o.candidate_id AS old_id, CASE WHEN o.candidate_id IS NULL THEN 'inserted'
 WHEN i.main_min IS NOT DISTINCT FROM o.main_min AND i.start_min IS NOT DISTINCT FROM o.start_min
 AND i.label IS NOT DISTINCT FROM o.label AND i.timezone IS NOT DISTINCT FROM o.timezone THEN 'unchanged'
 WHEN i.run_id <> o.run_id THEN 'superseded' ELSE 'updated' END AS outcome
FROM candidates i LEFT JOIN old o ON i.place_id = o.place_id AND i.source_id = o.source_id
 AND i.slot_date = o.slot_date AND i.slot = o.slot AND i.session_no = o.session_no WHERE i.candidate_id % 3 = 0""")
def g02(candidates):
    return publish.upsert(candidates.where("candidate_id % 3 <> 0"), candidates.where("candidate_id % 3 = 0")).select("candidate_id", "old_id", "outcome")


@query("g03_duplicate_sessions", "candidates", f"SELECT candidate_id, count(*) OVER (PARTITION BY {_KEYS5}) - 1 AS others FROM candidates WHERE status IN ('pending', 'approved') AND place_id IS NOT NULL QUALIFY others > 0")
def g03(candidates):
    return publish.duplicates(candidates).where("others > 0").select("candidate_id", "others")


@query("g04_carry_forward", "events", """
SELECT event_id, coalesce(last_value(cell IGNORE NULLS) OVER (PARTITION BY user_id
 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS filled
FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type
 WHEN event_id % 3 = 1 THEN NULL ELSE NULL END AS cell FROM events)""")
def g04(events):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "").otherwise('"')
    down = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", F.coalesce(extract.carried(raw, down), F.lit("")).alias("filled"))


@query("g05_change_page", ("change_events", "versions"), "SELECT event_id, kind, version FROM change_events LEFT JOIN versions USING (version_id) WHERE event_id > 1000 ORDER BY event_id LIMIT 100")
def g05(change_events, versions):
    page = reads.page(change_events.where("event_id > 1000"), [F.col("event_id")], 0, 100)
    return page.join(versions, "version_id", "left").select("event_id", "kind", "version")


@query("g06_next_version", "versions", "SELECT split_part(version, '.', 1) AS day, split_part(version, '.', 1) || '.' || (max(split_part(version, '.', 2)::INT) + 1) AS next_version FROM versions GROUP BY 1")
def g06(versions):
    return reads.next_versions(versions)


@query("g07_health_listing", "sources", "SELECT source_id, failures, (SELECT count(*) FROM sources WHERE failures > 0) AS total FROM sources WHERE failures > 0 ORDER BY last_success DESC NULLS LAST, source_id LIMIT 30 OFFSET 10")
def g07(sources):
    found = sources.where("failures > 0")
    return reads.page(found, [F.desc_nulls_last("last_success"), F.col("source_id")], 10, 30).select("source_id", "failures").withColumn("total", found.agg(F.count(F.lit(1))).scalar())


# the frame's zones that no zone database has
NO_ZONE = "'Mars/Base', 'europe/paris '"
VALID = f"""
act AS (SELECT *, count(*) OVER (PARTITION BY {_KEYS5}) - 1 AS oth FROM candidates WHERE status IN ('pending', 'approved')),
iss AS (SELECT *, timezone NOT IN ({NO_ZONE}) AS tz, list_filter([
 CASE WHEN timezone IN ({NO_ZONE}) THEN 'invalid_timezone' END, CASE WHEN place_id IS NULL THEN 'missing_mosque' END,
 CASE WHEN main_min IS NULL THEN 'missing_jamaat' END, CASE WHEN session_no < 1 THEN 'invalid_session_number' END,
 CASE WHEN timezone NOT IN ({NO_ZONE}) AND NOT slot_date BETWEEN {DAY} - 7
 AND {DAY} + 400 THEN 'date_out_of_range' END, CASE WHEN timezone NOT IN ({NO_ZONE}) AND slot = 'jumuah'
 AND dayofweek(slot_date) <> 5 THEN 'jumuah_not_friday' END,
 CASE WHEN timezone NOT IN ({NO_ZONE}) AND main_min < start_min THEN 'jamaat_before_start' END, CASE
 WHEN timezone NOT IN ({NO_ZONE}) AND main_min - start_min > 90 THEN '~jamaat_far_from_start' END,
 CASE WHEN place_id IS NOT NULL AND oth > 0 THEN 'duplicate_session' END, CASE
 WHEN json_extract_string(evidence, '$.ramadan_schedule') = 'true'
 AND json_extract_string(evidence, '$.ramadan_span_days')::INT > 35 THEN '~ramadan_metadata' END],
 lambda x: x IS NOT NULL) AS found FROM act),
val AS (SELECT *, len(list_filter(found, lambda x: NOT starts_with(x, '~'))) = 0 AS valid FROM iss),
chk AS (SELECT v.*, s.policy, s.source_type, array_to_string(list_transform(CASE WHEN valid
 AND run_kind = 'ai' THEN list_append(found, '~ai_requires_review') ELSE found END,
 lambda x: ltrim(x, '~')), ',') AS codes,
 CASE WHEN NOT valid THEN 'rejected'
 WHEN run_kind = 'ai' OR s.source_type = 'community' OR (s.source_type = 'website'
 AND NOT coalesce(json_extract_string(evidence, '$.contract') = 'site_extractor/v1'
 AND json_extract_string(evidence, '$.gate_passed') = 'true', false)) THEN 'pending' ELSE 'approved' END AS new_status
 FROM val v LEFT JOIN sources s USING (source_id)),
pub AS (SELECT *, CASE WHEN status <> 'approved' THEN 'not_approved'
 WHEN place_id IS NULL OR source_type IS NULL THEN 'missing_context' WHEN NOT ({PUB}) THEN 'policy_not_public'
 WHEN run_kind = 'ai' THEN 'ai_needs_override' WHEN NOT valid THEN 'invalid'
 WHEN main_min IS NULL THEN 'missing_time' ELSE 'publish' END AS outcome FROM chk),
win AS (SELECT * FROM pub WHERE outcome = 'publish' QUALIFY row_number() OVER (PARTITION BY place_id, slot_date,
 slot, session_no ORDER BY CASE confidence WHEN 'verified' THEN 1 WHEN 'imported' THEN 2
 WHEN 'inferred' THEN 3 ELSE 4 END, run_id DESC, source_id, candidate_id) = 1)"""


@query("p01_validate", ("candidates", "sources"), f"WITH {VALID} SELECT candidate_id, codes, valid FROM chk")
def p01(candidates, sources):
    rows = publish.validate(candidates, sources, AS_OF)
    return rows.select("candidate_id", F.array_join(F.transform("issues", lambda x: x["code"]), ",").alias("codes"), "valid")


@query("p02_status", ("candidates", "sources"), f"WITH {VALID} SELECT new_status, count(*) AS n FROM chk GROUP BY new_status")
def p02(candidates, sources):
    return publish.validate(candidates, sources, AS_OF).groupBy("new_status").agg(F.count(F.lit(1)).alias("n"))


@query("p03_gate", ("candidates", "sources"), f"SELECT candidate_id, CASE WHEN policy IS NULL OR NOT ({PUB}) THEN 'policy_not_public' WHEN run_kind = 'ai' THEN 'ai_needs_override' END AS reason FROM candidates LEFT JOIN sources USING (source_id)")
def p03(candidates, sources):
    return candidates.join(sources.select("source_id", "policy"), "source_id", "left").select("candidate_id", publish.gate().alias("reason"))


@query("p04_publishable", ("candidates", "sources"), f"WITH {VALID} SELECT outcome, count(*) AS n, min(candidate_id) AS first FROM pub GROUP BY outcome")
def p04(candidates, sources):
    return publish.publishable(publish.validate(candidates, sources, AS_OF)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))


def batch_of(candidates, sources):
    ready = publish.publishable(publish.validate(candidates, sources, AS_OF)).where("outcome = 'publish'")
    return publish.one_per_slot(ready)


KEYSQL = "place_id, slot_date, slot, session_no"
NEWDIFF = " OR ".join(f"n.{v} IS DISTINCT FROM o.{v}" for v in publish.VALUES)


def diff_sql(inside: str | None) -> str:
    old = f"old AS (SELECT *, {inside or 'true'} AS inside FROM previous WHERE source_id IN (SELECT source_id FROM sources WHERE {PUB}))"
    action = f"CASE WHEN o.source_id IS NULL OR (n.source_id IS NOT NULL AND ({NEWDIFF})) THEN 'published' WHEN n.source_id IS NOT NULL THEN 'carried' ELSE '{'carried' if inside else 'removed'}' END"
    if inside:
        action = f"CASE WHEN o.source_id IS NOT NULL AND NOT o.inside THEN 'carried' ELSE {action} END"
    return f"""{VALID}, {old}, dif AS (SELECT *, coalesce(n_place, o_place) AS place_id FROM (SELECT n.place_id AS n_place,
 o.place_id AS o_place, coalesce(n.slot_date, o.slot_date) AS slot_date, coalesce(n.slot, o.slot) AS slot,
 coalesce(n.session_no, o.session_no) AS session_no, {action} AS action,
 n.main_min AS n_main, o.main_min AS o_main, n.candidate_id AS n_cand, o.candidate_id AS o_cand FROM win n FULL
 JOIN old o ON n.place_id = o.place_id AND n.slot_date = o.slot_date AND n.slot = o.slot
 AND n.session_no = o.session_no))"""


_ROWS = "SELECT place_id, slot_date::VARCHAR AS slot_date, slot, session_no::INT AS session_no, action, CASE WHEN action = 'published' THEN n_main ELSE o_main END::INT AS main_min, CASE WHEN action = 'removed' THEN o_cand ELSE coalesce(n_cand, o_cand) END AS candidate_id FROM dif"
_PUB3 = ("candidates", "sources", "previous")


def _rows(result):
    return result.select("place_id", F.col("slot_date").cast("string").alias("slot_date"), "slot", "session_no", "action", "main_min", "candidate_id")


@query("p05_publish_full", _PUB3, f"WITH {diff_sql(None)} {_ROWS}")
def p05(candidates, sources, previous):
    return _rows(publish.publish(batch_of(candidates, sources), previous, sources))


@query("p06_publish_scoped", _PUB3, f"WITH {diff_sql('place_id % 2 = 0')} {_ROWS}")
def p06(candidates, sources, previous):
    return _rows(publish.publish(batch_of(candidates, sources), previous, sources, F.col("place_id") % 2 == 0))


@query("p07_change_events", _PUB3, f"""
WITH {diff_sql(None)} SELECT 5000 + row_number() OVER (ORDER BY place_id, slot_date, {ORD},
 session_no) AS event_id, 'occurrence_' || action AS kind, place_id,
 '{{"place_id":' || place_id || ',"date":"' || slot_date || '","slot":"' || slot || '","session_no":' || session_no || ',"main_min":' ||
 CASE WHEN action = 'published' THEN n_main ELSE o_main END || '}}' AS payload FROM dif WHERE action <> 'carried'""")
def p07(candidates, sources, previous):
    return publish.events(kept(publish.publish(batch_of(candidates, sources), previous, sources), "changes"), 5000)


def first_version(previous, sources):
    """An import: all rows are new."""
    return publish.publish(previous, previous.limit(0), sources)


def published_versions(candidates, sources, previous):
    """An import, a full publication, and two writers at once for the even and the odd places, with later times."""
    table = versions.VersionedTable(candidates.sparkSession, shared_folder(candidates.sparkSession, "versions"), buckets=8)
    # each publication reads the winners, some of them twice
    won = kept(batch_of(candidates, sources).select(*publish.KEY, "candidate_id", *publish.VALUES, "confidence"), "batch")
    table.publish(lambda _: first_version(previous, sources), AS_OF)
    table.publish(lambda old: publish.publish(won, old, sources), AS_OF)

    def later(parity):
        mine = F.col("place_id") % 2 == parity
        batch = won.where(mine).withColumn("main_min", F.col("main_min") + 7 + 4 * parity)
        return table.publish(lambda old: publish.publish(batch, old, sources, mine), AS_OF)

    with ThreadPoolExecutor(2) as writers:
        list(writers.map(later, (0, 1)))
    return table


@query("p05_versioned_publish", _PUB3, f"""
WITH {diff_sql(None)} SELECT place_id, slot_date::VARCHAR AS slot_date, slot, session_no::INT AS session_no,
 (main_min + CASE WHEN place_id % 2 = 0 THEN 7 ELSE 11 END)::INT AS main_min, '2024-02-01.4' AS version FROM win""")
def p05_versions(candidates, sources, previous):
    table = published_versions(candidates, sources, previous)
    current = table.current()
    return table.rows(current).select("place_id", F.col("slot_date").cast("string").alias("slot_date"), "slot", "session_no", "main_min", F.lit(current.name).alias("version"))


@query("p07_committed_events", _PUB3, f"""
WITH {diff_sql(None)}, e AS (SELECT 'occurrence_published' AS kind, place_id FROM previous UNION ALL SELECT 'occurrence_' || action, place_id FROM dif WHERE action <> 'carried'
 UNION ALL SELECT 'occurrence_published', place_id FROM win)
SELECT kind, place_id % 2 AS parity, count(*) AS n, (SELECT count(*) FROM e) AS last_id FROM e GROUP BY kind, place_id % 2""")
def p07_committed(candidates, sources, previous):
    events = published_versions(candidates, sources, previous).events()
    return events.groupBy("kind", (F.col("place_id") % 2).alias("parity")).agg(F.count(F.lit(1)).alias("n")).withColumn("last_id", events.agg(F.max("event_id")).scalar())


COVER = f"""
cov AS (SELECT source_id, count(*) FILTER (full_day) AS covered, bool_or(slot_date = {DAY} AND full_day) AS today
 FROM (SELECT source_id, slot_date, len(list_intersect(list(DISTINCT slot), CASE
 WHEN dayofweek(slot_date) = 5 THEN ['fajr', 'dhuhr', 'asr', 'maghrib', 'isha', 'jumuah'] ELSE ['fajr', 'dhuhr', 'asr', 'maghrib', 'isha'] END)) =
 CASE WHEN dayofweek(slot_date) = 5 THEN 6 ELSE 5 END AS full_day
 FROM candidates WHERE slot_date BETWEEN {DAY} AND {DAY} + 7 GROUP BY source_id, slot_date) GROUP BY source_id),
fre AS (SELECT s.source_id, CASE WHEN failures >= 3 THEN 0 ELSE coalesce(covered, 0) END AS covered, CASE
 WHEN failures >= 3 THEN 'source_failed' WHEN last_success IS NULL OR last_success < {DAY} - 30 THEN 'stale'
 WHEN NOT coalesce(today, false) THEN 'missing_today'
 WHEN covered < 8 THEN 'missing_next_days' ELSE 'fresh' END AS freshness FROM sources s LEFT
 JOIN cov USING (source_id))"""


@query("f12_day_coverage", "candidates", f"WITH {COVER.split('fre AS')[0].rstrip().rstrip(',')} SELECT source_id, covered, today FROM cov")
def f12(candidates):
    return publish.day_coverage(candidates, AS_OF)


@query("p08_source_freshness", ("sources", "candidates"), f"WITH {COVER} SELECT source_id, covered, freshness FROM fre")
def p08(sources, candidates):
    return publish.source_freshness(sources, candidates, AS_OF)


@query("p09_occurrence_freshness", ("previous", "sources", "candidates"), f"""
WITH {COVER} SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN freshness = 'fresh' THEN 'fresh'
 WHEN freshness IN ('missing_today', 'missing_next_days') THEN 'partial'
 WHEN freshness IS NULL THEN 'unknown' ELSE 'stale' END AS freshness FROM previous LEFT JOIN fre USING (source_id))
 GROUP BY freshness""")
def p09(previous, sources, candidates):
    mapped = publish.occurrence_freshness(previous, publish.source_freshness(sources, candidates, AS_OF))
    return mapped.groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))


@query("p10_contribution_intake", "cells", r"""
SELECT submission, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected,
 min(first_error) AS first_error FROM (SELECT id // 4 AS submission, slot IS NOT NULL AND minutes IS NOT NULL AS ok,
 CASE WHEN slot IS NULL THEN 'unsupported slot' WHEN minutes IS NULL THEN 'invalid time' END AS first_error FROM
 (SELECT id, CASE lower(trim(label_text)) WHEN 'fajr' THEN 'fajr' WHEN 'zuhr' THEN 'dhuhr'
 WHEN 'jummah' THEN 'jumuah' END AS slot, CASE WHEN regexp_full_match(trim(time_text), '\d{1,2}:\d{2}')
 AND split_part(trim(time_text), ':', 1)::INT <= 23
 AND split_part(trim(time_text), ':', 2)::INT <= 59 THEN 1 END AS minutes FROM cells)) GROUP BY submission""")
def p10(cells):
    rows = cells.select(F.expr("id div 4").alias("submission"), F.lit(1).alias("place_id"), F.lit("2024-02-02").cast("date").alias("slot_date"), F.col("label_text").alias("slot"), F.col("time_text").alias("main_time"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("int").alias("session_no"))
    return contributions.intake(contributions.schedule_rows(rows))


# corrections of known and unknown places, some of which are there already
define("sent", ("events",), "SELECT event_id AS correction_id, user_id * 11 AS place_id, 'Name ' || CAST(event_id AS STRING) AS name, 'mail ' || CAST(event_id AS STRING) AS email FROM @events WHERE event_id % 3 < 2")


@query("p10_corrections", ("corrections", "sent", "places"), """
SELECT correction_id, place_id, status FROM corrections UNION ALL SELECT correction_id, place_id, 'pending'
 FROM sent s WHERE place_id IN (SELECT place_id FROM places) AND NOT EXISTS (SELECT 1 FROM corrections c
 WHERE c.correction_id = s.correction_id)""")
def p10b(corrections, sent, places):
    known = corrections.withColumn("contact", F.lit(None).cast("struct<name:string,email:string>"))
    return contributions.public_view(contributions.appended(known, sent, places, "correction_id"))


@query("p10_new_places", ("sent", "places", "aliases", "sources"), "SELECT correction_id AS submission, 'community' AS source_type, 'place-' || correction_id AS external_id, 'unknown' AS policy, false AS public FROM sent WHERE correction_id % 4 <> 0")
def p10c(sent, places, aliases, sources):
    named = sent.select(F.col("correction_id").alias("submission"), F.when(F.col("correction_id") % 4 != 0, F.col("name")).alias("name"))
    return contributions.new_places(named).select("submission", "source_type", "external_id", "policy", "public")


@query("f14_publish_summary", _PUB3, f"""
WITH {diff_sql(None)} SELECT count(*) FILTER (action = 'published') AS published,
 count(*) FILTER (action = 'carried') AS carried, count(*) FILTER (action = 'removed') AS removed,
 (SELECT count(*) FROM pub WHERE outcome IN ('policy_not_public', 'ai_needs_override')) AS skipped_policy,
 (SELECT count(*) FROM pub WHERE outcome IN ('invalid', 'missing_time')) AS skipped_validation,
 (SELECT count(DISTINCT source_id) FROM win) AS sources FROM dif""")
def f14(candidates, sources, previous):
    # the marks are read twice, the winners too
    marked = publish.publishable(publish.validate(candidates, sources, AS_OF))
    marked = kept(marked.select("outcome", *publish.KEY, "candidate_id", *publish.VALUES, "confidence", "run_id"), "marked")
    batch = kept(publish.one_per_slot(marked.where("outcome = 'publish'")), "batch")
    return publish.summary(marked, batch, publish.publish(batch, previous, sources))


@query("f13_weekly_grid", "previous", f"""
SELECT slot, {', '.join(f"coalesce(string_agg(session_no || '=' || main_min, ',' ORDER BY session_no, main_min) FILTER (slot_date - DATE '2024-01-15' = {d}), '') AS day{d}" for d in range(7))}
 FROM previous WHERE place_id = 5 AND slot_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY slot""")
def f13(previous):
    return reads.weekly_grid(previous.where("place_id = 5"), "2024-01-15")
