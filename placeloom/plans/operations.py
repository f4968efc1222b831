"""Queries of reports, crawling and fetch outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions.text import domain_of, normalise_name
from placeloom.functions.times import WINDOWS
from placeloom.operators import crawl, leads, reads, reports
from placeloom.plans.frames import AS_OF
from placeloom.plans.registry import define, query
from placeloom.plans.scalar import class_sql

DAY = f"DATE '{AS_OF}'"
PUB = "policy = 'public_redistribution_allowed'"
NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HOST = r"regexp_replace(lower(regexp_extract({c}, '^[^:]*://([^/?#]*)', 1)), '^www\.', '')"


@query("f01_coverage", ("places", "sources", "previous", "candidates", "reviews", "corrections", "claims"), f"""
SELECT *, CASE WHEN active > 0 THEN round(100.0::DOUBLE * published / active, 1) ELSE 0 END AS published_pct
 FROM (SELECT count(*) AS places, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active'
 AND postcode IS NULL) AS no_postcode, count(*) FILTER (status = 'active' AND lat IS NULL) AS no_coordinates,
 count(*) FILTER (status = 'active' AND coalesce(website, '') = '') AS no_website FROM places),
 (SELECT count(DISTINCT place_id) AS published FROM previous), (SELECT count(*) AS sources,
 count(*) FILTER (last_seen IS NULL OR last_seen < {DAY} - 30) AS stale_sources FROM sources),
 (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved
 FROM candidates),
 (SELECT count(*) FILTER (status = 'pending') AS pending_reviews FROM reviews),
 (SELECT count(*) FILTER (status = 'pending') AS open_corrections FROM corrections),
 (SELECT count(*) FILTER (status = 'pending') AS open_claims FROM claims)""")
def f01(places, sources, previous, candidates, reviews, corrections, claims):
    return reports.coverage(places, sources, previous, candidates, reviews, corrections, claims, AS_OF)


@query("f02_group_counts", "sources", """
SELECT 'policy' AS "grouping", policy AS value, count(*) AS n FROM sources GROUP BY policy UNION ALL
 SELECT 'source_type', source_type, count(*) FROM sources GROUP BY source_type UNION ALL SELECT 'task_status',
 task_status, count(*) FROM sources GROUP BY task_status UNION ALL SELECT 'failure_category', failure_category,
 count(*) FROM sources GROUP BY failure_category""")
def f02(sources):
    return reports.counts_by(sources, ["policy", "source_type", "task_status", "failure_category"])


@query("f03_source_overlap", "sources", "SELECT label, count(*) AS n FROM (SELECT place_id, array_to_string(list_sort(list(DISTINCT source_type)), '+') AS label FROM sources WHERE place_id IS NOT NULL GROUP BY place_id) GROUP BY label")
def f03(sources):
    return reports.source_overlap(sources)


_BUCKETS = f"SELECT {NORM.format(c='name')} AS plain, city, count(*) AS n, string_agg(place_id, ',' ORDER BY place_id) AS ids FROM places WHERE status <> 'duplicate' GROUP BY 1, 2 HAVING count(*) > 1"


@query("f04_duplicate_buckets", "records", f"{_BUCKETS.replace('place_id', 'record_id').replace('FROM places', 'FROM records').replace(chr(39) + 'duplicate' + chr(39), chr(39) + 'x' + chr(39)).replace('status', 'class')} ORDER BY n DESC, plain, city NULLS LAST LIMIT 25")
def f04(records):
    named = records.select(F.col("record_id").alias("place_id"), "city", F.col("class").alias("status"), normalise_name(F.col("name")).alias("plain"))
    found = reports.duplicate_buckets(named, ["plain", "city"])
    return found.select("plain", "city", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("f05_identity_quality", ("places", "sources"), f"""
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM ({_BUCKETS})) AS duplicate_rows, (SELECT count(*) FROM sources
 WHERE place_id IS NOT NULL) AS linked, (SELECT count(*) FROM sources WHERE place_id IS NULL) AS unlinked,
 (SELECT count(*) FROM places WHERE status = 'active' AND coalesce(website, '') = '') AS no_website""")
def f05(places, sources):
    buckets = reports.duplicate_buckets(places.withColumn("plain", normalise_name(F.col("name"))), ["plain", "city"], None)
    linked = sources.agg(F.count_if(F.col("place_id").isNotNull()).alias("linked"), F.count_if(F.col("place_id").isNull()).alias("unlinked"))
    website = places.agg(F.count_if((F.col("status") == "active") & (F.coalesce("website", F.lit("")) == "")).alias("no_website"))
    return reports.beside(buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows")), linked, website)


_STALE = "last_seen IS NULL OR last_seen < {day} - {days}"


@query("f06_partner_report", ("sources", "candidates", "corrections"), f"""
WITH s AS (SELECT * FROM sources WHERE source_type = 'partner_feed'), c AS (SELECT * FROM candidates
 WHERE source_id IN (SELECT source_id FROM s))
SELECT section, value, count(*) AS n FROM (SELECT 'total' AS section, 'all' AS value FROM s UNION ALL
 SELECT 'linked', 'all' FROM s WHERE place_id IS NOT NULL UNION ALL SELECT 'policy', policy FROM s UNION ALL
 SELECT 'stale', external_id FROM s WHERE {_STALE.format(day=DAY, days=7)}
 UNION ALL SELECT 'candidate_status', status FROM c UNION ALL SELECT 'missing_recent', external_id FROM s
 WHERE place_id IS NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = s.source_id AND slot_date >= {DAY})
 UNION ALL SELECT 'open_corrections', 'all' FROM corrections JOIN s USING (place_id) WHERE status = 'pending')
 GROUP BY section, value""")
def f06(sources, candidates, corrections):
    return reports.partner_report(sources.where("source_type = 'partner_feed'"), candidates, corrections, AS_OF)


define("feed_sources", ("sources",), """
SELECT *, CASE source_id % 4 WHEN 0 THEN 'IE' WHEN 1 THEN '' ELSE NULL END AS meta_country, CASE source_id % 3
 WHEN 0 THEN 'mosque' WHEN 1 THEN 'prayer_room' ELSE NULL END AS meta_class FROM @sources
 WHERE source_type IN ('map_dump', 'website')""")


@query("f07_feed_report", ("feed_sources", "places", "reviews"), f"""
WITH j AS (SELECT s.*, p.place_id IS NOT NULL AS placed, p.country, p.lat, p.lon, p.postcode FROM feed_sources s LEFT
 JOIN places p USING (place_id))
SELECT section, value, count(*) AS n FROM (SELECT 'total' AS section, 'all' AS value FROM j UNION ALL
 SELECT 'linked', 'all' FROM j WHERE place_id IS NOT NULL UNION ALL SELECT 'country', coalesce(nullif(country, ''),
 nullif(meta_country, ''), 'unknown') FROM j UNION ALL SELECT 'policy', policy FROM j
 UNION ALL SELECT 'record_class', coalesce(meta_class, 'unknown') FROM j UNION ALL SELECT 'stale', external_id FROM j
 WHERE {_STALE.format(day=DAY, days=30)} UNION ALL SELECT 'missing_coordinates', external_id FROM j WHERE placed
 AND (lat IS NULL OR lon IS NULL) UNION ALL SELECT 'missing_postcode', external_id FROM j WHERE placed
 AND coalesce(trim(postcode), '') = ''
 UNION ALL SELECT 'pending_reviews', 'all' FROM reviews r JOIN feed_sources f USING (source_id)
 WHERE r.status = 'pending') GROUP BY section, value""")
def f07(feed_sources, places, reviews):
    metadata = F.create_map(F.lit("country"), F.col("meta_country"), F.lit("record_class"), F.col("meta_class"))
    return reports.discovery_report(feed_sources.withColumn("metadata", metadata), places, reviews, AS_OF)


define("lead_rows", ("events",), """
SELECT 'provider=p' || CAST(event_id % 4 AS STRING) || '; outcome=' || CASE event_id % 5 WHEN 0 THEN 'verified'
 WHEN 1 THEN 'fetch_failed' WHEN 2 THEN 'no_match'
 WHEN 3 THEN 'no_match' ELSE 'denied' END || '; url=https://www.site' || CAST(event_id % 61 AS STRING) || '.org/a' ||
 CASE WHEN event_id % 7 = 0 THEN '' ELSE '; name_ratio=' || CAST(event_id * 13 % 101 AS STRING) END || CASE
 WHEN event_id % 5 <> 1 THEN '' WHEN event_id % 4 = 0 THEN '; error was HTTP 403'
 WHEN event_id % 4 = 1 THEN '; Timeout' WHEN event_id % 4 = 2 THEN '; non-HTML body' ELSE '; unclear' END AS notes,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Town ' || CAST(event_id % 37 AS STRING) END AS location,
 event_id % 5 AS o, event_id % 61 AS d, event_id AS id FROM @events""")
_TOP = "(SELECT section, value, n FROM k WHERE section = '{k}' ORDER BY n DESC, value LIMIT {n})"


@query("f08_lead_analysis", "lead_rows", f"""
WITH r AS (SELECT *, 'site' || d || '.org' AS domain, o IN (2, 3) AS lost, CASE
 WHEN id % 7 = 0 THEN NULL ELSE id * 13 % 101 END AS ratio FROM lead_rows),
k AS (SELECT section, value, count(*) AS n FROM (SELECT 'provider' AS section, 'p' || id % 4 AS value FROM r
 UNION ALL SELECT 'outcome', ['verified', 'fetch_failed', 'no_match', 'no_match', 'denied'][o + 1] FROM r UNION ALL
 SELECT 'domain', domain FROM r UNION ALL SELECT 'location', location FROM r
 UNION ALL SELECT 'fetch_failure', ['403_cloudflare', 'timeout', 'non_html', 'other'][id % 4 + 1] FROM r WHERE o = 1
 UNION ALL SELECT 'name_ratio', CASE WHEN ratio < 40 THEN '0-39' WHEN ratio < 60 THEN '40-59'
 WHEN ratio < 80 THEN '60-79' WHEN ratio >= 80 THEN '80-100' END FROM r WHERE lost
 UNION ALL SELECT 'no_match_domain', domain FROM r WHERE lost) WHERE value IS NOT NULL GROUP BY section, value)
SELECT * FROM k WHERE section NOT IN ('domain', 'location', 'no_match_domain')
 UNION ALL {_TOP.format(k="domain", n=40)} UNION ALL {_TOP.format(k="location", n=20)}
 UNION ALL {_TOP.format(k="no_match_domain", n=30)}""")
def f08(lead_rows):
    return leads.lead_analysis(lead_rows)


_ORD = "CASE slot WHEN 'fajr' THEN 1 WHEN 'dhuhr' THEN 2 WHEN 'asr' THEN 3 WHEN 'maghrib' THEN 4 ELSE 5 END"
_WIN = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in WINDOWS.items())


# four kinds of runs: as they are, starts as times, constant times on most dates, no rows
define("checked_rows", ("candidates",), """
SELECT source_id, slot_date, slot, CASE WHEN source_id % 4 = 2 AND dayofmonth(slot_date) % 8 < source_id % 9
 THEN 300 WHEN source_id % 4 = 2 THEN 400 + dayofmonth(slot_date) ELSE main_min END AS main_min,
 CASE WHEN source_id % 4 = 2 AND dayofmonth(slot_date) % 8 < source_id % 9 THEN 300
 WHEN source_id % 4 = 2 THEN 400 + dayofmonth(slot_date) WHEN source_id % 4 = 1 THEN main_min ELSE start_min END AS start_min
 FROM @candidates WHERE source_id % 4 < 3""")
define("checked_runs", ("sources",), """
SELECT source_id, CASE source_id DIV 4 % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Image target — awaiting OCR'
 WHEN 3 THEN 'site says Jumuah_Only' WHEN 4 THEN 'PDF target — awaiting parser.' ELSE 'nothing there' END AS reason FROM @sources""")


@query("f10_plausibility", ("checked_rows", "checked_runs"), f"""
WITH win(slot, lo, hi) AS (VALUES {_WIN}), c AS (SELECT * FROM checked_rows), d AS (SELECT source_id, slot_date, slot, min(main_min) AS first
 FROM c WHERE slot <> 'jumuah' GROUP BY ALL), l AS (SELECT source_id, slot_date,
 first < lag(first) OVER (PARTITION BY source_id, slot_date ORDER BY {_ORD}) AS back FROM d),
y AS (SELECT source_id, count(*) FILTER (dis) AS days_disordered FROM (SELECT source_id, slot_date,
 coalesce(bool_or(back), false) AS dis FROM l GROUP BY ALL) GROUP BY source_id),
z AS (SELECT c.source_id, count(*) AS rows, count(*) FILTER (NOT (main_min BETWEEN lo AND hi)) AS outside_window,
 bool_or(slot_date BETWEEN {DAY} - 1 AND {DAY} + 31) AS has_near_date,
 bool_and(year(slot_date) <> 2024) AS other_year, bool_and(coalesce(main_min = start_min, false)) AS same,
 count(DISTINCT slot_date) AS dates FROM c JOIN win USING (slot) GROUP BY c.source_id),
q AS (SELECT source_id, sum(c) AS repeated FROM (SELECT source_id, slot, main_min, count(*) AS c FROM c GROUP BY ALL)
 JOIN z USING (source_id) WHERE c >= dates * 0.5 GROUP BY source_id)
SELECT r.source_id, coalesce(rows, 0) AS rows, outside_window, has_near_date, other_year, days_disordered,
 CASE WHEN rows IS NOT NULL THEN same AND dates >= 7 AND coalesce(repeated, 0) > rows * 0.5 END AS calculated,
 rows IS NULL AND (reason IS NULL OR NOT (lower(reason) LIKE '%jumuah_only%' OR lower(reason) LIKE '%awaiting ocr%'
 OR lower(reason) LIKE '%pdf target — awaiting parser%')) AS empty_refused
FROM checked_runs r LEFT JOIN z USING (source_id) LEFT JOIN y USING (source_id) LEFT JOIN q USING (source_id)""")
def f10(checked_rows, checked_runs):
    return reports.plausibility(checked_rows, AS_OF, checked_runs)


define("run_rows", ("candidates",), "SELECT source_id AS run_id, slot_date, slot, session_no, evidence FROM @candidates WHERE source_id % 6 <> 0")
define("run_reasons", ("sources",), """
SELECT source_id AS run_id, CASE source_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
 WHEN 2 THEN 'image target — awaiting OCR' WHEN 3 THEN 'site says Jumuah_Only' ELSE 'nothing there' END AS reason
 FROM @sources""")


@query("f11_result_contract", ("run_rows", "run_reasons"), """
WITH k AS (SELECT run_id, slot_date, slot, session_no, count(*) AS n,
 count(*) FILTER (json_extract_string(evidence, '$.contract') IS DISTINCT FROM 'site_extractor/v1') AS w,
 count(*) FILTER (json_extract_string(evidence, '$.gate_passed') IS DISTINCT FROM 'true') AS f FROM run_rows
 GROUP BY ALL),
s AS (SELECT run_id, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicates, sum(w)::BIGINT AS wrong_contract,
 sum(f)::BIGINT AS gate_failed FROM k GROUP BY run_id)
SELECT run_id, coalesce(rows, 0) AS rows, coalesce(duplicates, 0) AS duplicates,
 coalesce(wrong_contract, 0) AS wrong_contract, coalesce(gate_failed, 0) AS gate_failed, rows IS NULL
 AND coalesce(reason, '') = '' AS empty_without_reason, rows IS NULL
 AND coalesce(reason, '') = 'nothing there' AS empty_not_allowed FROM run_reasons LEFT JOIN s USING (run_id)""")
def f11(run_rows, run_reasons):
    return reports.result_contract(run_rows, run_reasons, "site_extractor/v1")


_D12 = rf"""
WITH w AS (SELECT DISTINCT place_id FROM sources WHERE source_type = 'website' AND place_id IS NOT NULL),
 p AS (SELECT place_id, max(greatest(last_seen, last_success)) AS seen_at FROM sources
 WHERE source_type = 'partner_feed' GROUP BY place_id),
j AS (SELECT pl.place_id, website, w.place_id IS NOT NULL AS crawled, p.seen_at, {HOST.format(c='website')} AS h
 FROM places pl LEFT JOIN w ON w.place_id = pl.place_id LEFT JOIN p ON p.place_id = pl.place_id
 WHERE status = 'active')
SELECT place_id, CASE WHEN coalesce(website, '') = '' THEN 'no_website' WHEN cls = 'aggregator' THEN 'aggregator'
 WHEN cls = 'umbrella' THEN 'umbrella' WHEN crawled THEN 'already_registered'
 WHEN seen_at >= {DAY} - 30 THEN 'recent_partner' ELSE 'registered' END AS outcome
 FROM (SELECT *, {class_sql('h')} AS cls FROM j)"""


@query("d12_crawl_registration", ("places", "sources"), _D12)
def d12(places, sources):
    return crawl.registration(places, sources, AS_OF)


@query("f09_skip_tally", ("places", "sources"), f"SELECT outcome, count(*) AS n FROM (WITH {_D12.strip()[5:]}) GROUP BY outcome")
def f09(places, sources):
    return d12(places, sources).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# extractor scripts by place: some keys end with a source's hint, others name a domain and a part of the name
define("scripts", ("places",), "SELECT CASE WHEN place_id % 4 = 0 THEN 'site_0000' || lpad(CAST(place_id % 10000 AS STRING), 4, '0') ELSE 'site_plain_' || CAST(place_id AS STRING) END AS key, CASE WHEN place_id % 400 = 1 THEN 'example.org' ELSE 'place' || CAST(place_id % 50 AS STRING) || '.example.org' END AS domain, CASE WHEN place_id % 3 = 0 THEN 'old town' ELSE 'hall ' || CAST(place_id % 10 AS STRING) END AS name_part FROM @places")
define("crawl_sources", ("places",), "SELECT place_id AS source_id, '0000' || lpad(CAST(place_id % 10000 AS STRING), 4, '0') AS hint, 'www2.place' || CAST(place_id % 50 AS STRING) || '.example.org' AS host, name AS place_name FROM @places")


@query("d13_script_assignment", ("scripts", "crawl_sources"), r"""
WITH h AS (SELECT key, source_id, 'hint' AS how FROM scripts
 JOIN crawl_sources ON regexp_extract(key, '_([0-9a-f]{8})$', 1) = hint),
d AS (SELECT key, source_id, 'domain' AS how FROM scripts
 JOIN crawl_sources ON (host = domain OR ends_with(host, '.' || domain)) AND contains(lower(place_name),
 lower(name_part)) WHERE key NOT IN (SELECT key FROM h))
SELECT key, source_id, how, count(source_id) OVER (PARTITION BY key) AS matches FROM (SELECT DISTINCT key
 FROM scripts) LEFT JOIN (SELECT * FROM h UNION ALL SELECT * FROM d) USING (key)""")
def d13(scripts, crawl_sources):
    return crawl.match_scripts(scripts, crawl_sources)


define("assigned", ("sources",), "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'site_plain_' || CAST(source_id % 60 AS STRING) ELSE 'gone_' || CAST(source_id AS STRING) END AS key, assignment AS status FROM @sources WHERE source_type = 'website' OR source_id % 3 = 0")


@query("d13_missing_scripts", ("assigned", "scripts"), "SELECT source_id, key, CASE WHEN key NOT IN (SELECT key FROM scripts) AND status <> 'disabled' THEN 'missing_script' ELSE status END AS status FROM assigned")
def d13b(assigned, scripts):
    return crawl.missing_scripts(assigned, scripts)


# target urls of extractors: host classes by turns, some extractors without assignment, some assignments without targets
define("targets", ("sources",), "SELECT 'x' || CAST(source_id % 701 AS STRING) AS key, url FROM @sources WHERE source_id % 701 < 600 AND source_id % 5 <> 2")
define("target_assignments", ("sources",), "SELECT 'x' || CAST(source_id % 701 AS STRING) AS key, assignment AS status FROM @sources WHERE source_id % 701 >= 100")


@query("d15_extractor_verdicts", ("targets", "target_assignments"), rf"""
WITH t AS (SELECT key, bool_or(cls = 'aggregator') AS agg, bool_or(cls = 'umbrella') AS umb
 FROM (SELECT key, {class_sql('h')} AS cls FROM (SELECT key, {HOST.format(c='url')} AS h FROM targets)) GROUP BY key),
 a AS (SELECT key, bool_or(status = 'active') AS active FROM target_assignments GROUP BY key)
SELECT verdict, count(*) AS n, min(key) AS first FROM (SELECT coalesce(t.key, a.key) AS key, CASE
 WHEN agg THEN 'aggregator' WHEN umb THEN 'umbrella' WHEN NOT coalesce(active,
 false) THEN 'no_active_assignment' ELSE 'keep' END AS verdict FROM t FULL JOIN a ON t.key = a.key)
 GROUP BY verdict""")
def d15b(targets, target_assignments):
    return crawl.extractor_verdicts(targets, target_assignments).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query("d14_authoring_eligibility", "sources", "SELECT source_id, CASE WHEN NOT enabled THEN 'disabled' WHEN assignment = 'active' THEN 'has_extractor' WHEN task_status = 'deployed' THEN 'deployed' WHEN task_status = 'skipped_review' THEN 'in_review' WHEN task_status = 'failed' AND NOT (failure_category = 'transient_network' AND attempts < 3) THEN 'failed_for_good' ELSE 'eligible' END AS verdict FROM sources WHERE source_type = 'website'")
def d14(sources):
    return crawl.eligible(sources).select("source_id", "verdict")


@query("d15_policy_verdicts", "sources", rf"""
SELECT source_id, CASE cls WHEN 'aggregator' THEN 'failed'
 WHEN 'umbrella' THEN 'review' ELSE 'ok' END AS source_verdict, CASE
 WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_scheme' WHEN cls = 'aggregator' THEN 'aggregator'
 WHEN cls = 'umbrella' THEN 'umbrella' WHEN cls = 'widget' THEN 'ok'
 WHEN h = own OR ends_with(h, '.' || own) THEN 'ok' ELSE 'off_domain' END AS target_verdict
FROM (SELECT *, {class_sql('h')} AS cls FROM (SELECT source_id, url, {HOST.format(c='url')} AS h,
 nullif({HOST.format(c='homepage')}, '') AS own FROM sources))""")
def d15(sources):
    # dealt out first: a few small files hold the rows of many sources
    rows = sources.select("source_id", "url", "homepage").repartition("source_id")
    rows = crawl.hosted(rows.select("source_id", "url", domain_of(F.col("homepage")).alias("own")), "url")
    return rows.select("source_id", crawl.source_verdict().alias("source_verdict"), crawl.target_verdict(F.col("url"), F.col("own")).alias("target_verdict"))


_LISTED = "CASE WHEN source_id % 4 = 0 THEN NULL ELSE assignment END"


@query("d16_extractor_listing", ("sources", "places"), f"""
SELECT source_id, name, {_LISTED} AS assignment, {_LISTED} IS NULL AS missing_script FROM sources LEFT
 JOIN (SELECT place_id, name FROM places) USING (place_id) WHERE source_type = 'website'
 ORDER BY next_run ASC NULLS FIRST, source_id LIMIT 60 OFFSET 5""")
def d16(sources, places):
    listed = crawl.listing(sources.withColumn("assignment", F.when(F.col("source_id") % 4 != 0, F.col("assignment"))), places)
    page = reads.page(listed, [F.asc_nulls_first("next_run"), F.col("source_id")], 5, 60)
    return page.select("source_id", "name", "assignment", "missing_script")


@query("d16_extractor_search", ("sources", "places"), f"""
SELECT source_id, name, {_LISTED} AS assignment, {_LISTED} IS NULL AS missing_script FROM sources
 JOIN (SELECT place_id, name FROM places) USING (place_id) WHERE source_type = 'website' AND name ILIKE '%hall%'
 ORDER BY next_run ASC NULLS FIRST, source_id LIMIT 40""")
def d16b(sources, places):
    listed = crawl.listing(sources.withColumn("assignment", F.when(F.col("source_id") % 4 != 0, F.col("assignment"))), places, "hall")
    page = reads.page(listed, [F.asc_nulls_first("next_run"), F.col("source_id")], 0, 40)
    return page.select("source_id", "name", "assignment", "missing_script")


@query("d17_convert_source_types", "sources", "SELECT source_id, CASE WHEN source_type = 'community' THEN 'map_dump' ELSE source_type END AS source_type FROM sources s WHERE source_type <> 'community' OR NOT EXISTS (SELECT 1 FROM sources o WHERE o.place_id = s.place_id AND o.source_type = 'map_dump')")
def d17(sources):
    return crawl.convert_source_type(sources, "community", "map_dump").select("source_id", "source_type")


_LASTOK = "(SELECT source_id, max(CASE WHEN success THEN event_id END) AS ok FROM fetches GROUP BY source_id)"


FOLDED = f"""
SELECT source_id, failures, CASE WHEN failures >= 3 THEN 'source_failed'
 WHEN failures > 0 THEN 'degraded' ELSE 'healthy' END AS state, CASE WHEN failures = 0 THEN 24 ELSE least(24, pow(2,
 least(failures, 4)))::INT END AS wait_hours
FROM (SELECT f.source_id, count(*) FILTER (NOT f.success AND (o.ok IS NULL OR (f.ts, f.event_id) > (t.ts,
 o.ok))) AS failures FROM fetches f JOIN {_LASTOK} o USING (source_id) LEFT JOIN fetches t ON t.event_id = o.ok
 GROUP BY f.source_id)"""


@query("j02_fetch_outcomes", "fetches", FOLDED)
def j02(fetches):
    return crawl.trailing_failures(fetches).select("source_id", "failures", "state", "wait_hours")


@query("j03_reschedule", "sources", "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 12 ELSE CASE greatest(failures, 1) WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 24 END END AS hours, CASE WHEN failures >= 3 AND source_id % 3 <> 0 THEN 'failed_validation' ELSE assignment END AS assignment FROM sources")
def j03(sources):
    ok = F.col("source_id") % 3 == 0
    return sources.select("source_id", crawl.reschedule(F.col("failures"), ok, F.lit(12)).alias("hours"), F.when((F.col("failures") >= crawl.FAILED_AT) & ~ok, "failed_validation").otherwise(F.col("assignment")).alias("assignment"))


define("runs", ("pages",), "SELECT page_id % 97 AS source_id, md5(html) AS hash, page_id % 3 = 0 AS success FROM @pages WHERE page_id % 3 <> 1")


SKIPPED = "SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.success AND r.source_id = p.page_id % 97 AND r.hash = md5(html)) THEN 'skip' ELSE 'extract' END AS action FROM pages p"


@query("j04_skip_unchanged", ("pages", "runs"), SKIPPED)
def j04(pages, runs):
    hashed = pages.select("page_id", (F.col("page_id") % 97).alias("source_id"), F.md5("html").alias("hash"))
    return crawl.unchanged(hashed, runs).select("page_id", "action")


@query("j05_ttl_lookup", "fetches", "SELECT source_id, event_id FROM fetches WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id) = 1")
def j05(fetches):
    return crawl.cached(fetches, "source_id", F.lit("2024-01-20 00:00:00").cast("timestamp"), 7 * 24).select("source_id", "event_id")


# lookups at times of their own: on an entry's, between entries, past the time to live, of keys without entries
define("lookups", ("fetches",), """
SELECT event_id AS lookup_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE (source_id * 7 + event_id) % 170 END AS source_id,
 CASE WHEN event_id % 5 = 0 THEN CAST(ts AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) + INTERVAL 37 HOUR END AS at FROM @fetches""")


@query("j05_lookups_as_of", ("lookups", "fetches"), """
SELECT lookup_id, arg_max(f.event_id, (f.ts, -f.event_id)) AS event_id FROM lookups l LEFT JOIN fetches f ON f.source_id = l.source_id
 AND f.ts <= l.at AND f.ts >= l.at - INTERVAL 12 HOUR GROUP BY lookup_id""")
def j05_as_of(lookups, fetches):
    entries = fetches.withColumn("ts", F.col("ts").cast("timestamp"))
    return crawl.cached_at(lookups.withColumn("at", F.col("at").cast("timestamp")), entries, "source_id", 12).select("lookup_id", "event_id")


@query("a11_artifacts", "pages", "SELECT source_id, count(*) AS artifacts, max(page_id) AS latest FROM (SELECT page_id % 40 AS source_id, page_id, sha256(html) AS h FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 40, sha256(html) ORDER BY page_id) = 1) GROUP BY source_id")
def a11(pages):
    first = crawl.artifacts(pages.select((F.col("page_id") % 40).alias("source_id"), "page_id", F.col("html").alias("body")))
    return first.groupBy("source_id").agg(F.count(F.lit(1)).alias("artifacts"), F.max("page_id").alias("latest"))
