"""Frames of the library's shapes (places, sources, candidates, ...) over the given tables.

as_of is DATE '2024-02-01' throughout. Only integer arithmetic, CASE and concatenation are used, so
that both engines derive the same rows bit for bit.
"""

from placeloom.plans.registry import define

AS_OF = "2024-02-01"

define("places", ("customer",), """
SELECT c_custkey AS place_id,
 CASE c_custkey % 7 WHEN 0 THEN 'Central' WHEN 1 THEN 'East' WHEN 2 THEN 'St. Mary''s' WHEN 3 THEN 'Green  Lane'
 WHEN 4 THEN 'North-West' WHEN 5 THEN 'Riverside' ELSE 'Old Town' END || ' ' ||
 CASE (c_custkey DIV 7) % 5 WHEN 0 THEN 'Hall' WHEN 1 THEN 'Education Trust' WHEN 2 THEN 'Centre'
 WHEN 3 THEN 'Welfare Association' ELSE 'House' END || ' ' || CAST(c_nationkey AS STRING) AS name,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE chr(CAST(65 + c_custkey % 5 AS INT)) || CAST(c_custkey % 9 + 1 AS STRING) || ' ' || CAST((c_custkey DIV 45) % 10 AS STRING) || 'AB' END AS postcode,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'City ' || CAST(c_custkey DIV 40 AS STRING) END AS city,
 CASE WHEN c_nationkey % 5 = 0 THEN 'IE' ELSE 'GB' END AS country,
 CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 51 + ((c_custkey DIV 4) * 7919 % 5000) / CAST(10000.0 AS DOUBLE) +
 CASE c_custkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0.0002 AS DOUBLE)
 WHEN 2 THEN CAST(0.0009 AS DOUBLE) ELSE CAST(0.003 AS DOUBLE) END END AS lat,
 CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE -1 + ((c_custkey DIV 4) * 104729 % 5000) / CAST(10000.0 AS DOUBLE) END AS lon,
 CASE WHEN c_custkey % 3 = 0 THEN NULL
 WHEN c_custkey % 11 = 0 THEN 'https://www.salah.com/p/' || CAST(c_custkey AS STRING)
 WHEN c_custkey % 23 = 0 THEN '' ELSE 'http://WWW.place' || CAST(c_custkey % 50 AS STRING) || '.example.org/home/?a=1' END AS website,
 CASE WHEN c_custkey % 10 < 7 THEN 'active' WHEN c_custkey % 10 < 9 THEN 'needs_review' ELSE 'duplicate' END AS status,
 c_acctbal AS balance, c_mktsegment AS segment
FROM @customer""")

define("aliases", ("places",), """
SELECT place_id, 'Alias ' || CAST(place_id % 6 AS STRING) || ' ' || substr(name, 1, 5) AS alias FROM @places
 WHERE place_id % 4 = 1
UNION ALL SELECT place_id, name AS alias FROM @places WHERE place_id % 9 = 2""")

define("customer3", ("customer",), "SELECT *, EACH(3) AS j FROM @customer")

define("sources", ("customer3",), """
SELECT c_custkey * 3 + j AS source_id,
 CASE WHEN (c_custkey * 3 + j) % 23 = 0 THEN NULL ELSE c_custkey DIV 10 END AS place_id,
 CASE j WHEN 0 THEN 'partner_feed' WHEN 1 THEN 'website' ELSE CASE
 WHEN c_custkey % 2 = 0 THEN 'community' ELSE 'map_dump' END END AS source_type,
 CASE WHEN (c_custkey * 3 + j) % 8 >= 3 THEN 'public_redistribution_allowed'
 WHEN (c_custkey * 3 + j) % 8 = 0 THEN 'unknown' ELSE 'internal_only' END AS policy,
 CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE DATE '2024-02-01' - CAST((c_custkey * 3 + j) % 60 AS INT) END AS last_seen,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE DATE '2024-02-01' - CAST((c_custkey * 7 + j) % 45 AS INT) END AS last_success,
 CAST(c_custkey % 5 AS INT) AS failures,
 'x' || CAST(c_custkey * 3 + j AS STRING) AS external_id,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ' Source ' || CAST(c_custkey % 4 AS STRING) || ' ' END AS attribution,
 CASE WHEN c_custkey % 5 = 0 THEN 'http://feed.place' || CAST(c_custkey % 50 AS STRING) || '.example.org/t'
 WHEN c_custkey % 5 = 1 THEN 'https://sub.salah.com/x' WHEN c_custkey % 5 = 2 THEN 'https://www.ismaili.net/'
 WHEN c_custkey % 5 = 3 THEN 'https://mawaqit.net/en/a' ELSE 'ftp://place' || CAST(c_custkey % 50 AS STRING) || '.example.org' END AS url,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'http://place' || CAST(c_custkey % 50 AS STRING) || '.example.org' END AS homepage,
 (c_custkey % 6) <> 1 AS enabled,
 CASE WHEN c_custkey % 3 = 0 THEN 'active' WHEN c_custkey % 3 = 1 THEN 'disabled' ELSE 'failed_validation' END AS assignment,
 CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE DATE '2024-02-01' - CAST(c_custkey % 9 AS INT) + 4 END AS next_run,
 CASE WHEN c_custkey % 7 < 3 THEN 'pending' WHEN c_custkey % 7 < 5 THEN 'failed'
 WHEN c_custkey % 7 = 5 THEN 'deployed' ELSE 'skipped_review' END AS task_status,
 CASE WHEN c_custkey % 2 = 0 THEN 'transient_network' ELSE 'aggregator' END AS failure_category,
 CAST(c_custkey % 5 AS INT) AS attempts
FROM @customer3""")

define("orders6", ("orders",), "SELECT *, EACH(6) AS slot FROM @orders")

define("candidates", ("orders6",), """
SELECT o_orderkey * 6 + slot AS candidate_id,
 o_custkey * 3 + o_orderkey % 3 AS source_id,
 CASE WHEN (o_custkey * 3 + o_orderkey % 3) % 23 = 0 THEN NULL ELSE o_custkey DIV 10 END AS place_id,
 DATE '2024-01-01' + CAST(o_orderkey % 60 AS INT) AS slot_date,
 CASE slot WHEN 0 THEN 'fajr' WHEN 1 THEN 'dhuhr' WHEN 2 THEN 'asr' WHEN 3 THEN 'maghrib'
 WHEN 4 THEN 'isha' ELSE 'jumuah' END AS slot,
 CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 1 + (o_orderkey DIV 60) % 2 END AS INT) AS session_no,
 CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 300 + 150 * slot + o_orderkey % 11 END AS INT) AS start_min,
 CAST(CASE WHEN (o_orderkey * 6 + slot) % 29 = 0 THEN NULL
 WHEN (o_orderkey * 6 + slot) % 31 = 0 THEN 290 + 150 * slot
 WHEN o_orderkey % 37 = 0 THEN 420 + 150 * slot ELSE 315 + 150 * slot + o_orderkey % 7 END AS INT) AS main_min,
 CASE WHEN o_orderkey % 41 = 0 THEN 'Mars/Base' WHEN o_orderkey % 43 = 0 THEN 'Europe/Dublin'
 WHEN o_orderkey % 47 = 0 THEN 'Asia/Karachi'
 WHEN o_orderkey % 53 = 0 THEN 'europe/paris ' ELSE 'Europe/London' END AS timezone,
 CASE WHEN o_orderkey % 5 < 2 THEN 'pending' WHEN o_orderkey % 5 < 4 THEN 'approved' ELSE 'superseded' END AS status,
 CASE WHEN o_orderkey % 19 = 0 THEN 'ai' ELSE 'parser' END AS run_kind,
 o_orderkey % 1000 AS run_id,
 CASE o_orderkey % 4 WHEN 0 THEN '{"contract":"site_extractor/v1","gate_passed":true}'
 WHEN 1 THEN '{"contract":"site_extractor/v1","gate_passed":false}'
 WHEN 2 THEN '{"ramadan_schedule":true,"ramadan_span_days":40}' ELSE NULL END AS evidence,
 CASE o_orderkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'imported' ELSE 'calculated' END AS confidence,
 CASE WHEN slot = 5 THEN 'Session ' || CAST((o_orderkey DIV 60) % 2 AS STRING) ELSE NULL END AS label
FROM @orders6""")

define("previous", ("candidates",), """
SELECT place_id, slot_date, slot, session_no, min(candidate_id) AS candidate_id, min(source_id) AS source_id,
 CAST(min(CASE WHEN candidate_id % 11 = 0 THEN main_min + 3 ELSE main_min END) AS INT) AS main_min,
 CAST(min(start_min) AS INT) AS start_min, min(label) AS label, min(timezone) AS timezone,
 min(confidence) AS confidence
FROM @candidates WHERE candidate_id % 4 <> 0 AND place_id IS NOT NULL AND main_min IS NOT NULL GROUP BY place_id,
 slot_date, slot, session_no""")

define("versions", ("nation",), """
SELECT n_nationkey AS version_id, '2024-01-' || CASE
 WHEN n_nationkey % 9 < 5 THEN '1' ELSE '2' END || CAST(n_nationkey % 5 AS STRING) || '.' || CAST(1 + n_nationkey % 12 AS STRING) AS version,
 CASE WHEN n_nationkey % 4 = 3 THEN 'draft' ELSE 'published' END AS status,
 CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE DATE '2024-01-10' + CAST(n_nationkey % 9 AS INT) END AS published_on,
 DATE '2024-01-01' + CAST(n_nationkey AS INT) AS created_on
FROM @nation""")

define("reviews", ("orders",), """
SELECT o_orderkey AS review_id, o_custkey * 3 + o_orderkey % 3 AS source_id, CASE
 WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 100) / CAST(100.0 AS DOUBLE) END AS score,
 CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 3 = 1 THEN 'accepted' ELSE 'rejected' END AS status,
 o_custkey AS proposed_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_custkey + 1) % 1500 END AS alternative_1,
 CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_custkey END AS alternative_2,
 CASE WHEN o_orderkey % 2 = 0 THEN 'postcode_match,name_ratio_95' ELSE 'name_ratio_88,city_match' END AS reasons,
 DATE '2024-01-01' + CAST(o_orderkey % 31 AS INT) AS created_on
FROM @orders""")

define("change_events", ("events",), """
SELECT event_id, event_type AS kind, user_id AS place_id, event_id % 25 AS version_id, props AS payload FROM @events""")

define("claims", ("events",), "SELECT event_id AS claim_id, user_id AS place_id, 'person' || CAST(event_id AS STRING) || ' at example.org' AS contact, CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'verified' END AS status FROM @events WHERE event_id % 3 = 0")
define("corrections", ("events",), """
SELECT event_id AS correction_id, user_id AS place_id, CASE
 WHEN event_id % 2 = 0 THEN 'pending' ELSE 'done' END AS status FROM @events WHERE event_id % 3 = 1""")

define("fetches", ("events",), "SELECT event_id, ts, user_id AS source_id, event_type <> 'error' AS success FROM @events")


def _name(k: str) -> str:
    return (f"CASE {k} % 7 WHEN 0 THEN 'Central' WHEN 1 THEN 'East' WHEN 2 THEN 'St. Mary''s' WHEN 3 THEN 'Green  Lane' WHEN 4 THEN 'North-West' WHEN 5 THEN 'Riverside' ELSE 'Old Town' END || ' ' || "
            f"CASE ({k} DIV 7) % 5 WHEN 0 THEN 'Hall' WHEN 1 THEN 'Education Trust' WHEN 2 THEN 'Centre' WHEN 3 THEN 'Welfare Association' ELSE 'House' END")


# incoming feed rows: some like a place, some near one, some new
define("feed_keys", ("supplier", "part"), "SELECT s_suppkey * 2 + 1 AS record_id, s_suppkey AS t, s_nationkey AS nation FROM @supplier UNION ALL SELECT p_partkey * 2 AS record_id, p_partkey AS t, CAST(p_size % 25 AS INT) AS nation FROM @part")
define("records", ("feed_keys",), f"""
SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'The ' || {_name("t")}
 WHEN 1 THEN 'New ' || {_name("(t + 3)")} ELSE {_name("t")} || ' ' || CAST(nation AS STRING) END AS name,
 CASE WHEN record_id % 4 = 3 THEN NULL ELSE chr(CAST(65 + t % 5 AS INT)) || CAST(t % 9 + 1 AS STRING) || CASE
 WHEN record_id % 2 = 0 THEN ' ' ELSE '' END || CAST((t DIV 45) % 10 AS STRING) || 'ab' END AS postcode,
 CASE WHEN record_id % 11 = 0 THEN NULL ELSE 'CITY ' || CAST(t DIV 40 AS STRING) END AS city, CASE
 WHEN nation % 5 = 0 THEN 'IE' ELSE 'GB' END AS country,
 51 + ((t DIV 4) * 7919 % 5000) / CAST(10000.0 AS DOUBLE) + CASE record_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 20
 WHEN 2 THEN 40 WHEN 3 THEN 80 WHEN 4 THEN 120 WHEN 5 THEN 300 ELSE 900 END / CAST(111195.0 AS DOUBLE) AS lat,
 -1 + ((t DIV 4) * 104729 % 5000) / CAST(10000.0 AS DOUBLE) AS lon,
 CASE WHEN record_id % 6 = 0 THEN NULL ELSE 'https://place' || CAST(t % 50 AS STRING) || '.example.org' END AS website,
 CASE record_id % 9 WHEN 0 THEN 'approximate' ELSE 'precise' END AS precision, CASE record_id % 13
 WHEN 0 THEN 'low' ELSE 'high' END AS confidence, CASE record_id % 8 WHEN 0 THEN 'multi_faith'
 WHEN 1 THEN 'prayer_room' ELSE 'mosque' END AS class,
 CASE WHEN record_id % 3 = 0 THEN 'map_dump' ELSE 'partner_feed' END AS source_type, 'x' || CAST(record_id AS STRING) AS external_id,
 record_id % 4 <> 1 AS public, DATE '2023-06-01' + CAST(record_id % 300 AS INT) AS record_date
FROM @feed_keys""")

define("register", ("customer",), f"""
SELECT c_custkey AS number, {_name("c_custkey")} || ' Community ' || CAST(c_custkey % 3 AS STRING) AS name,
 CASE WHEN c_custkey % 12 = 0 THEN '' ELSE chr(CAST(65 + c_custkey % 5 AS INT)) || CAST(c_custkey % 9 + 1 AS STRING) || ' ' || CAST((c_custkey DIV 45) % 10 AS STRING) || 'ab' END AS postcode,
 CASE c_custkey % 6 WHEN 0 THEN 'www.facebook.com/x' WHEN 1 THEN 'place' || CAST(c_custkey AS STRING) || '.org'
 WHEN 2 THEN 'https://reg' || CAST(c_custkey AS STRING) || '.org/home' WHEN 3 THEN ' '
 WHEN 4 THEN 'http://fedex.com' ELSE 'https://ok.example.net' END AS web
FROM @customer""")
