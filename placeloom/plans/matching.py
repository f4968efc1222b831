"""Queries of joins over places and of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.text import PARENT_PATTERNS
from placeloom.operators import leads, nearby, publish, reads, resolve
from placeloom.plans.frames import AS_OF
from placeloom.plans.registry import define, query
from placeloom.plans.scalar import _TOK, haversine_sql
from placeloom.sources import feeds
from placeloom.sources.files import shared_folder

DAY = f"DATE '{AS_OF}'"
PUB = "policy = 'public_redistribution_allowed'"


def _post(c: str) -> str:
    x = rf"regexp_replace(upper({c}), '\s+', '', 'g')"
    return f"CASE WHEN length({x}) < 5 THEN nullif({x}, '') WHEN regexp_full_match({x}, '[A-Z]{{1,2}}\\d[A-Z\\d]?\\d[A-Z]{{2}}') THEN {x}[:-4] || ' ' || {x}[-3:] ELSE {x} END"


def _key_sql(table: str) -> str:
    return rf"""SELECT *, {_post('postcode')} AS post, nullif(regexp_replace(upper(postcode), '\s+', '', 'g'), '') AS compact,
 nullif(trim(regexp_replace(lower(city), '\s+', ' ', 'g')), '') AS town,
 trim(regexp_replace(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
 CASE WHEN trim(website) <> '' THEN nullif(regexp_replace(lower(regexp_extract(CASE
 WHEN contains(website, '://') THEN website ELSE 'https://' || website END, '^[^:]*://([^/?#]*)', 1)), '^www\.', ''), '') END AS domain
 FROM {table}"""


KEYED = f"r AS ({_key_sql('records')}), p AS ({_key_sql('places')})"
METRES = haversine_sql("r", "p")
# the reference's own formulation, one OR join, as the check of the union of keyed joins
PAIRS = f"pairs AS (SELECT r.record_id, p.place_id, {METRES} AS metres, r.name AS r_name, p.name AS p_name, r.plain AS r_plain, p.plain AS p_plain, r.post AS r_post, p.post AS p_post, r.town AS r_town, p.town AS p_town, r.domain AS r_domain, p.domain AS p_domain, precision, confidence, class FROM r JOIN p ON r.country = p.country AND (r.compact = p.compact OR r.town = p.town OR (abs(r.lat - p.lat) < 0.006 AND {METRES} <= 500)))"
PLAUSIBLE = "CASE WHEN r_post = p_post THEN true WHEN metres <= 500 THEN true WHEN r_post IS NOT NULL AND p_post IS NOT NULL THEN false WHEN r_town IS NOT NULL AND p_town IS NOT NULL THEN r_town = p_town ELSE true END"
LOOSE = "(precision IN ('approximate', 'unknown') OR confidence = 'low' OR class IN ('defunct', 'uncertain', 'multi_faith', 'other'))"
GEO = "CASE " + " ".join(f"WHEN metres <= {m} THEN CASE WHEN {LOOSE} THEN {w}::DOUBLE ELSE {s}::DOUBLE END" for m, s, w in resolve.BANDS) + " ELSE 0::DOUBLE END"


@query("d01_blocking_pairs", ("records", "places"), f"WITH {KEYED}, {PAIRS} SELECT record_id, place_id FROM pairs")
def d01(records, places):
    return resolve.block(records, places)


@query("d02_plausible_pairs", ("records", "places"), f"WITH {KEYED}, {PAIRS} SELECT record_id, place_id, round(metres, 3) AS metres FROM pairs WHERE {PLAUSIBLE}")
def d02(records, places):
    facts = resolve.block_facts(records, places)
    return facts.where(resolve.plausible()).select("record_id", "place_id", F.round("metres", 3).alias("metres"))


_ORIGIN = "(SELECT 51.2::DOUBLE AS lat, -0.8::DOUBLE AS lon)"


@query("d03_radius_search", "places", f"SELECT p.place_id, round({haversine_sql('o', 'p')}, 3) AS metres FROM places p, {_ORIGIN} o WHERE status = 'active' AND {haversine_sql('o', 'p')} <= 5000 ORDER BY {haversine_sql('o', 'p')}, place_id LIMIT 10")
def d03(places):
    return reads.nearest(places, 51.2, -0.8, 5000.0, 10).select("place_id", F.round("metres", 3).alias("metres"))


@query("d04_nearby_times", ("places", "previous", "sources"), f"""
WITH near AS (SELECT p.place_id, round({haversine_sql('o', 'p')}, 3) AS metres FROM places p, {_ORIGIN} o
 WHERE status = 'active' AND {haversine_sql('o', 'p')} <= 20000 ORDER BY {haversine_sql('o', 'p')}, place_id LIMIT 40)
SELECT place_id, metres, slot, session_no::INT AS session_no, main_min FROM near JOIN previous USING (place_id)
 WHERE slot_date = DATE '2024-01-12' AND source_id IN (SELECT source_id FROM sources WHERE {PUB})""")
def d04(places, previous, sources):
    near = reads.nearest(places, 51.2, -0.8, 20000.0, 40).withColumn("metres", F.round("metres", 3))
    times = reads.nearby_times(near, previous, sources, "2024-01-12")
    return times.select("place_id", "metres", "slot", "session_no", "main_min")


_NEAR = f"near AS (SELECT record_id, place_id, metres, row_number() OVER (PARTITION BY record_id ORDER BY metres, place_id)::INT AS rank FROM (SELECT r.record_id, p.place_id, {METRES} AS metres FROM records r, places p WHERE r.lat IS NOT NULL AND p.lat IS NOT NULL))"


@query("d03_nearest_each", ("records", "places"), f"WITH {_NEAR} SELECT record_id, place_id, round(metres, 3) AS metres, rank FROM near WHERE rank <= 5")
def d03_each(records, places):
    near = nearby.nearest_each(records, places, "record_id", "place_id", 5)
    return near.select("record_id", "place_id", F.round("metres", 3).alias("metres"), "rank")


@query("d04_times_near_each", ("records", "places", "previous", "sources"), f"""
WITH {_NEAR} SELECT record_id, place_id, slot, session_no::INT AS session_no, main_min FROM near JOIN previous USING (place_id)
 WHERE rank <= 3 AND slot_date = DATE '2024-01-12' AND source_id IN (SELECT source_id FROM sources WHERE {PUB})""")
def d04_each(records, places, previous, sources):
    near = nearby.nearest_each(records, places, "record_id", "place_id", 3)
    return nearby.times_near_each(near, previous, sources, "2024-01-12").select("record_id", "place_id", "slot", "session_no", "main_min")


@query("d05_radius_join", ("records", "places"), f"SELECT r.record_id, p.place_id, round({METRES}, 3) AS metres FROM records r JOIN places p ON abs(r.lat - p.lat) < 0.006 AND {METRES} <= 500")
def d05(records, places):
    return resolve.within(records, places, "record_id", "place_id", 500.0).select("record_id", "place_id", F.round("metres", 3).alias("metres"))


# points on both sides of 180 degrees and by the poles
define("far_points", ("customer",), """
SELECT c_custkey AS point_id, CASE
 WHEN c_custkey % 5 = 4 THEN 89.9 + (c_custkey % 89) / CAST(1000.0 AS DOUBLE) ELSE -17 + (c_custkey DIV 8) % 3000 / CAST(100.0 AS DOUBLE) + (c_custkey % 331) / CAST(1000000.0 AS DOUBLE) END AS lat,
 CASE WHEN c_custkey % 5 = 4 THEN (c_custkey * 37) % 360 - CAST(180.0 AS DOUBLE)
 WHEN c_custkey % 2 = 0 THEN 180 - (c_custkey % 313) / CAST(100000.0 AS DOUBLE) ELSE -180 + (c_custkey % 317) / CAST(100000.0 AS DOUBLE) END AS lon
 FROM @customer""")


@query("d05_radius_join_round_the_globe", "far_points", f"SELECT a.point_id AS a, b.point_id AS b FROM far_points a JOIN far_points b ON abs(a.lat - b.lat) < 0.006 AND {haversine_sql('a', 'b')} <= 200")
def d05b(far_points):
    left = far_points.withColumnRenamed("point_id", "a")
    return resolve.within(left, far_points.withColumnRenamed("point_id", "b"), "a", "b", 200.0).select("a", "b")


@query("d06_crawled_only", ("places", "sources", "candidates"), "SELECT place_id FROM places p WHERE status = 'active' AND EXISTS (SELECT 1 FROM candidates c JOIN sources s USING (source_id) WHERE c.place_id = p.place_id AND s.source_type = 'website' AND c.status = 'approved')")
def d06(places, sources, candidates):
    return reads.crawled_places(places, sources, candidates).select("place_id")


@query("d07_candidate_context", ("candidates", "sources", "places"), "SELECT candidate_id, s.source_type, s.policy, p.status AS place_status FROM candidates c LEFT JOIN sources s USING (source_id) LEFT JOIN places p ON p.place_id = c.place_id")
def d07(candidates, sources, places):
    return reads.candidate_context(candidates, sources, places).select("candidate_id", "source_type", "policy", "place_status")


@query("a10_register", "register", r"SELECT number, regexp_replace(upper(postcode), '\s+', '', 'g') AS compact, CASE WHEN contains(trim(web), '://') THEN trim(web) ELSE 'https://' || trim(web) END AS url FROM register WHERE trim(web) <> '' AND trim(postcode) <> ''")
def a10(register):
    return register_rows(register).select("number", "compact", "url")


def register_rows(register):
    """The register written as a tab-separated file and read back."""
    spark = register.sparkSession
    path = shared_folder(spark, "register")
    register.toDF("Charity Number", "Charity Name", "Postcode", "Web Site").write.csv(path, header=True, sep="\t")
    columns = {"number": "Charity Number", "registered": "Charity Name", "postcode": "Postcode", "web": "Web Site"}
    return feeds.read_register(spark, path, columns).withColumn("number", F.col("number").cast("long"))


# some numbers of the register have a source already
define("register_sources", ("register",), """
SELECT number * 2 + j AS source_id, CASE WHEN j = 0 THEN 'register' ELSE 'website' END AS source_type,
 CAST(number AS STRING) AS external_id FROM (SELECT number, EACH(2) AS j FROM @register) WHERE number % 4 = 1""")


@query("d08_register_leads", ("register", "places", "register_sources"))
def d08(register, places, register_sources):
    found = leads.register_leads(register_rows(register), places, register_sources)
    return found.withColumn("ratio", F.round("ratio", 6))


@query("d08_register_pairs", ("register", "places"), rf"""
WITH k AS (SELECT number, name AS registered, regexp_replace(upper(postcode), '\s+', '', 'g') AS compact,
 regexp_replace(lower(regexp_extract(CASE
 WHEN contains(web, '://') THEN trim(web) ELSE 'https://' || trim(web) END, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') AS host
 FROM register WHERE trim(web) <> '' AND trim(postcode) <> '')
SELECT place_id, number FROM k JOIN places p ON k.compact = regexp_replace(upper(p.postcode), '\s+', '', 'g')
 WHERE coalesce(p.website, '') = '' AND NOT (contains(host, 'facebook.com') OR contains(host, 'x.com'))
 AND len(list_intersect({_TOK.format(c='p.name')}, {_TOK.format(c='registered')})) >= 2""")
def d08b(register, places):
    return leads.register_pairs(register_rows(register), places).select("place_id", "number")


# metadata of a source: keys of homepages, others, and values that are no urls
define("metadata_rows", ("sources",), """
SELECT source_id, place_id, source_type, k, CASE k WHEN 0 THEN 'homepage' WHEN 1 THEN 'homepage_url'
 WHEN 2 THEN 'mosque_website' WHEN 3 THEN 'official_website' WHEN 4 THEN 'primary_website' WHEN 5 THEN 'url'
 WHEN 6 THEN 'detail_page_url' ELSE 'website_url' END AS key,
 CASE WHEN (source_id + k) % 5 = 0 THEN ' HTTPS://h' || CAST(source_id AS STRING) || '.org/' || CAST(k AS STRING) || ' '
 WHEN (source_id + k) % 5 = 1 THEN 'ftp://x'
 WHEN (source_id + k) % 5 = 2 THEN '' ELSE 'http://p' || CAST(k AS STRING) || '.example.org' END AS url
FROM (SELECT source_id, place_id, source_type, EACH(8) AS k FROM @sources) WHERE (source_id * 3 + k) % 7 < 3""")


@query("d09_metadata_leads", ("metadata_rows", "places"), r"""
SELECT source_id, place_id, key, trim(url) AS url FROM metadata_rows JOIN places p USING (place_id)
 WHERE source_type = 'map_dump' AND coalesce(p.website, '') = '' AND k < 6
 AND regexp_matches(lower(trim(url)), '^https?://')""")
def d09(metadata_rows, places):
    pairs = F.map_from_entries(F.collect_list(F.struct("key", "url")))
    sources = metadata_rows.groupBy("source_id", "place_id", "source_type").agg(pairs.alias("metadata"))
    return leads.metadata_leads(sources, places, "map_dump")


@query("d09_tag_leads", ("metadata_rows", "places"), r"""
SELECT DISTINCT place_id, tag, trim(url) AS url FROM (SELECT place_id, url, CASE k WHEN 0 THEN 'website'
 WHEN 1 THEN 'contact:website' WHEN 2 THEN 'url' WHEN 3 THEN 'contact:url'
 WHEN 4 THEN 'name' ELSE 'old:website' END AS tag, k FROM metadata_rows WHERE place_id IS NOT NULL)
JOIN places p USING (place_id) WHERE k < 4 AND regexp_matches(lower(trim(url)), '^https?://')
 AND trim(url) IS DISTINCT FROM p.website""")
def d09b(metadata_rows, places):
    names = F.array(*[F.lit(t) for t in ("website", "contact:website", "url", "contact:url", "name")])
    tag = F.coalesce(F.get(names, F.col("k").cast("int")), F.lit("old:website"))
    rows = metadata_rows.where("place_id is not null")
    elements = rows.select("place_id", F.create_map(tag, F.col("url")).alias("tags"))
    return leads.tag_leads(elements, places).distinct()


# search results are an input: three ranked ones a query, made of the place's own columns
define("results", ("places",), """
SELECT DISTINCT '"' || name || '" ' || postcode AS query, r AS rank, CASE (length(name) + r) % 3
 WHEN 0 THEN 'https://facebook.com/a' || CAST(r AS STRING)
 WHEN 1 THEN 'https://site' || CAST(length(name) AS STRING) || '.org/' ELSE 'https://other.example.net/' || CAST(r AS STRING) END AS url
FROM (SELECT *, CAST(place_id % 3 + 1 AS INT) AS r FROM @places WHERE postcode IS NOT NULL)""")


@query("d10_search_leads", ("places", "results"), """
SELECT place_id, rank, url FROM (SELECT place_id, '"' || name || '" ' || postcode AS query FROM places
 WHERE coalesce(website, '') = '' AND postcode IS NOT NULL) q JOIN results USING (query)
 WHERE NOT contains(url, 'facebook.com')""")
def d10(places, results):
    return leads.search_leads(places, results)


@query("e02_geo_score", ("records", "places"), f"WITH {KEYED}, {PAIRS} SELECT record_id, place_id, {GEO} AS score FROM pairs WHERE metres <= 500")
def e02(records, places):
    return resolve.near_facts(records, places).select("record_id", "place_id", resolve.geo_score().alias("score"))


_PAR = "(?i)" + "|".join(PARENT_PATTERNS)
SCORED = rf"""rat AS (SELECT *, CASE
 WHEN r_plain = p_plain THEN 100 ELSE 0 END::DOUBLE AS ratio, 0::DOUBLE AS alias_ratio, {GEO} AS near FROM pairs
 WHERE {PLAUSIBLE}),
tot AS (SELECT *, round(least(CASE WHEN r_post = p_post THEN 0.35::DOUBLE ELSE 0 END + CASE
 WHEN ratio >= 92 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN r_domain = p_domain THEN 0.25::DOUBLE ELSE 0 END + CASE
 WHEN r_town = p_town THEN 0.10::DOUBLE ELSE 0 END + near
 - CASE WHEN ratio < 85
 AND (regexp_matches(r_name, '{_PAR}') OR regexp_matches(p_name, '{_PAR}')) THEN 0.20::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS score,
 coalesce(r_post = p_post, false)::INT + (ratio >= 92)::INT + coalesce(r_domain = p_domain,
 false)::INT + (near > 0)::INT AS strong, ratio >= 92 OR coalesce(r_domain = p_domain, false) OR coalesce(near > 0
 AND metres <= 25, false) AS identity FROM rat),
sco AS (SELECT * FROM tot WHERE score >= 0.25)"""


def exact_scores(records, places):
    """Scores with 100 for equal normalised names and 0 for others as ratio, which SQL can follow."""
    facts = resolve.pairs_to_score(records, places)
    return resolve.scored(facts.withColumns({"ratio": F.when(F.col("r_plain") == F.col("p_plain"), 100.0).otherwise(0.0), "alias_ratio": F.lit(0.0)}))


@query("e01_pair_score_given_ratios", ("records", "places"), f"WITH {KEYED}, {PAIRS}, {SCORED} SELECT record_id, place_id, score, strong, identity FROM sco")
def e01(records, places):
    return exact_scores(records, places).select("record_id", "place_id", "score", "strong", "identity")


@query("e01_pair_score", ("records", "places", "aliases"))
def e01b(records, places, aliases):
    facts = resolve.pairs_to_score(records, places, aliases)
    return resolve.scored(resolve.with_ratios(facts)).select("record_id", "place_id", "score", F.col("said").alias("reasons"))


@query("e03_decide_given_ratios", ("records", "places"), f"""
WITH {KEYED}, {PAIRS}, {SCORED},
rk AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top_score,
 first_value(ratio >= 85) OVER w AS top_named FROM sco WINDOW w AS (PARTITION BY record_id ORDER BY score DESC,
 place_id)),
fn AS (SELECT *, min(CASE WHEN ratio >= 85 THEN rank END) OVER (PARTITION BY record_id) AS first_named FROM rk),
gp AS (SELECT *, max(CASE WHEN rank = first_named THEN top_score - score END) OVER (PARTITION BY record_id) AS gap FROM fn),
ch AS (SELECT *, CASE WHEN NOT top_named AND gap <= 0.25 + 1e-9 THEN first_named ELSE 1 END AS chosen FROM gp),
ag AS (SELECT record_id, max(CASE WHEN rank = chosen THEN place_id END) AS place_id, max(CASE
 WHEN rank = chosen THEN score END) AS score, max(CASE WHEN rank = chosen THEN strong END) AS strong,
 bool_or(rank = chosen AND identity) AS identity, max(CASE WHEN rank <> chosen THEN score END) AS second FROM ch
 GROUP BY record_id)
SELECT r.record_id, CASE WHEN ag.record_id IS NULL THEN 'create' WHEN coalesce(second, 0) >= 0.5
 AND score - second < 0.1 - 1e-9 THEN 'review' WHEN score >= 0.75 AND strong >= 2
 AND identity THEN 'auto_link' ELSE 'review' END AS decision, place_id, score FROM records r LEFT
 JOIN ag USING (record_id)""")
def e03(records, places):
    return resolve.decide(records, exact_scores(records, places), False).select("record_id", "decision", "place_id", "score")


# ratios of all sizes, in quarters, so that thresholds and roundings of halves occur; some places have no alias
_RATIO, _ALIAS = "(60 + (record_id * 7 + place_id * 13) % 160 / 4.0::DOUBLE)", "CASE WHEN place_id % 3 > 0 THEN 60 + (record_id * 11 + place_id * 5) % 160 / 4.0::DOUBLE END"
RATED = rf"""rat AS (SELECT *, greatest(ratio, alias_ratio) AS best, regexp_matches(r_name, '{_PAR}') OR regexp_matches(p_name, '{_PAR}') AS parent
 FROM (SELECT *, {_RATIO} AS ratio, coalesce({_ALIAS}, 0) AS alias_ratio, {GEO} AS near FROM pairs WHERE {PLAUSIBLE})),
sco AS (SELECT * FROM (SELECT record_id, place_id, round_even(best, 0) AS shown, round(least(
 CASE WHEN r_post = p_post THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN ratio >= 92 THEN 0.30::DOUBLE WHEN ratio >= 85 THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN alias_ratio >= 92 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN r_domain = p_domain THEN 0.25::DOUBLE ELSE 0 END
 + CASE WHEN r_town = p_town THEN 0.10::DOUBLE ELSE 0 END + near - CASE WHEN best < 85 AND parent THEN 0.20::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS score,
 coalesce(r_post = p_post, false)::INT + (round_even(ratio, 0) >= 92)::INT + (round_even(alias_ratio, 0) >= 92)::INT
 + coalesce(r_domain = p_domain, false)::INT + coalesce(near > 0, false)::INT AS strong,
 round_even(ratio, 0) >= 92 OR round_even(alias_ratio, 0) >= 92 OR coalesce(r_domain = p_domain, false) OR coalesce(near > 0 AND metres <= 25, false) AS identity,
 array_to_string(list_filter([CASE WHEN r_post = p_post THEN 'postcode_match' END, CASE WHEN ratio >= 85 THEN 'name_ratio_' || round_even(ratio, 0)::INT END,
 CASE WHEN alias_ratio >= 92 THEN 'alias_ratio_' || round_even(alias_ratio, 0)::INT END, CASE WHEN r_domain = p_domain THEN 'domain_match' END,
 CASE WHEN r_town = p_town THEN 'city_match' END, CASE WHEN near > 0 THEN 'distance_' || floor(metres)::INT END,
 CASE WHEN parent AND best < 85 THEN 'parent_org_name' END], lambda x: x IS NOT NULL), ',') AS reasons FROM rat) WHERE score >= 0.25)"""


def rated(records, places):
    facts = resolve.pairs_to_score(records, places)
    quarters = lambda a, b: 60 + (F.col("record_id") * a + F.col("place_id") * b) % 160 / 4.0
    return resolve.scored(facts.withColumns({"ratio": quarters(7, 13), "alias_ratio": F.when(F.col("place_id") % 3 > 0, quarters(11, 5))}))


@query("e01_scores_of_ratios", ("records", "places"), f"WITH {KEYED}, {PAIRS}, {RATED} SELECT record_id, place_id, score, strong, identity, reasons FROM sco")
def e01_ratios(records, places):
    return rated(records, places).select("record_id", "place_id", "score", "strong", "identity", F.col("said").alias("reasons"))


@query("e03_decisions_of_ratios", ("records", "places"), f"""
WITH {KEYED}, {PAIRS}, {RATED},
rk AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top_score, first_value(shown >= 85) OVER w AS top_named
 FROM sco WINDOW w AS (PARTITION BY record_id ORDER BY score DESC, place_id)),
fn AS (SELECT *, min(CASE WHEN shown >= 85 THEN rank END) OVER (PARTITION BY record_id) AS first_named FROM rk),
gp AS (SELECT *, max(CASE WHEN rank = first_named THEN top_score - score END) OVER (PARTITION BY record_id) AS gap FROM fn),
ch AS (SELECT *, CASE WHEN NOT top_named AND gap <= 0.25 + 1e-9 THEN first_named ELSE 1 END AS chosen FROM gp),
ag AS (SELECT record_id, max(CASE WHEN rank = chosen THEN place_id END) AS place_id, max(CASE WHEN rank = chosen THEN score END) AS score,
 max(CASE WHEN rank = chosen THEN strong END) AS strong, bool_or(rank = chosen AND identity) AS identity,
 max(CASE WHEN rank <> chosen THEN score END) AS second FROM ch GROUP BY record_id)
SELECT r.record_id, CASE WHEN ag.record_id IS NULL THEN 'create' WHEN coalesce(second, 0) >= 0.5 AND score - second < 0.1 - 1e-9 THEN 'review'
 WHEN score >= 0.75 AND strong >= 2 AND identity THEN 'auto_link' ELSE 'review' END AS decision, place_id, score
FROM records r LEFT JOIN ag USING (record_id)""")
def e03_ratios(records, places):
    return resolve.decide(records, rated(records, places), False).select("record_id", "decision", "place_id", "score")


@query("e04_resolve_batch", ("records", "places", "aliases", "sources"))
def e04(records, places, aliases, sources):
    return resolve.resolve_batch(records, places, aliases, sources)


# records linked to a place by key, as the input of what follows a decision
define("linked", ("records",), "SELECT record_id % 700 AS place_id, record_id, name, website, city, postcode, country, record_id % 6 = 0 AS created, lat, lon, public, CASE WHEN record_id % 5 = 0 THEN NULL ELSE record_date END AS record_date, source_type, external_id FROM @records")


def _kept(k: str) -> str:
    return f"CASE WHEN (n.created OR nullif(trim(p.{k}), '') IS NULL) AND nullif(trim(n.{k}), '') IS NOT NULL THEN n.{k} ELSE p.{k} END AS {k}"


_AT = "n.lat IS NOT NULL AND n.lon IS NOT NULL AND (coalesce(n.created, false) OR p.lat IS NULL)"


@query("e05_survivorship", ("places", "linked"), f"""
WITH n AS (SELECT * FROM linked WHERE public QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY record_id) = 1)
SELECT p.place_id, {", ".join(map(_kept, resolve.FIELDS))}, {", ".join(f"CASE WHEN {_AT} THEN n.{k} ELSE p.{k} END AS {k}" for k in ("lat", "lon"))}
 FROM places p LEFT JOIN n USING (place_id)""")
def e05(places, linked):
    return resolve.survive(places, linked)


@query("e06_newer_names", ("places", "linked"), r"""
WITH o AS (SELECT *, row_number() OVER w AS n, lead(record_date) OVER w AS others
 FROM linked WINDOW w AS (PARTITION BY place_id ORDER BY record_date DESC NULLS LAST, record_id)),
t AS (SELECT place_id, name AS new FROM o WHERE n = 1 AND public AND record_date IS NOT NULL
 AND (others IS NULL OR record_date > others)),
j AS (SELECT p.place_id, p.name AS old, t.new,
 coalesce(trim(regexp_replace(regexp_replace(lower(t.new), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) <> trim(regexp_replace(regexp_replace(lower(p.name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')),
 false) AS renamed FROM places p LEFT JOIN t USING (place_id))
SELECT place_id, CASE WHEN renamed THEN new ELSE old END AS name, renamed FROM j""")
def e06(places, linked):
    return resolve.newer_names(places, linked)


@query("e07_source_upsert", ("sources", "records"), f"""
WITH o AS (SELECT source_type, external_id, source_id, url, last_seen FROM sources), n AS (SELECT source_type,
 external_id, website FROM records)
SELECT source_type, external_id, source_id, coalesce(n.website, o.url) AS url, (CASE
 WHEN n.external_id IS NOT NULL THEN {DAY} ELSE last_seen END)::VARCHAR AS last_seen, CASE
 WHEN o.external_id IS NULL THEN 'feed=' || n.external_id
 WHEN n.external_id IS NULL THEN 'feed=old,id=' || source_id ELSE 'feed=' || n.external_id || ',id=' || source_id END AS metadata
FROM o FULL JOIN n USING (source_type, external_id)""")
def e07(sources, records):
    old = sources.withColumn("metadata", F.create_map(F.lit("id"), F.col("source_id").cast("string"), F.lit("feed"), F.lit("old")))
    new = records.select("source_type", "external_id", F.col("website").alias("url"), F.create_map(F.lit("feed"), F.col("external_id")).alias("metadata"))
    out = resolve.upsert_sources(old, new, AS_OF)
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("source_type", "external_id", "source_id", "url", F.col("last_seen").cast("string").alias("last_seen"), F.array_join(pairs, ",").alias("metadata"))


@query("e08_alias_ensure", ("aliases", "linked"), r"""
WITH f AS (SELECT place_id, name AS alias,
 trim(regexp_replace(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM linked),
 h AS (SELECT place_id,
 trim(regexp_replace(regexp_replace(lower(alias), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM aliases)
SELECT place_id, plain, min(alias) AS alias FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.place_id = f.place_id
 AND h.plain = f.plain) GROUP BY place_id, plain""")
def e08(aliases, linked):
    return resolve.new_aliases(aliases, linked.select("place_id", F.col("name").alias("alias")))


@query("e09_settle_reviews", ("reviews", "sources"), """
SELECT review_id, CASE WHEN r.status = 'pending' AND source_id % 3 = 0 THEN 'accepted' ELSE r.status END AS status,
 CASE WHEN r.status = 'pending' AND source_id % 3 IN (0, 1) THEN s.place_id ELSE proposed_id END AS proposed_id
 FROM reviews r LEFT JOIN sources s USING (source_id)""")
def e09(reviews, sources):
    decision = F.when(F.col("source_id") % 3 == 0, "auto_link").when(F.col("source_id") % 3 == 1, "review")
    return resolve.settle_reviews(reviews, sources.select("source_id", decision.alias("decision"), "place_id"))


_CAND = "list_distinct(list_filter([proposed_id, alternative_1, alternative_2], lambda x: x IS NOT NULL))"


@query("e10_review_queue", "reviews", f"SELECT review_id, score, len({_CAND})::INT AS candidates FROM reviews WHERE status = 'pending' AND list_contains(string_split(reasons, ','), 'postcode_match') ORDER BY score DESC NULLS LAST, created_on, review_id LIMIT 50 OFFSET 10")
def e10(reviews):
    queue = resolve.review_queue(reviews, "pending", "postcode_match")
    return reads.page(queue, [F.desc_nulls_last("score"), F.col("created_on"), F.col("review_id")], 10, 50).select("review_id", "score", F.size("candidates").alias("candidates"))


@query("e10_review_queue_by_type", ("reviews", "sources"), f"SELECT review_id, score, len({_CAND})::INT AS candidates FROM reviews WHERE status = 'rejected' AND source_id IN (SELECT source_id FROM sources WHERE source_type = 'website') ORDER BY score DESC NULLS LAST, created_on, review_id LIMIT 50")
def e10b(reviews, sources):
    queue = resolve.review_queue(reviews, "rejected", source_type="website", sources=sources)
    return reads.page(queue, [F.desc_nulls_last("score"), F.col("created_on"), F.col("review_id")], 0, 50).select("review_id", "score", F.size("candidates").alias("candidates"))


@query("e11_bulk_accept", "reviews", f"SELECT review_id, {_CAND}[1] AS place_id FROM (SELECT * FROM reviews WHERE status = 'pending' AND score >= 0.6 ORDER BY score DESC, created_on, review_id LIMIT 300) WHERE len({_CAND}) = 1")
def e11(reviews):
    return resolve.bulk_accept(reviews, 0.6, 300).select("review_id", F.get("candidates", F.lit(0)).alias("place_id"))


@query("e12_bulk_activate", ("places", "sources", "reviews"), f"SELECT place_id FROM (SELECT * FROM places WHERE status = 'needs_review' AND place_id IN (SELECT place_id FROM sources) ORDER BY name, place_id LIMIT 40) WHERE place_id NOT IN (SELECT proposed_id FROM reviews WHERE status = 'pending') AND place_id IN (SELECT place_id FROM sources WHERE {PUB})")
def e12(places, sources, reviews):
    return resolve.bulk_activate(places, sources, reviews, 40).select("place_id")


# chains of merges are followed to their end
_MERGES = """RECURSIVE m0 AS (SELECT place_id AS d, place_id // 10 AS c FROM places WHERE status = 'duplicate'), f(d,
 c) AS (SELECT d, c FROM m0 UNION ALL SELECT f.d, m0.c FROM f JOIN m0 ON m0.d = f.c),
m AS (SELECT d AS duplicate_id, c AS canonical_id FROM f WHERE c NOT IN (SELECT d FROM m0))"""
_MOVED = {"sources": ("source_id", ["place_id"]), "candidates": ("candidate_id", ["place_id"]), "previous": ("candidate_id", ["place_id"]), "claims": ("claim_id", ["place_id"]), "corrections": ("correction_id", ["place_id"]), "reviews": ("review_id", ["proposed_id", "alternative_1", "alternative_2"])}
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(alias), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _merged(places, aliases, **tables):
    merges = places.where("status = 'duplicate'").select(F.col("place_id").alias("duplicate_id"), F.expr("place_id div 10").alias("canonical_id"))
    return resolve.merge_places(merges, places, aliases, {k: (df, _MOVED[k][1]) for k, df in tables.items()})


@query("e13_merge_places", ("places", "aliases", *_MOVED), f"""
WITH {_MERGES}, t AS ({" UNION ALL ".join(f"SELECT '{t}.{c}' AS kind, {key} AS id, {c} AS place_id FROM {t}" for t, (key, cols) in _MOVED.items() for c in cols)})
SELECT kind, coalesce(canonical_id, place_id) AS place_id, count(*) AS n, sum(id)::BIGINT AS ids FROM t LEFT
 JOIN m ON place_id = duplicate_id GROUP BY 1, 2""")
def e13(places, aliases, *tables):
    out = _merged(places, aliases, **dict(zip(_MOVED, tables, strict=True)))
    rows = [out[t].select(F.lit(f"{t}.{c}").alias("kind"), F.col(key).alias("id"), F.col(c).alias("place_id")) for t, (key, cols) in _MOVED.items() for c in cols]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("kind", "place_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("e13_merge_attributes", ("places", "aliases"), rf"""
WITH {_MERGES}, a AS (SELECT coalesce(canonical_id, place_id) AS place_id, alias FROM aliases LEFT
 JOIN m ON place_id = duplicate_id UNION ALL SELECT canonical_id, name FROM places JOIN m ON place_id = duplicate_id),
g AS (SELECT place_id, {_PLAIN} AS plain, min(alias) AS alias FROM a GROUP BY ALL), n AS (SELECT place_id,
 string_agg(alias, '|' ORDER BY alias) AS aliases FROM g GROUP BY place_id),
b AS (SELECT canonical_id, {", ".join(f"arg_min({c}, place_id) FILTER (trim({c}) <> '') AS {c}" for c in ("postcode", "city", "website"))},
 arg_min(lat, place_id) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lat, arg_min(lon,
 place_id) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lon FROM places JOIN m ON place_id = duplicate_id
 GROUP BY canonical_id)
SELECT p.place_id, CASE
 WHEN m.duplicate_id IS NOT NULL THEN 'duplicate' ELSE p.status END AS status, {", ".join(f"coalesce(nullif(trim(p.{c}), ''), b.{c}) AS {c}" for c in ("postcode", "city", "website"))},
 coalesce(p.lat, b.lat) AS lat, coalesce(p.lon, b.lon) AS lon, coalesce(n.aliases, '') AS aliases FROM places p LEFT
 JOIN m ON p.place_id = duplicate_id LEFT JOIN b ON b.canonical_id = p.place_id LEFT
 JOIN n ON n.place_id = p.place_id""")
def e13b(places, aliases):
    out = _merged(places, aliases)
    names = out["aliases"].groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))
    joined = out["places"].join(names, "place_id", "left")
    return joined.select("place_id", "status", "postcode", "city", "website", "lat", "lon", F.coalesce("aliases", F.lit("")).alias("aliases"))


@query("e14_website_backfill", ("sources", "places"), "SELECT CASE WHEN homepage = '' THEN 'no_website' WHEN place_id IS NULL THEN 'no_place' WHEN coalesce(website, '') <> '' THEN 'already_set' ELSE 'updated' END AS outcome, count(*) AS n FROM sources LEFT JOIN places USING (place_id) GROUP BY 1")
def e14(sources, places):
    return resolve.backfill_websites(sources, places).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
