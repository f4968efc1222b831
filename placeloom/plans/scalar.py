"""Queries of the scalar functions over strings that the given tables spell out."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, similarity, text, times
from placeloom.operators import domains
from placeloom.plans.registry import define, query

define("cells", ("orders",), """
SELECT o_orderkey AS id,
 CASE o_orderkey % 10 WHEN 0 THEN '9:45'
 WHEN 1 THEN CAST(o_orderkey % 14 AS STRING) || '.' || CAST(10 + o_orderkey % 60 AS STRING) || 'pm'
 WHEN 2 THEN '12 am' WHEN 3 THEN ' 12:15 PM. ' WHEN 4 THEN '25:00' WHEN 5 THEN '' WHEN 6 THEN 'noon'
 WHEN 7 THEN CAST(o_orderkey % 26 AS STRING) || ':' || CAST(10 + o_orderkey % 55 AS STRING)
 WHEN 8 THEN '5' ELSE NULL END AS time_text,
 CASE o_orderkey % 7 WHEN 0 THEN 'Fajr' WHEN 1 THEN ' ZUHR ' WHEN 2 THEN 'jummah' WHEN 3 THEN 'Asr Iqamah'
 WHEN 4 THEN 'Friday night prayer' WHEN 5 THEN 'magrib (sunset)' ELSE 'Sunrise' END AS label_text,
 CASE o_orderkey % 9 WHEN 0 THEN '1/6' WHEN 1 THEN '31/02/2024'
 WHEN 2 THEN CAST(1 + o_orderkey % 28 AS STRING) || '-' || CAST(1 + o_orderkey % 12 AS STRING) || '-24'
 WHEN 3 THEN '1st June' WHEN 4 THEN 'June ' || CAST(1 + o_orderkey % 30 AS STRING) || ', 2026' WHEN 5 THEN 'Mon 21st'
 WHEN 6 THEN '1 6' WHEN 7 THEN CAST(o_orderkey % 40 AS STRING) ELSE 'Sept. 3rd' END AS date_text,
 CASE o_orderkey % 6 WHEN 0 THEN '10 mins after' WHEN 1 THEN '+20'
 WHEN 2 THEN CAST(o_orderkey % 90 AS STRING) || ' minutes' WHEN 3 THEN '5m'
 WHEN 4 THEN 'after 15 min.' ELSE 'at start' END AS offset_text,
 CASE o_orderkey % 8 WHEN 0 THEN 'HTTP 503 from host' WHEN 1 THEN 'robots disallow' WHEN 2 THEN 'SSL error'
 WHEN 3 THEN 'odd' ELSE NULL END AS preflight,
 CASE o_orderkey % 5 WHEN 0 THEN 'site is an Aggregator' WHEN 1 THEN 'No prayer timetable found'
 WHEN 2 THEN 'agent stopped' WHEN 3 THEN 'other' ELSE NULL END AS reason,
 o_orderkey % 3 = 0 AS invalid, o_orderkey % 31 = 0 AS timed_out,
 CASE o_orderkey % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png'
 WHEN 3 THEN 'Application/JSON' WHEN 4 THEN 'text/plain' ELSE NULL END AS content_type,
 'provider=p' || CAST(o_orderkey % 3 AS STRING) || '; reason=r' || CAST(o_orderkey % 4 AS STRING) || CASE
 WHEN o_orderkey % 2 = 0 THEN '; name_ratio=' || CAST(o_orderkey % 101 AS STRING) ELSE '' END || '; url=https://place' || CAST(o_orderkey % 50 AS STRING) || '.example.org/x; postcode=' ||
 CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS notes,
 CASE WHEN o_orderkey % 2 = 0 THEN 'site_' || substr('0a1b2c3d4e5f',
 CAST(1 + o_orderkey % 5 AS INT), 8) ELSE 'site_x' END AS script_key,
 CASE o_orderkey % 4 WHEN 0 THEN ' Public_Redistribution_Allowed' WHEN 1 THEN 'internal_only'
 WHEN 2 THEN 'secret' ELSE NULL END AS policy_text,
 CASE o_orderkey % 6 WHEN 0 THEN 'sw1a1aa' WHEN 1 THEN ' e1 6 an ' WHEN 2 THEN 'd02x285' WHEN 3 THEN 'AB1'
 WHEN 4 THEN '' ELSE 'zz 99 9999 z' END AS postcode_text,
 CASE o_orderkey % 7 WHEN 0 THEN 'https://WWW.Place.org:8080/A/b/?q=1#x' WHEN 1 THEN 'place.org'
 WHEN 2 THEN 'http://sub.salah.com' WHEN 3 THEN ' www.ismaili.net/uk/ ' WHEN 4 THEN ''
 WHEN 5 THEN 'https://fedex.com/x//' ELSE 'https://en.mawaqit.net' END AS url_text,
 '<p>Visit &nbsp;us</p><script>var a="</p>";</script> at SW1A' || CASE
 WHEN o_orderkey % 2 = 0 THEN ' 1AA' ELSE '' END || '<br/>Hall&nbsp;' || CAST(o_orderkey % 5 AS STRING) AS html_text,
 DATE '2024-01-31' + CAST(o_orderkey % 60 AS INT) AS day, CAST(o_orderkey % 14 - 7 AS INT) AS shift
FROM @orders""")


@query("b01_normalise_name", "places", r"SELECT place_id, trim(regexp_replace(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normalised FROM places")
def b01(places):
    return places.select("place_id", text.normalise_name(F.col("name")).alias("normalised"))


@query("b02_normalise_postcode", "cells", r"""
SELECT id, CASE WHEN length(c) < 5 THEN nullif(c, '')
 WHEN regexp_full_match(c, '[A-Z]{1,2}\d[A-Z\d]?\d[A-Z]{2}') THEN c[:-4] || ' ' || c[-3:]
 WHEN regexp_full_match(c, '[A-Z0-9]{7}') THEN c[:3] || ' ' || c[4:] ELSE c END AS postcode
FROM (SELECT id, regexp_replace(upper(postcode_text), '\s+', '', 'g') AS c FROM cells)""")
def b02(cells):
    return cells.select("id", text.normalise_postcode(F.col("postcode_text")).alias("postcode"))


_FULL = "CASE WHEN contains(url_text, '://') THEN trim(url_text) ELSE 'https://' || trim(url_text) END"


@query("b03_domain", "cells", rf"SELECT id, CASE WHEN trim(url_text) <> '' THEN nullif(regexp_replace(lower(regexp_extract({_FULL}, '^[^:]*://([^/?#]*)', 1)), '^www\.', ''), '') END AS domain FROM cells")
def b03(cells):
    return cells.select("id", text.domain_of(F.col("url_text")).alias("domain"))


@query("b04_homepage", "cells", rf"""
SELECT id, CASE WHEN h <> '' AND trim(url_text) <> '' THEN regexp_extract(f, '^([^:]*)://', 1) || '://' || h || CASE
 WHEN p = '' THEN '/' ELSE p END END AS homepage
FROM (SELECT id, url_text, {_FULL} AS f,
 regexp_replace(lower(regexp_extract({_FULL}, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') AS h,
 regexp_replace(regexp_extract({_FULL}, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM cells)""")
def b04(cells):
    return cells.select("id", text.canonical_homepage(F.col("url_text")).alias("homepage"))


@query("b05_normalise_city", "places", r"SELECT place_id, nullif(trim(regexp_replace(lower(city), '\s+', ' ', 'g')), '') AS city FROM places")
def b05(places):
    return places.select("place_id", text.normalise_city(F.col("city")).alias("city"))


@query("b06_strict_time", "cells", r"""
SELECT id, CASE WHEN regexp_full_match(t, '\d{1,2}:\d{2}') AND split_part(t, ':', 1)::INT <= 23
 AND split_part(t, ':', 2)::INT <= 59 THEN split_part(t, ':', 1)::INT * 60 + split_part(t, ':', 2)::INT END AS minutes,
 CASE WHEN t <> '' AND NOT regexp_full_match(t, '\d{1,2}:\d{2}') THEN 'invalid time format (expected HH:MM): ' || time_text
 WHEN t <> '' AND (split_part(t, ':', 1)::INT > 23 OR split_part(t, ':', 2)::INT > 59) THEN 'invalid time value: ' || time_text END AS error
FROM (SELECT id, time_text, trim(time_text) AS t FROM cells)""")
def b06(cells):
    return cells.select("id", times.minutes_of(F.col("time_text")).alias("minutes"), times.minutes_error(F.col("time_text")).alias("error"))


_LOOSE = r"""loose AS (SELECT *, CASE WHEN hh <= 23 AND mm <= 59 THEN hh * 60 + mm END AS minutes FROM (SELECT *, CASE
 WHEN ap = 'pm' AND h < 12 THEN h + 12 WHEN ap = 'am' AND h = 12 THEN 0 ELSE h END AS hh,
 coalesce(TRY_CAST(m AS INT), 0) AS mm FROM
 (SELECT *, TRY_CAST(regexp_extract(t, p, 1) AS INT) AS h, regexp_extract(t, p, 2) AS m, regexp_extract(t,
 p, 3) AS ap FROM (SELECT *, lower(trim(time_text)) AS t, '^(\d{1,2})(?:[.:](\d{2}))?\s*(am|pm)?\.?\s*$' AS p
 FROM cells))))"""


@query("b07_loose_time", "cells", f"WITH {_LOOSE} SELECT id, minutes::INT AS minutes FROM loose")
def b07(cells):
    return cells.select("id", times.minutes_loose(F.col("time_text")).alias("minutes"))


_WIN = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in times.WINDOWS.items())


@query("b08_plausible_time", "cells", f"""
WITH {_LOOSE}, win(slot, lo, hi) AS (VALUES {_WIN})
SELECT id, slot, CASE WHEN minutes < 720 AND NOT (minutes BETWEEN lo AND hi) AND minutes + 720 BETWEEN lo
 AND hi THEN minutes + 720 ELSE minutes END::INT AS minutes FROM loose CROSS JOIN win""")
def b08(cells):
    slots = cells.select("id", times.minutes_loose(F.col("time_text")).alias("m"), F.explode(F.array(*[F.lit(s) for s in times.SLOTS])).alias("slot"))
    return slots.select("id", "slot", times.afternoon_where_due(F.col("m"), F.col("slot")).alias("minutes"))


@query("b09_slot_spelling", "cells", f"SELECT id, (MAP {{{', '.join(f"'{k}': '{v}'" for k, v in times.SPELLINGS.items())}}})[lower(trim(label_text))] AS slot FROM cells")
def b09(cells):
    return cells.select("id", times.slot_of(F.col("label_text")).alias("slot"))


_KEYS = " ".join(f"WHEN regexp_matches(lower(label_text), '{'|'.join(v)}') THEN '{k}'" for k, v in times.KEYWORDS.items())


@query("b10_slot_label", "cells", f"SELECT id, CASE {_KEYS} END AS slot FROM cells")
def b10(cells):
    return cells.select("id", times.slot_of_label(F.col("label_text")).alias("slot"))


@query("b11_offset_minutes", "cells", r"""
SELECT id, m AS minutes, (1430 + m) % 1440 AS shifted FROM (SELECT id,
 TRY_CAST(regexp_extract(offset_text, '(?i)(\d{1,3})\s*(?:minutes|minute|mins|min|m)(?:\s|$|\W)', 1) AS INT) AS m
 FROM cells)""")
def b11(cells):
    m = times.offset_minutes(F.col("offset_text"))
    return cells.select("id", m.alias("minutes"), times.plus_minutes(F.lit(1430), m).alias("shifted"))


_MON = ", ".join(f"'{k}': {v}" for k, v in times.MONTHS.items())
_DATE = "TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


@query("b12_british_date", "cells", rf"""
WITH n AS (SELECT *, trim(date_text) AS t, '^(\d{{1,2}})[/.\-](\d{{1,2}})(?:[/.\-](\d{{2,4}}))?$' AS p FROM cells),
y AS (SELECT *, TRY_CAST(regexp_extract(t, p, 3) AS INT) AS y3,
 nullif(regexp_extract(t, '(?:^|\D)(20\d{{2}})(?:\D|$)', 1), '') AS st FROM n),
k AS (SELECT *, list_filter(regexp_split_to_array(trim(CASE WHEN st IS NULL THEN t ELSE replace(t,
 st, ' ') END), '[\s,]+'), lambda x: x <> '') AS tok FROM y),
f AS (SELECT *, list_filter(list_transform(tok, lambda x: (MAP {{{_MON}}})[rtrim(lower(x), '.,')]),
 lambda x: x IS NOT NULL)[1] AS mon, list_filter(list_transform(tok,
 lambda x: TRY_CAST(regexp_extract(x, '(?i)^(\d{{1,2}})(?:st|nd|rd|th)?$', 1) AS INT)),
 lambda x: x IS NOT NULL)[1] AS dy FROM k)
SELECT id, CASE WHEN regexp_matches(t,
 p) THEN {_DATE.format(y="coalesce(CASE WHEN y3 < 100 THEN y3 + 2000 ELSE y3 END, 2025)", m="TRY_CAST(regexp_extract(t, p, 2) AS INT)", d="TRY_CAST(regexp_extract(t, p, 1) AS INT)")}
 WHEN mon IS NOT NULL
 AND dy IS NOT NULL THEN {_DATE.format(y="coalesce(TRY_CAST(st AS INT), 2025)", m="mon", d="dy")} END::VARCHAR AS parsed
 FROM f""")
def b12(cells):
    return cells.select("id", times.british_date(F.col("date_text"), 2025).cast("string").alias("parsed"))


@query("b13_day_of_month", "cells", r"""
WITH k AS (SELECT id, list_filter(regexp_split_to_array(trim(date_text), '[\s,]+'), lambda x: x <> '') AS tok FROM cells),
d AS (SELECT id, list_filter(list_transform(tok,
 lambda x: TRY_CAST(regexp_extract(x, '(?i)^(\d{1,2})(?:st|nd|rd|th)?$', 1) AS INT)),
 lambda x: x IS NOT NULL) AS days, list_filter(tok, lambda x: NOT regexp_matches(x, '(?i)^\d{1,2}(?:st|nd|rd|th)?$')
 AND NOT list_contains(['mon','tue','wed','thu','fri','sat','sun'], rtrim(lower(x), '.')[:3])) AS other FROM k)
SELECT id, CASE WHEN len(days) = 1 AND len(other) = 0 AND days[1] BETWEEN 1 AND 31 THEN days[1] END AS day FROM d""")
def b13(cells):
    return cells.select("id", times.day_of_month(F.col("date_text")).alias("day"))


@query("b14_months", "cells", """
SELECT id, (day + to_months(shift))::DATE::VARCHAR AS shifted, len(range(date_trunc('month', day)::TIMESTAMP,
 (date_trunc('month', day) + INTERVAL 1 MONTH)::TIMESTAMP, INTERVAL 1 DAY)) AS days_in_month, date_trunc('month',
 day)::DATE::VARCHAR AS first FROM cells""")
def b14(cells):
    days = times.month_dates(F.col("day"))
    return cells.select("id", F.add_months("day", F.col("shift")).cast("string").alias("shifted"), F.size(days).cast("long").alias("days_in_month"), F.get(days, F.lit(0)).cast("string").alias("first"))


def haversine_sql(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


@query("b15_distance", "places", f"SELECT a.place_id, round({haversine_sql('a', 'b')}, 3) AS metres FROM places a JOIN places b ON b.place_id = a.place_id + 1")
def b15(places):
    other = places.select((F.col("place_id") - 1).alias("place_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return places.join(other, "place_id").select("place_id", F.round(geo.metres_between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


@query("b16_token_sort_ratio", ("places", "aliases"))
def b16(places, aliases):
    return places.join(aliases, "place_id").select("place_id", "alias", F.round(similarity.token_sort_ratio(text.normalise_name(F.col("name")), text.normalise_name(F.col("alias"))), 6).alias("ratio"))


@query("b17_token_set_ratio", ("places", "aliases"))
def b17(places, aliases):
    return places.join(aliases, "place_id").select("place_id", "alias", F.round(similarity.token_set_ratio(text.normalise_name(F.col("name")), text.normalise_name(F.col("alias"))), 6).alias("ratio"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_TOKENS)
_TOK = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) >= 3 AND NOT list_contains([" + _STOP + "], t)))"


@query("b18_shared_tokens", ("places", "aliases"), f"SELECT place_id, alias, len(list_intersect({_TOK.format(c='name')}, {_TOK.format(c='alias')}))::INT AS shared FROM places JOIN aliases USING (place_id)")
def b18(places, aliases):
    return places.join(aliases, "place_id").select("place_id", "alias", text.shared_tokens(F.col("name"), F.col("alias")).alias("shared"))


@query("b19_record_date", "events", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(m, '$.source_record_updated_at') AS DATE),
 TRY_CAST(json_extract_string(m, '$.timestamp') AS DATE))::VARCHAR AS record_date
FROM (SELECT event_id, CASE event_id % 3
 WHEN 0 THEN '{"source_record_updated_at":"2024-01-0' || (1 + event_id % 9) || '","timestamp":"2023-05-05"}'
 WHEN 1 THEN '{"source_record_updated_at":"soon","timestamp":"2023-05-1' || (event_id % 10) || '"}' ELSE '{}' END AS m
 FROM events)""")
def b19(events):
    n = lambda k: (F.col("event_id") % k).cast("string")
    first = F.concat(F.lit('{"source_record_updated_at":"2024-01-0'), (F.col("event_id") % 9 + 1).cast("string"), F.lit('","timestamp":"2023-05-05"}'))
    second = F.concat(F.lit('{"source_record_updated_at":"soon","timestamp":"2023-05-1'), n(10), F.lit('"}'))
    meta = F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise("{}")
    return events.select("event_id", times.record_date(meta).cast("string").alias("record_date"))


_PAR = "|".join(text.PARENT_PATTERNS)


@query("b20_parent_name", "places", f"SELECT place_id, regexp_matches(name, '(?i){_PAR}') AS parent FROM places")
def b20(places):
    return places.select("place_id", text.is_parent_name(F.col("name")).alias("parent"))


def class_sql(host: str) -> str:
    test = lambda ds: " OR ".join(f"({host} = '{d}' OR ends_with({host}, '.{d}'))" for d in ds)
    return f"CASE WHEN {test(text.AGGREGATORS)} THEN 'aggregator' WHEN {test(text.UMBRELLAS)} THEN 'umbrella' WHEN {test(text.WIDGETS)} THEN 'widget' ELSE 'own' END"


@query("b21_domain_class", "sources", rf"SELECT source_id, {class_sql('h')} AS class FROM (SELECT source_id, regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') AS h FROM sources)")
def b21(sources):
    return sources.select("source_id", text.domain_class(text.domain_of(F.col("url"))).alias("class"))


_DENY = " OR ".join(f"contains(h, '{d}')" for d in text.DENIED_FRAGMENTS)


@query("b22_register_fragments", "cells", rf"SELECT id, coalesce({_DENY}, false) AS denied FROM (SELECT id, regexp_replace(lower(regexp_extract({_FULL}, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') AS h FROM cells)")
def b22_fragments(cells):
    return cells.select("id", text.is_denied_host(text.domain_of(F.col("url_text"))).alias("denied"))


# hosts that are on a list, and others that only look like it
define("hosted", ("orders",), """
SELECT o_orderkey AS id, 'https://' || CASE o_orderkey % 24 WHEN 0 THEN 'www.yell.com' WHEN 1 THEN 'fedex.com'
 WHEN 2 THEN 'maps.google.com' WHEN 3 THEN 'google.co.uk' WHEN 4 THEN 'youtu.be' WHEN 5 THEN 'WWW.Facebook.com'
 WHEN 6 THEN 'm.facebook.com' WHEN 7 THEN 'pages.facebook.com' WHEN 8 THEN 'en.wikipedia.org'
 WHEN 9 THEN 'de.wikipedia.org' WHEN 10 THEN 'yell.com.example.org' WHEN 11 THEN 'mosqueiq.com'
 WHEN 12 THEN 'find-and-update.company-information.service.gov.uk' WHEN 13 THEN 'company-information.service.gov.uk'
 WHEN 14 THEN 'a.b.salah.com' WHEN 15 THEN 'notsalah.com' WHEN 16 THEN 'www.ismaili.net' WHEN 17 THEN 'times.mawaqit.net'
 WHEN 18 THEN 'council.extra.example.net' WHEN 19 THEN 'odd.example.org' WHEN 20 THEN 'sub.odd.example.org'
 WHEN 21 THEN 'hall.blogspot.test' WHEN 22 THEN 'x.com' ELSE 'hall' || CAST(o_orderkey AS STRING) || '.example.org' END
 || '/about' AS url FROM @orders""")
_HOST = "CASE WHEN id % 24 = 23 THEN 'hall' || id || '.example.org' ELSE regexp_replace(lower(split_part(url, '/', 3)), '^www\\.', '') END"


@query("b22_denied_host", "hosted", f"SELECT id, {_HOST} IN ('yell.com', 'maps.google.com', 'youtu.be', 'facebook.com', 'm.facebook.com', 'en.wikipedia.org', 'mosqueiq.com', 'find-and-update.company-information.service.gov.uk', 'x.com') AS denied FROM hosted")
def b22(hosted):
    return hosted.select("id", text.is_directory_host(text.domain_of(F.col("url"))).alias("denied"))


@query("b21_extra_domains", "hosted", f"""
SELECT id, CASE WHEN id % 24 = 14 OR id % 24 = 18 THEN 'aggregator' WHEN id % 24 = 16 THEN 'umbrella'
 WHEN id % 24 = 17 THEN 'widget' ELSE 'own' END AS class FROM hosted""")
def b21_extra(hosted):
    return hosted.select("id", text.domain_class(text.domain_of(F.col("url")), {"aggregator": ("Extra.Example.net",)}).alias("class"))


@query("b21_domain_lists", "hosted", """
SELECT id, array_to_string(CASE id % 24 WHEN 0 THEN ['directory'] WHEN 1 THEN ['register'] WHEN 2 THEN ['directory']
 WHEN 4 THEN ['directory'] WHEN 5 THEN ['directory', 'register'] WHEN 6 THEN ['directory', 'register'] WHEN 7 THEN ['register']
 WHEN 8 THEN ['directory', 'register'] WHEN 9 THEN ['register'] WHEN 11 THEN ['directory'] WHEN 12 THEN ['directory']
 WHEN 14 THEN ['aggregator'] WHEN 16 THEN ['umbrella'] WHEN 17 THEN ['widget'] WHEN 18 THEN ['aggregator', 'umbrella']
 WHEN 19 THEN ['own'] WHEN 21 THEN ['blog'] WHEN 22 THEN ['directory', 'register'] ELSE [] END, ',') AS lists FROM hosted""")
def b21_lists(hosted):
    extra = hosted.sparkSession.createDataFrame([("extra.example.net", "suffix", "umbrella"), ("Extra.example.net ", "suffix", "aggregator"), ("odd.example.org", "exact", "own"), ("blogspot", "substring", "blog")], domains.SCHEMA)
    found = domains.with_lists(hosted, text.domain_of(F.col("url")), domains.domain_table(hosted.sparkSession, extra))
    return found.select("id", F.array_join("lists", ",").alias("lists"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("b23_strip_tags", "pages", f"SELECT page_id, length({_STRIP.format(c='html')}) AS n, md5({_STRIP.format(c='html')}) AS digest FROM pages")
def b23(pages):
    bare = text.strip_tags(F.col("html"))
    return pages.select("page_id", F.char_length(bare).cast("long").alias("n"), F.md5(bare).alias("digest"))


@query("b24_appears", "cells", r"""
SELECT id, contains(t, 'sw1a1aa') AS postcode_found, contains(t, 'usatsw1a') AS address_found, contains(t, 'hall3')
 AND length('hall3') >= 6 AS short_found
FROM (SELECT id, lower(regexp_replace(""" + _STRIP.format(c="html_text") + r""", '(?i)\s|&nbsp;|&#160;|&#xa0;', '', 'g')) AS t
 FROM cells)""")
def b24(cells):
    body = text.strip_tags(F.col("html_text"))
    return cells.select("id", text.appears_in(F.lit("SW1A 1AA"), body).alias("postcode_found"), text.appears_in(F.lit("us at sw1a"), body, 6).alias("address_found"), text.appears_in(F.lit("Hall 3"), body, 6).alias("short_found"))


@query("b25_content_kind", "cells", """
SELECT id, CASE WHEN p IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN p = 'application/pdf' THEN 'pdf'
 WHEN starts_with(p, 'image/') THEN 'image'
 WHEN p IN ('application/json', 'text/json') THEN 'json' ELSE 'unknown' END AS kind,
 coalesce(starts_with(lower(content_type), 'text/html'), false) AND contains(html_text, '<script')
 AND length(html_text) < 4000 AS widget
FROM (SELECT *, lower(trim(split_part(content_type, ';', 1))) AS p FROM cells)""")
def b25(cells):
    return cells.select("id", text.content_kind(F.col("content_type")).alias("kind"), text.script_widget(F.col("content_type"), F.col("html_text")).alias("widget"))


@query("b26_failure_category", "cells", r"""
SELECT id, CASE WHEN timed_out THEN 'timeout' WHEN contains(p, 'robots') THEN 'blocked_robots'
 WHEN regexp_matches(p, 'http 5\d\d') THEN 'transient_network' WHEN contains(p, 'ssl') THEN 'dead_site'
 WHEN p <> '' THEN 'transient_network'
 WHEN contains(r, 'aggregator') THEN 'aggregator' WHEN contains(r, 'no prayer timetable') THEN 'permanent_no_jamaat'
 WHEN contains(r, 'agent') THEN 'agent_error' WHEN invalid THEN 'validation_failed' ELSE 'agent_error' END AS category
FROM (SELECT *, lower(preflight) AS p, lower(reason) AS r FROM cells)""")
def b26(cells):
    return cells.select("id", text.failure_category(F.col("preflight"), F.col("reason"), F.col("invalid"), F.col("timed_out")).alias("category"))


@query("b27_lead_notes", "cells", r"""
SELECT id, regexp_extract(notes, 'provider=([^;\s]*)', 1) AS provider,
 regexp_extract(notes, '; reason=([^;\s]*)', 1) AS reason,
 TRY_CAST(regexp_extract(notes, 'name_ratio=([^;\s]*)', 1) AS DOUBLE) AS name_ratio,
 regexp_extract(notes, 'postcode=([^;\s]*)', 1) = 'yes' AS postcode_found FROM cells""")
def b27(cells):
    note = lambda k: text.note_value(F.col("notes"), k)
    return cells.select("id", note("provider").alias("provider"), note("reason").alias("reason"), note("name_ratio").try_cast("double").alias("name_ratio"), (note("postcode") == "yes").alias("postcode_found"))


@query("b29_expected_slots", "cells", "SELECT id, CASE WHEN dayofweek(day) = 5 THEN 'fajr,dhuhr,asr,maghrib,isha,jumuah' ELSE 'fajr,dhuhr,asr,maghrib,isha' END AS slots FROM cells")
def b29(cells):
    return cells.select("id", F.array_join(times.expected_slots(F.col("day")), ",").alias("slots"))


@query("b30_source_hint", "cells", "SELECT id, nullif(regexp_extract(script_key, '_([0-9a-f]{8})$', 1), '') AS hint FROM cells")
def b30(cells):
    return cells.select("id", text.source_hint(F.col("script_key")).alias("hint"))


POLICIES = ("public_redistribution_allowed", "internal_only", "unknown")


@query("b31_checked_value", "cells", f"""
SELECT id, CASE WHEN v IN {POLICIES} THEN v END AS policy, CASE
 WHEN v IN {POLICIES} THEN NULL ELSE 'expected one of: {", ".join(POLICIES)}; got ' || coalesce(policy_text, 'null') END AS error
FROM (SELECT id, policy_text, lower(trim(policy_text)) AS v FROM cells)""")
def b31(cells):
    value, error = text.checked_value(F.col("policy_text"), POLICIES)
    return cells.select("id", value.alias("policy"), error.alias("error"))
