"""Queries of feeds, extraction, exports, website checks and streams.

Files are made of the given tables: rows are rendered, written to a shared folder and read back.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from placeloom.functions import html
from placeloom.functions.times import WINDOWS, clock
from placeloom.operators import export, extract, extractors, websites
from placeloom.plans import operations
from placeloom.plans.registry import define, query
from placeloom.sources import feeds
from placeloom.sources.files import shared_folder
from placeloom.streaming import changes, outcomes

PUB = "policy = 'public_redistribution_allowed'"


def bundle_lines(places, name="mosques"):
    slot = lambda d, s, field, m: F.struct(F.lit(d).alias("date"), F.lit(s).alias("prayer"), F.lit(m).alias(field))
    rows = places.select(F.col("place_id").cast("string").alias("external_id"), "name", "city", "postcode", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.when(F.col("place_id") % 2 == 0, F.array(slot("2024-02-02", "Jumuah", "iqamah", "13:30"))).alias("schedules"), F.when(F.col("place_id") % 2 == 1, F.array(slot("2024-02-03", "fajr", "jamat", "06:10"))).alias("timetable"))
    return rows


_SLOTS = "SELECT place_id::VARCHAR AS external_id, CASE WHEN place_id % 2 = 0 THEN '2024-02-02' ELSE '2024-02-03' END AS slot_date, CASE WHEN place_id % 2 = 0 THEN 'jumuah' ELSE 'fajr' END AS slot, CASE WHEN place_id % 2 = 0 THEN '13:30' ELSE '06:10' END AS main_time, 1 AS session_no FROM places"


def _slots(records):
    return feeds.slots_of(records).select("external_id", F.col("slot_date").cast("string").alias("slot_date"), "slot", "main_time", "session_no")


@query("a01_bundle", "places", _SLOTS)
def a01(places):
    spark, rows = places.sparkSession, bundle_lines(places)
    path = shared_folder(spark, "bundle")
    # a bundle for each 500 places
    groups = rows.groupBy(F.expr("external_id div 500").alias("file")).agg(F.collect_list(F.struct(*rows.columns)).alias("mosques"))
    groups.select("file", F.to_json(F.struct("mosques")).alias("value")).write.partitionBy("file").text(path)
    return _slots(feeds.read_bundle(spark, f"{path}/*/*"))


@query("a02_ndjson", "places", _SLOTS)
def a02(places):
    spark, rows = places.sparkSession, bundle_lines(places)
    path = shared_folder(spark, "ndjson")
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(path)
    return _slots(feeds.read_ndjson(spark, path))


define("flat", ("places",), """
SELECT place_id AS row, CASE WHEN place_id % 9 = 0 THEN ' ' ELSE CAST(place_id DIV 3 AS STRING) END AS external_id,
 CASE WHEN place_id % 18 = 0 THEN NULL ELSE 'm' || CAST(place_id DIV 3 AS STRING) END AS mosque_id, name, city,
 postcode,
 '2024-03-0' || CAST(1 + place_id % 9 AS STRING) AS date, CASE
 WHEN place_id % 2 = 0 THEN 'Fajr' ELSE 'isha' END AS prayer, CASE
 WHEN place_id % 4 = 0 THEN '' ELSE '05:00' END AS jamaat, CASE
 WHEN place_id % 4 = 0 THEN '05:30' ELSE NULL END AS iqama, CASE
 WHEN place_id % 5 = 0 THEN '2' ELSE '' END AS session_number FROM @places""")


@query("a03_flat_csv", "flat", """
WITH k AS (SELECT *, coalesce(nullif(trim(external_id), ''), nullif(trim(mosque_id), '')) AS key FROM flat)
 SELECT key AS external_id, arg_min(name, row) AS name, arg_min(coalesce(city, '-'), row) AS city, count(*) AS slots
 FROM k WHERE key IS NOT NULL GROUP BY key""")
def a03(flat):
    spark = flat.sparkSession
    path = shared_folder(spark, "flat")
    flat.withColumnRenamed("row", "line").write.csv(path, header=True, emptyValue="")
    rows = feeds.read_flat_csv(spark, path).withColumn("row", F.col("line").cast("long"))
    places, slots, _ = feeds.regroup(rows)
    counts = slots.groupBy("external_id").agg(F.count(F.lit(1)).alias("slots"))
    return places.join(counts, "external_id").select("external_id", "name", F.coalesce("city", F.lit("-")).alias("city"), "slots")


@query("a04_time_aliases", "flat", "SELECT row, coalesce(nullif(jamaat, ''), iqama) AS main_time FROM flat")
def a04(flat):
    full = flat
    for c in feeds.TIME_ALIASES:
        full = full if c in full.columns else full.withColumn(c, F.lit(None).cast("string"))
    return full.select("row", feeds.main_time().alias("main_time"))


define("poi", ("places",), """
SELECT CASE WHEN place_id % 29 = 0 THEN 200.0 ELSE lon END AS lon, lat, CASE WHEN place_id % 31 = 0 THEN NULL ELSE
 CASE place_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '?' ELSE '' END || '[' || CASE place_id % 6 WHEN 0 THEN '120WDeobBang'
 WHEN 1 THEN '?NoWIrreg' WHEN 2 THEN '80NJSalf' WHEN 3 THEN 'Multi' WHEN 4 THEN '50J' ELSE 'Pkstn' END || ']' || CASE
 WHEN place_id % 37 = 0 THEN '' ELSE replace(name, '.', '') END || CASE
 WHEN place_id % 41 = 0 THEN ' defunct' ELSE '' END || '. 5 High Street. 0207 946 0123' END AS label,
 coalesce(city, 'Town') || ',' || coalesce(postcode, 'D02 X285') || CASE
 WHEN place_id % 23 = 0 THEN '' ELSE '-ID:' || CAST(place_id AS STRING) END AS comment FROM @places""")


@query("a05_poi_csv", "poi", r"""
WITH b AS (SELECT *, regexp_extract(label, '^([*?])?\[([^\]]*)\](.*)$', 3) AS body FROM poi),
p AS (SELECT *, list_filter(list_transform(string_split(replace(body, '0207 946 0123', ''), '.'),
 lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts,
 nullif(regexp_extract(comment, '-ID:(\d+)\s*$', 1), '') AS number FROM b)
SELECT number, parts[1] AS name, nullif(array_to_string(parts[2:], ', '), '') AS address, CASE
 WHEN label IS NOT NULL THEN '0207 946 0123' END AS phone, split_part(comment, ',', 1) AS city,
 CASE WHEN label IS NULL THEN 'missing_columns'
 WHEN lat IS NULL OR lon IS NULL OR abs(lon) > 180 THEN 'invalid_coordinates' WHEN number IS NULL THEN 'missing_id'
 WHEN len(parts) = 0 THEN 'missing_name' WHEN contains(lower(body), 'defunct') THEN 'defunct'
 WHEN contains(label, '[Multi]') THEN 'multi_faith' END AS skip_reason FROM p""")
def a05(poi):
    spark = poi.sparkSession
    path = shared_folder(spark, "poi")
    poi.select("lon", "lat", "label", "comment").write.csv(path)
    return feeds.decode_poi(feeds.read_poi_csv(spark, path)).select("number", "name", "address", "phone", "city", "skip_reason")


define("codes", ("places",), "SELECT place_id AS id, CASE place_id % 8 WHEN 0 THEN '120WDeobBang' WHEN 1 THEN '?NoWIrreg' WHEN 2 THEN '80NJSalf' WHEN 3 THEN 'MultiShia' WHEN 4 THEN '50J' WHEN 5 THEN 'Pkstn' WHEN 6 THEN NULL ELSE ' ArabArab ' END AS raw FROM @places")


@query("a06_info_code", "codes", """
SELECT id, CASE id % 8 WHEN 1 THEN 'low' WHEN 6 THEN 'unknown' ELSE 'high' END AS confidence, CASE id % 8
 WHEN 0 THEN 120 WHEN 2 THEN 80 WHEN 4 THEN 50 END AS capacity, CASE id % 8 WHEN 0 THEN 'yes'
 WHEN 1 THEN 'no' ELSE 'unknown' END AS women, CASE id % 8 WHEN 1 THEN 'irregular' WHEN 2 THEN 'no_jumuah'
 WHEN 3 THEN 'unknown' WHEN 4 THEN 'jumuah_only' ELSE 'full_time' END AS usage,
 CASE id % 8 WHEN 1 THEN 'prayer_room' WHEN 3 THEN 'multi_faith' WHEN 4 THEN 'hired_hall' ELSE 'mosque' END AS class,
 CASE id % 8 WHEN 0 THEN 'Deobandi' WHEN 2 THEN 'Salafi' WHEN 3 THEN 'Shia'
 WHEN 7 THEN 'Arab mainstream' END AS theme, CASE id % 8 WHEN 0 THEN 'Bangladeshi' WHEN 5 THEN 'Pakistani'
 WHEN 7 THEN 'Arab' END AS management FROM codes""")
def a06(codes):
    return codes.select("id", *[c.alias(k) for k, c in feeds.decode_info(F.col("raw")).items()])


define("elements", ("places",), """
SELECT CASE WHEN place_id % 50 = 7 THEN NULL WHEN place_id % 4 = 0 THEN 'node' WHEN place_id % 4 = 1 THEN 'way'
 WHEN place_id % 4 = 2 THEN 'relation' ELSE 'area' END AS type, place_id DIV 2 AS id, place_id AS pos, lat, lon,
 place_id % 6 AS k, name, city, website, country FROM @places""")
_ELEMENTS = "e AS (SELECT * FROM elements WHERE type <> 'area' OR type IS NULL QUALIFY type IS NULL OR row_number() OVER (PARTITION BY type, id ORDER BY pos) = 1)"
_SKIP = "CASE WHEN type IS NULL THEN 'invalid_type' WHEN k = 2 THEN 'no_name' WHEN lat IS NULL OR (type <> 'node' AND k = 3) THEN 'no_coords' WHEN k = 1 THEN 'non_muslim' END"


@query("a07_map_elements", "elements", f"WITH {_ELEMENTS} SELECT type, id, {_SKIP} AS skip_reason, CASE WHEN k = 2 THEN NULL WHEN k = 5 THEN 'Masjid ' || name ELSE name END AS name FROM e")
def a07(elements):
    return _mapped(elements).select("type", "id", "skip_reason", "name")


def _mapped(elements):
    """The elements written as dumps of 500 places each, read back and mapped."""
    spark = elements.sparkSession
    pick = lambda test, key, value: F.when(test, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    name = F.when(F.col("k") == 5, F.concat(F.lit("Masjid "), F.col("name"))).otherwise(F.col("name"))
    religion = F.when(F.col("k") == 1, "christian").when(F.col("k") == 5, "").otherwise(" Muslim")
    tags = F.map_concat(pick(F.col("k") != 2, "name", name), pick(F.lit(True), "religion", religion), pick(F.lit(True), "alt_name", F.concat(F.lit("A;b; a;"), name)),
        pick(F.lit(True), "addr:street", F.lit("High St")), pick(F.col("k") == 4, "addr:housenumber", F.lit("7")), pick(F.lit(True), "addr:city", F.col("city")), pick(F.lit(True), "website", F.col("website")), pick(F.lit(True), "addr:country", F.lit("UK")))
    center = F.when(F.col("k") != 3, F.struct("lat", "lon"))
    element = F.struct("pos", "type", "id", "lat", "lon", center.alias("center"), tags.alias("tags"))
    files = elements.groupBy(F.expr("pos div 500").alias("file")).agg(F.array_sort(F.collect_list(element), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("all"))
    path = shared_folder(spark, "elements")
    listed = F.transform("all", lambda e: e.dropFields("pos")).alias("elements")
    files.select("file", F.to_json(F.struct(listed)).alias("value")).write.partitionBy("file").text(path)
    return feeds.map_elements(feeds.read_map_dump(spark, f"{path}/*/*"))


@query("a08_tag_fields", "elements", f"""
WITH {_ELEMENTS} SELECT type, id, CASE WHEN k = 2 THEN 'A,b,' || name ELSE 'A,b' END AS aliases, CASE
 WHEN k = 4 THEN '7 High St' ELSE 'High St' END AS address, city, nullif(website, '') AS website, 'GB' AS country
 FROM e""")
def a08(elements):
    return _mapped(elements).select("type", "id", F.array_join("aliases", ",").alias("aliases"), "address", "city", "website", "country")


@query("a09_place_bundle", "elements", r"""
SELECT type || '/' || id AS external_id, CASE WHEN k = 5 THEN 'The ISLAMIC ' || name ELSE name END AS name, city,
 CASE WHEN k = 0 THEN 'IE' ELSE 'GB' END AS country, k <> 1 AS fits FROM elements WHERE type IS NOT NULL""")
def a09b(elements):
    spark = elements.sparkSession
    name = F.when(F.col("k") == 5, F.concat(F.lit("The ISLAMIC "), "name")).otherwise(F.col("name"))
    religion = F.when(F.col("k") == 1, "christian").when(F.col("k").isin(2, 5), F.lit(None)).otherwise("MUSLIM ")
    denomination = F.when(F.col("k") == 2, "Shia").when(F.col("k") == 1, "anglican")
    place = F.struct(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), name.alias("name"), "city", F.when(F.col("k") == 0, "ireland").otherwise("UK").alias("country"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), religion.alias("religion"), denomination.alias("denomination"))
    files = elements.where("type is not null").groupBy(F.expr("pos div 500").alias("file")).agg(F.collect_list(place).alias("places"))
    path = shared_folder(spark, "places")
    files.select("file", F.to_json(F.struct("places")).alias("value")).write.partitionBy("file").text(path)
    return feeds.read_place_bundle(spark, f"{path}/*/*").select("external_id", "name", "city", "country", "fits")


@query("a09_discovery_records", ("places", "elements"), f"""
WITH {_ELEMENTS} SELECT 'partner_feed' AS source_type, place_id::VARCHAR AS external_id, name, city, postcode,
 website FROM places UNION ALL
SELECT 'map_dump', type || '/' || id, CASE WHEN k = 5 THEN 'Masjid ' || name ELSE name END, city, NULL,
 nullif(website, '') FROM e WHERE {_SKIP} IS NULL""")
def a09(places, elements):
    mapped = _mapped(elements).where("skip_reason is null").withColumn("external_id", F.concat("type", F.lit("/"), "id"))
    records = feeds.discovery_records((places.withColumn("external_id", F.col("place_id")), "partner_feed"), (mapped, "map_dump"))
    return records.select("source_type", "external_id", "name", "city", "postcode", "website")


@query("a12_detail_pages", "places", """
SELECT place_id, CASE WHEN place_id % 7 = 0 THEN NULL ELSE '2024-01-' || (10 + place_id % 20) END AS updated, CASE
 WHEN place_id % 5 = 0 THEN website ELSE 'https://d' || place_id || '.org/?a=1&b=2' END AS website,
 (place_id % 90)::INT AS capacity, 'Mixed & calm' AS theme, substr('ABCDEF',
 (1 + place_id % 6)::INT, 1) AS accuracy, 2 AS sources FROM places""")
def a12(places):
    day = F.when(F.col("place_id") % 7 == 0, "99/99/2024").otherwise(F.concat((10 + F.col("place_id") % 20).cast("string"), F.lit("/01/2024")))
    site = F.when(F.col("place_id") % 5 == 0, "").otherwise(F.concat(F.lit("<li>Website:&nbsp;<b>https://d"), F.col("place_id").cast("string"), F.lit(".org/?a=1&amp;b=2</b></li>")))
    page = F.concat(F.lit("<p>Last Updated: <i>"), day, F.lit("</i></p>Tel: 0207 946 0123<br/>"), site, F.lit("<div class='x'>Capacity: "), (F.col("place_id") % 90).cast("string"), F.lit("</div><p>Theme: Mixed &amp; calm; x</p>Data accuracy: "), F.substring(F.lit("ABCDEF"), (F.col("place_id") % 6 + 1).cast("int"), F.lit(1)), F.lit("<br>Sources: council, visit</p>"))
    rows = places.select("place_id", page.alias("page")).select("place_id", feeds.detail_text(F.col("page")).alias("text"))
    rows = rows.select("place_id", *[c.alias(k) for k, c in feeds.detail_fields(F.col("text")).items()])
    known = feeds.overlay(places.select("place_id", "website"), rows, "place_id", ["website"])
    rows = rows.drop("website").join(known, "place_id")
    return rows.select("place_id", F.col("updated").cast("string").alias("updated"), "website", "capacity", "theme", "accuracy", F.size("sources").alias("sources"))


@query("b23_parsed_text", "pages")
def b23(pages):
    return pages.select("page_id", html.parsed_text(F.col("html")).alias("t")).select("page_id", "t.title", F.char_length("t.text").alias("chars"))


define("directory_pages", ("places",), """
SELECT place_id AS page_id, CASE
 WHEN place_id % 5 = 4 THEN 'https://www.islamicfinder.org/p/' ELSE 'https://dir.example.org/p/' END || CAST(place_id AS STRING) AS url,
 CASE place_id % 5 WHEN 4 THEN '<dt>Website:</dt> <a class="x" href="https://l' || CAST(place_id AS STRING) || '.org/">go</a>'
 WHEN 0 THEN '<script type="application/ld+json">{"@type":"Mosque","url":"https://own' || CAST(place_id AS STRING) || '.org/"}</script>'
 WHEN 1 THEN '<a href="https://w' || CAST(place_id AS STRING) || '.org">Visit website</a>'
 WHEN 2 THEN '<a href="/self">Website</a>' ELSE '<p>none</p>' END AS html FROM @places""")


@query("b28_official_site", "directory_pages", "SELECT page_id, CASE page_id % 5 WHEN 4 THEN 'https://l' || page_id || '.org/' WHEN 0 THEN 'https://own' || page_id || '.org/' WHEN 1 THEN 'https://w' || page_id || '.org' END AS site FROM directory_pages")
def b28(directory_pages):
    return directory_pages.select("page_id", html.parsed_site(F.col("url"), F.col("html")).alias("site"))


# timetable pages rendered of candidates, of some shapes by page_id % 11: what the parsers find must be the rows before
define("day_rows", ("candidates",), "SELECT source_id AS page_id, slot_date, max(CASE WHEN slot = 'fajr' THEN main_min END) AS fajr, max(CASE WHEN slot = 'isha' THEN main_min END) AS isha FROM @candidates GROUP BY source_id, slot_date")


def timetable_pages(day_rows):
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))
    shape, last = F.col("page_id") % 11, F.when(F.col("page_id") % 11 == 2, "").otherwise(cell(clock(F.col("isha"))))
    row = F.concat(F.lit("<tr>"), cell(F.date_format("slot_date", "d/M/yyyy")), cell(clock(F.col("fajr") - 15)), cell(clock(F.col("fajr"))), last, F.lit("</tr>"))
    pages = day_rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    first = F.when(shape == 1, "Day").otherwise("The Date")
    head = F.concat(F.lit("<table><tr><th>"), first, F.lit("</th><th>Fajr Begins</th><th>Fajr Jamaat</th>"), F.when(shape == 2, "").otherwise("<th>Isha Jamaat</th>"), F.lit("</tr>"))
    table = F.when(shape == 0, "").otherwise(F.concat(head, "rows", F.lit("</table>")))
    return pages.select("page_id", F.lit("https://t.example.org").alias("url"), F.concat(F.lit("<html><table><tr><td>menu</td></tr></table>"), table, F.lit("</html>")).alias("html"))


@query("k02_html_tables", "day_rows", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 1 ELSE 2 END AS tables, CASE WHEN page_id % 11 = 0 THEN 0 ELSE count(*)::INT + 1 END AS rows FROM day_rows GROUP BY page_id")
def k02(day_rows):
    parsed = timetable_pages(day_rows).select("page_id", html.parsed_tables(F.col("html")).alias("t"))
    table = extract.find_table(F.col("t"), ["fajr", "jamaat"])
    return parsed.select("page_id", F.size("t").alias("tables"), F.when(table.isNull(), 0).otherwise(F.size(table)).alias("rows"))


_SHIFT = "CASE WHEN {m} < 720 AND NOT ({m} BETWEEN lo AND hi) AND {m} + 720 BETWEEN lo AND hi THEN {m} + 720 ELSE {m} END"


@query("k03_table_timetable", "day_rows", f"""
WITH l AS (SELECT page_id, slot_date, 'fajr' AS slot, fajr AS m0, fajr - 15 AS s0, 120 AS lo, 450 AS hi FROM day_rows
 WHERE page_id % 11 > 1 UNION ALL SELECT page_id, slot_date, 'isha', isha, NULL, 1020, 1439 FROM day_rows
 WHERE page_id % 11 > 2),
s AS (SELECT *, {_SHIFT.format(m="m0")} AS m, {_SHIFT.format(m="s0")} AS st FROM l WHERE m0 IS NOT NULL),
 f AS (SELECT *, m BETWEEN lo AND hi AS good FROM s), p AS (SELECT DISTINCT page_id, page_id % 11 AS k FROM day_rows)
SELECT page_id, slot_date::VARCHAR AS slot_date, slot, CASE WHEN good THEN m END::INT AS main_min, CASE
 WHEN good THEN st END::INT AS start_min, CASE WHEN NOT good THEN 'implausible_time' END AS warning FROM f
UNION ALL SELECT page_id, NULL, CASE WHEN k = 2 THEN 'isha' END, NULL, NULL, CASE k WHEN 0 THEN 'no_table'
 WHEN 1 THEN 'no_date_column' ELSE 'missing_prayer_column' END FROM p WHERE k < 3""")
def k03(day_rows):
    rows = extract.table_rows(timetable_pages(day_rows), ["fajr", "jamaat"], "date", {"fajr": "fajr jamaat", "isha": "isha"}, 2024, start_columns={"fajr": "begins"})
    return rows.drop("row").withColumn("slot_date", F.col("slot_date").cast("string"))


# a month's table: bare days, blank and ditto cells that repeat the one above
define("month_rows", ("customer",), """
SELECT c_custkey DIV 28 AS page_id, c_custkey % 28 + 1 AS day, CASE
 WHEN c_custkey % 28 = 0 OR c_custkey % 5 = 0 THEN 'y' WHEN c_custkey % 5 = 1 THEN '"'
 WHEN c_custkey % 5 = 2 THEN '' ELSE 'Ditto' END AS mark, 300 + (c_custkey * 7) % 60 AS fajr FROM @customer""")


@query("k03_carried_timetable", "month_rows", """
SELECT page_id, (DATE '2024-02-01' + (day - 1)::INT)::VARCHAR AS slot_date, last_value(CASE
 WHEN mark = 'y' THEN fajr END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING
 AND CURRENT ROW)::INT AS main_min FROM month_rows""")
def k03b(month_rows):
    ordinal = F.concat(F.lit("Mon "), F.col("day").cast("string"), F.lit("th"))
    row = F.concat(F.lit("<tr><td>"), ordinal, F.lit("</td><td>"), F.when(F.col("mark") == "y", clock(F.col("fajr"))).otherwise(F.col("mark")), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", row.alias("row")))), lambda x: x["row"]), "")
    pages = month_rows.groupBy("page_id").agg(F.concat(F.lit("<table><tr><th>Day</th><th>Fajr</th></tr>"), rows, F.lit("</table>")).alias("html"))
    found = extract.table_rows(pages, ["fajr"], 0, {"fajr": 1}, 2024, month=2, carry_forward=True)
    return found.select("page_id", F.col("slot_date").cast("string").alias("slot_date"), "main_min")


class TableTimes(extractors.Extractor):
    """Fajr times of the first table that has them, and how long after their beginning they are."""

    key, version, targets = "table_times", "1.0", ("timetable",)

    def extract(self, found):
        page = found.artifact("timetable")
        table = next((t for t in html.tables_of(page.body) if t and "fajr jamaat" in " ".join(t[0]).lower()), None)
        if table is None:
            return extractors.Result(warnings=[extractors.Warned("no_table", "timetable table not found", page.label)], no_schedule_reason="timetable table not found")
        header = [c.lower() for c in table[0]]
        warnings = [] if "isha jamaat" in header else [extractors.Warned("missing_prayer_column", "isha", page.label)]
        rows = []
        for cells in table[1:]:
            begins, time = (cells[header.index(c)] for c in ("fajr begins", "fajr jamaat"))
            if time:
                day = datetime.datetime.strptime(cells[0], "%d/%m/%Y").date()
                start, main = (int(t[:2]) * 60 + int(t[3:]) for t in (begins, time))
                low, high = WINDOWS["fajr"]
                if low <= main <= high:
                    rows.append(extractors.SlotRow(day, "fajr", main, found.evidence(self, page.label, raw_text=time, selector="table"), start_min=start, more={"gap": main - start}))
                else:
                    warnings.append(extractors.Warned("implausible_time", f"{day} fajr {time}", page.label))
        return extractors.Result(rows, warnings, None if rows else "no extractable rows")


class Failing(extractors.Extractor):
    key, version, targets = "failing", "1.0", ("timetable",)

    def extract(self, found):
        raise RuntimeError(f"no timetable at {found.artifact('timetable').url}")


class Silent(extractors.Extractor):
    key, version, targets = "silent", "1.0", ("timetable",)

    def extract(self, found):
        return extractors.Result()


_HM = "lpad((fajr // 60)::VARCHAR, 2, '0') || ':' || lpad((fajr % 60)::VARCHAR, 2, '0')"
_NONE = "NULL, NULL, NULL, NULL, NULL"


@query("k01_user_extractors", "day_rows", f"""
WITH p AS (SELECT page_id, page_id % 5 AS e, page_id % 11 AS shape,
 count(*) FILTER (fajr BETWEEN 120 AND 450) AS good FROM day_rows GROUP BY page_id),
t AS (SELECT page_id, slot_date, fajr FROM day_rows JOIN p USING (page_id) WHERE e < 2 AND shape > 0 AND fajr IS NOT NULL)
SELECT page_id AS source_id, 'row' AS record, slot_date::VARCHAR AS slot_date, 'fajr' AS slot, fajr::INT AS main_min,
 (fajr - 15)::INT AS start_min, 15 AS gap, NULL AS code, NULL AS message, 'timetable' AS target_label, {_HM} AS raw_text,
 page_id::VARCHAR AS artifact_id FROM t WHERE fajr BETWEEN 120 AND 450
UNION ALL SELECT page_id, 'warning', {_NONE}, 'implausible_time', slot_date::VARCHAR || ' fajr ' || {_HM}, 'timetable',
 NULL, NULL FROM t WHERE NOT fajr BETWEEN 120 AND 450
UNION ALL SELECT page_id, 'warning', {_NONE}, 'missing_prayer_column', 'isha', 'timetable', NULL, NULL FROM p WHERE e < 2
 AND shape = 2
UNION ALL SELECT page_id, 'warning', {_NONE}, 'no_table', 'timetable table not found', 'timetable', NULL, NULL FROM p
 WHERE e < 2 AND shape = 0
UNION ALL SELECT page_id, 'no_schedule', {_NONE}, NULL, CASE WHEN shape = 0 THEN 'timetable table not found'
 ELSE 'no extractable rows' END, NULL, NULL, NULL FROM p WHERE e < 2 AND (shape = 0 OR good = 0)
UNION ALL SELECT page_id, 'error', {_NONE}, ['RuntimeError', 'ValueError', 'LookupError'][e - 1],
 ['no timetable at https://t.example.org', 'no rows and no no_schedule_reason', 'unknown extractor'][e - 1], NULL, NULL,
 NULL FROM p WHERE e >= 2""")
def k01(day_rows):
    pages = timetable_pages(day_rows)
    sources = pages.select(F.col("page_id").alias("source_id"), F.lit("A place").alias("name"), "url", F.lit("Europe/London").alias("timezone"), F.get(F.array(*map(F.lit, ("table", "table", "failing", "silent", "gone"))), (F.col("page_id") % 5).cast("int")).alias("extractor"))
    stored = pages.select(F.col("page_id").alias("source_id"), F.lit("timetable").alias("label"), "url", F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.col("page_id").alias("artifact_id"))
    found = extractors.run(sources, stored, {"table": TableTimes(), "failing": Failing(), "silent": Silent()}, "gap int")
    value = lambda k: F.get_json_object("evidence", f"$.{k}").alias(k)
    return found.select("source_id", "record", F.col("slot_date").cast("string").alias("slot_date"), "slot", "main_min", "start_min", "gap", "code", "message", "target_label", value("raw_text"), value("artifact_id"))


@query("k04_state_json", "day_rows", f"""
SELECT page_id, slot_date::VARCHAR AS slot_date, slot, session_no, m::INT AS main_min FROM (SELECT page_id,
 slot_date, 'fajr' AS slot, 1 AS session_no, fajr AS m FROM day_rows WHERE fajr BETWEEN 120 AND 450 UNION ALL
 SELECT page_id, slot_date, 'jumuah', s, 780 + 30 * s FROM day_rows, (VALUES (1), (2)) x(s))""")
def k04(day_rows):
    stamp = lambda hm: F.concat(F.col("slot_date").cast("string"), F.lit("T"), hm, F.lit(":00+00:00"))
    times = F.struct(stamp(clock(F.col("fajr"))).alias("fajr"), F.array(stamp(F.lit("13:30")), stamp(F.lit("14:00"))).alias("jumuah"))
    days = day_rows.groupBy("page_id").agg(F.collect_list(F.struct(F.col("slot_date").cast("string").alias("date"), times.alias("iqamah"))).alias("timetable"))
    state = F.url_encode(F.to_json(F.struct("timetable")))
    pages = days.select("page_id", F.concat(F.lit('<script>window.REDUX_STATE = "'), state, F.lit('";</script>')).alias("html"))
    rows = extract.state_rows(pages)
    return rows.withColumn("slot_date", F.col("slot_date").cast("string"))


@query("k05_year_calendar", "day_rows", """
SELECT page_id, slot_date::VARCHAR AS slot_date, slot, n AS session_no, m::INT AS main_min FROM (SELECT page_id,
 slot_date, 'fajr' AS slot, 1 AS n, fajr AS m FROM day_rows WHERE fajr BETWEEN 120 AND 450 UNION ALL SELECT page_id,
 slot_date, 'dhuhr', 1, 780 FROM day_rows
 UNION ALL SELECT page_id, slot_date, 'jumuah', 1, 795 FROM day_rows WHERE page_id % 3 > 0
 AND dayofweek(slot_date) = 5 UNION ALL SELECT page_id, slot_date, 'jumuah', 2, 840 FROM day_rows
 WHERE page_id % 3 = 1 AND dayofweek(slot_date) = 5)""")
def k05(day_rows):
    day = F.dayofmonth("slot_date").cast("string")
    times = F.array(F.coalesce(clock(F.col("fajr")), F.lit("")), F.lit("+15"), F.lit(""), F.lit(""), F.lit(""))
    starts = F.array(F.lit("05:00"), F.lit("06:30"), F.lit("12:45"), F.lit("15:00"), F.lit("17:00"), F.lit("19:00"))
    month = lambda m, c: F.map_from_entries(F.collect_list(F.when(F.month("slot_date") == m, F.struct(day, c))))
    both = day_rows.groupBy("page_id").agg(F.array(month(1, times), month(2, times)).alias("iqamaCalendar"), F.array(month(1, starts), month(2, starts)).alias("calendar"))
    friday = [F.when(F.col("page_id") % 3 > 0, "13:15").alias("jumua"), F.when(F.col("page_id") % 3 == 1, "2:00").alias("jumua2"), F.lit("").alias("jumua3")]
    conf = F.to_json(F.struct("calendar", "iqamaCalendar", *friday))
    rows = extract.calendar_rows(both.select("page_id", F.concat(F.lit("<script>let confData = "), conf, F.lit(";</script>")).alias("html")), 2024)
    return rows.withColumn("slot_date", F.col("slot_date").cast("string"))


@query("k06_rows_to_candidates", ("day_rows", "sources"), """
SELECT s.source_id, s.place_id, slot_date::VARCHAR AS slot_date,
 fajr::INT AS main_min, '{"contract":"site_extractor/v1","gate_passed":true,"artifact_id":' || page_id || '}' AS evidence
 FROM day_rows JOIN sources s ON s.source_id = page_id WHERE fajr IS NOT NULL""")
def k06(day_rows, sources):
    rows = day_rows.select("page_id", "slot_date", F.lit("fajr").alias("slot"), F.col("fajr").alias("main_min"))
    found = extract.as_candidates(rows, sources.select(F.col("source_id").alias("page_id"), "source_id", "place_id"), "site_extractor/v1", F.lit(True))
    return found.select("source_id", "place_id", F.col("slot_date").cast("string").alias("slot_date"), "main_min", "evidence")


# leads made of what the stored pages show: their title as the name, parts of it as postcode or address. A title is stored with
# character references (&amp; and the like), which a reader of the page sees as characters
define("store", ("pages",), "SELECT min(page_id) AS page_id, url, min(html) AS html FROM @pages WHERE url IS NOT NULL GROUP BY url")
define("titled", ("store",), "SELECT page_id, url, html, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, page_id % 9 AS k, CAST(page_id AS STRING) AS id FROM @store")
define("leads", ("titled",), """
SELECT page_id AS lead_id, CASE k WHEN 0 THEN CASE page_id % 3 WHEN 0 THEN 'https://facebook.com/x'
 WHEN 1 THEN 'https://www.yell.com/x' ELSE 'https://maps.google.com/' || id END WHEN 1 THEN 'https://gone.example.org/' || id
 WHEN 3 THEN 'https://' || id || '.fedex.com/' WHEN 7 THEN 'https://c' || id || '.example.org/home'
 WHEN 8 THEN 'https://d' || id || '.example.org/' ELSE url END AS url,
 CASE WHEN k = 5 THEN 'Xyzzyq Wqvbk' ELSE title END AS name, CASE WHEN k = 3 THEN 'QQ99 9QQ'
 WHEN k = 4 THEN NULL ELSE substr(title, 1, 9) END AS postcode, CASE
 WHEN k = 4 THEN lower(substr(title, 1, 16)) ELSE '12 No Street' END AS address, k = 6 AS trusted FROM @titled""")
define("shelf", ("titled",), """
SELECT url, html FROM @titled UNION ALL SELECT 'https://' || id || '.fedex.com/' AS url, html FROM @titled WHERE k = 3 UNION ALL
 SELECT 'https://c' || id || '.example.org/home' AS url, '<p>nothing here</p>' AS html FROM @titled WHERE k = 7
 UNION ALL SELECT 'https://c' || id || '.example.org/about' AS url, html FROM @titled WHERE k = 7
UNION ALL SELECT 'https://d' || id || '.example.org/' AS url, '<a href="https://own' || id || '.example.org/">Visit website</a>' AS html
 FROM @titled WHERE k = 8 UNION ALL SELECT 'https://own' || id || '.example.org/' AS url, html FROM @titled
 WHERE k = 8""")


# a title without a word is no name, a blank postcode is none, and an address of less than six characters is no evidence
@query("d11_verify_leads", ("leads", "shelf", "titled"), r"""
SELECT page_id AS lead_id, CASE WHEN k = 0 THEN 'denied' WHEN k = 1 THEN 'fetch_failed' WHEN shown THEN 'verified' ELSE 'no_match' END AS outcome,
 CASE WHEN NOT shown THEN NULL ELSE CASE k WHEN 7 THEN 'https://c' || id || '.example.org/about' WHEN 8 THEN 'https://own' || id || '.example.org/'
 WHEN 2 THEN url WHEN 4 THEN url WHEN 6 THEN url END END AS verified_url
FROM (SELECT *, k = 6 OR k IN (2, 4, 7, 8) AND regexp_matches(title, '[\p{L}\p{N}_]')
 AND CASE WHEN k = 4 THEN length(trim(substr(title, 1, 16))) >= 6 ELSE trim(substr(title, 1, 9)) <> '' END AS shown FROM titled)""")
def d11(leads, shelf, titled):
    return websites.verify(leads, shelf)


def _verified(places):
    leads = places.select(F.col("place_id").alias("lead_id"), "place_id", F.when(F.col("place_id") % 2 == 0, "verified").when(F.col("place_id") % 5 == 0, "denied").when(F.col("place_id") % 7 == 0, "fetch_failed").otherwise("no_match").alias("outcome"), F.concat(F.lit("https://v"), F.col("place_id").cast("string"), F.lit(".org")).alias("url"))
    leads = leads.withColumn("verified_url", F.when(F.col("outcome") == "verified", F.col("url")))
    return leads.withColumns({"provider": F.lit("p1"), "provider_rank": F.lit(1)}).unionByName(leads.withColumns({"provider": F.lit("p2"), "provider_rank": F.lit(2)}))


@query("e15_promote_websites", ("places", "sources"), "SELECT place_id, 'p1:' || place_id AS external_id, 'https://v' || place_id || '.org' AS website FROM places WHERE coalesce(website, '') = '' AND place_id % 2 = 0")
def e15(places, sources):
    return websites.promote(_verified(places), places, sources)


_OUTCOMES = "(SELECT place_id, website, CASE WHEN place_id % 2 = 0 THEN 'verified' WHEN place_id % 5 = 0 THEN 'denied' WHEN place_id % 7 = 0 THEN 'fetch_failed' ELSE 'no_match' END AS outcome FROM places)"


@query("e15_run_counts", ("places", "sources"), f"""
SELECT {", ".join(f"2 * count(*) FILTER (outcome = '{k}') AS {k}" for k in ("verified", "denied", "fetch_failed", "no_match"))}, 2 * count(*) FILTER (outcome IN ('fetch_failed', 'no_match')) AS audited,
 count(*) FILTER (outcome = 'verified' AND coalesce(website, '') = '') AS promoted FROM {_OUTCOMES}""")
def e15b(places, sources):
    verified = _verified(places)
    return websites.run_counts(verified, websites.promote(verified, places, sources))


@query("e15_audit_rows", "places", f"""
SELECT place_id, 'provider=' || p || '; outcome=' || outcome || '; url=https://v' || place_id || '.org' AS notes
 FROM {_OUTCOMES}, (VALUES ('p1'), ('p2')) x(p) WHERE outcome IN ('fetch_failed', 'no_match')""")
def e15c(places):
    return websites.audit_rows(_verified(places)).select("place_id", "notes")


@query("s01_export_set", ("previous", "places", "sources"), f"SELECT place_id, slot_date::VARCHAR AS slot_date, slot, session_no::INT AS session_no, name AS place_name FROM previous JOIN places USING (place_id) WHERE status = 'active' AND source_id IN (SELECT source_id FROM sources WHERE {PUB})")
def s01(previous, places, sources):
    rows = export.export_occurrences(previous, places, sources)
    return rows.select("place_id", F.col("slot_date").cast("string").alias("slot_date"), "slot", "session_no", "place_name")


_OCC = f"FROM previous o JOIN places p USING (place_id) WHERE p.status = 'active' AND o.source_id IN (SELECT source_id FROM sources WHERE {PUB})"


@query("s02_snapshot_ndjson", ("previous", "places", "sources", "aliases"), f"SELECT kind, count(*) AS lines FROM (SELECT 'occurrence' AS kind {_OCC} UNION ALL SELECT 'place' FROM places WHERE status = 'active') GROUP BY kind")
def s02(previous, places, sources, aliases):
    lines = places.sparkSession.read.text(f"{written_snapshot(previous, places, sources, aliases)}/snapshot.ndjson")
    return lines.groupBy(F.get_json_object("value", "$.record_type").alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def _clock_sql(c: str) -> str:
    return f"lpad(({c} // 60)::VARCHAR, 2, '0') || ':' || lpad(({c} % 60)::VARCHAR, 2, '0')"


@query("s03_occurrence_csv", ("previous", "places", "sources"), f"SELECT place_id, p.name AS place_name, slot_date::VARCHAR AS date, slot, session_no::INT AS session_no, label AS session_label, {_clock_sql('start_min')} AS start_time, {_clock_sql('main_min')} AS main_time, timezone, o.source_id AS source_id, confidence {_OCC}")
def s03(previous, places, sources):
    return export.occurrence_table(export.export_occurrences(previous, places, sources))


def _json_sql(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


# keys in their order; nulls stay
_LINE = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in {
    "confidence": _json_sql("confidence"), "date": _json_sql("slot_date::VARCHAR"), "main_time": _json_sql(_clock_sql("main_min")), "place_id": "place_id", "place_name": _json_sql("p.name"),
    "record_type": _json_sql("'occurrence'"), "session_label": _json_sql("label"), "session_no": "session_no", "slot": _json_sql("slot"), "source_id": "o.source_id", "start_time": _json_sql(_clock_sql("start_min")), "timezone": _json_sql("timezone"),
}.items())


def written_snapshot(previous, places, sources, aliases):
    folder = shared_folder(places.sparkSession, "snapshot")
    export.write_snapshot(export.export_places(places, aliases, sources), export.export_occurrences(previous, places, sources), folder)
    return folder


@query("s02_occurrence_lines", ("previous", "places", "sources", "aliases"), f"SELECT '{{' || {_LINE} || '}}' AS line {_OCC}")
def s02_lines(previous, places, sources, aliases):
    lines = places.sparkSession.read.text(f"{written_snapshot(previous, places, sources, aliases)}/snapshot.ndjson")
    return lines.where(F.get_json_object("value", "$.record_type") == "occurrence").select(F.col("value").alias("line"))


_CSV = " || ',' || ".join(f"coalesce({c}::VARCHAR, '')" for c in ("place_id", "p.name", "slot_date", "slot", "session_no", "label", _clock_sql("start_min"), _clock_sql("main_min"), "timezone", "o.source_id", "confidence"))
_NODE = "SELECT file, left(prefix, {d}) AS prefix, sha256(string_agg(prefix || ':' || sha, ',' ORDER BY prefix)) AS sha, sum(lines)::BIGINT AS lines, sum(bytes)::BIGINT AS bytes FROM {of} GROUP BY 1, 2"
_PLACE = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in {
    "aliases": "'[' || coalesce(names, '') || ']'", "balance": "coalesce(balance::VARCHAR, 'null')", "city": _json_sql("city"), "country": _json_sql("country"), "lat": "coalesce(lat::VARCHAR, 'null')", "lon": "coalesce(lon::VARCHAR, 'null')", "name": _json_sql("name"),
    "origin": "coalesce('[' || origin || ']', 'null')", "place_id": "place_id", "postcode": _json_sql("postcode"), "record_type": _json_sql("'place'"), "segment": _json_sql("segment"), "status": _json_sql("status"), "website": _json_sql("website"),
}.items())


@query("s05_snapshot_digests", ("previous", "places", "sources", "aliases"), f"""
WITH a AS (SELECT place_id, string_agg('"' || alias || '"', ',' ORDER BY alias) AS names FROM (SELECT DISTINCT place_id, alias FROM aliases) GROUP BY 1),
 s AS (SELECT place_id, string_agg('{{"source_id":' || source_id || ',"source_type":"' || source_type || '"}}', ',' ORDER BY source_id) AS origin FROM sources WHERE {PUB} GROUP BY 1),
 l AS (SELECT 'occurrences.csv' AS file, {_CSV} AS line {_OCC} UNION ALL SELECT 'snapshot.ndjson', '{{' || {_LINE} || '}}' {_OCC}
 UNION ALL SELECT 'snapshot.ndjson', '{{' || {_PLACE} || '}}' FROM places LEFT JOIN a USING (place_id) LEFT JOIN s USING (place_id) WHERE status = 'active'),
 c AS (SELECT file, sha256(line) AS digest, count(*) AS n, sum(strlen(line) + 1) AS bytes FROM l
 GROUP BY 1, 2), t2 AS (SELECT file, left(digest, 2) AS prefix, sha256(string_agg(digest || ':' || n, ',' ORDER BY digest || ':' || n)) AS sha,
 sum(n) AS lines, sum(bytes) AS bytes FROM c GROUP BY 1, 2), t1 AS ({_NODE.format(d=1, of="t2")}), t0 AS ({_NODE.format(d=0, of="t1")})
SELECT file, coalesce(lines, 0) AS lines, coalesce(bytes, 0) AS bytes, coalesce(sha, sha256('')) AS sha256
 FROM (VALUES ('snapshot.ndjson'), ('occurrences.csv')) f(file) LEFT JOIN t0 USING (file)""")
def s05_digests(previous, places, sources, aliases):
    folder = written_snapshot(previous, places, sources, aliases)
    return export.snapshot_digests(places.sparkSession, folder, digits=2)


@query("s04_changes_ndjson", ("change_events", "versions"), """SELECT '{"event_id":' || event_id || ',"kind":"' || kind || '","version":"' || version || '"}' AS value
 FROM change_events JOIN versions USING (version_id) WHERE version_id = 4""")
def s04(change_events, versions):
    rows = change_events.where("version_id = 4").join(versions.select("version_id", "version"), "version_id", "left")
    return export.as_json(rows.select("event_id", "kind", "version"))


@query("s05_metadata", ("previous", "places", "sources"), f"""
SELECT (SELECT count(*) FROM places WHERE status = 'active') AS places, (SELECT count(*)
 FROM previous) AS occurrences, count(*) FILTER ({PUB}) AS public_sources,
 count(*) FILTER (NOT ({PUB})) AS restricted_sources,
 'Default' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY first) FROM (SELECT trim(attribution) AS line,
 min(source_id) AS first FROM sources s JOIN places p USING (place_id) WHERE p.status = 'active' AND {PUB}
 AND attribution IS NOT NULL GROUP BY 1)) AS attribution
FROM sources JOIN places USING (place_id) WHERE places.status = 'active'""")
def s05(previous, places, sources):
    return export.metadata(places, previous, sources, "Default")


@query("j01_change_feed", "events", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def j01(events):
    spark = events.sparkSession
    source, target, checkpoint = (shared_folder(spark, n) for n in ("events", "feed", "cursor"))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    # the older half comes second, with replays of the newer one
    late = F.col("event_id") % 2 == 0
    for part in (events.where(~late), events.where(late).unionByName(events.where("event_id % 10 = 1"))):
        part.write.mode("append").parquet(source)
        changes.drain(changes.change_feed(spark, source, events.schema, 500), target, checkpoint)
    return spark.read.parquet(target).select("event_id", "event_type")


def drained(fetches):
    spark = fetches.sparkSession
    source, target, checkpoint = (shared_folder(spark, n) for n in ("fetches", "health", "state"))
    # the newer half comes first
    newer = F.dayofmonth("ts") > 15
    for part in (fetches.where(newer), fetches.where(~newer)):
        part.write.mode("append").parquet(source)
        outcomes.drain_rows(outcomes.fold_outcomes(spark.readStream.schema(fetches.schema).parquet(source)), target, checkpoint)
    return spark, target


@query("j02_fetch_outcomes_stream", "fetches", operations.FOLDED)
def j02(fetches):
    return outcomes.latest_health(*drained(fetches))


# every third source was fetched in a time to come, so it isn't due yet
define("fetches_ahead", ("fetches",), "SELECT event_id, source_id, CASE WHEN source_id % 3 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 100 YEAR ELSE CAST(ts AS TIMESTAMP) END AS ts, success FROM @fetches")


@query("j02_due_sources", ("fetches", "fetches_ahead"), f"""
SELECT source_id, failures, strftime(last + to_hours(wait_hours), '%Y-%m-%d %H:%M:%S') AS due_at
FROM ({operations.FOLDED}) h JOIN (SELECT source_id, max(ts) AS last FROM fetches_ahead GROUP BY source_id) USING (source_id)
WHERE source_id % 3 <> 0""")
def j02_due(fetches, fetches_ahead):
    due = outcomes.due_sources(*drained(fetches_ahead))
    return due.withColumn("due_at", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"))


@query("j04_skip_unchanged_stream", ("pages", "runs"), operations.SKIPPED)
def j04(pages, runs):
    spark = pages.sparkSession
    at = F.timestamp_seconds(F.col("page_id"))
    hashed = pages.select("page_id", (F.col("page_id") % 97).alias("source_id"), F.md5("html").alias("hash"), at.alias("at"))
    runs = runs.withColumn("at", F.timestamp_seconds(F.lit(0)))
    stored, ran, target, checkpoint = (shared_folder(spark, n) for n in ("hashed", "runs", "actions", "state"))
    hashed.limit(0).write.parquet(stored)
    stream = lambda: outcomes.changed_pages(spark.readStream.schema(hashed.schema).parquet(stored), spark.readStream.schema(runs.schema).parquet(ran))
    # failed runs, then successful ones of some of the same bodies, then the pages
    for part, folder in ((runs.where("not success"), ran), (runs.where("success"), ran), (hashed, stored)):
        part.write.mode("append").parquet(folder)
        outcomes.drain_rows(stream(), target, checkpoint)
    return spark.read.parquet(target).select("page_id", "action")
