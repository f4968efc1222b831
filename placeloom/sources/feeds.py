"""Readers of place and timetable feeds: JSON bundles, NDJSON, flat CSV, POI CSV, map dumps, registers, detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.html import unescaped
from placeloom.functions.text import compact_postcode, normalise_postcode, squeezed
from placeloom.functions.times import literal_map

# Names a feed may give the main time, the first present one counts.
TIME_ALIASES = ("jamaat_time", "jamaat", "jamat", "iqamah", "iqama")
SLOT = "struct<date:string,prayer:string,start_time:string," + ",".join(f"{a}:string" for a in TIME_ALIASES) + ",session_number:int,session_label:string,timezone:string>"
PLACE = f"external_id string, name string, city string, postcode string, latitude double, longitude double, schedules array<{SLOT}>, timetable array<{SLOT}>"

# Codes of a packed info field.
THEMES = {"Arab": "Arab mainstream", "Deob": "Deobandi", "Maud": "Maudoodi", "Salf": "Salafi", "Shia": "Shia", "Brel": "Bareilvi", "Sufi": "Sufi"}
MANAGERS = {"Arab": "Arab", "Bang": "Bangladeshi", "Guje": "Gujerati", "Paki": "Pakistani", "Pkstn": "Pakistani", "Stud": "Students", "Stdnt": "Students", "Tami": "Tamil", "Turk": "Turkish"}


def main_time(of=F.col) -> Column:
    """The first non-blank of the names that a feed may give the main time."""
    return F.coalesce(*[F.nullif(F.trim(of(a)), F.lit("")) for a in TIME_ALIASES])


def places_of(records: DataFrame) -> DataFrame:
    return records.select("external_id", "name", "city", normalise_postcode(F.col("postcode")).alias("postcode"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def slots_of(records: DataFrame) -> DataFrame:
    """One row a slot, of `schedules` or else `timetable`."""
    rows = records.select("external_id", F.inline(F.coalesce("schedules", "timetable")))
    return rows.select("external_id", F.try_to_date("date").alias("slot_date"), F.lower(F.trim("prayer")).alias("slot"), "start_time", main_time().alias("main_time"), F.coalesce("session_number", F.lit(1)).alias("session_no"), "session_label", F.coalesce("timezone", F.lit("Europe/London")).alias("timezone"))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Places of JSON bundles, `mosques: [...]` or one record a file; give it to places_of and slots_of."""
    whole = spark.read.schema(f"mosques array<struct<{PLACE.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>, {PLACE}").json(path, multiLine=True)
    single = [c.strip().split(" ")[0] for c in ("external_id", "name", "city", "postcode", "latitude", "longitude", "schedules", "timetable")]
    listed = whole.where("mosques is not null").select(F.inline("mosques"))
    return listed.select(*single).unionByName(whole.where("mosques is null and external_id is not null and name is not null").select(*single))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One place a line; blank lines are skipped by the reader."""
    return spark.read.schema(PLACE).json(path).where("external_id is not null")


def read_flat_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat timetable CSV as one row a slot, all columns text, with `row` in file order."""
    rows = spark.read.csv(path, header=True)
    for c in ("external_id", "mosque_id", "name", "mosque_name", "city", "postcode", "session_number", "session_label", "timezone", "date", "prayer", "start_time", *TIME_ALIASES):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def regroup(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, slots, rejected) of flat rows: attributes of a place from its first row; rows without a key are rejected."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    keyed = rows.withColumn("key", F.coalesce(clean("external_id"), clean("mosque_id")))
    good = keyed.where("key is not null")
    first = good.groupBy("key").agg(F.min_by(F.struct(F.coalesce(clean("name"), clean("mosque_name"), F.col("key")).alias("name"), clean("city").alias("city"), clean("postcode").alias("postcode")), "row").alias("p"))
    places = first.select(F.col("key").alias("external_id"), "p.name", "p.city", "p.postcode")
    slots = good.select(F.col("key").alias("external_id"), F.try_to_date(F.trim("date")).alias("slot_date"), F.lower(F.trim("prayer")).alias("slot"), main_time().alias("main_time"), F.coalesce(clean("session_number").try_cast("int"), F.lit(1)).alias("session_no"), F.coalesce(clean("timezone"), F.lit("Europe/London")).alias("timezone"))
    return places, slots, keyed.where("key is null").select("row", F.lit("missing external_id").alias("error"))


def decode_info(raw: Column) -> dict[str, Column]:
    """Parts of a packed info code: confidence, capacity, women, usage, class, theme and management."""
    text = F.trim(raw)
    body = F.regexp_replace(text, r"^\?", "")
    capacity = F.regexp_extract(body, r"^(\d+)", 1).try_cast("int")
    body = F.regexp_replace(body, r"^\d+", "")
    women = F.when(body.startswith("NoW"), "no").when(body.startswith("W"), "yes").otherwise("unknown")
    body = F.regexp_replace(body, "^(NoW|W)", "")
    kind = F.when(F.lower(body).startswith("multi"), "multi").when(body.startswith("Irreg"), "irreg").when(body.startswith("NJ"), "nj").when(body.startswith("J"), "j").otherwise("")
    usage = F.coalesce(F.try_element_at(literal_map({"multi": "unknown", "irreg": "irregular", "nj": "no_jumuah", "j": "jumuah_only"}), kind), F.lit("full_time"))
    record = F.coalesce(F.try_element_at(literal_map({"multi": "multi_faith", "irreg": "prayer_room", "j": "hired_hall"}), kind), F.lit("mosque"))
    body = F.regexp_replace(body, "^((?i:multi)|Irreg|NJ|J)", "")
    theme = F.regexp_extract(body, f"^({'|'.join(sorted(THEMES, key=len, reverse=True))})", 1)
    body = F.regexp_replace(body, f"^({'|'.join(THEMES)})", "")
    manager = F.regexp_extract(body, f"^({'|'.join(sorted(MANAGERS, key=len, reverse=True))})", 1)
    named = lambda m, c: F.try_element_at(literal_map(m), c)
    confidence = F.when(raw.isNull(), "unknown").when(text.startswith("?"), "low").otherwise("high")
    return {"confidence": confidence, "capacity": capacity, "women": women, "usage": usage, "class": record, "theme": named(THEMES, theme), "management": named(MANAGERS, manager)}


PHONE = r"\(?\+?\d[\d\s()\-]{8,}\d"


def read_poi_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (lon, lat, label, comment) of headless POI CSV files; give it to decode_poi. What is no number is null."""
    return spark.read.csv(path, schema="lon double, lat double, label string, comment string", header=False)


def decode_poi(rows: DataFrame) -> DataFrame:
    """Headless POI rows (lon, lat, label, comment) with their parts and `skip_reason`, null for a good row.

    Label: [*|?][info]name. address. phone; comment: city,postcode-ID:number. Address is what follows the
    first full stop, without the last phone number.
    """
    shape = r"^([*?])?\[([^\]]*)\](.*)$"
    flag, info, body = (F.regexp_extract("label", shape, k) for k in (1, 2, 3))
    number = F.nullif(F.regexp_extract("comment", r"-ID:(\d+)\s*$", 1), F.lit(""))
    phones = F.regexp_extract_all(F.col("label"), F.lit(PHONE), F.lit(0))
    rows = rows.withColumns({"flag": flag, "info": info, "body": body, "number": number, "phone": F.get(phones, F.size(phones) - 1)})
    bare = F.when(F.col("phone").isNotNull(), F.replace(F.col("body"), F.col("phone"), F.lit(""))).otherwise(F.col("body"))
    parts = F.filter(F.transform(F.split(bare, r"\."), squeezed), lambda p: p != "")
    place = F.regexp_replace("comment", r"-ID:\d+\s*$", "")
    rows = rows.withColumns({"parts": parts, "place": place, **decode_info(F.col("info"))})
    postcode = F.when(F.contains("place", F.lit(",")), normalise_postcode(F.substring_index("place", ",", -1)))
    city = F.nullif(squeezed(F.regexp_replace("place", r",[^,]*$", "")), F.lit(""))
    name = F.get("parts", F.lit(0))
    defunct = F.lower("body").contains("defunct")
    skip = (
        F.when(F.col("label").isNull() | F.col("comment").isNull(), "missing_columns").when(F.col("lat").isNull() | F.col("lon").isNull() | (F.abs("lat") > 90) | (F.abs("lon") > 180), "invalid_coordinates")
        .when(F.col("number").isNull(), "missing_id").when(name.isNull(), "missing_name").when(defunct, "defunct").when(F.col("class") == "multi_faith", "multi_faith")
    )
    address = F.nullif(F.array_join(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))), ", "), F.lit(""))
    country = F.when(F.col("postcode").rlike(r"^[A-Z]\d\d [A-Z0-9]{4}$|^D6W "), "IE").otherwise("GB")
    out = rows.select("number", name.alias("name"), address.alias("address"), "phone", city.alias("city"), postcode.alias("postcode"), "capacity", "usage", "class", "confidence", "women", skip.alias("skip_reason"))
    return out.withColumn("country", country)


# Denominations, and parts of a name, of the places that a feed is about.
DENOMINATIONS, NAME_PARTS = ("muslim", "sunni", "shia", "ahmadiyya"), ("masjid", "mosque", "islamic")
ELEMENT = "type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>"


def of_religion(religion: Column, denomination: Column, name: Column) -> Column:
    """Whether a place belongs to the feed's religion, by its tags or its name."""
    bare = lambda c: F.lower(F.trim(c))
    tests = (bare(religion) == "muslim") | bare(denomination).isin(*DENOMINATIONS)
    return F.coalesce(tests, F.lit(False)) | F.coalesce(F.lower(name).rlike("|".join(NAME_PARTS)), F.lit(False))


def read_map_dump(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map dumps `{"elements": [...]}` with their place `pos` (file, index); give it to map_elements."""
    whole = spark.read.schema(f"elements array<struct<{ELEMENT}>>").json(path, multiLine=True)
    rows = whole.select(F.input_file_name().alias("file"), F.posexplode("elements").alias("index", "e"))
    return rows.select("e.*", F.struct("file", "index").alias("pos"))


def map_elements(elements: DataFrame) -> DataFrame:
    """Elements (type, id, lat, lon, center, tags) as places with `skip_reason`; of one (type, id) the first by `pos` counts.

    The reason is the first of invalid_type (no type or id), no_name, no_coords and non_muslim. Elements of other
    types than node, way and relation are dropped.
    """
    tag = lambda k: F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit(""))
    first = F.row_number().over(Window.partitionBy("type", "id").orderBy("pos"))
    invalid = F.col("type").isNull() | F.col("id").isNull()
    rows = elements.where(invalid | F.col("type").isin("node", "way", "relation")).withColumn("n", first)
    rows = rows.where(invalid | (F.col("n") == 1))
    name = F.coalesce(tag("name"), tag("name:en"), tag("official_name"))
    node = F.col("type") == "node"
    lat, lon = (F.when(node, F.col(k)).otherwise(F.col(f"center.{k}")) for k in ("lat", "lon"))
    skip = (
        F.when(invalid, "invalid_type").when(name.isNull(), "no_name").when(lat.isNull() | lon.isNull(), "no_coords")
        .when(~of_religion(tag("religion"), tag("denomination"), name), "non_muslim")
    )
    fields = [c.alias(k) for k, c in tag_fields(name).items()]
    return rows.select("type", "id", name.alias("name"), lat.alias("lat"), lon.alias("lon"), *fields, skip.alias("skip_reason"))


NORMALISED = (
    "osm_type string, osm_id bigint, name string, aliases array<string>, address_line1 string, city string, postcode string, "
    "country string, website_url string, latitude double, longitude double, religion string, denomination string"
)


def read_place_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Places of normalised bundles, `{"places": [...]}` or one place a file, as records with `fits`, whether the religion does."""
    inner = NORMALISED.replace(", ", ",").replace(" ", ":")
    whole = spark.read.schema(f"places array<struct<{inner}>>, {NORMALISED}").json(path, multiLine=True)
    columns = [c.split(" ")[0] for c in NORMALISED.split(", ")]
    listed = whole.where("places is not null").select(F.inline("places"))
    single = whole.where("places is null and osm_type is not null and osm_id is not null").select(*columns)
    rows = listed.unionByName(single)
    country = F.when(F.upper(F.trim("country")).isin("IE", "IRELAND"), "IE").otherwise("GB")
    return rows.select(
        F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("external_id"), "name", "aliases", "city",
        normalise_postcode(F.col("postcode")).alias("postcode"), country.alias("country"), F.col("website_url").alias("website"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        of_religion(F.col("religion"), F.col("denomination"), F.col("name")).alias("fits"),
    )


def tag_fields(name: Column) -> dict[str, Column]:
    """Aliases, address, city, website and country of an element's tags."""
    tag = lambda k: F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit(""))
    listed = F.flatten(F.array(*[F.split(F.coalesce(tag(k), F.lit("")), ";") for k in ("alt_name", "official_name", "loc_name")]))
    listed = F.filter(F.transform(listed, lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.lower(F.coalesce(name, F.lit("")))))
    # one spelling of each, the first
    distinct = F.filter(listed, lambda a, i: ~F.exists(F.slice(F.transform(listed, lambda b: F.lower(b)), 1, i), lambda b: b == F.lower(a)))
    street = F.coalesce(F.concat(tag("addr:housenumber"), F.lit(" "), tag("addr:street")), tag("addr:street"), tag("addr:housenumber"))
    site = F.coalesce(tag("website"), tag("contact:website"), tag("url"))
    site = F.when(F.instr(site, "://") > 0, site).otherwise(F.concat(F.lit("https://"), site))
    country = F.when(F.upper(tag("addr:country")).isin("GB", "UK"), "GB").when(F.upper(tag("addr:country")).isin("IE", "IRELAND"), "IE")
    return {"aliases": distinct, "address": F.coalesce(tag("addr:full"), street, tag("addr:place")), "city": F.coalesce(*[tag(f"addr:{k}") for k in ("city", "town", "village", "suburb")]), "website": site, "country": country}


def discovery_records(*feeds: tuple[DataFrame, str]) -> DataFrame:
    """Feeds of places as one frame of records: what a feed lacks is null."""
    fields = {"external_id": "string", "name": "string", "city": "string", "postcode": "string", "lat": "double", "lon": "double", "website": "string", "country": "string"}
    frames = []
    for df, kind in feeds:
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]
        frames.append(df.select(F.lit(kind).alias("source_type"), *cols))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def detail_text(html: Column) -> Column:
    """Text of a detail page: a line for each block, tags gone, character references resolved."""
    lines = F.regexp_replace(html, r"(?i)<(br|/p|/div|/li|/tr|/h\d|/dd|/td)\b[^>]*>", "\n")
    return unescaped(F.regexp_replace(lines, r"(?s)<[^>]*>", " "))


def detail_fields(text: Column) -> dict[str, Column]:
    """Labelled fields of a detail page's text."""
    found = lambda p: F.nullif(squeezed(F.regexp_extract(text, p, 1)), F.lit(""))
    listed = F.transform(F.split(found(r"Sources:[ \t]*([^\n]+)"), ","), squeezed)
    return {
        "updated": F.try_to_date(found(r"Last Updated:?\s*(\d{2}/\d{2}/\d{4})"), "dd/MM/yyyy"),
        "phone": found(rf"(?:Tel|Phone):?\s*({PHONE})"), "website": found(r"Website:?[ \t]*(\S+)"),
        "capacity": found(r"Capacity:?\s*(\d+)").try_cast("int"), "theme": found(r"Theme:?[ \t]*([^\n;]+)"),
        "accuracy": found(r"Data accuracy:?\s*([A-F])\b"), "sources": F.filter(listed, lambda s: s != ""),
    }


def overlay(records: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """records with the fields that details know in place of their own."""
    known = details.select(key, *[F.col(f).alias(f"detail {f}") for f in fields])
    joined = records.join(known, key, "left")
    return joined.withColumns({f: F.coalesce(f"detail {f}", f) for f in fields}).select(*records.columns)


def read_register(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """Register rows with web and postcode: number, registered, status, compact postcode and url, by a map of column names.

    columns: number, registered, postcode, web and, if there is one, status to the file's names.
    """
    rows = spark.read.csv(path, header=True, sep=sep, maxCharsPerColumn=-1)
    rows = rows.select(*[F.trim(F.col(f"`{v}`")).alias(k) for k, v in columns.items()])
    rows = rows.where((F.coalesce("web", F.lit("")) != "") & compact_postcode(F.col("postcode")).isNotNull())
    url = F.when(F.instr("web", "://") > 0, F.col("web")).otherwise(F.concat(F.lit("https://"), "web"))
    return rows.withColumns({"compact": compact_postcode(F.col("postcode")), "url": url}).drop("postcode", "web")
