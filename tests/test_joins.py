"""Joins at scale: heavy keys in tiles, nearest places, long chains of merges, as-of lookups, domain lists, digests."""

import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import crawl, domains, export, nearby, resolve, skew


def test_a_key_with_half_of_all_rows_is_split(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(900).select(F.col("id").alias("b"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    found = skew.tiled_join(left, right, ["k"], F.col("a"), F.col("b"), tile=100)
    pairs = found.select("a", "b").collect()
    wanted = {tuple(r) for r in left.join(right, "k").select("a", "b").collect()}
    assert len(pairs) == len(wanted) and {tuple(r) for r in pairs} == wanted
    # no pair of tiles, so no group of the join, holds more than about a tile of either side
    marks = {r.k: (r.left_tiles, r.right_tiles) for r in skew.heavy_keys(left, ["k"], "left_tiles", 100).join(skew.heavy_keys(right, ["k"], "right_tiles", 100), ["k"], "full").collect()}
    assert marks == {0: (15, 3)}
    sizes = left.where("k = 0").groupBy(F.pmod(F.xxhash64("a"), F.lit(15))).count().agg(F.max("count")).first()[0]
    assert sizes < 160


def test_a_city_with_half_of_the_records_blocks_alike(spark, monkeypatch):
    schema = "name string, postcode string, city string, country string, website string, lat double, lon double, precision string, confidence string, class string"
    rng = random.Random(3)
    row = lambda i: (f"Hall {i}", None if i % 3 else "AB1 2CD", "Town" if i % 2 else f"City {i % 40}", "GB", None, 51 + rng.random() / 100, -1.0, None, None, None)
    records = spark.createDataFrame([(i, *row(i)) for i in range(200)], f"record_id long, {schema}")
    places = spark.createDataFrame([(i, *row(i)) for i in range(150)], f"place_id long, {schema}")
    whole = {tuple(r) for r in resolve.block(records, places).collect()}
    assert len(whole) > 100 * 75
    join = skew.tiled_join
    monkeypatch.setattr(resolve, "tiled_join", lambda *a: join(*a, tile=7))
    split = resolve.block(records, places).collect()
    assert len(split) == len(whole) and {tuple(r) for r in split} == whole


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * geo.RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_places_round_the_globe(spark, k):
    rng = random.Random(7)
    # a dense town, one point with many places, the far side of the date line, the poles, and empty sea between
    points = [(51 + rng.random() / 50, rng.random() / 50) for _ in range(150)] + [(51.01, 0.01)] * 30
    points += [(10.0, 179.99), (10.0, -179.98), (89.9, 10.0), (89.95, -170.0), (-89.99, 0.0), (-33.0, 151.0)]
    origins = [(51.01, 0.01), (51.2, 0.5), (10.0, -179.999), (10.01, 179.999), (90.0, 0.0), (89.99, 100.0), (-90.0, 50.0), (0.0, 0.0), (-34.0, -100.0), (51.005, 0.003)]
    places = spark.createDataFrame([*((i, *p) for i, p in enumerate(points)), (999, None, 1.0)], "place_id long, lat double, lon double")
    asked = spark.createDataFrame([*((i, *p) for i, p in enumerate(origins)), (99, 1.0, None)], "origin_id long, lat double, lon double")
    found = {}
    for r in nearby.nearest_each(asked, places, "origin_id", "place_id", k).collect():
        found.setdefault(r.origin_id, []).append((r.rank, round(r.metres, 3), r.place_id))
    assert set(found) == set(range(len(origins)))
    for i, o in enumerate(origins):
        best = sorted((metres(o, p), j) for j, p in enumerate(points))[:k]
        assert sorted(found[i]) == [(n, pytest.approx(d, abs=0.01), j) for n, (d, j) in enumerate(best, 1)]


def test_nearest_of_fewer_places_than_asked_for(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 100.0)], "place_id long, lat double, lon double")
    asked = spark.createDataFrame([(1, 10.0, 10.0)], "origin_id long, lat double, lon double")
    assert [r.place_id for r in nearby.nearest_each(asked, places, "origin_id", "place_id", 5).orderBy("rank").collect()] == [1, 2]
    assert nearby.nearest_each(asked, places.limit(0), "origin_id", "place_id", 5).collect() == []


def test_a_chain_of_ten_thousand_merges(spark):
    n = 10_000
    merges = spark.range(1, n + 1).select(F.col("id").alias("duplicate_id"), (F.col("id") - 1).alias("canonical_id"))
    found = resolve.final_targets(merges)
    assert found.count() == n and found.where("canonical_id <> 0").count() == 0


def test_lookups_as_of(spark):
    rng = random.Random(5)
    day = datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(minutes=30 * h)
    # one key with most of the rows, equal times, entries on the edge of the time to live
    entries = [(rng.choice(["a", "a", "a", "b"]), at(rng.randrange(400)), i) for i in range(600)]
    lookups = [(i, rng.choice(["a", "b", "c"]), at(rng.randrange(-5, 500))) for i in range(300)]
    found = crawl.cached_at(spark.createDataFrame(lookups, "lookup_id long, key string, at timestamp"), spark.createDataFrame(entries, "key string, ts timestamp, event_id long"), "key", 6, parts=5)
    got = {r.lookup_id: (r.event_id, r.ts) for r in found.collect()}
    for i, key, when in lookups:
        fresh = [(ts, -e) for k, ts, e in entries if k == key and when - datetime.timedelta(hours=6) <= ts <= when]
        assert got[i] == ((-max(fresh)[1], max(fresh)[0]) if fresh else (None, None))


def test_domain_lists(spark):
    extra = spark.createDataFrame([("Example.org", "suffix", "mine"), ("only.test", "exact", "mine"), ("odd", "substring", "bits"), (" ", "suffix", "mine")], domains.SCHEMA)
    hosts = ["yell.com", "a.yell.com", "fedex.com", "example.org", "a.b.example.org", "notexample.org", "only.test", "a.only.test", "www.odd.net", "salah.com.", None, ""]
    rows = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(hosts)], "id long, h string, lists string").drop("lists")
    found = {hosts[r.id]: r.lists for r in domains.with_lists(rows, F.col("h"), domains.domain_table(spark, extra)).collect()}
    assert found == {"yell.com": ["directory"], "a.yell.com": [], "fedex.com": ["register"], "example.org": ["mine"], "a.b.example.org": ["mine"], "notexample.org": [], "only.test": ["mine"], "a.only.test": [], "www.odd.net": ["bits"], "salah.com.": ["aggregator"], None: [], "": []}
    many = spark.range(domains.SUBSTRINGS + 1).select(F.col("id").cast("string").alias("domain"), F.lit("substring").alias("kind"), F.lit("x").alias("list"))
    with pytest.raises(ValueError, match="substring"):
        domains.host_lists(rows.select(F.col("h").alias("host")), many)


def test_content_digest(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = ["b", "a", "", "a", "ü"]
    make = lambda xs, n=3: spark.createDataFrame([(x,) for x in xs], "value string").repartition(n)
    first = export.content_digest(make(lines)).first()
    assert (first.lines, first.bytes) == (5, 10) and first.sha256 == export.content_digest(make(lines[::-1], 1)).first().sha256
    assert first.sha256 == sha(",".join(sorted(f"{sha(x)}:{lines.count(x)}" for x in set(lines))))
    assert first.sha256 != export.content_digest(make(lines[1:])).first().sha256 != export.content_digest(make([*lines, "a"])).first().sha256
    assert tuple(export.content_digest(make([])).first()) == (0, 0, sha(""))
    deep = export.content_digest(make(map(str, range(500))), digits=2).first()
    assert deep.lines == 500 and deep.sha256 != export.content_digest(make(map(str, range(500)))).first().sha256


def _sent_to_all(df):
    """Tables that the plan sends through the driver."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_no_table_of_places_passes_the_driver(spark):
    """Spark takes these tables for small ones; all that is broadcast are the heavy keys of the two keyed joins, once a side."""
    schema = "record_id long, lat double, lon double, postcode string, city string, country string, name string, website string, precision string, confidence string, class string"
    records = spark.createDataFrame([(i, 51.0, i / 1e4, f"A{i} 1AB", f"City {i}", "GB", f"n {i}", "", "precise", "high", "mosque") for i in range(4)], schema)
    places = records.drop("precision", "confidence", "class").withColumnRenamed("record_id", "place_id")
    assert _sent_to_all(resolve.within(records, places, "record_id", "place_id", 500.0)) == 0
    assert _sent_to_all(resolve.near_facts(records, places)) == 0
    assert _sent_to_all(resolve.block(records, places)) == _sent_to_all(resolve.block_facts(records, places)) == 4


def test_pairs_of_several_joins_come_once(spark):
    """Every pair here shares the postcode, the city and the neighbourhood, or two of them, or one."""
    rows = [(i, 51.0 + i % 2, -1.0, ("A1 1AB", "B2 2AB", None)[i % 3], ("X", "Y", None)[i // 3 % 3], "GB") for i in range(18)]
    records = spark.createDataFrame(rows, "record_id long, lat double, lon double, postcode string, city string, country string").selectExpr("*", "'n' AS name", "'' AS website")
    places = records.withColumnRenamed("record_id", "place_id")
    found = [tuple(r) for r in resolve.block(records, places).collect()]
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] or any(a[k] is not None and a[k] == b[k] for k in (3, 4))}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_leads_of_titles_with_character_references_agree_with_sql(spark, tmp_path):
    """Titles with &amp;, and without a word or of a few letters, in every kind of lead (page_id % 9)."""
    import duckdb

    from placeloom import plans

    titles = ["For&amp;&amp;&amp; th strend", "a = &quot;2abc&quot; and more", "Reer.", "***", "Éçé Éçé Éçé", "plain old title"]
    rows = [(i, f"https://site{i}.example.org/p", f"<html><head><title>{titles[i // 9]}</title></head><body><p>text {i}</p></body></html>") for i in range(9 * len(titles))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in plans.QUERIES["d11_verify_leads"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == set(con.execute(plans.ORACLES["d11_verify_leads"]).fetchall())
    assert (2, "verified", rows[2][1]) in found and (29, "no_match", None) in found


def test_points_by_a_pole_have_cells_of_their_own(spark):
    """Rows of cells are split close to the poles too, and no near point of another row is lost."""
    rng = random.Random(5)
    rows = [(i, rng.choice((1, -1)) * (89.9 + rng.random() / 10), rng.uniform(-180, 180)) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, lat double, lon double")
    found = {(r.a, r.b) for r in resolve.within(df, df.withColumnRenamed("a", "b"), "a", "b", 900.0).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in rows if metres(a[1:], b[1:]) <= 900}
    n = spark.range(1).select(geo.columns_of(geo.lat_cell(F.lit(89.95), 200.0), 200.0).alias("n")).first().n
    assert n > 100


def test_scripts_of_a_busy_domain_match_as_brute_force(spark):
    """One domain has most scripts and sources; matches are counted before the rows are made, and only heavy keys are broadcast."""
    keys = [(f"site_{i:08x}" if i % 7 == 0 else f"site_plain_{i}", "a.org" if i % 5 else "b.a.org", ("hall", "Old", None)[i % 3]) for i in range(60)]
    hosts = [(i, f"{i:08x}", ("www.b.a.org", "a.org", None, "xa.org")[i % 4], ("Hall 1", "old hall", "Other", None)[i // 4 % 4]) for i in range(64)]
    df = crawl.match_scripts(spark.createDataFrame(keys, "key string, domain string, name_part string"), spark.createDataFrame(hosts, "source_id long, hint string, host string, place_name string"))
    wanted = []
    for key, domain, part in keys:
        by = [(key, h[0], "hint") for h in hosts if key[-8:] == h[1] and key[-9] == "_"]
        by = by or [(key, h[0], "domain") for h in hosts if h[2] and h[3] and part and (h[2] == domain or h[2].endswith("." + domain)) and part.lower() in h[3].lower()]
        wanted += [(*m, len(by)) for m in by] or [(key, None, None, 0)]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, wanted))
    assert _sent_to_all(df) == 4


def test_wide_cells_lose_no_point_and_are_fewer(spark):
    """Round the globe, by the poles and on the edges of cells, a point meets as many others from about four cells as from nine."""
    rng = random.Random(9)
    rows = [(i, *rng.choice(((rng.uniform(89.9, 90), rng.uniform(-180, 180)), (-89.95, rng.uniform(-180, 180)), (10 + rng.random() / 40, rng.choice((179.99, -180.0, 180.0, -179.99)) + rng.uniform(-0.01, 0.01) % 0.01), (60 + rng.random() / 30, rng.random() / 20)))) for i in range(500)]
    rows += [(500 + i, k * 2 * 900 / geo.DEGREE, m * 360 / 22_237) for i, (k, m) in enumerate((k, m) for k in (-1, 0, 1) for m in (-1, 0, 1))]
    df = spark.createDataFrame(rows, "a long, lat double, lon double")
    other = df.withColumnRenamed("a", "b")
    found = {(r.a, r.b) for r in geo.within(df, other, "a", "b", 900.0, wide=True).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in rows if metres(a[1:], b[1:]) <= 900} and len(found) > 2 * len(rows)
    cells = df.agg(*[F.avg(F.size(f(F.col("lat"), F.col("lon"), 900.0))).alias(n) for n, f in (("nine", geo.near_cells), ("wide", geo.touched_cells))]).first()
    assert cells.wide < 0.6 * cells.nine
