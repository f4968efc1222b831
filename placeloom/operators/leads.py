"""Website leads of places without one: from registers, source metadata, map tags and searches, and their analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.similarity import token_set_ratio
from placeloom.functions.text import compact_postcode, domain_of, is_denied_host, is_directory_host, normalise_name, note_value, shared_tokens
from placeloom.operators.reads import missing_website
from placeloom.sources.files import kept

REGISTER_TOKENS, REGISTER_RATIO, SEARCH_RESULTS = 2, 60, 3
# Metadata keys that hold a place's own homepage, and website tags of a map element.
HOMEPAGE_KEYS = ("homepage", "homepage_url", "mosque_website", "official_website", "primary_website", "url")
WEBSITE_TAGS = ("website", "contact:website", "url", "contact:url")
TOP_DOMAINS, TOP_LOCATIONS, TOP_NO_MATCH = 40, 20, 30


def register_pairs(register: DataFrame, places: DataFrame) -> DataFrame:
    """Register rows (number, registered, compact, url) of a place's postcode that share two words with its name.

    The places have no website; a denied host is no lead.
    """
    without = missing_website(places).withColumn("compact", compact_postcode(F.col("postcode")))
    pairs = register.join(without.select("place_id", "name", "compact"), "compact")
    pairs = pairs.where(~is_denied_host(domain_of(F.col("url"))))
    return pairs.where(shared_tokens(F.col("name"), F.col("registered")) >= REGISTER_TOKENS)


def register_leads(register: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """(place_id, number, url, ratio, source_id) of register pairs with a likely name.

    source_id is that of the register source (its external_id is the number) that there is already, else null.
    """
    ratio = token_set_ratio(normalise_name(F.col("name")), normalise_name(F.col("registered")))
    known = sources.where("source_type = 'register'").groupBy(F.col("external_id").alias("known"))
    known = known.agg(F.min("source_id").alias("source_id"))
    pairs = register_pairs(register, places).withColumn("ratio", ratio).where(F.col("ratio") >= REGISTER_RATIO)
    pairs = pairs.join(known, F.col("number").cast("string") == F.col("known"), "left")
    return pairs.select("place_id", "number", "url", "ratio", "source_id")


def is_web(url: Column) -> Column:
    return F.coalesce(F.lower(F.trim(url)).rlike("^https?://"), F.lit(False))


def metadata_leads(sources: DataFrame, places: DataFrame, source_type: str) -> DataFrame:
    """(source_id, place_id, key, url) of homepage-like keys in the metadata of sources of a type, for places without website."""
    without = places.where(F.coalesce("website", F.lit("")) == "").select("place_id")
    rows = sources.where(F.col("source_type") == source_type).join(without, "place_id", "left_semi")
    rows = rows.select("source_id", "place_id", F.explode("metadata").alias("key", "url"))
    return rows.where(F.col("key").isin(*HOMEPAGE_KEYS) & is_web(F.col("url"))).withColumn("url", F.trim("url"))


def tag_leads(elements: DataFrame, places: DataFrame) -> DataFrame:
    """(place_id, tag, url) of website tags of linked map elements (place_id, tags) that differ from the place's website."""
    rows = elements.join(places.select("place_id", "website"), "place_id")
    rows = rows.select("place_id", "website", F.explode("tags").alias("tag", "url"))
    rows = rows.where(F.col("tag").isin(*WEBSITE_TAGS)).withColumn("url", F.trim("url"))
    return rows.where(is_web(F.col("url")) & ~F.col("url").eqNullSafe(F.col("website"))).select("place_id", "tag", "url")


def search_query(name: Column, postcode: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('" '), postcode)


def search_leads(places: DataFrame, results: DataFrame) -> DataFrame:
    """(place_id, rank, url) of the first results (query, rank, url) of each place's search; equal queries are asked once."""
    asked = missing_website(places).withColumn("query", search_query(F.col("name"), F.col("postcode")))
    queries = asked.select("query").distinct()
    allowed = (F.col("rank") <= SEARCH_RESULTS) & ~is_directory_host(domain_of(F.col("url")))
    found = queries.join(results, "query").where(allowed)
    return asked.select("place_id", "query").join(found, "query").select("place_id", "rank", "url")


def ratio_bucket(ratio: Column) -> Column:
    return F.when(ratio < 40, "0-39").when(ratio < 60, "40-59").when(ratio < 80, "60-79").when(ratio >= 80, "80-100")


def fetch_failure(notes: Column) -> Column:
    """Why a page wasn't fetched, by the words of the note; the first that fits."""
    text = F.lower(notes)
    blocked = F.contains(notes, F.lit("403")) | F.contains(text, F.lit("cloudflare"))
    return (
        F.when(F.contains(text, F.lit("non-html")), "non_html").when(blocked, "403_cloudflare")
        .when(F.contains(text, F.lit("timeout")), "timeout").otherwise("other")
    )


def lead_analysis(leads: DataFrame) -> DataFrame:
    """(section, value, n) of audit rows (notes, location): provider, outcome, domain, location, fetch_failure, name_ratio, no_match_domain.

    notes hold k=v pairs. Buckets of the name ratio and the last section count what didn't match; domains, locations
    and domains without match are cut to their most frequent (ties by value).
    """
    value = lambda k: note_value(F.col("notes"), k)
    # every value once a row: columns of their own, as several sections use them
    leads = leads.select("notes", "location", *[value(k).alias(k) for k in ("provider", "outcome", "url", "name_ratio")])
    leads = leads.withColumns({"domain": domain_of(F.col("url")), "ratio": F.col("name_ratio").try_cast("double")})
    outcome, domain = F.col("outcome"), F.col("domain")
    lost, failed = outcome == "no_match", outcome == "fetch_failed"
    sections = {
        "provider": F.col("provider"), "outcome": outcome, "domain": domain, "location": F.col("location"),
        "fetch_failure": F.when(failed, fetch_failure(F.col("notes"))),
        "name_ratio": F.when(lost, ratio_bucket(F.col("ratio"))),
        "no_match_domain": F.when(lost, domain),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("value")) for k, v in sections.items()])
    counts = leads.select(F.inline(pairs)).where("value is not null").groupBy("section", "value")
    # read four times; written, the notes are read once
    counts = kept(counts.agg(F.count(F.lit(1)).alias("n")), "lead-counts")
    top = {"domain": TOP_DOMAINS, "location": TOP_LOCATIONS, "no_match_domain": TOP_NO_MATCH}
    cut = [counts.where(F.col("section") == k).orderBy(F.desc("n"), "value").limit(n) for k, n in top.items()]
    out = counts.where(~F.col("section").isin(*top))
    for c in cut:
        out = out.unionByName(c)
    return out
