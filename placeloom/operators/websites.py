"""Verification of website leads against stored pages, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.html import parsed_site, parsed_text
from placeloom.functions.similarity import token_set_ratio
from placeloom.functions.text import appears_in, domain_of, is_directory_host, normalise_name

NAME_RATIO, ADDRESS_CHARS = 60, 6
# Paths that often have the address, in the order they are tried.
CONTACT_PATHS = ("/contact", "/contact-us", "/about", "/about-us", "/find-us", "/visit-us")


def page_facts(pages: DataFrame) -> DataFrame:
    """(url, title, body, site): each page is parsed once, before any join."""
    return pages.select("url", parsed_text(F.col("html")).alias("t"), parsed_site(F.col("url"), F.col("html")).alias("site")).select("url", "t.title", F.col("t.text").alias("body"), "site")


def evidence(name: Column, postcode: Column, address: Column, title: Column, body: Column) -> Column:
    """Whether a page shows the place's name (ratio), and its postcode or the first line of its address. Texts are searched whole."""
    text = F.concat_ws(" ", title, body)
    ratio = token_set_ratio(normalise_name(name), normalise_name(text))
    place = appears_in(postcode, text) | F.coalesce((F.char_length(F.trim(address)) >= ADDRESS_CHARS) & appears_in(address, text), F.lit(False))
    return F.coalesce((ratio >= NAME_RATIO) & place, F.lit(False))


def verify(leads: DataFrame, pages: DataFrame) -> DataFrame:
    """leads (lead_id, url, name, postcode, address, trusted) with outcome and url: verified, denied, fetch_failed or no_match.

    A denied host comes first, then a trusted lead (its source names the place), which is verified unseen.
    Else the lead's page, then the site it names, then contact pages of its host, the first hit wins. All are
    equi-joins on the url with pages parsed once.
    """
    facts = page_facts(pages)
    host = F.regexp_extract("url", r"^([^:]+://[^/?#]+)", 1)
    denied, trusted = is_directory_host(domain_of(F.col("url"))), F.coalesce("trusted", F.lit(False))
    seen = leads.join(facts, "url", "left").withColumn("fetched", F.col("body").isNotNull())
    place = ["lead_id", "name", "postcode", "address"]
    tries = seen.where(~denied & ~trusted & F.col("fetched")).select(*place, F.lit(0).alias("rank"), "url", "title", "body", "site")
    linked = tries.where("site is not null").select(*place, F.lit(1).alias("rank"), F.col("site").alias("url")).join(facts.drop("site"), "url")
    paths = F.posexplode(F.array(*[F.lit(p) for p in CONTACT_PATHS])).alias("k", "path")
    contact = tries.select(*place, host.alias("host"), paths)
    contact = contact.select(*place, (F.col("k") + 2).alias("rank"), F.concat("host", "path").alias("url")).join(facts.drop("site"), "url")
    columns = [*place, "rank", "url", "title", "body"]
    every = tries.select(columns).unionByName(linked.select(columns)).unionByName(contact.select(columns))
    shown = evidence(*[F.col(c) for c in ("name", "postcode", "address", "title", "body")])
    hits = every.where(shown).groupBy("lead_id").agg(F.min_by("url", "rank").alias("verified_url"))
    verified = F.when(trusted, F.col("url")).otherwise(F.col("verified_url"))
    outcome = F.when(denied, "denied").when(verified.isNotNull(), "verified").when(~F.col("fetched"), "fetch_failed").otherwise("no_match")
    joined = seen.join(hits, "lead_id", "left")
    return joined.select("lead_id", outcome.alias("outcome"), F.when(outcome == "verified", verified).alias("verified_url"))


def promote(verified: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """New manual sources of verified leads (lead_id, place_id, provider, provider_rank, outcome, verified_url).

    One a place that has no website yet, that of the first provider; a (provider, place) that has a source
    already is left out, so a second run adds nothing.
    """
    good = verified.where("outcome = 'verified'").withColumn("external_id", F.concat_ws(":", "provider", F.col("place_id").cast("string")))
    fresh = good.join(sources.select("external_id"), "external_id", "left_anti")
    without = places.where(F.coalesce("website", F.lit("")) == "").select("place_id")
    best = fresh.join(without, "place_id", "left_semi").groupBy("place_id").agg(F.min_by(F.struct("external_id", "verified_url"), F.struct("provider_rank", "lead_id")).alias("b"))
    return best.select("place_id", "b.external_id", F.col("b.verified_url").alias("website"))


def audit_rows(verified: DataFrame) -> DataFrame:
    """(lead_id, place_id, notes) of leads (also url, provider, outcome) that were neither verified nor denied, notes as k=v."""
    lost = verified.where(F.col("outcome").isin("fetch_failed", "no_match"))
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in ("provider", "outcome", "url")]
    return lost.select("lead_id", "place_id", F.concat_ws("; ", *parts).alias("notes"))


def run_counts(verified: DataFrame, promoted: DataFrame) -> DataFrame:
    """One row: how many leads were verified, denied, fetch_failed and no_match, audit rows, and websites promoted."""
    names = ("verified", "denied", "fetch_failed", "no_match")
    counts = verified.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in names])
    total = promoted.agg(F.count(F.lit(1)))
    return counts.select("*", (F.col("fetch_failed") + F.col("no_match")).alias("audited"), total.scalar().alias("promoted"))
