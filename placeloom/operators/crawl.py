"""Crawl registration, assignments, policy verdicts, fetch outcomes and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.text import domain_class, domain_of, source_hint
from placeloom.operators.skew import shuffled, tiled_join
from placeloom.sources.files import shared_folder

RECENT_DAYS, FAILED_AT, RETRYABLE, ATTEMPTS = 30, 3, ("transient_network", "agent_error", "timeout", "validation_failed"), 3
BACKOFF_HOURS = (2, 4, 8, 24)


def hosted(rows: DataFrame, url: str) -> DataFrame:
    """rows with `host` and `kind`, the domain and its class of a url, each worked out once a row however often they are used."""
    rows = rows.withColumn("host", domain_of(F.col(url)))
    return rows.withColumn("kind", domain_class(F.col("host")))


def registration(places: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Active places with `outcome` of registering their website for crawling; the first reason against it counts."""
    crawled = sources.where("source_type = 'website' and place_id is not null").select("place_id").distinct().withColumn("crawled", F.lit(True))
    partner = sources.where("source_type = 'partner_feed' and place_id is not null").groupBy("place_id").agg(F.max(F.greatest("last_seen", "last_success")).alias("partner_at"))
    kind = F.col("kind")
    recent = F.coalesce(F.col("partner_at") >= F.date_sub(F.lit(as_of).cast("date"), RECENT_DAYS), F.lit(False))
    outcome = (
        F.when(F.coalesce("website", F.lit("")) == "", "no_website").when(kind == "aggregator", "aggregator").when(kind == "umbrella", "umbrella")
        .when(F.col("crawled"), "already_registered").when(recent, "recent_partner").otherwise("registered")
    )
    active = hosted(places.where("status = 'active'"), "website")
    return active.join(crawled, "place_id", "left").join(partner, "place_id", "left").select("place_id", outcome.alias("outcome"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back, so that what is used twice isn't worked out again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_scripts(scripts: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, source_id, how, matches) of scripts: by the hint in their key, else by domain suffix and a part of the name.

    scripts: key, domain, name_part. sources: source_id, hint, host, place_name. The suffix join explodes a
    host into its suffixes (as many as it has dots), so it is an equi-join. Names are compared once for each distinct
    part and name of a domain, and matches are counted from these, so the result's rows are only written. A domain
    that many scripts or sources have is split into tiles.
    """
    by_hint = scripts.select("key", source_hint(F.col("key")).alias("hint"))
    hinted = _kept(by_hint.join(shuffled(sources.groupBy("hint").agg(F.count(F.lit(1)).alias("n"))), "hint"), "hinted")
    rest = _kept(scripts.join(shuffled(hinted.select("key").distinct()), "key", "left_anti").select("key", "domain", "name_part"), "rest")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = sources.where("host is not null").select("source_id", F.lower("place_name").alias("named"), F.explode(suffixes).alias("domain"))
    hosts = hosts.join(shuffled(rest.select("domain").distinct()), "domain", "left_semi")
    parts, names = rest.select("domain", "name_part").distinct(), hosts.groupBy("domain", "named").agg(F.count(F.lit(1)).alias("n"))
    fits = _kept(tiled_join(parts, names, ["domain"], F.col("name_part"), F.col("named")).where(F.contains("named", F.lower("name_part"))), "fits")
    of_part = rest.join(shuffled(fits.groupBy("domain", "name_part").agg(F.sum("n").alias("n"))), ["domain", "name_part"])
    matches = _kept(hinted.select("key", "n").union(of_part.select("key", "n")).groupBy("key").agg(F.sum("n").alias("matches")), "matches")
    counted = lambda df, *by: df.join(shuffled(matches), "key").select("key", "matches", *by)
    met = _kept(fits.select("domain", "name_part", "named").join(shuffled(hosts), ["domain", "named"]).select("domain", "name_part", "source_id"), "met")
    columns = lambda df, how: df.select("key", "source_id", F.lit(how).alias("how"), "matches")
    hits = columns(tiled_join(counted(by_hint, "hint"), sources.select("hint", "source_id"), ["hint"], F.col("key"), F.col("source_id")), "hint")
    hits = hits.union(columns(tiled_join(counted(rest, "domain", "name_part"), met, ["domain", "name_part"], F.col("key"), F.col("source_id")), "domain"))
    # a script that matches nothing stays, without a source
    none = scripts.select("key").distinct().join(shuffled(matches), "key", "left_anti")
    return hits.union(none.select("key", F.lit(None).cast(sources.schema["source_id"].dataType), F.lit(None).cast("string"), F.lit(0).cast("long")))


def missing_scripts(assignments: DataFrame, scripts: DataFrame) -> DataFrame:
    """assignments (source_id, key, status) with `status` missing_script where no script has their key; disabled ones stay so."""
    known = scripts.select("key").distinct().withColumn("known", F.lit(True))
    gone = F.col("known").isNull() & (F.col("status") != "disabled")
    joined = assignments.join(known, "key", "left")
    return joined.select(*[F.when(gone, "missing_script").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in assignments.columns])


def eligible(sources: DataFrame) -> DataFrame:
    """Website sources with `verdict`: whether an extractor may be written for them."""
    retry = F.col("failure_category").isin(*RETRYABLE) & (F.col("attempts") < ATTEMPTS)
    verdict = (
        F.when(~F.col("enabled"), "disabled").when(F.col("assignment") == "active", "has_extractor").when(F.col("task_status") == "deployed", "deployed")
        .when(F.col("task_status") == "skipped_review", "in_review").when((F.col("task_status") == "failed") & ~retry, "failed_for_good").otherwise("eligible")
    )
    return sources.where("source_type = 'website'").withColumn("verdict", verdict)


def source_verdict() -> Column:
    """Verdict on a source by the class `kind` of its url's domain (see hosted)."""
    kind = F.col("kind")
    return F.when(kind == "aggregator", "failed").when(kind == "umbrella", "review").otherwise("ok")


def target_verdict(url: Column, own: Column) -> Column:
    """Why a target url, with its `host` and `kind` (see hosted), isn't allowed for a source whose domain is `own`; ok if it is."""
    host, kind = F.col("host"), F.col("kind")
    return (
        F.when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "bad_scheme").when(host.isNull(), "no_host").when(kind == "aggregator", "aggregator")
        .when(kind == "umbrella", "umbrella").when(kind == "widget", "ok").when((host == own) | host.endswith(F.concat(F.lit("."), own)), "ok").otherwise("off_domain")
    )


def extractor_verdicts(targets: DataFrame, assignments: DataFrame) -> DataFrame:
    """(key, verdict) of extractors by their target urls (key, url) and assignments (key, status).

    The first that fits: aggregator (any target of one), umbrella, no_active_assignment, keep. An extractor without
    targets or without assignments is judged too.
    """
    kind = F.col("kind")
    flags = hosted(targets, "url").groupBy("key").agg(F.max(kind == "aggregator").alias("aggregator"), F.max(kind == "umbrella").alias("umbrella"))
    active = assignments.groupBy("key").agg(F.max(F.col("status") == "active").alias("active"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = F.when(flag("aggregator"), "aggregator").when(flag("umbrella"), "umbrella").when(~flag("active"), "no_active_assignment").otherwise("keep")
    return flags.join(active, "key", "full").select("key", verdict.alias("verdict"))


def listing(sources: DataFrame, places: DataFrame, text: str | None = None) -> DataFrame:
    """Website sources with their place's name and `missing_script` (no assignment); a source without place stays, but for a text search."""
    kept = sources.where("source_type = 'website'")
    if text is not None:
        kept = kept.join(places.where(F.col("name").ilike(f"%{text}%")).select("place_id", "name"), "place_id")
    else:
        kept = kept.join(places.select("place_id", "name"), "place_id", "left")
    return kept.withColumn("missing_script", F.col("assignment").isNull())


def trailing_failures(fetches: DataFrame, key: str = "source_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(key, failures, last_ok, state, wait_hours): failures since the last success, as a fold over the outcomes.

    The last success is one aggregate, the failures after it another; no key's outcomes are gathered.
    """
    at = F.struct(*order)
    last = fetches.groupBy(key).agg(F.max(F.when(F.col("success"), at)).alias("ok"))
    # one row a key on the right; both aggregates combine before their shuffle
    later = fetches.where(~F.col("success")).select(key, at.alias("at")).join(last.where("ok is not null").select(key, F.col("ok").alias("last")), key, "left")
    counts = later.where("last is null or at > last").groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    both = last.join(counts, key, "left")
    failures = F.coalesce("failures", F.lit(0)).cast("long")
    state = F.when(failures >= FAILED_AT, "source_failed").when(failures > 0, "degraded").otherwise("healthy")
    wait = F.when(failures == 0, 24).otherwise(F.least(F.lit(24), F.pow(F.lit(2), F.least(failures, F.lit(4))).cast("int")))
    return both.select(key, failures.alias("failures"), F.col(f"ok.{order[0]}").alias("last_ok"), state.alias("state"), wait.alias("wait_hours"))


def reschedule(failures: Column, success: Column, every_hours: Column) -> Column:
    """Hours to the next run: the source's frequency after a success, else a growing pause."""
    pause = F.element_at(F.array(*[F.lit(h) for h in BACKOFF_HOURS]), F.least(F.greatest(failures, F.lit(1)), F.lit(len(BACKOFF_HOURS))).cast("int"))
    return F.when(success, every_hours).otherwise(pause)


def artifacts(pages: DataFrame) -> DataFrame:
    """(source_id, hash, page_id) of stored bodies: of equal ones of a source the first page."""
    hashed = pages.select("source_id", "page_id", F.sha2("body", 256).alias("hash"))
    return hashed.groupBy("source_id", "hash").agg(F.min("page_id").alias("page_id"))


def convert_source_type(sources: DataFrame, old: str, new: str) -> DataFrame:
    """sources with those of type `old` as `new`; where their place has one of that type already they go."""
    taken = sources.where(F.col("source_type") == new).select("place_id")
    moved = sources.where(F.col("source_type") == old).join(taken, "place_id", "left_anti").withColumn("source_type", F.lit(new))
    return sources.where(F.col("source_type") != old).unionByName(moved.select(*sources.columns))


def unchanged(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Pages (source_id, hash) that need no new extraction: their hash has a successful run. Bodies stay out of the join."""
    done = runs.where("success").select("source_id", "hash").distinct()
    return pages.join(done.withColumn("done", F.lit(True)), ["source_id", "hash"], "left").withColumn("action", F.when(F.col("done"), "skip").otherwise("extract")).drop("done")


def cached(entries: DataFrame, key: str, as_of: Column, ttl_hours: int) -> DataFrame:
    """The latest entry of each key that isn't older than the time to live."""
    fresh = entries.where((F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))) & (F.col("ts") <= as_of))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), "event_id"))
    return fresh.withColumn("n", rank).where("n = 1").drop("n")


def cached_at(lookups: DataFrame, entries: DataFrame, key: str, ttl_hours: int, parts: int = 64) -> DataFrame:
    """lookups (lookup_id, key, at) with (event_id, ts) of the latest entry (key, ts, event_id) at each one's own time.

    An as-of join: an entry counts from its time until it is older than the time to live, the smaller event_id of
    equal times; both are null where there is none. Time is cut into parts of the time to live. Entries and lookups of a key and
    part meet in one ordered window; what earlier parts leave is one row a part, carried on in a second window. So
    a key with very many entries is as many groups as it has parts, and no lookup meets all entries.
    """
    width = ttl_hours * 3600 / parts
    part = lambda c: F.floor(F.unix_micros(c) / (width * 1e6)).cast("long").alias("part")
    entry = F.struct("ts", (-F.col("event_id")).alias("last"))
    stored = entries.select(key, part(F.col("ts")), F.col("ts").alias("time"), F.lit(0).alias("asks"), entry.alias("entry"), F.lit(None).cast("long").alias("lookup_id"))
    asked = lookups.select(key, part(F.col("at")), F.col("at").alias("time"), F.lit(1).alias("asks"), F.lit(None).cast("struct<ts:timestamp,last:bigint>").alias("entry"), F.col("lookup_id").cast("long").alias("lookup_id"))
    both = stored.unionByName(asked)
    within = Window.partitionBy(key, "part").orderBy("time", "asks", "entry").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(key, "part").agg(F.max("entry").alias("entry"), F.max("asks").alias("asks"))
    before = ends.withColumn("carried", F.last("entry", ignorenulls=True).over(earlier)).where("asks = 1").select(key, "part", "carried")
    found = both.withColumn("own", F.last("entry", ignorenulls=True).over(within)).where("asks = 1")
    found = found.join(before, [key, "part"]).withColumn("entry", F.coalesce("own", "carried"))
    fresh = F.col("entry.ts") >= F.col("time") - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    return found.select("lookup_id", key, F.col("time").alias("at"), F.when(fresh, -F.col("entry.last")).alias("event_id"), F.when(fresh, F.col("entry.ts")).alias("ts"))
