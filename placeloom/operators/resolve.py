"""Entity resolution: blocking, pair scores, decisions and what follows from them.

Pairs come from keyed joins only (postcode; country and city; grid cells), never from one join with an
OR. Fuzzy ratios are worked out once for each distinct pair of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions import geo
from placeloom.functions.geo import within
from placeloom.functions.similarity import best_ratios
from placeloom.functions.text import compact_postcode, domain_of, is_parent_name, normalise_city, normalise_name, normalise_postcode
from placeloom.operators.skew import shuffled, tiled_join
from placeloom.sources.files import kept, shared_folder

NEAR_METRES, IDENTITY_METRES = 500, 25
# Ratios of names, terms of a score, thresholds of a decision.
STRONG, LIKELY = 92, 85
SAME_POSTCODE, STRONG_NAME, LIKELY_NAME, STRONG_ALIAS, SAME_DOMAIN, SAME_CITY = 0.35, 0.30, 0.15, 0.20, 0.25, 0.10
AUTO_LINK, PARENT_PENALTY, LEAST_SCORE, OVERRIDE_GAP = 0.75, 0.20, 0.25, 0.25
# Metres, score with and without identity allowed.
BANDS = ((25, 0.75, 0.25), (50, 0.45, 0.20), (100, 0.35, 0.20), (150, 0.25, 0.15), (500, 0.15, 0.10))


def keyed(df: DataFrame) -> DataFrame:
    """df with the keys that blocking and scoring compare; as it is if it has them."""
    if {"post", "compact", "town", "plain", "domain"} <= set(df.columns):
        return df
    return df.withColumns({"post": normalise_postcode(F.col("postcode")), "compact": compact_postcode(F.col("postcode")), "town": normalise_city(F.col("city")), "plain": normalise_name(F.col("name")), "domain": domain_of(F.col("website"))})


def same(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


#: What pairs and scores look at of a record (r_...) and a place (p_...); a plan takes along what it needs of it.
_IDS, _KEYS = ("record_id", "place_id"), ("compact", "town", "lat", "lon")


def record_side(records: DataFrame) -> DataFrame:
    """record_id, country, and r_ columns: all that pairs and scores need of a record alone, so that no pair works it out again."""
    loose = F.col("precision").isin("approximate", "unknown") | (F.col("confidence") == "low") | F.col("class").isin("defunct", "uncertain", "multi_faith", "other")
    more = {"plain": F.col("plain"), "domain": F.col("domain"), "mark": name_mark(F.col("plain")), "parent": is_parent_name(F.col("name"))}
    more |= {"loose": F.coalesce(loose, F.lit(False))} if "precision" in records.columns else {}
    return keyed(records).select("record_id", "country", *[F.col(k).alias(f"r_{k}") for k in _KEYS], *[c.alias(f"r_{k}") for k, c in more.items()])


def place_side(places: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """place_id, country, and p_ columns; with aliases also p_others (their normalised forms, a line each) and p_alias_mark, a mark that bounds all of them."""
    more = {"plain": F.col("plain"), "domain": F.col("domain"), "mark": name_mark(F.col("plain")), "parent": is_parent_name(F.col("name"))}
    found = keyed(places).select("place_id", "country", *[F.col(k).alias(f"p_{k}") for k in _KEYS], *[c.alias(f"p_{k}") for k, c in more.items()])
    return found if aliases is None else found.join(shuffled(alias_side(aliases)), "place_id", "left")


def alias_side(aliases: DataFrame) -> DataFrame:
    """(place_id, p_others, p_alias_mark) of the places with aliases."""
    named = aliases.select("place_id", normalise_name(F.col("alias")).alias("alias")).where("alias is not null").distinct().withColumn("mark", name_mark(F.col("alias")))
    # a letter that any alias has, the shortest, the most that has no letter: no alias reaches more
    bound = F.struct(F.bit_or("mark.bits").alias("bits"), F.min("mark.size").alias("size"), F.max("mark.rest").alias("rest"))
    return named.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "\n").alias("p_others"), bound.alias("p_alias_mark"))


def written_sides(records: DataFrame, places: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides worked out and written once, in as many tasks as a shuffle has whatever the files are."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(record_side(records.repartition(parts)), "records"), kept(place_side(places.repartition(parts), aliases), "places")


def _by_key(rec: DataFrame, pla: DataFrame, key: str) -> DataFrame:
    """Pairs of one country with the key."""
    left, right = rec.withColumn(key, F.col(f"r_{key}")), pla.withColumn(key, F.col(f"p_{key}"))
    return tiled_join(left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull()), ["country", key], F.col("record_id"), F.col("place_id"))


def _near(rec: DataFrame, pla: DataFrame) -> DataFrame:
    """Pairs of one country within 500 m, with metres."""
    left, right = rec.withColumns({"lat": F.col("r_lat"), "lon": F.col("r_lon")}), pla.withColumns({"lat": F.col("p_lat"), "lon": F.col("p_lon")})
    more = lambda df: tuple(c for c in df.columns if c[:2] in ("r_", "p_"))
    return within(left, right, *_IDS, NEAR_METRES, more(rec), more(pla), ("country",), wide=True)


#: Degrees of latitude that no pair within 500 m differs by.
FAR = NEAR_METRES / geo.DEGREE * 1.01


def _compared(joined: DataFrame, metres: Column, **known: bool) -> DataFrame:
    """Pairs as scores see them: what both sides tell together; `known` is what the join makes sure.

    The metres are marked as of this place in the plan alone: else Spark would put their formula wherever they are used,
    and work it out a dozen times a pair.
    """
    facts = {"same_post": same("r_compact", "p_compact"), "no_post": F.col("r_compact").isNull() | F.col("p_compact").isNull(), "same_town": same("r_town", "p_town"), "no_town": F.col("r_town").isNull() | F.col("p_town").isNull(), "same_domain": same("r_domain", "p_domain"), "parent": F.col("r_parent") | F.col("p_parent")}
    facts |= {k: F.lit(v) for k, v in known.items()}
    beside = [c for c in ("r_loose", "r_plain", "r_mark", "p_plain", "p_mark", "p_others", "p_alias_mark") if c in joined.columns]
    return joined.select(*_IDS, *[c.alias(k) for k, c in facts.items()], *beside, F.when(F.spark_partition_id() >= 0, metres).alias("metres"))


def _metres(whole: bool) -> Column:
    """The distance of a pair; unless it is to be whole, only that of pairs that may lie within 500 m, else null."""
    found = geo.metres_between(F.col("r_lat"), F.col("r_lon"), F.col("p_lat"), F.col("p_lon"))
    return found if whole else F.when(F.abs(F.col("p_lat") - F.col("r_lat")) <= FAR, found)


def _pairs(rec: DataFrame, pla: DataFrame, whole: bool) -> DataFrame:
    """Each pair comes of the first of the three joins that makes it, so none is there twice."""
    by_town = _by_key(rec, pla, "town").where(~same("r_compact", "p_compact"))
    near = _near(rec, pla).where(~same("r_compact", "p_compact") & ~same("r_town", "p_town"))
    return (
        _compared(_by_key(rec, pla, "compact"), _metres(whole), same_post=True, no_post=False)
        .union(_compared(by_town, _metres(whole), same_post=False, same_town=True, no_town=False))
        .union(_compared(near, F.col("metres"), same_post=False, same_town=False))
    )


def block(records: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (record_id, place_id) of one country that share the postcode or the city, or lie within 500 m."""
    return _pairs(record_side(records), place_side(places), True).select(*_IDS)


def block_facts(records: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs of `block` as `pair_facts` gives them, without a join of the pairs with either side again."""
    return _pairs(record_side(records), place_side(places), True)


def pairs_to_score(records: DataFrame, places: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The plausible ones of `block_facts`, with metres only up to 500 or a little more, beyond which no score asks for them."""
    return _pairs(*written_sides(records, places, aliases), False).where(plausible())


def near_facts(records: DataFrame, places: DataFrame) -> DataFrame:
    """Those of `block_facts` that lie within 500 m."""
    return _compared(_near(record_side(records), place_side(places)), F.col("metres"))


#: Letters of a name that its mark tells apart, with a first and a second occurrence; 52 bits of a long.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def name_mark(plain: Column) -> Column:
    """(bits, size, rest) of a name: a bit for each first and second occurrence of a letter, and what has none."""
    every = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    without = lambda i: F.char_length(F.replace(plain, F.substring(F.lit(LETTERS), i, F.lit(1)), F.lit("")))
    seen = F.transform(every, lambda i: F.least(F.char_length(plain) - without(i), F.lit(2)))
    # none, one or two of a letter are the bits 0, 1 and 11 at its place
    values = F.array(*[F.lit(v).cast("long") for v in (0, 1, 3)])
    place = F.array(*[F.lit(1 << 2 * i).cast("long") for i in range(len(LETTERS))])
    bits = F.aggregate(F.zip_with(seen, place, lambda n, p: F.get(values, n) * p), F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.aggregate(seen, F.lit(0), lambda a, n: a + n)
    return F.struct(bits.alias("bits"), F.char_length(plain).alias("size"), (F.char_length(plain) - some).alias("rest"))


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """Whether names with these marks can have the ratio: no common subsequence is longer than the letters they share."""
    most = F.bit_count(a["bits"].bitwiseAND(b["bits"])) + F.least(a["rest"], b["rest"])
    return 200 * most >= ratio * (a["size"] + b["size"]) - 1e-6


def promising(records: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """The pairs of `block` that are plausible and can score 0.25 or more; no other pair is left out."""
    return promising_facts(record_side(records), place_side(places, aliases)).select(*_IDS)


def promising_facts(rec: DataFrame, pla: DataFrame) -> DataFrame:
    """The pairs of `promising` as `pair_facts` gives them, of both sides.

    A pair that shares the city alone needs a missing postcode to be plausible, and an equal domain, a likely name
    or a strong alias to score; bounds of the ratios rule most of them out inside the join. The records of a
    city are dealt into parts, so that a large one is no hot task.
    """
    fits = same("r_domain", "p_domain") | _name_fits() | _alias_fits()
    by_town = _by_key(rec, pla, "town").where((F.col("r_compact").isNull() | F.col("p_compact").isNull()) & fits)
    by_town = _compared(by_town, _metres(False), same_post=False, no_post=True, same_town=True, no_town=False).where(~F.coalesce(F.col("metres") <= NEAR_METRES, F.lit(False)))
    near = _near(rec, pla).where(~same("r_compact", "p_compact"))
    by_post = _compared(_by_key(rec, pla, "compact"), _metres(False), same_post=True, no_post=False)
    return by_post.union(_compared(near, F.col("metres"), same_post=False)).union(by_town)


def pair_facts(pairs: DataFrame, records: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs with what both sides tell together, and their distance."""
    rec, pla = record_side(records).drop("country"), place_side(places).drop("country")
    return _compared(pairs.join(shuffled(rec), "record_id").join(shuffled(pla), "place_id"), _metres(True))


def plausible() -> Column:
    """Whether a pair is worth a score: equal postcodes, or nearness, or a postcode that lacks with no two cities that differ."""
    near = F.coalesce(F.col("metres") <= NEAR_METRES, F.lit(False))
    return F.col("same_post") | near | (F.col("no_post") & (F.col("no_town") | F.col("same_town")))


def _near_points() -> Column:
    """Hundredths that the distance gives; identity isn't allowed for vague places and records."""
    found = F.lit(0)
    for metres, strict, weak in reversed(BANDS):
        found = F.when(F.col("metres") <= metres, F.when(F.col("r_loose"), _hundredths(weak)).otherwise(_hundredths(strict))).otherwise(found)
    return found


def _hundredths(x: float) -> int:
    return round(100 * x)


def geo_score() -> Column:
    """Score of the distance."""
    return _near_points() / F.lit(100.0)


#: Below this ratio a name changes no score, no reason and no decision: the least that rounds to LIKELY.
ROUNDS_TO_LIKELY = LIKELY - 0.5


def _name_fits() -> Column:
    return may_reach(F.col("r_mark"), F.col("p_mark"), ROUNDS_TO_LIKELY)


def _alias_fits() -> Column:
    return F.coalesce(may_reach(F.col("r_mark"), F.col("p_alias_mark"), ROUNDS_TO_LIKELY), F.lit(False))


def with_ratios(pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """pair facts with `ratio` of the names and `alias_ratio`, the best of the place's aliases, where they matter.

    Names are compared where the pairs are made, so no pair is shuffled for it; the vectorised ratio remembers pairs of
    names. Only names whose lengths and letters allow a ratio that rounds to LIKELY go through it: a lower one changes
    no score, no reason and no decision, and is null. aliases: for pairs that don't hold those of their places.
    """
    if aliases is not None:
        pairs = pairs.join(shuffled(alias_side(aliases)), "place_id", "left")
    name, other = F.when(_name_fits(), F.col("p_plain")), F.when(_alias_fits(), F.col("p_others"))
    asked = pairs.withColumns({"asked": F.when(_name_fits() | _alias_fits(), F.col("r_plain")), "name": name, "others": other})
    asked = asked.drop("r_plain", "p_plain", "r_mark", "p_mark", "p_others", "p_alias_mark")
    found = best_ratios(F.col("asked"), F.col("name"), F.col("others"))
    return asked.withColumn("found", found).withColumns({"ratio": F.col("found.one"), "alias_ratio": F.col("found.best")}).drop("asked", "name", "others", "found")


def scored(facts: DataFrame) -> DataFrame:
    """(record_id, place_id, score, said, strong, identity, best_ratio) of pairs with ratios, scores from 0.25 up; said: the reasons as text.

    Terms are hundredths, added as whole numbers, so ties and sums are the same everywhere. A ratio counts as strong by
    its rounded value.
    """
    ratio, alias = F.coalesce("ratio", F.lit(0.0)), F.coalesce("alias_ratio", F.lit(0.0))
    rounded = lambda c: F.rint(c).cast("int")
    best, near = F.greatest(ratio, alias), _near_points()
    parent = F.col("parent") & (best < LIKELY)
    points = lambda c, x: F.when(c, _hundredths(x)).otherwise(0)
    total = points(F.col("same_post"), SAME_POSTCODE) + F.when(ratio >= STRONG, _hundredths(STRONG_NAME)).when(ratio >= LIKELY, _hundredths(LIKELY_NAME)).otherwise(0)
    total = total + points(alias >= STRONG, STRONG_ALIAS) + points(F.col("same_domain"), SAME_DOMAIN) + points(F.col("same_town"), SAME_CITY) + near - points(parent, PARENT_PENALTY)
    said = F.concat_ws(
        ",", F.when(F.col("same_post"), "postcode_match"), F.when(ratio >= LIKELY, F.concat(F.lit("name_ratio_"), rounded(ratio).cast("string"))), F.when(alias >= STRONG, F.concat(F.lit("alias_ratio_"), rounded(alias).cast("string"))),
        F.when(F.col("same_domain"), "domain_match"), F.when(F.col("same_town"), "city_match"), F.when(near > 0, F.concat(F.lit("distance_"), F.floor("metres").cast("string"))), F.when(parent, "parent_org_name"),
    )
    flag = lambda c: c.cast("int")
    strong = flag(F.col("same_post")) + flag(rounded(ratio) >= STRONG) + flag(rounded(alias) >= STRONG) + flag(F.col("same_domain")) + flag(near > 0)
    identity = (rounded(ratio) >= STRONG) | (rounded(alias) >= STRONG) | F.col("same_domain") | F.coalesce((near > 0) & (F.col("metres") <= IDENTITY_METRES), F.lit(False))
    kept_pairs = facts.where(total >= _hundredths(LEAST_SCORE))
    return kept_pairs.select(*_IDS, (F.least(total, F.lit(100)) / F.lit(100.0)).alias("score"), said.alias("said"), strong.alias("strong"), identity.alias("identity"), rounded(best).alias("best_ratio"))


def score(facts: DataFrame) -> DataFrame:
    """The rows of `scored` with the reasons as an array."""
    return scored(facts).withColumn("reasons", F.when(F.col("said") != "", F.split("said", ",")).otherwise(F.array().cast("array<string>"))).drop("said")


def decide(records: DataFrame, scored: DataFrame, alternatives: bool = True) -> DataFrame:
    """One decision a record: auto_link, review or create, with the place, score and, where asked for, three alternatives.

    Candidates are ranked by score, then place_id. A first one without a likely name gives way to the best
    one with it, if that is at most 0.25 lower. Candidates of a record that differ in the place alone are counted before
    they are shuffled, the smallest place_id stands for them: ranks and the second score need no more.
    """
    rank = Window.partitionBy("record_id").orderBy(F.desc("score"), "place_id")
    every = Window.partitionBy("record_id")
    kinds = scored.groupBy("record_id", "score", "strong", "identity", (F.col("best_ratio") >= LIKELY).alias("named")).agg(F.min("place_id").alias("place_id"), F.count(F.lit(1)).alias("n"))
    named = F.col("named")
    rows = kinds.withColumn("rank", F.row_number().over(rank))
    rows = rows.withColumn("top_score", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(every)).withColumn("top_named", F.max(F.when(F.col("rank") == 1, named)).over(every))
    rows = rows.withColumn("first_named", F.min(F.when(named, F.col("rank"))).over(every))
    rows = rows.withColumn("promoted_gap", F.max(F.when(F.col("rank") == F.col("first_named"), F.col("top_score") - F.col("score"))).over(every))
    chosen = F.when(~F.col("top_named") & (F.col("promoted_gap") <= OVERRIDE_GAP + 1e-9), F.col("first_named")).otherwise(1)
    rows = rows.withColumn("chosen", F.col("rank") == F.coalesce(chosen, F.lit(1)))
    by = rows.groupBy("record_id").agg(
        F.max(F.when(F.col("chosen"), F.struct("place_id", "score", "strong", "identity"))).alias("best"),
        F.max(F.when(~F.col("chosen") | (F.col("n") > 1), F.col("score"))).alias("second"),
    )
    unclear = (F.coalesce("second", F.lit(0.0)) >= 0.5) & (F.col("best.score") - F.col("second") < 0.1 - 1e-9)
    link = (F.col("best.score") >= AUTO_LINK) & (F.col("best.strong") >= 2) & F.col("best.identity")
    decision = F.when(F.col("best").isNull(), "create").when(F.coalesce(unclear, F.lit(False)), "review").when(link, "auto_link").otherwise("review")
    found = records.select("record_id").join(shuffled(by), "record_id", "left").select("record_id", decision.alias("decision"), F.when(decision != "create", F.col("best.place_id")).alias("place_id"), F.col("best.score").alias("score"))
    if not alternatives:
        return found
    first = scored.select("record_id", "place_id", "score").withColumn("rank", F.row_number().over(rank)).where("rank <= 3")
    first = first.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place_id"))), lambda x: x["place_id"]).alias("first"))
    ids = F.slice(F.array_distinct(F.concat(F.array("place_id"), F.col("first"))), 1, 3)
    return found.join(shuffled(first), "record_id", "left").withColumn("alternatives", F.when(F.col("decision") == "review", ids)).drop("first")


def resolve(records: DataFrame, places: DataFrame, aliases: DataFrame, alternatives: bool = True) -> DataFrame:
    """Decisions for a batch of records against the places there are. What pairs need of both sides is worked out and written once."""
    facts = promising_facts(*written_sides(records, places, aliases)).where(plausible())
    return decide(records, scored(with_ratios(facts)), alternatives)


def resolve_batch(records: DataFrame, places: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcomes for a whole bundle: existing links first, then decisions, new places by a hash of the source key."""
    known = sources.where("place_id is not null").select("source_type", "external_id", F.col("place_id").alias("linked"))
    joined = records.join(shuffled(known), ["source_type", "external_id"], "left")
    fresh = joined.where("linked is null").drop("linked")
    decided = fresh.select("record_id", "source_type", "external_id").join(shuffled(resolve(fresh, places, aliases, False)), "record_id")
    new_id = F.when(F.col("decision") == "create", F.substring(F.sha2(F.concat_ws("|", "source_type", "external_id"), 256), 1, 16))
    done = joined.where("linked is not null").select("record_id", F.lit("existing_link").alias("outcome"), F.col("linked").alias("place_id"), F.lit(None).cast("string").alias("new_place"))
    return done.unionByName(decided.select("record_id", F.col("decision").alias("outcome"), "place_id", new_id.alias("new_place")))


#: Fields of a place that records may fill.
FIELDS = ("name", "postcode", "city", "country", "website")


def survive(places: DataFrame, linked: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """places with fields taken from their public records (place_id, public, created, fields, lat, lon).

    Of several records of a place the one with the smallest record_id counts. A place that it created takes
    every field that the record has; others take it only where theirs is empty. A location comes whole.
    """
    new = linked.where("public").groupBy("place_id").agg(F.min_by(F.struct("created", *fields, "lat", "lon"), "record_id").alias("n"))
    created = F.coalesce(F.col("n.created"), F.lit(False))

    def keep(k: str) -> Column:
        own, other = F.nullif(F.trim(k), F.lit("")), F.nullif(F.trim(f"n.{k}"), F.lit(""))
        return F.when((created | own.isNull()) & other.isNotNull(), F.col(f"n.{k}")).otherwise(F.col(k)).alias(k)

    whole = F.col("n.lat").isNotNull() & F.col("n.lon").isNotNull() & (created | F.col("lat").isNull())
    located = [F.when(whole, F.col(f"n.{k}")).otherwise(F.col(k)).alias(k) for k in ("lat", "lon")]
    return places.join(new, "place_id", "left").select("place_id", *[keep(k) for k in fields], *located)


def newer_names(places: DataFrame, linked: DataFrame) -> DataFrame:
    """(place_id, name, renamed): a place takes the name of its latest dated public record, if that differs and is newest."""
    # record_id breaks ties, and the second date is that of the other records
    order = Window.partitionBy("place_id").orderBy(F.desc_nulls_last("record_date"), "record_id")
    ranked = linked.withColumn("n", F.row_number().over(order)).withColumn("others", F.lead("record_date").over(order))
    top = ranked.where((F.col("n") == 1) & F.col("public") & F.col("record_date").isNotNull() & (F.col("others").isNull() | (F.col("record_date") > F.col("others"))))
    joined = places.select("place_id", F.col("name").alias("old")).join(top.select("place_id", F.col("name").alias("new")), "place_id", "left")
    differs = F.coalesce(normalise_name(F.col("new")) != normalise_name(F.col("old")), F.lit(False))
    return joined.select("place_id", F.when(differs, F.col("new")).otherwise(F.col("old")).alias("name"), differs.alias("renamed"))


def upsert_sources(existing: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Full outer join on (source_type, external_id): scalar fields replaced, metadata maps merged (new keys win), last_seen stamped."""
    old = existing.select("source_type", "external_id", F.struct("source_id", "url", "last_seen", "metadata").alias("o"))
    new = incoming.select("source_type", "external_id", F.struct("url", "metadata").alias("n"))
    empty = F.create_map().cast("map<string,string>")
    merged = lambda a, b: F.map_concat(F.map_filter(F.coalesce(a, empty), lambda k, v: ~F.map_contains_key(F.coalesce(b, empty), k)), F.coalesce(b, empty))
    both = old.join(new, ["source_type", "external_id"], "full")
    return both.select("source_type", "external_id", F.col("o.source_id").alias("source_id"), F.coalesce("n.url", "o.url").alias("url"), F.when(F.col("n").isNotNull(), F.lit(as_of).cast("date")).otherwise(F.col("o.last_seen")).alias("last_seen"), merged(F.col("o.metadata"), F.col("n.metadata")).alias("metadata"))


def new_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (place_id, alias) whose normalised form the place lacks, once each."""
    plain = lambda df: df.withColumn("plain", normalise_name(F.col("alias")))
    missing = plain(wanted).join(plain(aliases).select("place_id", "plain"), ["place_id", "plain"], "left_anti")
    return missing.groupBy("place_id", "plain").agg(F.min("alias").alias("alias"))


def settle_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending reviews of a source after a new decision (source_id, decision, place_id): accepted on auto_link, else refreshed."""
    joined = reviews.join(decisions.withColumnRenamed("place_id", "decided"), "source_id", "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & (F.col("decision") == "auto_link"), "accepted").otherwise(F.col("status"))
    proposed = F.when(pending & F.col("decision").isNotNull(), F.col("decided")).otherwise(F.col("proposed_id"))
    return joined.select("review_id", status.alias("status"), proposed.alias("proposed_id"))


def review_candidates() -> Column:
    """Distinct candidates of a review: the proposed place, then the alternatives."""
    return F.array_distinct(F.filter(F.array("proposed_id", "alternative_1", "alternative_2"), lambda x: x.isNotNull()))


def review_queue(reviews: DataFrame, status: str, reason: str | None = None, source_type: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Reviews of a status with their candidates, of one reason token and one type of source where asked for."""
    found = reviews.where(F.col("status") == status)
    if reason is not None:
        found = found.where(F.array_contains(F.split("reasons", ","), reason))
    if source_type is not None:
        found = found.join(sources.where(F.col("source_type") == source_type).select("source_id"), "source_id", "left_semi")
    return found.withColumn("candidates", review_candidates())


def bulk_accept(reviews: DataFrame, least: float, limit: int) -> DataFrame:
    """Pending reviews from a score up: the first `limit` in the queue's order, and of these those with one candidate."""
    queue = reviews.where((F.col("status") == "pending") & (F.col("score") >= least)).orderBy(F.desc("score"), "created_on", "review_id").limit(limit)
    return queue.withColumn("candidates", review_candidates()).where(F.size("candidates") == 1)


def bulk_activate(places: DataFrame, sources: DataFrame, reviews: DataFrame, limit: int) -> DataFrame:
    """needs_review places with a source, the first `limit` by name, without pending review and with a public source."""
    having = places.where("status = 'needs_review'").join(sources.select("place_id"), "place_id", "left_semi")
    first = having.orderBy("name", "place_id").limit(limit)
    open_ = reviews.where("status = 'pending'").select(F.col("proposed_id").alias("place_id"))
    public = sources.where("policy = 'public_redistribution_allowed'").select("place_id")
    return first.join(open_, "place_id", "left_anti").join(public, "place_id", "left_semi")


def final_targets(merges: DataFrame, rounds: int = 32) -> DataFrame:
    """merges (duplicate_id, canonical_id) with chains followed to their end; at most 2^rounds long, a circle has no end.

    Pointer jumping: each round lets every merge take its target's target and writes the result, so a round reads
    the last one's table alone and a chain of n takes log2(n) rounds.
    """
    spark = merges.sparkSession
    found = merges.where("duplicate_id <> canonical_id").select("duplicate_id", "canonical_id")
    for _ in range(rounds):
        after = found.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("next"))
        path = shared_folder(spark, "merges")
        found.join(after, "canonical_id", "left").select("duplicate_id", F.coalesce("next", "canonical_id").alias("canonical_id"), F.col("next").isNotNull().alias("moved")).write.parquet(path)
        table = spark.read.parquet(path)
        found = table.drop("moved")
        if table.where("moved").isEmpty():
            return found
    raise ValueError("the merges go in a circle")


def merge_places(merges: DataFrame, places: DataFrame, aliases: DataFrame, keyed_tables: dict[str, tuple[DataFrame, list[str]]], adopted: tuple[str, ...] = ("postcode", "city", "website")) -> dict[str, DataFrame]:
    """Tables after merging (duplicate_id, canonical_id), by name; places and aliases beside the given ones.

    keyed_tables: name to (table, its columns that name places): sources, candidates, occurrences, claims,
    corrections, reviews. Duplicates get that status, their names become aliases of the canonical place (once
    each, by normalised form), and a canonical place without an `adopted` attribute or a location takes that
    of its smallest duplicate that has one.
    """
    merges = final_targets(merges)

    def rekeyed(df: DataFrame, column: str) -> DataFrame:
        to = merges.select(F.col("duplicate_id").alias(column), F.col("canonical_id").alias("merged into"))
        moved = df.join(to, column, "left").withColumn(column, F.coalesce("merged into", column))
        return moved.select(*df.columns)

    out = {}
    for name, (df, columns) in keyed_tables.items():
        for c in columns:
            df = rekeyed(df, c)
        out[name] = df
    dead = places.join(merges, places.place_id == merges.duplicate_id)
    names = dead.select(F.col("canonical_id").alias("place_id"), F.col("name").alias("alias"))
    kept = rekeyed(aliases.select("place_id", "alias"), "place_id").union(names).withColumn("plain", normalise_name(F.col("alias")))
    out["aliases"] = kept.groupBy("place_id", "plain").agg(F.min("alias").alias("alias")).drop("plain")
    first = lambda c: F.min_by(F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.col(c)), F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.col("duplicate_id"))).alias(f"other {c}")
    at = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    best = dead.groupBy("canonical_id").agg(*[first(c) for c in adopted], F.min_by(at, F.when(at.isNotNull(), F.col("duplicate_id"))).alias("other at"))
    gone = merges.select(F.col("duplicate_id").alias("place_id"), F.lit(True).alias("gone"))
    joined = places.join(gone, "place_id", "left").join(best.withColumnRenamed("canonical_id", "place_id"), "place_id", "left")
    lost = F.col("lat").isNull() | F.col("lon").isNull()
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"other {c}")) for c in adopted}
    filled |= {c: F.when(lost & F.col("other at").isNotNull(), F.col("other at")[c]).otherwise(F.col(c)) for c in ("lat", "lon")}
    filled["status"] = F.when(F.col("gone"), "duplicate").otherwise(F.col("status"))
    out["places"] = joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in places.columns])
    return out


def backfill_websites(sources: DataFrame, places: DataFrame) -> DataFrame:
    """Sources with `outcome` of taking their homepage as the website of a place that has none."""
    joined = sources.join(places.select("place_id", "website"), "place_id", "left")
    outcome = F.when(F.coalesce("homepage", F.lit("")) == "", "no_website").when(F.col("place_id").isNull(), "no_place").when(F.coalesce("website", F.lit("")) != "", "already_set").otherwise("updated")
    return joined.withColumn("outcome", outcome)
