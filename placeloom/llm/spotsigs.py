"""Document fingerprints: SpotSigs (native).

A spot signature is a common word (the anchor) with the chain of content words that follow it. The
set of a text's signatures is its fingerprint: boilerplate and edits touch few of them. Sets are
partitioned by their length, and a pair is compared only if the lengths let its Jaccard similarity
reach the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import in_order, join_counted, written

# Frequent function words of the four languages of the corpus.
ANCHORS = (
    "the a an of and to in is it that this for on with as by at from was are be or "
    "le la les un une des de du et en est que pour dans sur par au aux "
    "der die das ein eine und ist zu den dem von mit sich des auf "
    "el los las uno una y es que por con para su al del no se lo"
).split()
#: Content words of a chain.
CHAIN = 3
#: Sets that meet under a signature in one group, at most.
TILE = 1024


def with_signatures(df: DataFrame, text: str, name: str, anchors: tuple[str, ...] | list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds column `name`: the sorted distinct 64-bit hashes of the spot signatures of column `text`.

    Words are lower-case runs of letters, digits and characters beyond ASCII. Each anchor and the next `chain`
    words that are none make one signature; near the end a chain may be shorter, but has a word. A text
    without a signature has two hashes of the whole text in their place, so that different texts keep different
    fingerprints; null is an empty text.
    """
    text_or_empty = F.coalesce(F.col(text), F.lit(""))
    words, content, spots = (F.col(f"{name}_{x}") for x in ("words", "content", "spots"))
    # columns of their own: an expression in a lambda would be worked out for every word
    df = df.withColumn(f"{name}_words", F.filter(F.split(F.lower(text_or_empty), r"[^a-z0-9\x{80}-\x{10ffff}]+"), lambda w: w != ""))
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*anchors), i)), lambda i: i.isNotNull())
    df = df.withColumns({f"{name}_content": F.filter(words, lambda w: ~w.isin(*anchors)), f"{name}_spots": places})

    def spot(place: Column, i: Column) -> Column:
        # i anchors stand before this one, so its chain begins after place - i content words
        return F.when(place - i < F.size(content), F.xxhash64(F.get(words, place), *[F.get(content, place - i + k) for k in range(chain)]))

    df = df.withColumn(name, F.filter(F.transform(spots, spot), lambda s: s.isNotNull()))
    whole = F.array(*[F.xxhash64(F.lit(f"whole {k}"), text_or_empty) for k in range(2)])
    df = df.withColumn(name, F.sort_array(F.array_distinct(F.when(F.size(name) > 0, F.col(name)).otherwise(whole))))
    return df.drop(*[f"{name}_{x}" for x in ("words", "content", "spots")])


def fingerprint(sigs: Column) -> Column:
    """The set as one string: its length, then a digest of its sorted signatures."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.md5(F.array_join(F.transform(sigs, lambda s: s.cast("string")), ",")))


def length_partition(size: Column, least: float) -> Column:
    """Number of a set's length partition: sets that can reach `least` lie in the same one or the next."""
    return F.floor(F.ln(size.cast("double")) / math.log(1 / least) + 1e-9).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    of = lambda shared: shared / (F.size(a) + F.size(b) - shared).cast("double")
    # the one-element array has the intersection worked out once
    return F.transform(F.array(F.size(F.array_intersect(a, b))), of)[0]


def pruned_likeness(a: Column, b: Column, least: float) -> Column:
    """Jaccard similarity of two signature sets where it reaches `least`, else 0; sets whose lengths rule that out aren't compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = length_partition(large, least) - length_partition(small, least) > 1
    kept = F.transform(F.array(likeness(a, b)), lambda x: F.when(x < least, 0.0).otherwise(x))[0]
    return F.when(apart | (small < large * least), 0.0).otherwise(kept)


def rare_first(sets: DataFrame, key: str) -> DataFrame:
    """(key, sigs) of sets, each one's signatures in one order of all: those that few sets have first."""
    held = written(sets.select(key, F.explode("sigs").alias("sig")), "held")
    counts = written(held.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "counts")
    ranked = join_counted(held, counts, ["sig"], "n")
    ordered = F.array_sort(F.collect_list(F.struct("n", "sig")))
    return ranked.groupBy(key).agg(ordered.alias("ranked")).select(key, F.col("ranked.sig").alias("sigs"))


def near_pairs(docs: DataFrame, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """Pairs of different signature sets with Jaccard similarity of `least` or more.

    Returns left, right (fingerprints, left < right) and similarity, for the classes of documents with
    equal fingerprints; join them to `doc_id, fingerprint` for the members. A pair meets only under a
    signature that is among the first of both sets, rare ones first (as many as the threshold lets differ,
    and one), within the same or the next length partition. A signature under which more than `tile` sets
    meet is cut into tiles, and each pair of tiles is a group of its own. An empty table gives no pairs.
    """
    sets = with_signatures(docs.select("text"), "text", "sigs").select("sigs").withColumn("fingerprint", fingerprint(F.col("sigs"))).dropDuplicates(["fingerprint"])
    sets = written(sets.withColumn("part", length_partition(F.size("sigs"), least)), "spots")
    sizes = sets.select("fingerprint", "part", F.size("sigs").alias("size"))
    first = F.size("sigs") - F.ceil(F.size("sigs") * F.lit(least) - 1e-9).cast("int") + 1
    heads = rare_first(sets, "fingerprint").select("fingerprint", F.explode(F.slice("sigs", F.lit(1), first)).alias("sig")).join(sizes, "fingerprint")
    heads = written(heads, "heads")
    # a set of a partition also meets those of the next one
    met = heads.select("sig", "fingerprint", "size", (F.col("part")).alias("own"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = written(met, "met")
    groups = written(met.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    placed = join_counted(met, groups, ["sig", "part"], "n")
    tiles = F.ceil(F.col("n") / tile)
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("fingerprint"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    placed = placed.select("sig", "part", "own", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fingerprint", "size")
    left, right = (placed.select("sig", "part", "low", "high", *[F.col(c).alias(f"{side}_{c}") for c in ("own", "tile", "fingerprint", "size")]) for side in ("left", "right"))
    both = left.join(right, ["sig", "part", "low", "high"]).where("left_fingerprint < right_fingerprint")
    both = both.where((F.least("left_size", "right_size") >= F.greatest("left_size", "right_size") * least))
    # two sets of the partition before meet there, not here; two of one tile meet in its own group
    both = both.where("left_own = part or right_own = part").where("low = high or left_tile <> right_tile")
    pairs = both.select(F.col("left_fingerprint").alias("left"), F.col("right_fingerprint").alias("right")).distinct()
    named = lambda side: sets.select(F.col("fingerprint").alias(side), F.col("sigs").alias(f"{side}_sigs"))
    both = pairs.join(named("left"), "left").join(named("right"), "right")
    return both.select("left", "right", pruned_likeness(F.col("left_sigs"), F.col("right_sigs"), least).alias("similarity")).where(F.col("similarity") >= least)


def following(ids: DataFrame, order: list[str]) -> DataFrame:
    """ids (key, ...) with `after`, the key of the row before it in the order, that of the last row for the first, and `twin`.

    The ids are dealt into ordered slices; only the ends of the slices meet in one window. twin tells whether
    the row before has the same order[0] or this row has none.
    """
    dealt = in_order(ids, [F.col(c) for c in order], "ids")
    inner = Window.partitionBy("slice").orderBy(*order)
    twin = F.col(order[0]).isNull() | F.coalesce(F.col(order[0]) == F.lag(order[0]).over(inner), F.lit(False))
    rows = dealt.withColumns({"after": F.lag("key").over(inner), "twin": twin})
    ends = dealt.groupBy("slice").agg(F.max_by("key", F.struct(*order)).alias("greatest"))
    across = ends.withColumn("before", F.coalesce(F.lag("greatest").over(Window.orderBy("slice")), F.max_by("greatest", "slice").over(Window.partitionBy(F.lit(0)))))
    rows = rows.join(across.select("slice", "before"), "slice")
    return rows.select(*ids.columns, "twin", F.coalesce("after", "before").alias("after"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text, and the next document by descending doc_id.

    The edited text has the last half (rounded down) of its code points replaced by the first as many,
    or all, of the next document. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, n_signatures, near_edited and near_next. A null text counts as empty; a single
    document is its own next. Every row is a document of its own: those without doc_id come last, those
    with one doc_id in the descending order of a hash of their text. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    length = F.char_length("text").alias("n")
    keyed = rows.select(F.col("doc_id").alias("key"), "text")
    links = written(following(keyed.select("key", F.col("key").alias("doc_id"), length), ["key"]), "links")
    if links.agg(F.max("twin")).first()[0]:
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
        keyed = rows.select("key", "text")
        links = written(following(rows.select("doc_id", F.xxhash64("text").alias("digest"), "key", length), ["doc_id", "digest", "key"]), "links")
    # the next document gives the head of its text and its set to the one before it; both joins have the
    # texts by key, and nothing else, so that Spark shuffles them once
    links = links.select(F.col("key").alias("of"), "doc_id", "n", "after")
    heads = with_signatures(keyed.join(links, keyed.key == links.after), "text", "next_sigs")
    heads = heads.select("of", "doc_id", F.expr("substring(text, 1, int(n div 2))").alias("head"), "next_sigs")
    both = keyed.join(heads, keyed.key == heads["of"]).drop("of", "key").withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.col("head")))
    both = with_signatures(with_signatures(both, "text", "sigs"), "edited", "edited_sigs").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        F.size("sigs").alias("n_signatures"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
