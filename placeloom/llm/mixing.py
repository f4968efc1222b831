"""Mixing sources to target weights (native).

Each document gets a hash-random key, documents are sorted by it within their source, running
sums of the word counts are taken, and the source is cut at its exact budget. A budget above the
source's size takes the whole source once and again up to the cut in a second epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import ROW_KEYS, row_keys, running_sums, word_count, written

#: Weights of the sources by code point, again from the start after the last.
WEIGHTS = (3, 1, 2)
#: What the mix holds, as a share of all words.
SHARE = 1.5
#: Epochs at most: a source's target stops at this many times its size.
EPOCHS = 2
#: Rows of a slice, about, and hex digits of the key that name one at least and at most.
SLICE, DIGITS, MOST_DIGITS = 50_000, 3, 6


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Targets of the sources (source, source_size): weight's share of the total, at most epochs x size.

    What sources at their cap leave is shared among the others by weight until none is above. That
    end state is min(cap, level x weight), and the level follows from running sums over the
    sources by cap / weight.
    """
    total = sources.agg(F.sum("source_size").alias("all_words"))
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "sources")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(pattern, (F.col("rank") % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    sums = running_sums(ranked, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "used": F.col("weight")}, "caps")
    wanted = F.lit(share) * total.scalar()
    weight_sum = ranked.agg(F.sum("weight")).scalar()
    sums = sums.withColumn("level", (wanted - F.col("caps")) / (weight_sum - F.col("used")))
    level = sums.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "rank"))).scalar()
    return sums.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, carried: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target and taken. taken is at most epochs x size; the
    document at the cut gives only the words up to it, so a source's sum is its target rounded down.
    Nulls: a null text has size 0, null sources are one source (the last), a null doc_id has a
    key of its text. Repeated rows count each; ties of the key go by doc_id, then size. An empty table gives
    an empty result. The columns `carried` are returned too, and break ties last; others are ignored. A table
    without text gives the number of words as `size`.
    """
    if key is None:
        # rows without doc_id are told apart by their texts, so they don't meet in one slice
        spare = F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")))) if "text" in docs.columns else F.lit("")
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), spare))
    size = F.col("size") if "text" not in docs.columns else word_count(F.col("text"))
    base = written(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *carried), "sizes")
    rows = base.count()
    digits = next((d for d in range(DIGITS, MOST_DIGITS) if rows <= SLICE << 4 * d), MOST_DIGITS)
    base = base.withColumn("slice", F.substring("key", 1, digits))
    slices = base.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = written(slices, "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("shift", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # null sources meet too: the flag and an empty name stand for null
    named = lambda df: df.withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    slices = named(slices).join(named(targets).drop("source"), ["name", "no_source"]).select("name", "no_source", "slice", "shift", "source_size", "target")
    inner = Window.partitionBy("name", "no_source", "slice").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    rows = named(base).withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(slices, ["name", "no_source", "slice"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("shift") - F.col("before")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each epoch that takes one.

    Whole documents only: one that the cut goes through stays whole in that epoch. Those that the mix takes
    nothing of are left out. Every row counts by itself, whether its doc_id is null, repeated or unique;
    the key of a row without doc_id is that of its text, so they don't meet in one slice.
    """
    rows = row_keys(docs)
    light = written(rows.select(*ROW_KEYS, F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), word_count(F.col("doc.text")).alias("size")).where("size > 0"), "keys")
    again = light.groupBy(*ROW_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        # equal rows need numbers of their own, so the whole is written
        rows = written(rows.withColumn("digest", F.monotonically_increasing_id()), "rows")
        light = written(rows.select(*ROW_KEYS, F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), word_count(F.col("doc.text")).alias("size")), "keys")
    options.setdefault("key", F.md5(F.when(~F.col("no_id"), F.col("doc_id").cast("string")).otherwise(F.col("digest").cast("string"))))
    taken = mix(light, carried=tuple(ROW_KEYS), **options).where("taken > 0")
    taken = taken.select(*ROW_KEYS, F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    kept = rows.join(taken, ROW_KEYS).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return kept.select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


SQL = r"""
WITH d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size, md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS used FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - caps) / ((SELECT sum(weight) FROM w) - used) AS lev FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(lev, (ratio, rk)) FROM l WHERE lev <= ratio), cap)) AS target FROM l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target) AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(budget / source_size) ELSE 0 END AS whole FROM b)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + least(greatest(budget - whole * source_size - before, 0), size))::BIGINT AS taken FROM e
"""
