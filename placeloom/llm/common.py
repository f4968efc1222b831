"""Helpers shared by the corpus operators: written tables, ordered slices and words.

Every helper is a plain DataFrame composition. Nothing that grows with the rows passes the
driver; what does (a histogram, a few cut points) is bounded by a parameter.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local session that has none (tests, a laptop) gets a temporary folder; a cluster without one
    is an error, for no machine sees what another writes to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/placeloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor never makes an earlier stage run again, and what a
    later stage reads twice is the same both times.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again."""
    for table in tables:
        store, path = fs.FileSystem.from_uri(table.written_to)
        store.delete_dir(path)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs (with doc_id, text) with the columns no_id, id_or_none and digest before its own, packed in `doc`.

    They tell rows apart by doc_id and text (by its 64-bit hash), and none is null, so they can be joined on.
    """
    missing = F.col("doc_id").isNull()
    return docs.select(
        missing.alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id_or_none"),
        F.xxhash64("text").alias("digest"), F.struct(*docs.columns).alias("doc"),
    )


ROW_KEYS = ["no_id", "id_or_none", "digest"]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(c: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt into ordered slices: column `slice` rises with the order, ties stay together.

    It is written, since the bounds of a range partitioning come from a sample and may differ
    when they are worked out again.
    """
    dealt = df.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    return written(dealt, name)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds for each (name, value) the sum of value over all rows before this one in the order.

    Distributed: sums of each slice, then their offsets (one row a slice), then a window inside
    each slice. `order` must be total for a deterministic result.
    """
    for k, v in sums.items():
        df = df.withColumn(f"{k}_in", v)
    dealt = in_order(df, order, name)
    whole = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("slice").agg(*[F.sum(f"{k}_in").alias(f"{k}_sum") for k in sums])
    offsets = offsets.select("slice", *[F.coalesce(F.sum(f"{k}_sum").over(whole), F.lit(0)).alias(f"{k}_off") for k in sums])
    inner = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"{k}_before": F.coalesce(F.sum(f"{k}_in").over(inner), F.lit(0)) for k in sums}).join(offsets, "slice")
    out = out.withColumns({k: F.col(f"{k}_before") + F.col(f"{k}_off") for k in sums})
    return out.drop("slice", *[f"{k}_{x}" for k in sums for x in ("in", "off", "before")])


def slices_for(rows: int, least: int = 256, most_rows: int = 50_000) -> int:
    """How many slices keep a slice of `rows` rows in all at about most_rows or below.

    >>> slices_for(1000), slices_for(10**9)
    (256, 20000)
    """
    return max(least, -(-rows // most_rows))


def numbered(df: DataFrame, group: list[str], spread: Column, order: list[Column], number: str, rows: int = 0) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps; no group meets in one task.

    A group is spread over slices by a hash of `spread`, as many as `rows` (about how many df has) asks for;
    the rows of a slice are numbered in a window and shifted by the counts of the slices before it. The
    table of counts has at most groups x slices rows.
    """
    slices = slices_for(rows)
    df = df.withColumn("spread", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*group).orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, "spread").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*group, "spread", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inner = Window.partitionBy(*group, "spread").orderBy(*order)
    out = df.withColumn(number, F.row_number().over(inner).cast("long") - 1)
    out = out.join(offsets, [*group, "spread"])
    return out.withColumn(number, F.col(number) + F.col("shift")).drop("spread", "shift")


#: A key with one in so many of all rows, or more, counts as hot; so there are at most HOT hot keys.
HOT = 50_000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of rows with facts (one row a key; column `count` tells how many of rows have it).

    Keys that hold one in HOT of all rows or more, of which there are at most HOT, are broadcast, so that
    no hot key meets in one task; the others are shuffled. Both inputs are read twice and should be written.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT >= total
    hot, cold = facts.where(is_hot), facts.where(~is_hot)
    beside = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(beside)
