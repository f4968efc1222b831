"""Domain lists as a table: which lists the hosts of a frame are on, by an equi-join on the suffixes of each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.text import AGGREGATORS, DENIED_FRAGMENTS, DIRECTORY_HOSTS, UMBRELLAS, WIDGETS

#: How a row of the table fits: the host itself, the host and its subdomains, or any host that holds the text.
KINDS = ("exact", "suffix", "substring")
#: Texts of the kind substring, at most: they are tested against each distinct host, so they must stay few.
SUBSTRINGS = 1_000
#: Hosts on a list up to which they are broadcast to the rows.
HOSTS = 100_000

SCHEMA = "domain string, kind string, list string"


def domain_table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(domain, kind, list) of the built-in lists directory, register, aggregator, umbrella and widget, and of `extra` rows."""
    lists = {("directory", "exact"): DIRECTORY_HOSTS, ("register", "substring"): DENIED_FRAGMENTS, ("aggregator", "suffix"): AGGREGATORS, ("umbrella", "suffix"): UMBRELLAS, ("widget", "suffix"): WIDGETS}
    known = spark.createDataFrame([(d, kind, name) for (name, kind), domains in lists.items() for d in domains], SCHEMA)
    if extra is None:
        return known
    return known.unionByName(extra.select(F.lower(F.trim("domain")).alias("domain"), "kind", "list")).where("domain <> ''").distinct()


def suffixes(host: Column) -> Column:
    """(domain, whole) of a host: itself, and what is left without its first label, and so on."""
    labels = F.split(F.trim(F.lower(host), F.lit(".")), r"\.")
    at = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(at(i).alias("domain"), (i == 1).alias("whole")))


def host_lists(hosts: DataFrame, table: DataFrame) -> DataFrame:
    """(host, lists): the sorted lists of every distinct host of hosts (host) that is on one.

    Exact and suffix rows meet the exploded suffixes of each distinct host in an equi-join, however long the
    lists are; the few substring rows are tested host by host.
    """
    distinct = hosts.select("host").where("host <> ''").distinct()
    parts = distinct.select("host", F.inline(suffixes(F.col("host"))))
    joined = parts.join(table.where("kind in ('exact', 'suffix')"), "domain").where("kind = 'suffix' or whole").select("host", "list")
    texts = table.where("kind = 'substring'").limit(SUBSTRINGS + 1).collect()
    if len(texts) > SUBSTRINGS:
        raise ValueError(f"more than {SUBSTRINGS} substring rows")
    if texts:
        array = F.array(*[F.struct(F.lit(t.domain).alias("domain"), F.lit(t.list).alias("list")) for t in texts])
        held = F.filter(array, lambda t: F.contains(F.lower("host"), t["domain"]))
        joined = joined.union(distinct.select("host", F.explode(F.transform(held, lambda t: t["list"])).alias("list")))
    return joined.groupBy("host").agg(F.sort_array(F.collect_set("list")).alias("lists"))


def with_lists(df: DataFrame, host: Column, table: DataFrame) -> DataFrame:
    """df with `lists`, those that a host is on; empty for none and for a null host.

    The hosts on a list are broadcast up to HOSTS of them, so that a host that very many rows have is no hot key.
    """
    df = df.withColumn("host of lists", host)
    found = host_lists(df.select(F.col("host of lists").alias("host")), table).withColumnRenamed("host", "host of lists")
    if found.limit(HOSTS + 1).count() <= HOSTS:
        found = F.broadcast(found)
    return df.join(found, "host of lists", "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<string>"))).drop("host of lists")
