"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the edges (a, b) reach, for each node of an edge.

    Each round every node joins its least neighbour by a hash of its id, and the edges are contracted;
    the hash makes long chains shrink by a share each round, a star vanishes in one. The neighbours of
    a node are only ever reduced by a minimum, which combines before the shuffle, so a node with very
    many of them is no hot task.
    """
    name = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
    links = written(edges.select(name("a").alias("a"), name("b").alias("b")).where("a <> b").distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        least = written(least, "joined")
        steps.append(least)
        to = lambda side: least.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731,B023
        links = links.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = written(links.where("a <> b").distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = written(found.select(F.col("node.id").alias("node"), F.col("root.id").alias("root")), "roots")
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
