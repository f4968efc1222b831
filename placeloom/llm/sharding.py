"""Sharding: minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are ordered by the hash of their text, and
the smallest capacity for which a greedy walk over the ordered group sizes needs at most n shards
is found by binary search; the shards are cut where that walk cuts them.

The walk never sees all groups: the driver holds sums of 4096 ranges of the hash, and only the
ranges in which a cut can fall are looked into, split again by the next bits where they hold too
many groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import numbered, written

SHARDS = 8
#: Hex digits by which a range of the hash is split: 4096 parts.
STEP = 3
#: Groups that the driver looks at in one go, at most; above it ranges are split again.
LOOKED_AT = 100_000


def greedy_cuts(sizes: list[int], capacity: int) -> list[int] | None:
    """First indices of the shards of a greedy walk; None if a size is above the capacity.

    >>> greedy_cuts([3, 4, 2, 5], 7)
    [0, 2]
    """
    cuts, room = [], -1
    for i, x in enumerate(sizes):
        if x > capacity:
            return None
        if room < x:
            cuts.append(i)
            room = capacity
        room -= x
    return cuts


class OrderedSums:
    """Sizes of groups in the order of their keys, summed where no cut can fall.

    An item is [key prefix, size, number of groups, largest group]. An item of one group is atomic.
    """

    def __init__(self, items: list[list]):
        self.items = sorted(items)
        self.ends, total = [], 0
        for x in self.items:
            total += x[1]
            self.ends.append(total)
        self.total = total

    def walk(self, capacity: int, shards: int, whole: bool) -> list[int] | None:
        """Items at which the walk cuts, None if it needs more shards.

        whole: an item stays together (a cut before it), so success is sure for the groups too. Else an
        item may be cut anywhere, so failure is sure for the groups too.
        """
        at, cuts = 0, []
        for _ in range(shards):
            if at >= self.total:
                return cuts
            i = bisect_right(self.ends, at + capacity)
            if i == len(self.ends):
                return cuts
            cuts.append(i)
            to = self.ends[i - 1] if i and (whole or self.items[i][2] == 1) else at + capacity
            if to <= at:
                return None
            at = to
        return cuts if at >= self.total else None

    def reach(self, capacity: int, shards: int, whole: bool) -> list[int]:
        """Like walk, but without failing: bounds of where cuts fall (whole: from below, else from above)."""
        at, cuts = 0, []
        for _ in range(shards):
            i = bisect_right(self.ends, at + capacity)
            if i == len(self.ends):
                return cuts + [i - 1] * (shards - len(cuts))
            cuts.append(i)
            at = max(at, self.ends[i - 1] if i else 0) if whole else at + capacity
        return cuts

    def least(self, shards: int, whole: bool) -> int:
        """Smallest capacity at which the walk succeeds."""
        low, high = max([0, *(x[3] for x in self.items)]) - 1, self.total
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, whole) is not None else (mid, high)
        return high


def shard_bounds(groups: DataFrame, shards: int = SHARDS, looked_at: int = LOOKED_AT) -> tuple[list[str], int]:
    """First group keys of shards 1, 2, ..., and the smallest capacity, of groups (key, size)."""
    def summed(where, digits: int) -> list[list]:
        part = groups.where(where) if where is not None else groups
        part = part.groupBy(F.substring("key", 1, digits).alias("part"))
        return [list(r) for r in part.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect()]

    sums = OrderedSums(summed(None, STEP))
    while True:
        low, high = sums.least(shards, whole=False), sums.least(shards, whole=True)
        # for every capacity between the two, cut k falls between these items
        spans = list(zip(sums.reach(low, shards, whole=True), sums.reach(high, shards, whole=False), strict=True))
        open_items = [x for i, x in enumerate(sums.items) if x[2] > 1 and any(a <= i <= b for a, b in spans)]
        if not open_items:
            cuts = sums.walk(high, shards, whole=True)
            return [sums.items[i][0] for i in cuts], high
        names = [x[0] for x in open_items]
        digits = len(names[0])
        where = F.substring("key", 1, digits).isin(names)
        shut = [x for x in sums.items if x[0] not in set(names)]
        if sum(x[2] for x in open_items) <= looked_at or digits + STEP > 32:
            found = [[r[0], r[1], 1, r[1]] for r in groups.where(where).select("key", "size").collect()]
        else:
            found = summed(where, digits + STEP)
        sums = OrderedSums(shut + found)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every document, sizes in bytes near equal and equal texts together.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard. A null text counts as an empty
    one (size 1, crc 0). Repeated rows each get a slot, and so do rows without doc_id. A group above a fair share gets a shard as large as
    itself, for it stays whole. Fewer groups than shards leave shards empty; an empty table gives an
    empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("key"))
    rows = written(rows, "sized")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    bounds, _ = shard_bounds(groups, shards)
    number = sum([(F.col("key") >= b).cast("int") for b in bounds], F.lit(0))
    rows = rows.withColumn("shard", number)
    out = numbered(rows, ["shard"], F.struct("doc_id", "key"), [F.col("key"), F.col("doc_id")], "slot", rows.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
