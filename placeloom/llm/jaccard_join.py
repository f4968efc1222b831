"""N-gram Jaccard join: signature trees.

Documents become sets of word shingles; equal sets are one class. A pair of sets that reaches the
similarity shares one of the first shingles of both in a common order, so sets that share one there
meet in a block. In a block the sets are the leaves of a signature tree, whose nodes hold the OR of
their leaves' bitmaps and the range of their sizes. The tree is traversed against itself (or another
one); a pair of nodes is dropped when sizes or the largest possible overlap rule out every pair of
leaves. That is done twice: over narrow bitmaps alone, whose pairs connect the sets to clusters, and
over wider ones in a cluster, where what is left is checked on the whole sets. So a whole set is sent
to one cluster, not to each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import HOT, ROW_KEYS, WORD, dropped, join_counted, row_keys, written
from placeloom.llm.components import components
from placeloom.llm.shingles import set_names, shingle_sets
from placeloom.llm.tokenizing import FINE, small_batches

#: Shingles are counted in so many buckets of their hash (bits) to put frequent ones last.
BUCKET_BITS = 16
#: A bucket that holds more than one in so many of all shingles is busy; at most BUSY are.
BUSY = 4096
#: Children of a node, and sets of a block's tile.
FANOUT, TILE = 4, 1024
#: Names that a task remembers so as to send equal sets once, about, at most.
MET = 500_000
#: Bits of a narrow bitmap: NARROW times the least size of its class, a power of two; of a wide one: WIDTH
#: times a set's size, at most MOST_BITS.
NARROW, WIDTH, MOST_BITS = 4, 16, 1 << 15


def bitmaps(flat: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of each set, as 64-bit words; flat has their elements one set after another."""
    at = (flat & np.uint64(bits - 1)).astype(np.int64)
    maps = np.zeros((len(sizes), bits // 8), np.uint8)
    np.bitwise_or.at(maps, (np.repeat(np.arange(len(sizes)), sizes), at >> 3), (1 << (at & 7)).astype(np.uint8))
    return maps.view(np.uint64)


def size_class(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Class k of each size (2^k up to below 2^(k + 1)), and whether it can link with one of class k + 1."""
    k = np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1
    return k, 100 * sizes >= percent * (np.int64(2) << k)


def narrow_bits(k: int) -> int:
    return max(64, NARROW << int(k))


def narrow_bitmaps(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> list[bytes]:
    """A bitmap of each set, of the width of the highest class that it is compared in."""
    sizes = np.diff(bounds)
    k, up = size_class(sizes, percent)
    k = k + up
    owner, out = np.repeat(k, sizes), np.empty(len(sizes), object)
    for c in np.unique(k):
        maps = bitmaps(hashes[owner == c], sizes[k == c], narrow_bits(c))
        out[k == c] = [m.tobytes() for m in maps]
    return list(out)


def folded(marks: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps as 64-bit words, those of twice the width folded to `bits`."""
    size = bits // 8
    rows = [m if len(m) == size else (int.from_bytes(m[:size], "little") | int.from_bytes(m[size:], "little")).to_bytes(size, "little") for m in marks]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


class SignatureTree:
    """Bitmaps and size ranges of sets, and of groups of FANOUT of them up to a root.

    Sets are sorted by size, so that ranges stay narrow. `levels` goes from the leaves to the root; each is
    (bits, least size, greatest size, most collisions): the collisions of a set are its elements less
    its bits.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, leaves: bool = False):
        lost = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1 and not leaves:
            maps, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the node and number of each child below level."""
        below = len(self.levels[level - 1][0])
        kids = nodes[:, None] * FANOUT + np.arange(FANOUT)
        return np.nonzero(kids < below)[0], kids[kids < below]


def possible(left: SignatureTree, right: SignatureTree, level: tuple[int, int], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether leaves below nodes a and b can reach the similarity, by their sizes and bitmaps."""
    (maps_a, low_a, high_a, lost_a), (maps_b, low_b, high_b, lost_b) = left.levels[level[0]], right.levels[level[1]]
    keep = (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a])
    for lo in range(0, len(a), 4096):
        part = np.flatnonzero(keep[lo : lo + 4096]) + lo
        x, y = a[part], b[part]
        overlap = np.bitwise_count(maps_a[x] & maps_b[y]).sum(axis=1, dtype=np.int64) + np.minimum(lost_a[x], lost_b[y])
        keep[part] = overlap * (100 + percent) >= percent * (low_a[x] + low_b[y])
    return keep


def traverse(left: SignatureTree, right: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the dual traversal can't rule out; each pair once if both trees are one."""
    own = left is right
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = possible(left, right, (la, lb), a, b, percent)
        a, b = a[keep], b[keep]
        if la == lb == 0:
            break
        if la >= lb:
            at, kids = left.children(la, a)
            a, b, la = kids, b[at], la - 1
            if own or (lb > la):
                at, kids = right.children(lb, b)
                a, b, lb = a[at], kids, lb - 1
        else:
            at, kids = right.children(lb, b)
            a, b, lb = a[at], kids, lb - 1
        if own:
            once = a <= b
            a, b = a[once], b[once]
    return (a[a != b], b[a != b]) if own else (a, b)


def by_size(sizes: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """Indices of each side, small sets first."""
    order = np.argsort(sizes, kind="stable")
    return [order[side[order] == x] for x in np.unique(side)]


def hopeful(maps: np.ndarray, sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the sets of a block whose similarity the narrow bitmaps can't rule out."""
    groups = by_size(sizes, side)
    trees = [SignatureTree(maps[g], sizes[g]) for g in groups]
    a, b = traverse(trees[0], trees[-1], percent)
    a, b = groups[0][a], groups[-1][b]
    label = np.arange(len(sizes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(label)))
    return label[moved], moved


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where each begins (and the end), of rows sorted by the keys."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        starts = group_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        kept = table.slice(starts[-1]) if len(starts) else table
    if kept is not None and kept.num_rows:
        yield kept, np.array([0, kept.num_rows])


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    values = np.stack([np.asarray(table.column(k)) for k in keys])
    return np.flatnonzero(np.concatenate(([True], (values[:, 1:] != values[:, :-1]).any(axis=0)))) if table.num_rows else np.empty(0, np.int64)


def pairs_within(starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows in the groups of at most `most` rows."""
    first, size = starts[:-1], np.diff(starts)
    small = (size > 1) & (size <= most)
    at = [(first[small & (size > j)] + i, first[small & (size > j)] + j) for i in range(most) for j in range(i + 1, most)]
    return np.concatenate([x for x, _ in at]), np.concatenate([x for _, x in at])


PLACE = ["block", "class", "low", "high"]


def _hopes(percent: int):
    """(a, b) names of pairs to connect, from rows (block, class, low, high, tile, name, n, marks) sorted by PLACE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, PLACE):
            names, sizes, tile, kind = (np.asarray(table.column(c)) for c in ("name", "n", "tile", "class"))
            crossed = np.asarray(table.column("low")) != np.asarray(table.column("high"))
            marks = table.column("marks").to_pylist()
            found = [(names[:0], names[:0])]
            # a group of a node's children: its tree has the leaves and their root alone
            a, b = pairs_within(starts, FANOUT)
            fit = ~crossed[a] | (tile[a] != tile[b])
            a, b = a[fit], b[fit]
            for c in np.unique(kind[a]):
                x, y = a[kind[a] == c], b[kind[a] == c]
                rows, at = np.unique(np.concatenate((x, y)), return_inverse=True)
                tree = SignatureTree(folded([marks[i] for i in rows], narrow_bits(c)), sizes[rows], leaves=True)
                keep = possible(tree, tree, (0, 0), at[: len(x)], at[len(x) :], percent)
                found.append((names[x[keep]], names[y[keep]]))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo > FANOUT and not (crossed[lo] and (tile[lo:hi] == tile[lo]).all()):
                    x, y = hopeful(folded(marks[lo:hi], narrow_bits(kind[lo])), sizes[lo:hi], tile[lo:hi], percent)
                    found.append((names[lo + x], names[lo + y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _links(percent: int):
    """(a, b) doc_ids of links, from rows (block, class, low, high, tile, doc_id, tokens) sorted by PLACE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, PLACE):
            ids, tile = np.asarray(table.column("doc_id")), np.asarray(table.column("tile"))
            mixed_sides = np.asarray(table.column("low")) != np.asarray(table.column("high"))
            found = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo > 1 and not (mixed_sides[lo] and (tile[lo:hi] == tile[lo]).all()):
                    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").slice(lo, hi - lo).to_pylist()]
                    found += [(ids[lo + x], ids[lo + y]) for x, y in block_links(sets, tile[lo:hi], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what is connected among the sets of a block.

    side: all alike, every pair counts; else only pairs of different sides. Pairs that links already
    connect aren't checked; every other pair that the tree can't rule out is.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    groups = by_size(sizes, side)
    bits = min(MOST_BITS, max(64, 1 << int(WIDTH * sizes.max() - 1).bit_length()))
    maps = bitmaps(np.concatenate(sets), sizes, bits)
    trees = [SignatureTree(maps[g], sizes[g]) for g in groups]
    a, b = traverse(trees[0], trees[-1], percent)
    a, b = groups[0][a], groups[-1][b]
    first = np.lexsort((b, a))
    a, b = a[first], b[first]
    label, links = np.arange(len(sets)), []
    while len(a):
        row = a == a[0]
        for x, y in zip(a[row], b[row], strict=True):
            if label[x] != label[y] and similar(sets[x], sets[y], percent):
                links.append((int(x), int(y)))
                label[label == label[y]] = label[x]
        rest = ~row & (label[a] != label[b])
        a, b = a[rest], b[rest]
    return links


def _facts(size: int, percent: int):
    """Rows of documents (doc_id, n, name, twin, marks), then counts of buckets (bucket, count) of the partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("twin", pa.int64()), ("marks", pa.binary()), ("bucket", pa.int32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in small_batches(batches, *FINE):
            hashes, bounds = shingle_sets(batch.column("text"), size)
            counts += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            name, twin = set_names(hashes, bounds)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(name.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(narrow_bitmaps(hashes, bounds, percent), pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], schema=schema)

    return run


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements that a set of n shares at least with any that reaches the similarity."""
    return -(-percent * n // 100)


def _heads(size: int, percent: int, rank: np.ndarray, wanted: np.ndarray):
    """(token, class, name) of the first shingles of each set, rare buckets first; equal sets once a partition.

    Only shingles of wanted buckets are given. Equal sets are sent once as long as a task remembers them.

    A set that can link with one of the next size class is in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in small_batches(batches, *FINE):
            if len(met) > MET:
                met.clear()
            hashes, bounds = shingle_sets(batch.column("text"), size)
            names = set_names(hashes, bounds)[0]
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((hashes, rank[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], owner))
            place = np.arange(len(hashes)) - bounds[owner]
            new = np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if names[i] not in met:
                    met.add(names[i])
                    new[i] = True
            head = (place < (n - least_overlap(n, percent) + 1)[owner]) & new[owner]
            head &= wanted[(hashes[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            tokens, who = hashes[order][head].view(np.int64), owner[head]
            k, up = size_class(n, percent)
            also = up[who]
            columns = np.concatenate((tokens, tokens[also])), np.concatenate((k[who], k[who[also]] + 1)), names.view(np.int64)[np.concatenate((who, who[also]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "name"])

    return run


def _members(size: int):
    """(block..., doc_id, tokens) of each set for each of its places, from (doc_id, name, places, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, *FINE):
            hashes, bounds = shingle_sets(batch.column("text"), size)
            names = set_names(hashes, bounds)[0].view(np.int64)
            good = np.flatnonzero(names == np.asarray(batch.column("name")))
            places = batch.column("places")
            for lo in range(0, len(good), 64):
                rows = [(p, i) for i in good[lo : lo + 64] for p in places[int(i)].as_py()]
                at = pa.array([i for _, i in rows], pa.int64())
                sets = [hashes[bounds[i] : bounds[i + 1]].tobytes() for _, i in rows]
                cols = [pa.array([p[k] for p, _ in rows], pa.int64()) for k in (*PLACE, "tile")]
                yield pa.RecordBatch.from_arrays([*cols, batch.column("doc_id").take(at).cast(pa.int64()), pa.array(sets, pa.binary())], names=[*PLACE, "tile", "doc_id", "tokens"])

    return run


def tiled(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (block, class, name) with their tile, once for each pair (low, high) of tiles of the block that it is in."""
    keys = ["block", "class"]
    counts = blocks.groupBy(keys).agg(F.count(F.lit(1)).alias("rows"))
    large = written(counts.where(F.col("rows") > tile), "tiles")
    # the others are one tile
    if large.count() <= HOT:
        placed = blocks.join(F.broadcast(large), keys, "left")
    else:
        placed = join_counted(blocks, written(counts, "counts"), keys, "rows")
    placed = placed.withColumn("tiles", F.ceil(F.coalesce("rows", F.lit(1)) / tile))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("name"), F.col("tiles")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return placed.select("name", "block", "class", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile")


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of percent or more of their shingle sets.

    docs: doc_id, text. Returns doc_id, n_shingles and component_id, the smallest doc_id that links reach,
    the document's own included. Shingles are of `size` words; A-Z count as a-z. A document with fewer
    words has one shingle of all; null and empty texts, or without words, have none and link with nothing.
    Repeated rows are equal documents; rows without doc_id link with nothing and have a null component_id. An empty
    table gives an empty result. Texts are read whole, other columns ignored. Shingles are compared by 64-bit hashes.

    The sets of a shingle and a size class meet under the smallest name among them; for shingles of busy
    buckets it is found by an aggregate and a join, not in one window. A block or cluster above TILE sets is
    cut into tiles, and each pair of tiles is a group of its own, so that no task holds a whole hot block.
    Links of a group only span what they connect.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    facts = written(texts.mapInArrow(_facts(size, percent), "doc_id long, n long, name long, twin long, marks binary, bucket int, count long"), "facts")
    counts = facts.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count"))
    by_bucket = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, count in counts.collect():  # at most 2^BUCKET_BITS rows
        by_bucket[bucket] = count
    rank = np.empty(len(by_bucket), np.int32)
    rank[np.argsort(by_bucket, kind="stable")] = np.arange(len(by_bucket))

    marks = facts.where("n > 0").select("name", "n", "marks")
    facts = facts.where("doc_id is not null").select("doc_id", "n", "name", "twin")
    classes = written(facts.where("n > 0").groupBy("name", "twin", "n").agg(F.min("doc_id").alias("first")), "classes")
    busy = by_bucket * BUSY > by_bucket.sum()
    # two passes over the texts: those of quiet buckets go straight to a window, the few others are written
    heads = lambda wanted: texts.select("text").mapInArrow(_heads(size, percent, rank, wanted), "token long, class long, name long")
    keys = ["token", "class"]
    by_token = Window.partitionBy(*keys)
    quiet = heads(~busy).withColumns({"block": F.min("name").over(by_token), "last": F.max("name").over(by_token)})
    # shingles that very many sets may have don't meet in a window
    loud = written(heads(busy), "heads")
    shared = loud.groupBy(*keys).agg(F.min("name").alias("block"), F.max("name").alias("last"), F.count(F.lit(1)).alias("rows"))
    met = join_counted(loud, written(shared, "busy"), keys, "rows")
    blocks = quiet.select("block", "last", "class", "name").unionByName(met.select("block", "last", "class", "name"))
    blocks = written(blocks.where("block <> last").select("block", "class", "name").distinct(), "blocks")

    marked = tiled(blocks).join(marks.dropDuplicates(["name", "n"]), "name").repartition(*PLACE).sortWithinPartitions(*PLACE, "name")
    hopes = marked.select(*PLACE, "tile", "name", "n", "marks").mapInArrow(_hopes(percent), "a long, b long")
    clusters = components(hopes).select(F.col("component").alias("block"), F.lit(0).cast("long").alias("class"), F.col("node").alias("name"))
    places = tiled(written(clusters, "clusters")).groupBy("name").agg(F.collect_list(F.struct(*PLACE, "tile")).alias("places"))
    wanted = classes.join(places, "name").select(F.col("first").alias("doc_id"), "name", "places")
    members = texts.join(wanted, "doc_id").mapInArrow(_members(size), "block long, class long, low long, high long, tile long, doc_id long, tokens binary")
    members = members.repartition(*PLACE).sortWithinPartitions(*PLACE, "doc_id")
    edges = members.mapInArrow(_links(percent), "a long, b long")
    found = components(edges)
    dropped(loud, blocks)
    joined = classes.join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    joined = joined.select("name", "twin", F.col("n").alias("of"), F.coalesce("component", "first").alias("component"))
    same = (facts.name == joined.name) & (facts.twin == joined.twin) & (facts.n == joined.of)
    out = facts.join(joined, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    loose = docs.select("doc_id", "text").where("doc_id is null").mapInArrow(_facts(size, percent), "doc_id long, n long, name long, twin long, marks binary, bucket int, count long")
    none = F.lit(None).cast("long")
    return out.unionByName(loose.where("bucket is null").select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest doc_id, null ids last, then the smallest hash of its text.

    Every row takes part by itself, so rows without doc_id and different texts under one doc_id are told
    apart by their texts alone (by 64-bit hashes); of equal rows with different other columns the one with the
    least hash of them stays. Texts without words are copies of nothing; of such rows only those with
    equal doc_id (not null) and text count as one.
    """
    rows = row_keys(docs)
    facts = written(rows.select(*ROW_KEYS, (~F.coalesce(F.col("doc.text").rlike(WORD), F.lit(False))).alias("wordless")), "keys")
    # equal texts are one node, so nothing but the texts is read again
    found = similar_components(docs.select(F.xxhash64("text").alias("doc_id"), "text"), size, percent)
    found = found.groupBy(F.col("doc_id").alias("digest")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    ranked = join_counted(facts.where("not wordless"), written(found, "found"), ["digest"], "n")
    first = ranked.groupBy("component").agg(F.min(F.struct(*ROW_KEYS)).alias("first")).select("first.*")
    first = first.unionByName(facts.where("wordless and not no_id").select(*ROW_KEYS).distinct())
    # of equal rows one stays: the rare texts that have some are gathered, those without doc_id too
    counts = facts.groupBy(*ROW_KEYS).agg(F.count(F.lit(1)).alias("n"))
    kept = written(counts.join(first, ROW_KEYS), "kept")
    single = join_counted(rows, kept.where("n = 1"), ROW_KEYS, "n").select("doc.*")
    several = join_counted(rows, kept.where("n > 1"), ROW_KEYS, "n")
    spelled = F.xxhash64(F.to_json("doc"))
    several = several.groupBy(*ROW_KEYS).agg(F.min_by("doc", spelled).alias("doc")).select("doc.*")
    loose = docs.where(F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return single.unionByName(several).unionByName(loose)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, hash(sh_one) AS h FROM (SELECT doc_id, sh, unnest(sh) AS sh_one FROM s)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, root) AS (SELECT x, x FROM (SELECT DISTINCT x FROM e) UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
"""
