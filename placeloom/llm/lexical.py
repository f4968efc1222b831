"""Ranked lexical search of many items at once, with shared sums worked out once.

Each block of items is compiled into a graph of sums. Terms that the same items hold, each as often, are one
node (mined with a grouping by term), so their accumulator in a document is added up once for all those
items. Pairs of nodes that several items share become nodes of their own, level by level, until no
pair is shared; an item's score is the sum over the few nodes that are left of it. Documents are read
as postings (their terms that any item of the block holds, and how often), in tasks that keep the best of each item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.alnum import BETWEEN, Index, words_of
from placeloom.llm.common import ascii_lower, join_counted, written
from placeloom.llm.shingles import span_hashes
from placeloom.llm.tokenizing import small_batches

#: Documents returned for an item, and the share of its length that a document's weight depends on, in percent.
BEST, LENGTH = 10, 75
#: Distinct texts of items in a block, about, and characters of them: they bound what the driver compiles at a time.
ITEMS, CHARS = 256, 4_000_000
#: Nodes of an item that are paired with each other; longer lists are paired in runs of so many.
RUN = 256
#: Levels of shared pairs above the terms' nodes.
LEVELS = 12
#: Sums that a task holds at a time.
CELLS = 4_000_000


@dataclass
class Graph:
    """Sums of a block: nodes 0 to leaves - 1 are sets of terms, the others sums of two earlier ones, level by level.

    leaf[t] and times[t] give the nodes of term t and the factor of its sum there (several nodes if items hold it
    with other terms); top[bounds[i] : bounds[i + 1]] are the nodes whose sum is item i's score.
    """

    leaves: int
    term: np.ndarray
    leaf: np.ndarray
    times: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    top: np.ndarray
    bounds: np.ndarray

    @property
    def nodes(self) -> int:
        return self.leaves + sum(len(a) for a, _ in self.levels)


def shared_pairs(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that two lists or more share, the most shared first, no node in two of them."""
    keys = []
    for nodes in lists:
        for at in range(0, len(nodes), RUN):
            part = np.sort(nodes[at : at + RUN])
            a, b = np.triu_indices(len(part), 1)
            keys.append((part[a].astype(np.int64) << 32) | part[b])
    keys, counts = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
    keys, counts = keys[counts > 1], counts[counts > 1]
    used, left, right = set(), [], []
    for key in keys[np.lexsort((keys, -counts))].tolist():
        a, b = key >> 32, key & 0xFFFFFFFF
        if a not in used and b not in used:
            used |= {a, b}
            left.append(a)
            right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def compiled(terms: list[list[tuple[int, int]]], items: int) -> Graph:
    """The graph of terms[t] = [(item, how often it holds t), ...], mined for shared sets of terms."""
    leaves: dict[tuple, int] = {}
    term, leaf, times, lists = [], [], [], [[] for _ in range(items)]
    for t, held in enumerate(terms):
        # one node for each number of times a term is held, shared by all terms of the same items
        for n in sorted({n for _, n in held}):
            name = tuple(sorted(i for i, m in held if m == n))
            if name not in leaves:
                leaves[name] = len(leaves)
                for i in name:
                    lists[i].append(leaves[name])
            term.append(t)
            leaf.append(leaves[name])
            times.append(n)
    lists = [np.array(x, np.int64) for x in lists]
    levels, nodes = [], len(leaves)
    for _ in range(LEVELS):
        left, right = shared_pairs(lists)
        if not len(left):
            break
        partner, sums = np.full(nodes, -1), np.full(nodes, -1)
        partner[left], partner[right] = right, left
        sums[left], sums[right] = (nodes + np.arange(len(left)),) * 2
        for i, own in enumerate(lists):
            both = np.isin(partner[own], own) & (partner[own] >= 0)
            lists[i] = np.unique(np.where(both, sums[own], own))
        levels.append((left, right))
        nodes += len(left)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return Graph(len(leaves), np.array(term, np.int64), np.array(leaf, np.int64), np.array(times, np.int64), levels, np.concatenate(lists) if lists else np.empty(0, np.int64), bounds)


class BlockScores:
    """Scores of documents for the items of a block, from the documents' postings."""

    def __init__(self, graph: Graph, weight: np.ndarray, documents: int, terms: int):
        self.graph, self.weight, self.documents, self.terms = graph, weight, documents, terms
        self.first = np.searchsorted(graph.term, np.arange(len(weight) + 1))
        self.step = max(1, CELLS // max(1, graph.nodes + len(graph.top)))

    def added(self, n: np.ndarray, tf: np.ndarray, term: np.ndarray) -> np.ndarray:
        """What a term that occurs tf times adds to the score of a document of n terms: 64-bit integers."""
        m = 100 - LENGTH + (LENGTH * n * self.documents) // self.terms
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Items x documents: the score of every document (postings by row, n terms each)."""
        g, docs = self.graph, len(n)
        part = self.added(n[row], tf, term)
        copies = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        cell = g.leaf[at] * docs + np.repeat(row, copies)
        # whole numbers far below 2^53: doubles are exact
        sums = np.zeros((g.nodes, docs), np.int64)
        sums[: g.leaves] = np.bincount(cell, np.repeat(part, copies) * g.times[at], g.leaves * docs).reshape(g.leaves, docs)
        made = g.leaves
        for left, right in g.levels:
            sums[made : made + len(left)] = sums[left] + sums[right]
            made += len(left)
        out = np.zeros((len(g.bounds) - 1, docs), np.int64)
        some = np.flatnonzero(np.diff(g.bounds))
        if len(some):
            out[some] = np.add.reduceat(sums[g.top], g.bounds[some])
        return out


def kept_best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, has_id: np.ndarray, best: int) -> np.ndarray:
    """Which entries are among the best of their item: score down, rows with doc_id first, doc_id up."""
    order = np.lexsort((doc, ~has_id, -score, item))
    sorted_item = item[order]
    start = np.searchsorted(sorted_item, sorted_item)
    return order[np.arange(len(order)) - start < best]


def postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """doc_id, n (terms in all), and the numbers and occurrences of the known terms (by hash) of every document."""
    index = Index(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = words_of(batch.column("text"))
            known = index.find(words.hashes())
            has = known >= 0
            key, tf = np.unique(words.row[has] * (len(hashes) + 1) + known[has], return_counts=True)
            ends = np.searchsorted(key, np.arange(1, words.texts + 1) * (len(hashes) + 1))
            bounds = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % (len(hashes) + 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words.counts()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def best_of_block(table: DataFrame, scores: BlockScores, best: int) -> DataFrame:
    """item (its number in the block), doc_id and score of the best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(scores.graph.bounds) - 1
        limit = np.zeros(items, np.int64)
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        for whole in batches:
            for at in range(0, whole.num_rows, scores.step):
                batch = whole.slice(at, scores.step)
                terms = batch.column("terms")
                lengths = np.diff(np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1])
                flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                found = scores.scores(np.repeat(np.arange(len(lengths)), lengths), flat("terms"), flat("tfs"), batch.column("n").to_numpy())
                # a document below an item's worst held one can't enter
                item, doc = np.nonzero((found > 0) & (found >= limit[:, None]))
                ids = batch.column("doc_id")
                has_id = ~ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                joined = [np.concatenate(x) for x in zip(held, (item, found[item, doc], ids[doc], has_id[doc]), strict=True)]
                stay = kept_best(*joined, best)
                held = [x[stay] for x in joined]
                full = np.bincount(held[0], minlength=items) >= best
                worst = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(worst, held[0], held[1])
                limit = np.where(full, worst, 0)
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[2], mask=~held[3]), pa.array(held[1])], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents (doc_id, text) of each item (item_id, text).

    Null and empty texts, or texts without terms, are found by no item and find none. Texts are read whole. Repeated
    items are answered each, whatever their item_id; equal texts are searched once. Repeated documents are ranked
    each. Equal scores go by doc_id; rows without doc_id take part and come last among equals. Empty tables give
    an empty result. Other columns are ignored.

    The distinct texts of the items are dealt into blocks by hash, of about block_items texts; the documents are read
    for each block, as a search in blocks does.
    """
    split = lambda c: F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), BETWEEN), lambda w: w != "")
    asked = items.select("item_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("query"), "text")
    queries = written(asked.groupBy("query").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count(F.lit(1)).alias("n")), "queries")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size.n // block_items), -(-(size.chars or 0) // CHARS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = None
    for k in range(blocks):
        # the terms of the block's items, and which items hold each how often
        own = queries.where(block == k).select("query", F.explode(split(F.col("text"))).alias("term"))
        held = own.groupBy("term", "query").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("query", "n"))).alias("held"))
        terms = held.orderBy("term").collect()
        if not terms:
            continue
        names = sorted({x.query for t in terms for x in t.held})
        number = {q: i for i, q in enumerate(names)}
        graph = compiled([[(number[x.query], x.n) for x in t.held] for t in terms], len(names))
        encoded = [t.term.encode() for t in terms]
        ends = np.cumsum([len(w) for w in encoded], dtype=np.int64)
        hashes = span_hashes(np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64), ends - [len(w) for w in encoded], ends)
        table = written(postings(docs, hashes), "postings")
        sums = table.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        if not sums.terms:
            break
        seen = np.zeros(len(terms), np.int64)
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            seen[r.term] = r.df
        weight = np.floor(1000 * np.log((2.0 * sums.documents + 2) / (2.0 * seen + 1))).astype(np.int64)
        hits = best_of_block(table, BlockScores(graph, weight, sums.documents, sums.terms), best)
        query = F.get(F.array(*[F.lit(q) for q in names]), F.col("item"))
        hits = written(hits.select(query.alias("query"), "doc_id", "score"), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    answers = ranked.groupBy("query").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("answers"))
    answers = written(answers.join(queries.select("query", "n"), "query"), "answers")
    out = join_counted(written(asked.select("item_id", "query"), "asked"), answers, ["query"], "n")
    return out.select("item_id", F.explode("answers").alias("answer")).select("item_id", "answer.*")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
k AS (SELECT item_id, i, term, count(*) AS times FROM q GROUP BY ALL),
n AS (SELECT r, doc_id, count(*)::BIGINT AS n FROM d GROUP BY ALL),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM k) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, docs),
s AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS part FROM p JOIN n USING (r) JOIN w USING (term), a),
t AS (SELECT item_id, i, r, sum(times * part)::BIGINT AS score FROM k JOIN s USING (term) GROUP BY ALL HAVING sum(times * part) > 0),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t JOIN n USING (r))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
