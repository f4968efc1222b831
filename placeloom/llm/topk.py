"""Exact top-k search: columnar branch-and-bound.

Vectors are turned into integers and gathered into tiles that hold them dimension by dimension. A
block of queries goes through the tiles, a block of dimensions at a time: partial sums are
accumulated, the mass that is left of query and candidate bounds what the other dimensions can add,
and pairs that stay below the query's k-th best so far are dropped by compaction. That k-th best rises
from tile to tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import shared_path, written

#: Vectors of a tile and queries of a block; both bound the memory of a task.
TILE, BLOCK = 4096, 512
#: Dimensions that are accumulated between two bounds.
STEP = 8
#: Pairs are compacted once less than this share of them is alive, as so many queries tell: for more, whole
#: blocks of dimensions of all pairs are summed faster.
DENSE, TELLING = 0.25, 16
#: Scores are exact in float64 below this.
EXACT = 2**53
_LONG = np.iinfo(np.int64)


def merged(k: int, scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists, by (score, smaller id)."""
    scores, ids = np.concatenate((scores, more_scores)), np.concatenate((ids, more_ids))
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


class Search:
    """The k best candidates so far of each query of a block.

    rows, queries: row numbers and vectors (query x dimension, float64 of integer values). `pairs` counts pairs
    times dimensions, `summed` those that were accumulated.
    """

    def __init__(self, rows: np.ndarray, queries: np.ndarray, k: int, step: int = STEP):
        self.rows, self.queries, self.k, self.step = rows, queries, k, step
        self.scores, self.ids = [np.empty(0)] * len(rows), [np.empty(0, np.int64)] * len(rows)
        self.limit = np.full(len(rows), -np.inf)
        self.pairs = self.summed = 0

    def tile(self, rows: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """Takes in a tile: row numbers, ids, and columns (dimension x candidate)."""
        if np.isinf(self.limit).any() and len(rows) > 8 * self.k:
            # a small part first, whose k-th best bounds the rest
            head = np.arange(len(rows)) < 8 * self.k
            self.tile(rows[head], ids[head], columns[:, head])
            self.tile(rows[~head], ids[~head], columns[:, ~head])
            return
        dims, n = columns.shape
        # the dimensions with the most mass come first
        order = np.argsort(-(self.queries**2).sum(axis=0) * (columns**2).sum(axis=1), kind="stable")
        columns, queries = columns[order], self.queries[:, order]
        cuts = [*range(0, dims, self.step), dims] if dims else [0]
        left = lambda x, axis: np.sqrt(np.maximum(0, np.cumsum((x**2)[::-1], axis=axis)[::-1]))
        mass, asked = left(columns, 0), left(queries.T, 0)
        part, at = np.zeros((len(queries), n)), None
        self.pairs += len(queries) * n * dims
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if at is None:
                part += queries[:, lo:hi] @ columns[lo:hi]
                self.summed += part.size * (hi - lo)
            else:
                q, c = at
                for d in range(lo, hi):
                    part += queries[q, d] * columns[d, c]
                self.summed += len(part) * (hi - lo)
            if hi == dims:
                break
            # a margin above the rounding of the square roots keeps the bound safe
            if at is None:
                alive = lambda some: part[some] + asked[hi][some, None] * mass[hi] * (1 + 1e-9) + 1e-6 >= self.limit[some, None]  # noqa: E731, B023
                if alive(slice(None, None, max(1, len(queries) // TELLING))).mean() < DENSE:
                    keep = alive(slice(None))
                    at, part = np.nonzero(keep), part[keep]
            else:
                q, c = at
                keep = part + asked[hi][q] * mass[hi][c] * (1 + 1e-9) + 1e-6 >= self.limit[q]
                at, part = (q[keep], c[keep]), part[keep]
        if at is None:
            at = np.nonzero(part >= self.limit[:, None])
            part = part[at]
        own = (self.rows[at[0]] == rows[at[1]]) | (part < self.limit[at[0]])
        q, c, part = at[0][~own], at[1][~own], part[~own]
        for i in np.unique(q):
            mine = slice(*np.searchsorted(q, [i, i + 1]))
            self.scores[i], self.ids[i] = merged(self.k, self.scores[i], self.ids[i], part[mine], ids[c[mine]])
            if len(self.scores[i]) == self.k:
                self.limit[i] = self.scores[i][-1]

    def wide_tile(self, rows: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """Like tile, for values whose products float64 can't hold: whole numbers of any size, without bounds."""
        whole = np.array([[int(x) for x in c] for c in columns], object).reshape(columns.shape)
        for i, query in enumerate(self.queries):
            other = np.flatnonzero(rows != self.rows[i])
            scores = sum((int(x) * whole[d, other] for d, x in enumerate(query) if x), np.zeros(len(other), object))
            both = [*zip(self.scores[i], self.ids[i], strict=True), *zip(scores, ids[other], strict=True)]
            best = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]
            self.scores[i], self.ids[i] = np.array([x[0] for x in best], object), np.array([x[1] for x in best], np.int64)

    def found(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, scores as longs, ids); a score beyond a long is the nearest one."""
        for i, (scores, ids) in enumerate(zip(self.scores, self.ids, strict=True)):
            yield i, np.array([min(max(int(x), _LONG.min), _LONG.max) for x in scores], np.int64), ids


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component, as doubles; row is unique.

    Vectors that are null, or hold a component that is null, NaN or infinite (scaled, too), are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))
    # a double from 2^53 on is whole, and floor() would cut it to a long
    whole = lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null and vec_id is not null")
    rows = rows.where(F.forall("v", finite)).select("vec_id", F.transform("v", lambda x: whole(x * scale)).alias("v"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as a matrix (vector x dimension), zeros after the end of a shorter one."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten())
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def tiles(rows: DataFrame, dims: int, tile: int) -> DataFrame:
    """(n, rows, ids, cells): tiles of up to `tile` vectors, cells dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            row, ids = (np.asarray(table.column(c)).astype("<i8") for c in ("row", "vec_id"))
            cells = np.ascontiguousarray(dense(table.column("v").combine_chunks(), dims).T)
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (row, ids, cells)]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)]), *blobs], names=["n", "rows", "ids", "cells"])

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            while kept.num_rows >= tile:
                yield made(kept.slice(0, tile))
                kept = kept.slice(tile)
        if kept is not None and kept.num_rows:
            yield made(kept)

    return rows.select("row", "vec_id", "v").mapInArrow(run, "n long, rows binary, ids binary, cells binary")


def read_tiles(folder: str, part: int, parts: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids and columns of the tiles number part, part + parts, ...; one tile is held at a time."""
    store, path = fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    number = 0
    for file in files:
        with store.open_input_file(file) as source:
            for batch in pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(batch_size=1):
                if number % parts == part:
                    cells = np.frombuffer(batch.column("cells")[0].as_buffer(), "<f8").reshape(dims, batch.column("n")[0].as_py())
                    yield *(np.frombuffer(batch.column(c)[0].as_buffer(), "<i8") for c in ("rows", "ids")), cells
                number += 1


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """The k vectors with the highest integer inner product for each query.

    vectors: vec_id long, embedding array. is_query picks the queries among them; every row but the query's own
    row is a candidate. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A query
    with fewer candidates gets all. Null vectors, and those with a null or non-finite component, take no part;
    shorter ones count as if zeros followed. Rows with one vec_id are rows of their own: each is a candidate (of
    the others too), and each that asks gets a list of its own. Values of any size are searched exactly; a
    score beyond a long is returned as the nearest long. No queries or an empty table give an empty result.

    The tiles are written once. The queries are dealt over blocks, and a block over as many tasks as keep the
    cluster busy; such a task streams its share of the tiles from the shared folder: a stated query set
    against all rows, in blocks. Only k rows a query leave it.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "vectors")
    facts = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))))
    n, n_queries, dims, most = facts.first()
    dims = dims or 0
    wide = dims * int(most or 0) ** 2 >= EXACT
    folder = shared_path(spark, "tiles")
    tiles(rows, dims, tile).write.parquet(folder)
    blocks = max(1, -(-n_queries // block))
    # values that are ranked in one task need no common size
    parts = 1 if wide else max(1, min(-(-n // tile), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    asking = rows.where(is_query).select("row", "vec_id", "v", dealt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        queries = dense(group.column("v").combine_chunks(), dims)
        todo = Search(np.asarray(group.column("row")), queries, k)
        for tile_rows, ids, columns in read_tiles(folder, group.column("part")[0].as_py(), parts, dims):
            (todo.wide_tile if wide else todo.tile)(tile_rows, ids, columns)
        row, query_id = np.asarray(group.column("row")), np.asarray(group.column("vec_id"))
        found = list(todo.found())
        sizes = [len(ids) for _, _, ids in found]
        rank = [np.arange(1, m + 1, dtype=np.int32) for m in sizes]
        join = lambda x, kind: np.concatenate([np.empty(0, kind), *x])
        columns = np.repeat(row, sizes), np.repeat(query_id, sizes), join(rank, np.int32), join([x[2] for x in found], np.int64), join([x[1] for x in found], np.int64)
        return pa.table(dict(zip(("row", "query_id", "rank", "vec_id", "score"), columns, strict=True)))

    found = asking.groupBy("block", "part").applyInArrow(search, "row long, query_id long, rank int, vec_id long, score long")
    if parts > 1:
        number = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "rank"))
        found = found.withColumn("rank", number).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
 FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 20
"""
