"""Packing: non-negative least squares over shallow length combinations.

Documents become token ids, cut into windows; what is left over at a document's end is a piece of a
length class. All combinations of up to DEPTH classes that fill a window are enumerated, repeat
counts are solved by non-negative least squares against the histogram of the classes, and rounded;
each combination then takes its pieces by their number in the class. The pieces that the rounding
leaves are packed greedily, one after another, cut where a window is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import numbered, running_sums, written
from placeloom.llm.tokenizing import FINE, encoder, small_batches, with_end

WINDOW = 2048
#: Tokens of a length class, and pieces of a combination.
CLASS, DEPTH = 8, 3
#: Id after each document.
END = 1


def combinations(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending class numbers that sum up to `classes`, at most `depth` of them.

    >>> combinations(4, 3)
    [(4,), (1, 3), (2, 2), (1, 1, 2)]
    """
    found, open_ = [], [((), classes)]
    for _ in range(depth):
        found += [(*c, left) for c, left in open_ if left >= (c[-1] if c else 1)]
        open_ = [((*c, n), left - n) for c, left in open_ for n in range(c[-1] if c else 1, left // 2 + 1)]
    return found


def least_squares(columns: list[dict[int, int]], target: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """x >= 0 with the least |A x - target|, A given by the non-zero entries of its columns.

    Sequential coordinate-wise descent: each step solves exactly for one x_j >= 0 with the others held.
    It ends when no count moves by a fifth any more, for they are rounded.
    """
    left = [float(v) for v in target]
    x = [0.0] * len(columns)
    entries = [(list(c.items()), float(sum(v * v for v in c.values()))) for c in columns]
    for _ in range(sweeps):
        most = 0.0
        for j, (column, norm) in enumerate(entries):
            step = sum(left[i] * v for i, v in column) / norm
            step = step if x[j] + step > 0 else -x[j]
            if step:
                x[j] += step
                for i, v in column:
                    left[i] -= step * v
                most = max(most, abs(step))
        if most < 0.2:
            break
    return np.array(x)


def repeats(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used, within the histogram (index: class, 0 unused)."""
    classes = len(histogram) - 1
    # a piece of the last class fills a window alone, whatever the others do
    options = [c for c in combinations(classes, depth) if len(c) > 1 and all(histogram[n] for n in c)]
    columns = [{n: c.count(n) for n in c} for c in options]
    counts = [0, *map(int, histogram[1:classes]), 0]
    x = least_squares(columns, np.array(counts))
    plan = [((classes,), int(histogram[classes]))] if histogram[classes] else []
    for j in np.argsort(-x, kind="stable"):
        times = min(int(x[j] + 0.5), *(counts[n] // k for n, k in columns[j].items()))
        if times > 0:
            plan.append((options[j], times))
            for n, k in columns[j].items():
                counts[n] -= times * k
    return plan


def tail_cuts(total: int, window: int = WINDOW) -> list[int]:
    """Where the last, partly full window is cut, so that each part has a power of two.

    >>> tail_cuts(2048 + 37)
    [2080, 2084]
    """
    at, cuts = total - total % window, []
    rest = total - at
    while rest:
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
        cuts.append(at)
    return cuts[:-1]


def tokenised(docs: DataFrame, vocabulary: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n, ids, crcs) of every document: its ids with the end id, little-endian, and the crc32 of each window.

    `row` is unique and fixed, since the table is written. ids are 16-bit where the vocabulary allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, *FINE):
            ids = with_end(*encoder(vocabulary).encode(batch.column("text")), end)
            crcs = [[zlib.crc32(x[i : i + window].astype("<u4")) for i in range(0, len(x), window)] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "crcs"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, crcs array<long>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "tokens", "zstd")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 of the ids from start, length long, in place of ids."""
    for batch in batches:
        crc = []
        for ids, n, start, length in zip(*(batch.column(c) for c in ("ids", "n", "start", "length")), strict=True):
            raw, n, start, length = ids.as_buffer(), n.as_py(), start.as_py(), length.as_py()
            part = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")[start : start + length]
            crc.append(zlib.crc32(part.astype("<u4")))
        names = [c for c in batch.schema.names if c not in ("ids", "n")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(crc, pa.int64())], names=[*names, "crc"])


def pack(tokens: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """Where every token of `tokenised` documents lies: pieces (row, doc_id, n, start, length, crc, sequence_id, offset).

    A sequence holds at most `window` tokens. Full windows and combinations use ids from 0 in the order of
    the plan; the greedy rest follows. Only the histogram (window / CLASS numbers) and the plan made of
    it pass the driver. Pieces of a class are numbered over slices of a hash, so a length that very
    many documents share is no hot task.
    """
    spark = tokens.sparkSession
    classes = window // CLASS
    facts = tokens.select("row", "doc_id", "n", F.posexplode("crcs").alias("k", "crc")).withColumn("start", (F.col("k") * window).cast("long"))
    facts = facts.withColumn("length", F.least(F.lit(window), F.col("n") - F.col("start")).cast("long")).drop("k")
    facts = facts.withColumn("class", F.ceil(F.col("length") / CLASS).cast("int"))
    pieces = written(numbered(facts, ["class"], F.struct("row", "start"), [F.col("row"), F.col("start")], "number", tokens.count()), "pieces")

    histogram = np.zeros(classes + 1, np.int64)
    for n, count in pieces.groupBy("class").count().collect():  # at most window / CLASS rows
        histogram[n] = count
    slots, taken, sequences = [], np.zeros(classes + 1, np.int64), 0
    for combination, times in repeats(histogram, depth):
        for place, n in enumerate(combination):
            slots.append((n, int(taken[n]), int(taken[n]) + times, sequences, place))
            taken[n] += times
        sequences += times
    # one row for each piece of a combination: bounded by the classes, not the documents
    plan = spark.createDataFrame(slots, "class int, low long, high long, base long, place int")
    met = (pieces["class"] == plan["class"]) & (pieces["number"] >= plan["low"]) & (pieces["number"] < plan["high"])
    placed = pieces.join(F.broadcast(plan), met).drop(plan["class"])
    placed = placed.withColumn("sequence_id", F.col("base") + F.col("number") - F.col("low"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    names = ["row", "doc_id", "n", "start", "length", "crc", "sequence_id", "offset"]

    limits = F.array(*[F.lit(int(x)) for x in taken])
    rest = pieces.where(F.col("number") >= F.get(limits, F.col("class")))
    rest = rest.withColumn("place", F.xxhash64("row", "start"))
    rest = running_sums(rest, [F.col("place"), F.col("row"), F.col("start")], {"at": F.col("length")}, "rest")
    total = int(histogram[1:].sum() and (rest.agg(F.sum("length")).first()[0] or 0))
    ends = F.array(*[F.lit(x) for x in tail_cuts(total, window)]) if tail_cuts(total, window) else F.array().cast("array<long>")
    first = (F.floor(F.col("at") / window) + 1) * window
    last = F.ceil((F.col("at") + F.col("length")) / window) * window - window
    full = F.when(first <= last, F.sequence(first, last, F.lit(window).cast("long"))).otherwise(F.array().cast("array<long>"))
    inside = F.filter(ends, lambda e: (e > F.col("at")) & (e < F.col("at") + F.col("length")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("at"), full, inside)))
    parts = rest.select("row", "doc_id", "n", "start", "length", "crc", "at", F.posexplode(cuts).alias("k", "from"), F.size(cuts).alias("parts"), F.concat(F.slice(cuts, 2, F.lit(window)), F.array(F.col("at") + F.col("length"))).alias("to"))
    parts = parts.withColumn("size", F.get("to", F.col("k")) - F.col("from"))
    # the window that a part lies in, or the part of the last one; those follow all windows
    bound = F.greatest((F.floor(F.col("from") / window) * window), F.coalesce(F.array_max(F.filter(ends, lambda e: e <= F.col("from"))), F.lit(0)))
    tails = F.size(F.filter(ends, lambda e: e <= F.col("from")))
    parts = parts.select(
        "row", "doc_id", "n", (F.col("start") + F.col("from") - F.col("at")).alias("start"), F.col("size").alias("length"), F.when(F.col("parts") == 1, F.col("crc")).alias("crc"),
        (F.lit(sequences) + F.floor(F.col("from") / window) + tails).alias("sequence_id"), (F.col("from") - bound).alias("offset"),
    )
    parts = written(parts, "parts")
    cut = parts.where("crc is null").drop("crc", "n").join(tokens.select("row", "n", "ids"), "row")
    schema = "row long, doc_id long, start long, length long, sequence_id long, offset long, crc long"
    again = cut.select("row", "doc_id", "start", "length", "sequence_id", "offset", "n", "ids").mapInArrow(_crcs, schema)
    again = again.join(tokens.select("row", "n"), "row")
    return placed.select(names).unionByName(parts.where("crc is not null").select(names)).unionByName(again.select(names))


def packed_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece with the end id alone; repeated rows are packed each; a null
    doc_id is kept. An empty table gives an empty result. Other columns are ignored.
    """
    pieces = pack(tokenised(docs, vocabulary, window=window), window)
    return pieces.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
