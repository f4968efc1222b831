"""Quality classifier: naive Bayes support vectors.

Indicators of character n-grams, and of one word n times running, are scaled by the log-count ratio of the two classes, and a linear
hinge-loss model is fitted on them by dual coordinate descent. A logistic curve over the margins of
held-back training rows turns a margin into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from placeloom.llm.common import written
from placeloom.llm.shingles import word_hashes
from placeloom.llm.tokenizing import FINE, small_batches

#: n-grams of so many bytes, hashed to 2^BITS indicators.
ORDERS = (1, 2, 3, 4)
BITS = 18
#: Longest run of one word that has an indicator.
RUN = 16
SIZE = (1 << BITS) + RUN + 1
#: Labelled rows of each class that the model is fitted on, at most.
ROWS = 1500
#: Indicators of the fitted rows of each class, about, at most: bounds what reaches the driver (4 bytes each).
CELLS = 4_000_000
#: Of the rows, one in so many calibrates the score.
CALIBRATION = 5
#: Up to so many n-grams of a text are sorted rather than marked in a table of all.
FEW = 2000
#: Score from which a text counts as good.
CUT = 0.3


def longest_runs(texts: pa.Array) -> np.ndarray:
    """How often a word stands running in each text at most, up to RUN; 0 for texts without words."""
    words, row = word_hashes(texts)
    most = np.zeros(len(texts), np.int64)
    if len(words):
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])))
        at = np.arange(len(words))
        np.maximum.at(most, row, at - np.maximum.accumulate(np.where(again, -1, at)) + 1)
    return np.minimum(most, RUN)


def indicators(texts: pa.Array, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed n-grams of each whole text, and where each text's begin; null is empty.

    After the 2^bits of the n-grams come those of runs: number n if a word stands n times running.
    """
    runs = longest_runs(texts)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    # a slice of a batch: its own bytes, not those of the whole batch
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # a digit counts as 0, whichever it is
    raw = np.where((raw >= 48) & (raw <= 57), np.uint8(48), raw).astype(np.uint32)
    found, bounds = [], [0]
    seen = np.zeros(1 << bits, bool)
    for lo, hi, run in zip(offsets[:-1], offsets[1:], runs, strict=True):
        text = raw[lo:hi]
        gram, cells = np.zeros(len(text), np.uint32), []
        for n in range(1, max(orders) + 1):
            if len(text) < n:
                break
            gram = gram[: len(text) - n + 1] * np.uint32(257) + text[n - 1 :] + np.uint32(1)
            if n in orders:
                cells.append((gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - bits))
        cells = np.concatenate(cells).astype(np.int64) if cells else np.empty(0, np.int64)
        if len(cells) < FEW:
            cells = np.unique(cells)
        else:
            seen[cells] = True
            cells = np.flatnonzero(seen)
            seen[cells] = False
        found.append(np.concatenate((cells, (1 << bits) + np.arange(2, run + 1))).astype(np.int32))
        bounds.append(bounds[-1] + len(found[-1]))
    return np.concatenate(found) if found else np.empty(0, np.int32), np.array(bounds)


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, size: int) -> np.ndarray:
    """log of the share of an indicator among the good rows' to that among the bad rows', each count from 1."""
    p, q = np.ones(size), np.ones(size)
    for row, y in zip(rows, good, strict=True):
        (p if y else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, good: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum of hinge losses, by coordinate descent on its dual.

    Row i holds values[j] for j in rows[i], scaled to length 1, and a constant 1 for the bias. Each step
    solves for one dual variable in [0, c_i]; c_i is larger for the rarer class, so both weigh alike.
    """
    rng = np.random.default_rng(seed)
    y = np.where(good, 1.0, -1.0)
    share = {True: max(1, good.sum()), False: max(1, (~good).sum())}
    upper = np.array([cost * len(rows) / (2 * share[bool(g)]) for g in good])
    length = np.array([max(1e-9, np.sqrt((values[r] ** 2).sum())) for r in rows])
    weights, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norm = np.array([(values[r] ** 2).sum() for r in rows]) / length**2 + 1
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = values[r] / length[i]
            gradient = y[i] * (weights[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def margins(found: np.ndarray, bounds: np.ndarray, weights: np.ndarray, values: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each row, whatever rows stand beside it; weights are those of the scaled indicators."""
    some = np.diff(bounds) > 0

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(some))
        if some.any():
            out[some] = np.add.reduceat(x.astype(np.float64)[found], bounds[:-1][some])
        return out

    return sums(weights * values) / np.maximum(np.sqrt(sums(values**2)), 1e-9) + bias


def logistic_fit(margin: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets; a is positive."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))])
    w = np.array([2.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class QualityModel:
    """A fitted model: fixed size (SIZE weights), whatever the corpus."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray):
        self.values, self.weights, self.bias, self.curve = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, (1.0, 0.0)
        if not good.any() or good.all():
            # only one class to learn from, or none: all scores say so
            self.curve = (1e-3, 0.0 if not len(good) else 3.0 if good.all() else -3.0)
            return
        back = np.arange(len(rows)) % CALIBRATION == 0
        if len(np.unique(good[back])) < 2 or len(np.unique(good[~back])) < 2:
            back = np.ones(len(rows), bool)
        fit = ~back if not back.all() else back
        part = [r for r, f in zip(rows, fit, strict=True) if f]
        values = log_count_ratio(part, good[fit], SIZE)
        weights, self.bias = dual_descent(part, values, good[fit])
        self.values, self.weights = values.astype(np.float32), weights.astype(np.float32)
        held = [r for r, b in zip(rows, back, strict=True) if b]
        margin = margins(np.concatenate(held), np.cumsum([0, *map(len, held)]), self.weights, self.values, self.bias)
        self.curve = logistic_fit(margin, good[back])

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = margins(*indicators(texts), self.weights, self.values, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def held_out(doc_id) -> F.Column:
    """Rows never learned from: crc32 of the doc_id as text is divisible by 5; a null one counts as not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(doc_id, quality, found): the distinct indicators of the labelled documents that a model is fitted on.

    At most `rows` documents of each class: those with the least hash of their doc_id among all labelled ones
    that aren't held out. A doc_id with several labels has its lowest, one with several texts its least
    text, so repeats don't multiply the sample. Of each class the first in the order of the hash are taken
    until they hold `cells` indicators (the last may go beyond). All of it is a bounded sample, spread evenly.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, *FINE):
            found, bounds = indicators(batch.column("text"))
            packed = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "quality", "found"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = written(texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, found binary"), "sample")
    # at most `rows` numbers a class
    before = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = found.select("doc_id", "quality", F.octet_length("found").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return found.join(F.broadcast(first.where(F.col("before") < 4 * cells).select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cells: int = CELLS) -> QualityModel:
    """A model of labels.quality, fitted on the bounded `sample`."""
    got = sample(docs, labels, rows, cells).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return QualityModel([np.frombuffer(r.found, np.int32) for r in got], np.array([r.quality == 1 for r in got], bool))


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """docs with column `name` (0 to 1, in place of one of that name); only `text` is an input of it."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, *FINE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column("text")))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of a text without n-grams; texts of any length are read whole;
    repeated rows are scored each; documents without a label too. Without labels every score is about
    1/2. An empty table gives an empty result. Other columns are ignored, and never inputs of a score.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs."""
    name = "score of the quality classifier"
    return score(docs, fit(docs, labels, rows), name).where(F.col(name) >= CUT).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
