"""Target-distribution importance resampling over hashed word and word-pair features, with a head-tail vocabulary.

Features are the words of a text and its pairs of neighbours; a feature's bucket is its CRC-32 modulo
BUCKETS. The most frequent words of all documents (the head) are broadcast with the exact state that their
CRC has after them, and the buckets of all pairs of the PAIRED most frequent ones as one table, for a pair is
never more frequent than its words. All other features, the tail, take their CRC directly, a pair's from
the state after its first word. Both give the exact totals of each bucket in the documents and in the target.

A document's weight is the mean of its features' log-ratios of target to documents; a Gumbel number drawn from
its doc_id is added, and the highest sums are the resampled documents (without replacement).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.alnum import BETWEEN, CRC_START, Index, Words, crc_on, crc_step, words_of
from placeloom.llm.common import ascii_lower, running_sums, written
from placeloom.llm.shingles import span_hashes
from placeloom.llm.tokenizing import small_batches

BUCKETS = 10_000
#: A word belongs to the head if it is one in so many of all words or more; how many of them, the most frequent, have the buckets of their pairs at hand.
HEAD, PAIRED = 65_536, 1_024
#: Least words of a document that can be drawn, the percentage drawn, and the seed of the draw.
LEAST, PERCENT, SEED = 20, 25, 7


def head_words(docs: DataFrame, head: int = HEAD) -> list[str]:
    """The words that hold one in `head` of all words of the documents or more, the most frequent first (ties by the word).

    So there are at most `head` of them, whatever the number of words, and only they are sent to the driver.
    """
    words = docs.select(F.explode(F.split(ascii_lower(F.col("text")), BETWEEN)).alias("word")).where("word <> ''")
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * head >= total).collect()
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


class Head:
    """CRC states of the head's words and buckets of pairs of the first `paired`; of bounded size, to be broadcast."""

    def __init__(self, words: list[str], buckets: int = BUCKETS, paired: int = PAIRED):
        encoded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.cumsum([len(w) for w in encoded], dtype=np.int64)
        starts = ends - np.array([len(w) for w in encoded], np.int64)
        self.buckets, self.paired = buckets, min(paired, len(words))
        self.index = Index(span_hashes(raw.astype(np.uint64), starts, ends) if words else np.empty(0, np.uint64))
        self.states = crc_on(np.full(len(words), CRC_START), raw, starts, ends)
        spaced = crc_step(self.states[: self.paired], 32)
        firsts, seconds = np.repeat(np.arange(self.paired), self.paired), np.tile(np.arange(self.paired), self.paired)
        self.pairs = self._bucket(crc_on(spaced[firsts], raw, starts[seconds], ends[seconds])).astype(np.uint16)

    def _bucket(self, states: np.ndarray) -> np.ndarray:
        return (~states) % np.uint32(self.buckets)

    def features(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of every feature: first all words, then all pairs."""
        known = self.index.find(words.hashes())
        tail = np.flatnonzero(known < 0)
        states = self.states[known] if len(self.states) else np.empty(len(known), np.uint32)
        states[tail] = crc_on(np.full(len(tail), CRC_START), words.raw, words.starts[tail], words.ends[tail])
        second = np.flatnonzero(words.follows())
        a, b = known[second - 1].astype(np.int64), known[second].astype(np.int64)
        at_hand = (a >= 0) & (b >= 0) & (a < self.paired) & (b < self.paired)
        pairs = np.empty(len(second), np.int64)
        pairs[at_hand] = self.pairs[a[at_hand] * self.paired + b[at_hand]]
        rest = second[~at_hand]
        pairs[~at_hand] = self._bucket(crc_on(crc_step(states[rest - 1], 32), words.raw, words.starts[rest], words.ends[rest]))
        return np.concatenate((self._bucket(states).astype(np.int64), pairs)), np.concatenate((words.row, words.row[second]))


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends one number a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.buckets, np.int64)
        for batch in small_batches(batches):
            total += np.bincount(head.features(words_of(batch.column("text")))[0], minlength=head.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(head.buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(of_documents: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """1000 x the log-ratio of target to documents of each bucket, each count from 1, rounded down."""
    s, t = of_documents.sum(), of_target.sum()
    return np.floor(1000 * np.log(((of_target + 1) * float(s + len(of_documents))) / ((of_documents + 1) * float(t + len(of_target))))).astype(np.int64)


def weights(docs: DataFrame, head: Head, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain rounded down, 0 without features) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = words_of(batch.column("text"))
            bucket, text = head.features(words)
            n = np.bincount(text, minlength=words.texts)
            total = np.zeros(words.texts, np.int64)
            np.add.at(total, text, gains[bucket])
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(words.counts()), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, head: int = HEAD, paired: int = PAIRED, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn ones, else null) of every document of docs (doc_id, text).

    target has the texts whose distribution is wanted. Null and empty texts, or texts without words, have no
    features and weight 0, and count for nothing. Texts are read whole. A row without doc_id counts in the totals but has a
    null score and isn't drawn, nor counted in the share drawn. Repeated rows are scored each; equal
    scores go by doc_id, then weight and features, so equal rows have neighbouring ranks. Empty tables give
    totals of 0 and an empty result. Other columns are ignored. No head changes a result, only how
    many features take their CRC directly.
    """
    model = Head(head_words(docs, head), buckets, paired)
    gains = bucket_gains(bucket_totals(docs, model), bucket_totals(target, model))
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((first + 0.5) / 4294967296.0)))
    rows = written(weights(docs, model, gains).withColumn("score", F.col("weight") + gumbel), "weights")
    able = (F.col("n_words") >= least) & F.col("doc_id").isNotNull()
    drawn = rows.where(able).count() * percent // 100
    order = [F.desc("score"), F.col("doc_id"), F.col("weight"), F.col("n_features")]
    ranked = running_sums(rows.where(able), order, {"before": F.lit(1).cast("long")}, "ranks")
    ranked = ranked.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1)).drop("before")
    out = ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
 UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS v FROM bits WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS row_no, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words, true AS is_doc FROM documents),
b AS (SELECT NULL AS doc_id, -row_number() OVER () AS row_no, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words, false AS is_doc FROM benchmark),
t AS (SELECT * FROM d UNION ALL SELECT * FROM b),
f AS (SELECT row_no, is_doc, unnest(list_concat(words, list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM t),
g AS (SELECT row_no, is_doc, feature, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT feature FROM g),
h AS (SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM u),
c AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(v[xor(s, x) % 256 + 1], s // 256)), 4294967295) % 10000 AS bucket FROM h, crc_table),
e AS (SELECT g.*, bucket FROM g JOIN c USING (feature)),
tot AS (SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM e GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM tot)::DOUBLE) / ((s + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM tot)::DOUBLE)))::BIGINT AS gain FROM tot),
w AS (SELECT row_no, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM e JOIN gain USING (bucket) WHERE is_doc GROUP BY row_no),
s AS (SELECT doc_id, len(words) >= 20 AND doc_id IS NOT NULL AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, weight, n_features) AS place FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM s WHERE able) * 25 // 100 THEN place END AS rank FROM r
"""
