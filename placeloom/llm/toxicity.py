"""Toxicity by class-conditional Kneser-Ney models.

A model of word pairs for toxic texts and one for ordinary texts are counted on a bounded sample of labelled
documents; both use absolute discounting, and the mass that they set aside goes to how many words each word
follows in the class (its continuation counts), from there to the beginnings of words (their first `LETTERS`
characters, so that forms of a toxic word which no labelled text has are known by it), and from there to the
continuation counts of all documents, which the classes share. A text's score is a logistic curve over the difference of its log-likelihoods
under both models, divided by its length; labelled documents that the models haven't seen fit the curve.

The shared counts are those of the whole corpus and grow with it: the distinct pairs of neighbouring words of all
documents, counted by their second word. Words that neither class has are one word for each beginning that some
class has, "another one of this beginning", and else "another one".
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from placeloom.llm.alnum import Index, Words, words_of
from placeloom.llm.common import slices_for, written
from placeloom.llm.quality import logistic_fit
from placeloom.llm.shingles import mixed
from placeloom.llm.tokenizing import small_batches

#: Labelled documents of each class that the models and the curve are fitted on, and words of them, at most (8 bytes each on the driver).
ROWS, WORDS = 2_500, 1_500_000
#: Of those documents, one in so many fits the curve.
CALIBRATION = 4
#: Characters of a word that are its beginning.
LETTERS = 5
#: Discounts (of a word, of a pair) and how many times what is expected of an expression is set aside, that are tried: those with
#: the least log loss on the calibration's texts are used, the first of equals. The last two are for corpora of mostly toxic texts.
DISCOUNTS = ((10, 40, 3.0), (3, 40, 3.0), (10, 10, 3.0), (3, 10, 3.0), (3, 3, 3.0), (10, 40, 1.5), (3, 10, 1.5))
#: Score from which a text counts as toxic.
CUT = 0.7
#: Pairs that a task gathers before it thins them out, and documents whose pairs make one group, about.
PENDING, GROUP = 4_000_000, 20_000


def held_out(doc_id) -> F.Column:
    """Rows never learned from: crc32 of the doc_id as text leaves 1 when divided by 3; a null one counts as not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, toxic, words, beginnings): the hashes of the words of the labelled documents that the models learn from, and of their beginnings.

    Of each class the first `rows` documents in the order of a hash of their doc_id, of those the first that hold `words`
    words (the last may go beyond). Held-out ones are left out. A doc_id with several labels has its
    highest, one with several texts its least.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = words_of(batch.column("text"))
            ends = np.cumsum(found.counts())[:-1]
            packed = [pa.array([x.tobytes() for x in np.split(hashes, ends)], pa.binary()) for hashes in (found.hashes(), found.beginnings(LETTERS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), *packed], names=["doc_id", "toxic", "words", "beginnings"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = written(texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words binary, beginnings binary"), "sample")
    # at most `rows` numbers a class
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = found.select("doc_id", "toxic", F.octet_length("words").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return found.join(F.broadcast(first.where(F.col("before") < 8 * words).select("doc_id")), "doc_id")


class Vocabulary:
    """Numbers of the words of the sample; 0 is every other word, 1 stands before the first word of a text.

    With the beginnings of words (their hashes), words that aren't known but for their beginning have a number
    for each of these, after those of the words. `begins` is the number of each word's beginning; 0 and 1 are their own.
    """

    def __init__(self, hashes: np.ndarray, beginnings: np.ndarray | None = None):
        words, at = np.unique(hashes, return_index=True)
        known, of = np.unique(beginnings if beginnings is not None else np.empty(0, np.uint64), return_inverse=True)
        self.index, self.parts = Index(words), Index(known)
        self.size = len(words) + len(known) + 2
        own = of[at] + 2 if len(of) else np.arange(len(words)) + 2
        self.begins = np.concatenate(([0, 1], own, np.arange(len(known)) + 2)).astype(np.int64)

    def numbers(self, hashes: np.ndarray, beginnings: np.ndarray | None = None) -> np.ndarray:
        found = self.index.find(hashes).astype(np.int64)
        out = np.where(found < 0, 0, found + 2)
        if beginnings is not None:
            other = np.flatnonzero(found < 0)
            part = self.parts.find(beginnings[other]).astype(np.int64)
            out[other] = np.where(part < 0, 0, part + len(self.index.known) - 1 + 2)
        return out

    def only(self, kept: np.ndarray) -> Vocabulary:
        """The vocabulary of the numbers that are `kept` alone (0 and 1 must be), numbered anew in the same order."""
        out, words = object.__new__(Vocabulary), len(self.index.known) - 1
        out.index, out.parts = Index(self.index.known[:-1][kept[2 : 2 + words]]), Index(self.parts.known[:-1][kept[2 + words :]])
        out.size = int(kept.sum())
        return out

    def pairs(self, second: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Each word's pair with the word before it, first * size + second."""
        first = np.ones(len(second), np.int64)
        at = np.flatnonzero(follows)
        first[at] = second[at - 1]
        return first * self.size + second


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as compressed differences, byte by byte plane."""
    steps = np.diff(keys, prepend=0).astype("<i8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel())


def shared_counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How many words each word of the vocabulary follows in all documents: its continuation count.

    Tasks send the distinct pairs of their texts, compressed, to groups by a hash of the pair, so no frequent
    word's pairs meet; the groups count the distinct ones by second word.
    """
    size = vocabulary.size
    groups = slices_for(docs.count(), least=64, most_rows=GROUP)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(keys: np.ndarray) -> pa.RecordBatch:
            group = (mixed(keys.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            parts = np.split(keys[order], np.searchsorted(group[order], np.arange(1, groups)))
            full = [g for g, p in enumerate(parts) if len(p)]
            columns = [pa.array(full, pa.int32()), pa.array([len(parts[g]) for g in full], pa.int64()), pa.array([packed(parts[g]) for g in full], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["group", "n", "pairs"])

        seen, pending, waiting = np.empty(0, np.int64), [], 0
        for batch in small_batches(batches):
            words = words_of(batch.column("text"))
            pending.append(np.unique(vocabulary.pairs(vocabulary.numbers(words.hashes(), words.beginnings(LETTERS)), words.follows())))
            waiting += len(pending[-1])
            if waiting >= PENDING:
                seen, pending, waiting = np.unique(np.concatenate((seen, *pending))), [], 0
                if len(seen) >= 2 * PENDING:
                    yield sent(seen)
                    seen = np.empty(0, np.int64)
        seen = np.unique(np.concatenate((seen, *pending)))
        if len(seen):
            yield sent(seen)

    def counted(chunks: pa.Table) -> pa.Table:
        seen, pending, waiting = np.empty(0, np.int64), [], 0
        for data, n in zip(chunks.column("pairs").to_pylist(), chunks.column("n").to_pylist(), strict=True):
            pending.append(unpacked(data, n))
            waiting += n
            # the union grows by a share each time, so each pair is sorted a few times only
            if waiting >= max(PENDING, len(seen)):
                seen, pending, waiting = np.unique(np.concatenate((seen, *pending))), [], 0
        seen = np.unique(np.concatenate((seen, *pending)))
        word, n = np.unique(seen % size, return_counts=True)
        return pa.table({"word": word, "n": n})

    chunks = docs.select("text").mapInArrow(gathered, "group int, n long, pairs binary")
    counts = chunks.groupBy("group").applyInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    # at most as many rows as the sample has words
    for batch in counts.select("word", "n").toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("n").to_numpy()
    return out


def distinct_contexts(pairs: np.ndarray, follows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of texts (sorted) and after how many different words each stands.

    Counts of contexts, as in every order of a Kneser-Ney model but the highest: copies and passages that
    many documents share don't multiply.
    """
    before = np.ones(len(pairs), np.int64)
    at = np.flatnonzero(follows)
    before[at] = pairs[at - 1] // size
    order = np.lexsort((before, pairs))
    pairs, before = pairs[order], before[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (before[1:] != before[:-1])
    return np.unique(pairs[new], return_counts=True)


def counted_in(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts that the other class has of the pairs of one, scaled to as many in all."""
    out = np.zeros(len(one[0]))
    both, here, there = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    out[here] = other[1][there] * (one[1].sum() / max(1, other[1].sum()))
    return out


class ClassModel:
    """P(word | word before, class) by absolute discounting of counts of contexts, down to the shared base.

    A word's discount is `word_discount` or `expected` times what the other class has of it, whichever is more; a beginning has what
    its words set aside, discounted likewise, and a pair's discount is `pair_discount` or `expected` times what the other class has.
    So rare expressions, and those that aren't much more frequent in the class than in the other, take their probability from the
    shared counts alone. What is expected isn't taken from these: in a corpus much larger than the sample, new contexts of
    frequent words end and those of rare ones don't, so a rare word of the class would seem to be as frequent elsewhere.
    """

    def __init__(self, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], size: int, base: np.ndarray, word_discount: float, pair_discount: float, expected: float, begins: np.ndarray | None = None):
        (pairs, counts), shared = one, counted_in(one, other)
        first, second = pairs // size, pairs % size
        begins = np.arange(size) if begins is None else begins
        kinds = np.bincount(second, minlength=size).astype(float)
        total = max(1.0, kinds.sum())
        there = np.bincount(other[0] % size, minlength=size) * (total / max(1, len(other[0])))
        aside = np.minimum(kinds, np.maximum(word_discount, expected * there))
        parts, part_base = np.bincount(begins, aside, size), np.bincount(begins, base, size)
        part_aside = np.minimum(parts, np.maximum(word_discount, expected * np.bincount(begins, there, size)))
        self.common = part_aside.sum() / total if len(pairs) else 1.0
        self.own = (kinds > aside) | (parts > part_aside)[begins]
        # a word's share of its beginning is the shared counts'
        self.single = (kinds - aside) / total + ((parts - part_aside) / total / np.where(part_base > 0, part_base, 1))[begins] * base + self.common * base
        seen = np.bincount(first, counts, size)
        aside = np.minimum(counts, np.maximum(pair_discount, expected * shared))
        self.left = np.where(seen > 0, np.bincount(first, aside, size) / np.maximum(seen, 1), 1.0)
        kept = counts > aside
        self.keys, self.pair = pairs[kept], ((counts - aside) / np.maximum(seen[first], 1))[kept]

    def log_of(self, keys: np.ndarray, size: int) -> np.ndarray:
        own = np.zeros(len(keys))
        own[np.searchsorted(keys, self.keys)] = self.pair
        return np.log(own + self.left[keys // size] * self.single[keys % size])


class LogRatios:
    """log P(word | word before, toxic) - log P(word | word before, ordinary), of the words and pairs that tell.

    All other words share one ratio and all other contexts one weight, so only those that tell are kept.
    """

    def __init__(self, models: list[ClassModel], vocabulary: Vocabulary):
        toxic, ordinary = models
        keys, size = np.union1d(toxic.keys, ordinary.keys), vocabulary.size
        single, left = np.log(toxic.single) - np.log(ordinary.single), np.log(toxic.left) - np.log(ordinary.left)
        common = np.log(toxic.common) - np.log(ordinary.common)
        tells = toxic.own | ordinary.own | (left != 0)
        tells[keys // size] = tells[keys % size] = True
        tells[:2] = True
        number = np.cumsum(tells) - 1
        self.words = vocabulary.only(tells)
        self.single, self.left = np.where(toxic.own | ordinary.own, single, common)[tells], left[tells]
        self.keys = number[keys // size] * self.words.size + number[keys % size]
        self.ratios = toxic.log_of(keys, size) - ordinary.log_of(keys, size)
        self.pairs = Index(mixed(self.keys.astype(np.uint64)))

    def differences(self, hashes: np.ndarray, beginnings: np.ndarray, follows: np.ndarray, row: np.ndarray, texts: int, empty: float) -> np.ndarray:
        """Length-normalised log-likelihood difference of each text; `empty` for texts without words."""
        numbers = self.words.numbers(hashes, beginnings)
        pairs = self.words.pairs(numbers, follows)
        known = self.pairs.find(mixed(pairs.astype(np.uint64)))
        ratio = self.left[pairs // self.words.size] + self.single[numbers]
        ratio[known >= 0] = self.ratios[known[known >= 0]]
        n = np.bincount(row, minlength=texts)
        return np.where(n > 0, np.bincount(row, ratio, texts) / np.maximum(n, 1), empty)


def log_loss(score: np.ndarray, toxic: np.ndarray) -> float:
    return float(-np.log(np.where(toxic, score, 1 - score)).mean())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class ToxicityModel:
    """Fitted ratios and the curve of a score. Their size is at most the sample's, whatever the corpus."""

    def __init__(self, texts: list[np.ndarray], beginnings: list[np.ndarray], toxic: np.ndarray, vocabulary: Vocabulary, shared: np.ndarray):
        back = np.arange(len(texts)) % CALIBRATION == 0
        if len(np.unique(toxic[back])) < 2 or len(np.unique(toxic[~back])) < 2:
            back = np.ones(len(texts), bool)
        fitted = ~back if not back.all() else back
        base = (shared + 1) / (shared.sum() + vocabulary.size)
        counts = []
        own = [[t for t, f, y in zip(texts, fitted, toxic, strict=True) if f and y == c] for c in (True, False)]
        # both classes learn from about as many words, for counts of contexts don't grow in proportion to the text
        least = min(sum(map(len, x)) for x in own)
        for part in own:
            words, follows, _ = self._joined(part[: 1 + int(np.searchsorted(np.cumsum([len(t) for t in part]), least))])
            counts.append(distinct_contexts(vocabulary.pairs(vocabulary.numbers(words), follows), follows, vocabulary.size))
        candidates = [LogRatios([ClassModel(one, other, vocabulary.size, base, *d, vocabulary.begins) for one, other in (counts, counts[::-1])], vocabulary) for d in DISCOUNTS]
        self.ratios, self.center, self.scale, self.curve = candidates[0], 0.0, 1.0, (1.0, 0.0)
        if not toxic.any() or toxic.all():
            # only one class to learn from, or none: all scores say so
            self.scale, self.curve = 0.0, (0.0, 0.0 if not len(toxic) else 3.0 if toxic.all() else -3.0)
            return
        words, follows, row = self._joined([t for t, b in zip(texts, back, strict=True) if b])
        begun = self._joined([t for t, b in zip(beginnings, back, strict=True) if b])[0]
        found = [r.differences(words, begun, follows, row, int(back.sum()), 0.0) for r in candidates]
        with_words = np.bincount(row, minlength=int(back.sum())) > 0
        own = toxic[back][with_words]
        if len(np.unique(own)) < 2:
            return
        losses = []
        for ratios, difference in zip(candidates, (f[with_words] for f in found), strict=True):
            # an ordinary text is the middle, and so is a text without words
            center, scale = float(np.median(difference[~own])), 1 / max(1e-9, float(difference.std()))
            curve = logistic_fit(scale * (difference - center), own)
            losses.append(round(log_loss(logistic(curve[0] * scale * (difference - center) + curve[1]), own), 3))
            if losses[-1] < min(losses[:-1], default=np.inf):
                self.ratios, self.center, self.scale, self.curve = ratios, center, scale, curve

    @staticmethod
    def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, follows, row) of the words of all texts."""
        n = np.array([len(t) for t in texts], np.int64)
        row = np.repeat(np.arange(len(texts)), n)
        follows = np.ones(len(row), bool)
        follows[(np.cumsum(n) - n)[n > 0]] = False
        return np.concatenate(texts) if texts else np.empty(0, np.uint64), follows, row

    def scores(self, words: Words) -> np.ndarray:
        difference = self.ratios.differences(words.hashes(), words.beginnings(LETTERS), words.follows(), words.row, words.texts, self.center)
        return logistic(self.curve[0] * self.scale * (difference - self.center) + self.curve[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, words: int = WORDS) -> ToxicityModel:
    """Models of labels.toxic on the bounded `sample`, with shared counts of all documents."""
    got = sample(docs, labels, rows, words).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    texts, beginnings = ([np.frombuffer(r[name], np.uint64) for r in got] for name in ("words", "beginnings"))
    vocabulary = Vocabulary(*(np.concatenate([np.empty(0, np.uint64), *x]) for x in (texts, beginnings)))
    return ToxicityModel(texts, beginnings, np.array([r.toxic == 1 for r in got], bool), vocabulary, shared_counts(docs, vocabulary))


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs with column `name` (0 to 1, in place of one of that name); only `text` is an input of it."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(words_of(batch.column("text"))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts, or texts without words, get the score of an average ordinary text; texts of any length are
    read whole; repeated rows are scored each; documents without a label or doc_id too. Without labels every score
    is 1/2, with one class only all scores say so. An empty table gives an empty result. Other columns are ignored,
    and labels, lang, source and doc_id are never inputs of a score.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, rows, words))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
