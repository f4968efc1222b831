"""op11, op12, op13: importance resampling, ranked search, toxicity."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeloom.llm import alnum, importance, lexical, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "...", "One", "one two ONE two", "Ünïcode ÀB é1 2x", "a" * 100_000, "word " * 40, "A_b-c d\x00e\x7ff 漢字 g", "x y " * 30 + "z", "one two three " * 9]


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame([(i, t, 7, "clash", 1, 0.5) for i, t in rows], f"{name} long, text string, n long, score string, rank int, weight double")


def test_words_and_their_crc():
    found = alnum.words_of(pa.array(TEXTS))
    assert list(found.counts()) == [len(words(t)) for t in TEXTS]
    every = [w.encode() for t in TEXTS for w in words(t)]
    assert [found.raw[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)] == every
    start = np.full(len(every), alnum.CRC_START)
    assert list(~alnum.crc_on(start, found.raw, found.starts, found.ends)) == [zlib.crc32(w) for w in every]
    assert alnum.words_of(pa.array([], pa.string())).texts == 0 and len(alnum.words_of(pa.array([None, ""])).hashes()) == 0
    sliced = alnum.words_of(pa.array(TEXTS).slice(3, 3))
    assert list(sliced.counts()) == [len(words(t)) for t in TEXTS[3:6]]


def test_index_finds_all_and_nothing_else():
    rng = np.random.default_rng(1)
    known = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    # many equal low bits
    known = np.unique(np.concatenate((known, np.arange(300, dtype=np.uint64) << np.uint64(40))))
    rng.shuffle(known)
    index = alnum.Index(known)
    assert list(index.find(known)) == list(range(len(known)))
    assert set(index.find(known + np.uint64(1)).tolist()) <= {-1, *range(len(known))} and index.find(np.array([12345], np.uint64))[0] == -1
    assert list(alnum.Index(np.empty(0, np.uint64)).find(np.array([0, 7], np.uint64))) == [-1, -1]


def resampled(docs, target, buckets, least, percent, seed):
    grams = lambda t: [*words(t), *map(" ".join, zip(words(t), words(t)[1:], strict=False))]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, text in docs:
        found = grams(text)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(found), weight, score, None, len(words(text)) >= least and i is not None])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("head, paired", [(1, 0), (3, 2), (65_536, 1_024)])
def test_resampling_against_brute_force(spark, head, paired):
    docs = [*enumerate(TEXTS), (None, "one two three " * 9), (4, "one two ONE two"), (7, "word " * 40), (7, "word " * 40), (99, "three four five " * 8)]
    target = ["one two three", None, "three four", "word é1"]
    found = importance.resample(frame(spark, docs), frame(spark, list(enumerate(target)), "item_id"), 50, head, paired, 20, 60, 7).collect()
    assert sorted((tuple(r) for r in found), key=repr) == resampled(docs, target, 50, 20, 60, 7)
    assert any(r.rank for r in found)


def test_resampling_of_empty_tables(spark):
    none = frame(spark, [])
    assert importance.resample(none, none).collect() == []
    found = importance.resample(frame(spark, [(1, "a b")]), none).collect()
    assert [tuple(r)[:3] for r in found] == [(1, 3, found_weight(["a", "b", "a b"]))] and found[0].rank is None


def found_weight(grams):
    s = Counter(zlib.crc32(g.encode()) % 10_000 for g in grams)
    return sum(math.floor(1000 * math.log(10_003 / ((s[zlib.crc32(g.encode()) % 10_000] + 1) * 10_000))) for g in grams) // len(grams)


def searched(docs, items, best):
    bags = [(i, Counter(words(t))) for i, t in docs]
    size = {k: sum(b.values()) for k, (_, b) in enumerate(bags)}
    n, total = sum(v > 0 for v in size.values()), sum(size.values())
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for k, (i, bag) in enumerate(bags):
            m = 25 + (75 * size[k] * n) // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w, times in asked.items() if bag[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_items", [2, 256])
def test_search_against_brute_force(spark, block_items):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for k in range(120)]
    docs += [*((200 + i, t) for i, t in enumerate(TEXTS)), (None, docs[5][1]), (None, docs[6][1]), (5, docs[5][1]), (300, docs[5][1])]
    # shared sets of terms, repeats, equal items, nulls
    items = [(k, " ".join([*vocabulary[k : k + 12], *vocabulary[k : k + 3]])) for k in range(0, 20, 2)]
    items += [(50, "w1 w2 W1"), (51, "w1 w2 W1"), (51, "w1 w2 W1"), (None, "w3 one two"), (60, None), (61, ""), (62, "unknown"), (63, "one é1 2x 漢字")]
    found = lexical.search(frame(spark, docs), frame(spark, items, "item_id"), 10, block_items).collect()
    assert sorted((tuple(r) for r in found), key=repr) == searched(docs, items, 10)


def test_search_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    empty = lexical.search(some, none.withColumnRenamed("doc_id", "item_id"))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(none, some.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert lexical.search(frame(spark, [(1, None)]), some.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_graph_shares_sums():
    rng = np.random.default_rng(5)
    held = [sorted({int(i): int(rng.integers(1, 3)) for i in rng.choice(12, rng.integers(1, 6), replace=False)}.items()) for _ in range(300)]
    held += [[(i, 1) for i in range(12)]] * 20
    graph = lexical.compiled(held, 12)
    assert graph.levels and graph.leaves < len(held)
    # terms of the same items are one node
    assert len({int(graph.leaf[np.flatnonzero(graph.term == t)[0]]) for t in range(300, 320)}) == 1
    part = rng.integers(0, 1000, len(held))
    sums = np.zeros(graph.nodes, np.int64)
    np.add.at(sums, graph.leaf, part[graph.term] * graph.times)
    made = graph.leaves
    for left, right in graph.levels:
        sums[made : made + len(left)] = sums[left] + sums[right]
        made += len(left)
    got = [int(sums[graph.top[a:b]].sum()) for a, b in zip(graph.bounds[:-1], graph.bounds[1:], strict=True)]
    assert got == [sum(int(part[t]) * n for t, x in enumerate(held) for i, n in x if i == item) for item in range(12)]
    assert len(graph.top) < sum(len(x) for x in held) / 2


def toxic_corpus(n=240):
    rng = np.random.default_rng(11)
    plain, bad = [f"p{k}" for k in range(300)], ["scoundrel", "blockhead", "numskull"]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(plain, 80, p=np.arange(300, 0, -1) / np.arange(300, 0, -1).sum()))
        if k % 2:
            for at in rng.integers(0, 80, 6):
                text[at] = str(rng.choice(bad))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, k % 2))
    return rows, labels


def test_toxicity_learns_and_keeps_its_fold(spark):
    rows, labels = toxic_corpus()
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "p1 p2 blockhead numskull scoundrel blockhead"), (1003, "p1 " * 5000), (3, rows[3][1])]
    known = spark.createDataFrame([*labels, (3, 1, 0), (9999, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.assess(frame(spark, rows), known).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    truth = {k: t for k, _, t in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r.score for r in found}
    assert by[1000] == by[1001] == by[1002] < 0.3 and by[1003] < 0.5 and by[None] > 0.7
    # labels of the held-out fold, other columns and the order of the rows aren't inputs
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.assess(frame(spark, rows[::-1]).withColumn("score", F.lit("x")), flipped).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in found)


def test_toxicity_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert [r.score for r in toxicity.assess(docs, none).collect()] == [0.5, 0.5]
    assert toxicity.assess(frame(spark, []), none).collect() == []
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score > 0.9 for r in toxicity.assess(docs, one).collect()} == {True}


def test_shared_counts_are_those_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PENDING", 5)
    texts = ["a b c", "b c a b", "c c d", None, "", "z a z b y a", "a b c"]
    known = ["a", "b", "c"]
    vocabulary = toxicity.Vocabulary(alnum.words_of(pa.array([" ".join(known)])).hashes())
    number = dict(zip(known, vocabulary.numbers(alnum.words_of(pa.array([" ".join(known)])).hashes()), strict=True))
    counts = toxicity.shared_counts(frame(spark, list(enumerate(texts))), vocabulary)
    pairs = {(number.get(a, 0) if a else 1, number.get(b, 0)) for t in texts for a, b in zip([None, *words(t)], words(t), strict=False)}
    assert {w: c for w, c in enumerate(counts) if c} == dict(Counter(b for _, b in pairs))
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 50, 1000))
    assert (toxicity.unpacked(toxicity.packed(keys), len(keys)) == keys).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    size, base = 50, np.full(50, 1 / 50)
    words_in = rng.integers(2, size, 4000) ** 2 // size + 0
    follows = np.ones(4000, bool)
    follows[::40] = False
    first = np.where(follows, np.concatenate(([1], words_in[:-1])), 1)
    pairs, counts = toxicity.distinct_contexts(first * size + words_in, follows, size)
    for d in toxicity.DISCOUNTS:
        model = toxicity.ClassModel((pairs, counts), (pairs[::2], counts[::2] // 9), size, base, *d)
        assert abs(model.single.sum() - 1) < 1e-9
        for v in range(size):
            own = model.keys // size == v
            total = model.pair[own].sum() + model.left[v] * model.single.sum()
            assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("module, name", [(importance, "op11_importance"), (lexical, "op12_lexical_search")])
def test_queries_match_their_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(module.SQL)
    names = [c[0] for c in wanted.description]
    assert sorted((tuple(r[n] for n in names) for r in getattr(module, name)(spark, SF).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_toxicity_knows_new_forms_of_words(spark):
    # every form of the toxic word stands in one document only, so the held-out ones have forms that no labelled text has
    rng = np.random.default_rng(13)
    plain = [f"p{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        text = list(rng.choice(plain, 80))
        if k % 2:
            for at in range(0, 80, 20):
                text[at] = f"Grünsch{k}x{at}"
        rows.append((k, " ".join(text)))
        labels.append((k, 1, k % 2))
    found = toxicity.assess(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    assert len(found) > 100 and all(r.predicted == r.doc_id % 2 for r in found)


def test_rare_words_of_a_class_stay_known_in_a_large_corpus():
    # all contexts of a rare toxic word are new ones in the corpus, those of frequent words were seen long ago
    size, word, base = 60, 50, np.ones(60)
    first, second = np.divmod(np.arange(2, 42 * 10), 10)
    plain = (np.sort((first + 2) * size + second + 2), np.ones(len(first), np.int64))
    toxic = np.unique(np.concatenate((plain[0], np.arange(2, 42) * size + word)))
    base[word] = 40
    model = toxicity.ClassModel((toxic, np.ones(len(toxic), np.int64)), plain, size, base / base.sum(), *toxicity.DISCOUNTS[0])
    assert model.own[word]


def test_beginnings_of_words():
    found = alnum.words_of(pa.array(["Straßenbahn straße strand", None, "stra é éééééé ééééé9 " + "x" * 4 + "ü", "str"])).beginnings(5)
    whole = ~alnum.words_of(pa.array(["straß straß stran stra é ééééé ééééé xxxxü str"])).hashes()
    assert (found == whole).all()
    assert len(alnum.words_of(pa.array(["", None])).beginnings(5)) == 0
