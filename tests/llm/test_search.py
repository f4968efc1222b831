"""op5, op7, op8: top-k, SpotSigs, Jaccard join."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.llm import jaccard_join, shingles, spotsigs, topk
from placeloom.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 3, 50])
def test_topk_brute_force(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(1)]) for i in range(120)] + [(200 + i, [0.5] * 12) for i in range(10)]
    rows += [(300, None), (301, [1.0, float("nan")] * 6), (302, [None] * 12), (303, [float("inf")] * 12), (304, [1.0] * 5), (305, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k, tile=40, block=3).collect())
    ints = {i: np.array([np.floor(64 * x) for x in v] + [0] * (12 - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 20 == 0:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert found == sorted(want)


def brute_topk(rows, k):
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(rows) if n != at)[:k]
            want += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


@pytest.mark.parametrize("size", [1.0, 2e5, 1e9, 1e12])
def test_topk_repeated_ids_and_large_values(spark, size):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in (rng.normal(size=64) * size).round(2)]) for i in rng.integers(0, 30, 50)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5, tile=16, block=4).select("query_id", "rank", "vec_id", "score").collect())
    assert found == brute_topk([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 5)


def test_topk_prunes_without_loss():
    rng = np.random.default_rng(6)
    vectors = np.floor(64 * rng.normal(size=(6000, 48)) * np.geomspace(4, 0.25, 48))
    todo = topk.Search(np.arange(40), vectors[:40], 10)
    for lo in range(0, 6000, 1000):
        todo.tile(np.arange(lo, lo + 1000), np.arange(lo, lo + 1000), np.ascontiguousarray(vectors[lo : lo + 1000].T))
    assert todo.summed < 0.7 * todo.pairs
    every = vectors[:40] @ vectors.T
    for i, scores, ids in todo.found():
        want = sorted((-every[i, j], j) for j in range(6000) if j != i)[:10]
        assert [(-s, j) for s, j in zip(scores, ids, strict=True)] == want


def test_topk_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_chars string")


def test_edited_documents(spark):
    texts = [(1, "The quick brown fox and the lazy dog of a village run"), (5, ""), (9, None), (12, "né é " * 40), (13, "The quick brown fox and the lazy dog of a village run"), (40, "the of a"), (41, "word " * 20_000), (42, "la The " * 30_000)]
    rows = {r.doc_id: r for r in spotsigs.edited_documents(docs(spark, texts)).collect()}
    order = sorted(rows, reverse=True)
    plain = {i: t or "" for i, t in texts}
    for at, i in enumerate(order):
        follow = plain[order[(at + 1) % len(order)]]
        n = len(plain[i])
        edited = plain[i][: n - n // 2] + follow[: n // 2]
        assert rows[i].n_chars == n and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[1].fingerprint == rows[13].fingerprint != rows[12].fingerprint
    assert rows[5].fingerprint == rows[9].fingerprint
    one = spotsigs.edited_documents(docs(spark, texts[:1])).collect()
    assert one[0].near_next == 1.0
    assert spotsigs.edited_documents(docs(spark, []).limit(0)).count() == 0


def brute_signatures(text, chain=spotsigs.CHAIN):
    words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.lower()) if w]
    anchors, found = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchors:
            after = tuple([x for x in words[i + 1 :] if x not in anchors][:chain])
            if after:
                found.add((w, *after))
    return found or {("whole", 0, text), ("whole", 1, text)}


def check_edited(rows, found):
    """rows: (doc_id, text) in descending order of the ids; found: rows of edited_documents in that order."""
    prints = {}
    for at, ((doc_id, text), r) in enumerate(zip(rows, found, strict=True)):
        follow = rows[(at + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 2] + follow[: n // 2]
        own, changed, after = (brute_signatures(t) for t in (text, edited, follow))
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.n_signatures == len(own)
        for other, likeness in ((changed, r.near_edited), (after, r.near_next)):
            want = len(own & other) / len(own | other)
            assert likeness == pytest.approx(want, abs=1e-12)
        for sigs, name in ((own, r.fingerprint), (changed, r.edited_fingerprint)):
            assert prints.setdefault(frozenset(sigs), name) == name
    assert len(set(prints.values())) == len(prints)


def test_edited_documents_are_brute_force(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(spotsigs.edited_documents(some).collect(), key=lambda r: -r.doc_id)
    check_edited([(r.doc_id, r.text or "") for r in some.orderBy(F.desc("doc_id")).collect()], found)


def test_edited_documents_of_repeated_and_missing_ids(spark):
    twice = spotsigs.edited_documents(docs(spark, [(1, "b"), (1, "a"), (2, "c of the d"), (None, "d"), (None, None), (2, "c of the d")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in twice) == [(False, 1, 1), (False, 1, 1), (False, 2, 10), (False, 2, 10), (True, 0, 0), (True, 0, 1)]
    # of the two equal rows one is the other's next
    assert 1.0 in [r.near_next for r in twice if r.doc_id == 2]


def test_spot_signatures_by_hand(spark):
    df = spotsigs.with_signatures(docs(spark, [(1, "The red fox of the big old village. An end"), (2, "none here"), (3, "of the")]), "text", "sigs", anchors=["the", "of", "an"], chain=2)
    sigs = {r.doc_id: r.sigs for r in df.collect()}
    spots = [("the", "red", "fox"), ("of", "big", "old"), ("the", "big", "old"), ("an", "end", None)]
    want = spark.range(1).select(F.array_sort(F.array(*[F.xxhash64(*[F.lit(x) for x in spot]) for spot in spots]))).first()[0]
    assert sigs[1] == want and len(sigs[2]) == len(sigs[3]) == 2


@pytest.mark.parametrize("tile", [3, 1024])
def test_spotsigs_pairs_are_brute_force(spark, tile):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    hot = [(1000 + i, f"The shared start of a passage that is everywhere, and w{i} for the end of it. A tail on the text with a mark") for i in range(12)]
    some = some.select("doc_id", "text").union(spark.createDataFrame(hot, "doc_id long, text string"))
    pairs = spotsigs.near_pairs(some, 0.6, tile).collect()
    found = {(r.left, r.right) for r in pairs}
    assert len(found) == len(pairs) and spotsigs.near_pairs(some.limit(0)).count() == 0
    sets = {}
    for r in spotsigs.with_signatures(some, "text", "sigs").withColumn("fp", spotsigs.fingerprint(F.col("sigs"))).collect():
        sets[r.fp] = set(r.sigs)
    names = sorted(sets)
    assert found == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def brute_components(texts, size, percent):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = {i: [w for w in low(t).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] for i, t in texts.items()}
    sets = {i: ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components_are_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = np.random.default_rng(5)
    texts, base = {}, [f"w{x}" for x in rng.integers(0, 400, 120)]
    for i in range(60):
        mine = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            mine[at] = f"n{rng.integers(0, 50)}"
        texts[i] = " ".join(mine)
    for i in range(60, 90):
        texts[i] = " ".join(f"v{x}" for x in rng.integers(0, 30, rng.integers(1, 25)))
    texts |= {100: None, 101: "", 102: " \n\t ", 103: "One two", 104: "ONE  two", 105: "ß É", 106: texts[3], 107: texts[3].upper(), 108: "a " * 30_000}
    rows = jaccard_join.similar_components(docs(spark, list(texts.items())), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, size, percent)


def test_join_edges(spark):
    rows = jaccard_join.similar_components(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    # a row for each document; one without doc_id links with nothing
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == sorted([(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, None)], key=repr)
    assert jaccard_join.similar_components(docs(spark, []).limit(0)).count() == 0
    kept = jaccard_join.one_of_each(docs(spark, [(3, "a b c d e f"), (2, "A b c d e f"), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4] and kept.columns == ["doc_id", "text", "n_chars"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=40), st.sampled_from([50, 80, 90]))
def test_tree_loses_no_pair(sets, percent):
    arrays = [np.sort(shingles.mixed(np.array(sorted(s), np.uint64))) for s in sets]
    found = jaccard_join.block_links(arrays, np.zeros(len(sets), np.int64), percent)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                assert find(a) == find(b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100} and found[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    words, row = shingles.word_hashes(pa.array(["Ab c\nab", None, " ", "É ab"]))
    assert row.tolist() == [0, 0, 0, 3, 3] and words[0] == words[2] == words[4] and len(set(words.tolist())) == 3
