"""op2, op6, op9, op10 and the pipeline: packing, mixing, sharding, token records."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from placeloom.llm import common, jaccard_join, mixing, packing, quality, sharding, token_records, tokenizing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")


EDGES = [(1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, "x " * 30_000, "t"), (5, "one\x0btwo\u00a0three", None), (6, "a b c", "u"), (9, "a b c", "")]


def test_encoder_equals_whole_texts():
    encoder = tokenizing.TextEncoder(VOCABULARY)
    random.seed(2)
    alphabet = [" ", " ", "a", "B", "'", "s", "1", "\n", "\t", ".", "!", "é", "\u00a0", "日", "-", "\u0301", "…"]
    texts = ["", None, "a  b", "a \n b", "don't, it's", "<|endoftext|> z", "x\ny.\nZ", "w" * 200] + ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)]
    ids, lengths = encoder.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert got.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 20)
    encoder = tokenizing.TextEncoder(VOCABULARY)
    for part in range(6):
        texts = [f"word{part} again {i} word" for i in range(part * 7, part * 7 + 12)]
        ids, lengths = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def whole(rows, end):
    encode = tokenizing.TextEncoder(VOCABULARY).tokenizer.encode
    return [(i, encode(t or "", add_special_tokens=False).ids + [end]) for i, t, *_ in rows]


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(spark, window):
    rows = EDGES + [(100 + i, " ".join(f"w{i * j}" for j in range(i * 7 % 90)), "s") for i in range(150)]
    pieces = packing.packed_documents(docs(spark, rows), VOCABULARY, window).collect()
    ids = dict(whole(rows, packing.END))
    for doc_id, x in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(x) and p.ids_crc32 == crc(x[at : at + p.length])
            at += p.length
        assert at == len(x)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    assert padding <= 0.02 * sum(map(len, ids.values())) + window
    assert packing.packed_documents(docs(spark, []).limit(0), VOCABULARY).count() == 0


def test_packing_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "other", "s"), (None, "a b c", "s"), (None, None, "s")]
    pieces = packing.packed_documents(docs(spark, rows), VOCABULARY, 64).collect()
    sizes = [len(ids) for _, ids in whole(rows, packing.END)]
    assert sum(p.length for p in pieces) == sum(sizes)
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in pieces if p.start == 0) == sorted((r[0] or 0, n) for r, n in zip(rows, sizes, strict=True))


def test_least_squares_and_plan():
    columns = [{1: 2}, {1: 1, 2: 1}]
    assert packing.least_squares(columns, np.array([0.0, 30.0, 10.0])) == pytest.approx([10, 10], abs=1)
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 33, 20_000), minlength=33)
    plan = packing.repeats(histogram)
    used = np.zeros(33, int)
    for c, times in plan:
        assert sum(c) == 32 and times > 0
        for n in c:
            used[n] += times
    assert (used <= histogram).all() and used.sum() > 0.9 * histogram.sum()


def test_mixing(spark):
    rows = EDGES + [(100 + i, "w " * (i % 13), f"src{i % 5}" if i % 7 else None) for i in range(200)]
    found = {r.doc_id: r for r in mixing.mix(docs(spark, rows)).collect()}
    assert found == {r.doc_id: r for r in mixing.mix(docs(spark, rows).repartition(7)).collect()}
    sums, taken, target = {}, {}, {}
    for i, t, s in rows:
        n = len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
        assert found[i].size == n and 0 <= found[i].taken <= 2 * n
        sums[s], taken[s] = sums.get(s, 0) + n, taken.get(s, 0) + found[i].taken
        target[s] = found[i].target
    order = sorted((s for s in sums if s is not None)) + [s for s in sums if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9  # the level by bisection
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sums[s], mid * weight[s]) for s in sums) < 1.5 * sum(sums.values()) else (low, mid)
    for s in sums:
        assert target[s] == pytest.approx(min(2 * sums[s], low * weight[s]), rel=1e-6)
        assert taken[s] == int(target[s] + 1e-9) and all(found[i].source_size == sums[s] for i, _, x in rows if x == s)
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}
    again = mixing.mix(docs(spark, [(1, "a b", "a"), (1, "a b", "a"), (None, "c", "a"), (None, "c", "a")])).collect()
    assert len(again) == 4 and sum(r.taken for r in again) == 9 and all(r.taken <= 2 * r.size for r in again)


def test_mixed_documents(spark):
    rows = [(i, "w " * (1 + i % 13), f"src{i % 4}") for i in range(100)]
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(docs(spark, rows)).collect()}
    out = mixing.mixed_documents(docs(spark, rows))
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert out.columns == ["doc_id", "text", "source", "size"] and copies == {i: int(np.ceil(t)) for i, t in taken.items() if t > 0}


def brute_capacity(sizes, shards):
    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        cuts = sharding.greedy_cuts(sizes, mid)
        low, high = (mid, high) if cuts is None or len(cuts) > shards else (low, mid)
    return high


@pytest.mark.parametrize("looked_at", [0, 100_000])
def test_sharding(spark, looked_at, monkeypatch):
    monkeypatch.setattr(sharding, "LOOKED_AT", looked_at)
    rows = EDGES + [(100 + i, f"text {i % 120} " * (i % 120 % 17), "s") for i in range(300)] + [(900 + i, "hot group", "s") for i in range(200)]
    found = {r.doc_id: r for r in sharding.shard(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    groups, slots = {}, {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        assert (found[i].size, found[i].text_crc32, found[i].law, found[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        groups.setdefault(t or "", []).append(found[i])
        slots.setdefault(found[i].shard, []).append(found[i].slot)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    ordered = [sum(r.size for r in groups[t]) for t in sorted(groups, key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())]
    loads = {}
    for r in found.values():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) == brute_capacity(ordered, 8)
    assert sharding.shard(docs(spark, []).limit(0)).count() == 0
    again = sharding.shard(docs(spark, [(1, "a", "s"), (1, "a", "s"), (None, "a", "s"), (None, None, "s")])).collect()
    assert sorted((r.doc_id or 0, r.size) for r in again) == [(0, 1), (0, 2), (1, 2), (1, 2)]
    assert sorted(r.slot for r in again if r.size == 2) == [0, 1, 2]


def test_shard_bounds_option(spark):
    groups = spark.createDataFrame([(f"{i * 7919 % 65536:04x}" + "0" * 28, 1 + i % 50) for i in range(500)], "key string, size long")
    ordered = [r["size"] for r in groups.orderBy("key").collect()]
    for looked_at in (0, 10, 10_000):
        assert sharding.shard_bounds(groups, 8, looked_at)[1] == brute_capacity(ordered, 8)


def test_token_records(spark):
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_records.token_index(docs(spark, EDGES), common.shared_path(spark, "test"), VOCABULARY).collect())
    want, at = [], 0
    for i, ids in sorted(whole(EDGES, token_records.END)):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert found == want
    assert token_records.token_index(docs(spark, []).limit(0), common.shared_path(spark, "none"), VOCABULARY).count() == 0
    twice = token_records.token_index(docs(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b", "s")]), common.shared_path(spark, "twice"), VOCABULARY).collect()
    assert sorted(r.start for r in twice) == [0, 2, 4] and [r.doc_id for r in twice if r.start == 0] == [None]


def test_record_format_and_index(spark, tmp_path):
    manifest = token_records.write_records(docs(spark, EDGES), f"file://{tmp_path}/out", VOCABULARY, file_bytes=50).collect()
    ids = dict(whole(EDGES, token_records.END))
    for m in manifest:
        data = memoryview((tmp_path / "out" / m.file).read_bytes())
        index = np.frombuffer((tmp_path / "out" / m.file.replace(".rec", ".idx")).read_bytes(), "<i8").reshape(-1, 3)
        assert len(index) == m.records and index[:, 2].sum() == m.tokens
        for doc_id, offset, n in index[::-1]:  # any order
            got = token_records.read_record(data, offset)
            assert got[0] == doc_id and got[1].tolist() == ids[doc_id] and len(got[1]) == n
        for at in (0, 9, 20, len(data) - 1):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                where = 0
                while where < len(broken):
                    where = token_records.read_record(memoryview(bytes(broken)), where)[2]


def test_records_are_read_in_shuffled_order(spark):
    folder = common.shared_path(spark, "shuffled")
    rows = EDGES + [(None, "no id", "s"), (6, "again", "s")] + [(100 + i, f"text {i}", "s") for i in range(40)]
    manifest = token_records.write_records(docs(spark, rows), folder, VOCABULARY, file_bytes=200)
    index = token_records.record_index(manifest, folder)
    orders = []
    for seed in (1, 2):
        found = token_records.read_shuffled(index, folder, seed).collect()
        assert [r.at for r in found] == sorted(r.at for r in found)
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(whole(rows, token_records.END), key=key)
        orders.append([(r.file, r.place) for r in found])
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) and orders[0] != sorted(orders[0])
    again = token_records.read_shuffled(index, folder, 1).collect()
    assert [(r.file, r.place) for r in again] == orders[0]


def shingle_components(texts, size, percent):
    """Groups (lists of places) of texts that links of shingle sets connect, all pairs compared; texts without words alone."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "")
    words = [[w for w in low(t).split(" ") if w] for t in texts]
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set() for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return {g: [i for i in range(len(texts)) if group[i] == g] for g in group}, [len(w) for w in words]


def brute_pipeline(rows, model):
    """How often the mix holds each (doc_id, text, source) of rows, by plain loops."""
    kept = [r for r in rows if model.scores(pa.array([r[1]], pa.string()))[0] >= quality.CUT]
    groups, _ = shingle_components([r[1] for r in kept], 5, 80)
    single = [min((kept[i] for i in g), key=lambda r: r[0]) for g in groups.values()]
    _, sizes = shingle_components([r[1] for r in single], 5, 80)
    by_source = {}
    for r, n in zip(single, sizes, strict=True):
        by_source.setdefault(r[2], []).append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], n))
    order = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    total = {s: sum(n for *_, n in by_source[s]) for s in order}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), mixing.SHARE * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < level * weight[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    copies = {}
    for s in order:
        budget = int(target[s] + 1e-6)
        for _, doc_id, n in sorted(by_source[s]) * 2:
            if budget > 0 and n:
                copies[doc_id] = copies.get(doc_id, 0) + 1
                budget -= n
    return copies


def packed_copies(pieces):
    """How often each doc_id lies in the sequences whole, from pieces whose ids are checked against its tokens."""
    starts = {}
    for p in pieces:
        starts.setdefault((p.doc_id, p.doc_tokens), {}).setdefault(p.start, []).append(p)
    copies = {}
    for (doc_id, n), at in starts.items():
        tokens = sum(p.length for ps in at.values() for p in ps)
        assert tokens % n == 0
        copies[doc_id] = copies.get(doc_id, 0) + tokens // n
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return copies


def test_pipeline_is_brute_force(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in documents.orderBy("doc_id").collect()]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert packed_copies(pieces) == brute_pipeline(rows, quality.fit(documents, labels))
    encode = tokenizing.TextEncoder(VOCABULARY).tokenizer.encode
    text = {i: t for i, t, _ in rows}
    for p in pieces[::7]:
        ids = encode(text[p.doc_id] or "", add_special_tokens=False).ids + [packing.END]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_pipeline_edges(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    ids = [(None, text(0)), (None, text(0)), (5, text(1)), (5, text(2)), (6, text(3)), (6, text(3)), (7, None), (8, ""), (9, " \n "), (10, "one"), (11, "word " * 30_000)]
    rows = spark.createDataFrame([(i, t, None if k % 3 else "s", k, "clash", 0.5) for k, (i, t) in enumerate(ids)], "doc_id long, text string, source string, size long, row_key string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, kept in (("rows", rows), ("none", rows.limit(0))):
        kept.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/rows")
        assert docs.columns == rows.columns
    # without labels every document stays; of copies one; the mix takes no text without words
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert set(packed_copies(pieces)) == {None, 5, 6, 10, 11} and packed_copies(pieces)[5] >= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages_keep_rows_by_their_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20 + k))
    ids = [(None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (5, text(3)), (6, text(4)), (None, text(4)), (7, None), (7, None), (None, ""), (None, None)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in ids], "doc_id long, text string, row_id string").withColumn("source", F.lit("a"))
    single = jaccard_join.one_of_each(rows)
    order = lambda x: repr(x)
    wanted = [(None, text(0)), (None, text(1)), (5, text(2)), (5, text(3)), (6, text(4))]
    assert single.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=order) == sorted([*wanted, (7, None), (None, ""), (None, None)], key=order)
    # the whole of each source twice: no row is lost or multiplied
    mixed = mixing.mixed_documents(single, share=2.0)
    assert sorted(((r.doc_id, r.text) for r in mixed.collect()), key=order) == sorted(wanted * 2, key=order)
    assert mixed.columns == rows.columns


def test_mix_tells_rows_without_id_apart_by_text(spark):
    import duckdb

    rows = [*((None, " ".join(["w"] * (1 + k % 5)) + f" t{k}", "a") for k in range(40)), *((k, f"x y {k}", "ab"[k % 2]) for k in range(20)), (None, None, "b")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    wanted = con.execute(mixing.SQL)
    names = [c[0] for c in wanted.description]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).drop("source").collect()
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(wanted.fetchall(), key=repr)
    assert {r.taken for r in found if r.doc_id is None} != {0}
