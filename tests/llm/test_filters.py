"""op1, op3, op4: url filters, quality, licences."""

import math
import textwrap
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeloom.llm import jaccard_join, licenses, quality, url_filter

SF = "/root/testdata/sf0.01"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>x</p>", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def by_hand(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best


URLS = ["http://A.Example.com/en/7x", "https://b.example.com/en/5?q#f", "x://sub.net/de/1", "http://example.net/de/81", "http://example.net/de/9", "https://a.org/es/x", "https://org/fr/", None, "", "no scheme", "http://", "http://É.com/EN/", "HTTP://com?/en/", "a://b://c/d", "http://" + "y" * 5000 + ".com/fr/"]


def test_url_parts_and_rules(spark):
    rows = {r.page_id: r for r in url_filter.judge(pages(spark, URLS * 2)).collect()}
    assert len(rows) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        host, path, rule = by_hand(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule.name), url
        assert rows[i].verdict in ("allow", "block")
        if rule:
            assert rows[i].verdict == rule.verdict
        else:
            assert rows[i].verdict == ("allow" if rows[i].score >= rows[i].threshold else "block")


def brute_models(urls, order=url_filter.ORDER):
    """score(url) of models counted by hand from {(url, n, accepted)}."""
    grams = {True: {}, False: {}}
    for url, n, accepted in urls:
        text = url_filter.START * order + url
        for i in range(order, len(text)):
            for k in range(order + 1):
                for key in (("gram", text[i - k : i + 1]), ("seen", k, text[i - k : i])):
                    grams[accepted][key] = grams[accepted].get(key, 0) + n
    kinds = {}
    for side in (True, False):
        for key in grams[side]:
            if key[0] == "gram":
                kinds[side, key[1][:-1]] = kinds.get((side, key[1][:-1]), 0) + 1

    def p(side, context, c):
        low = p(side, context[1:], c) if context else url_filter.FLOOR
        seen = grams[side].get(("seen", len(context), context), 0)
        if seen < url_filter.LEAST_SEEN:
            return low
        return (grams[side].get(("gram", context + c), 0) + kinds[side, context] * low) / (seen + kinds[side, context])

    def score(url):
        text = url_filter.START * order + url
        ratios = [math.log(p(True, text[i - order : i], text[i]) / p(False, text[i - order : i], text[i])) for i in range(order, len(text))]
        return sum(ratios) / len(ratios) if ratios else 0.0

    return score


def brute_threshold(scored):
    """The bin with the least sum of both error rates of (score, accepted), ties nearest 0."""
    good, bad = [s for s, a in scored if a], [s for s, a in scored if not a]
    if not good or not bad:
        return 0.0
    place = lambda s: max(-url_filter.RANGE * url_filter.STEPS, min(url_filter.RANGE * url_filter.STEPS, math.floor(s * url_filter.STEPS)))
    bins = {place(s) for s, _ in scored}
    errors = {b: sum(place(s) < b for s in good) / len(good) + sum(place(s) >= b for s in bad) / len(bad) for b in bins}
    return min(bins, key=lambda b: (round(errors[b], 12), abs(b), b)) / url_filter.STEPS


@pytest.mark.parametrize("given", ["table", "edges"])
def test_url_verdicts_are_brute_force(spark, given):
    df = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url") if given == "table" else pages(spark, URLS * 3).select("page_id", "url")
    df = df.union(df.limit(5)).union(spark.createDataFrame([(None, "http://x.example.com/fr/é?q=日本"), (None, None)], "page_id long, url string"))
    rows = [(r.page_id, r.url) for r in df.collect()]
    urls = {}
    for _, url in rows:
        if url:
            urls[url] = urls.get(url, 0) + 1
    ruled = {url: (n, by_hand(url)[2].verdict == "allow") for url, n in urls.items() if by_hand(url)[2]}
    held = {url: zlib.crc32(url.encode()) % url_filter.FOLDS == 0 for url in urls}
    score = brute_models([(url, n, a) for url, (n, a) in ruled.items() if not held[url]])
    limit = brute_threshold([(score(url), a) for url, (n, a) in ruled.items() if held[url] for _ in range(n)])
    want = []
    for page_id, url in rows:
        rule, mark = by_hand(url)[2], score(url or "")
        want.append((page_id, rule.verdict if rule else "allow" if mark >= limit else "block", round(mark, 6)))
    found = url_filter.judge(df).collect()
    assert {r.threshold for r in found} == {limit}
    order = lambda x: repr(x)
    assert sorted(((r.page_id, r.verdict, round(r.score, 6) + 0.0) for r in found), key=order) == sorted(((i, v, m + 0.0) for i, v, m in want), key=order)


def test_url_models_read_whole_urls(spark):
    urls = [f"http://h{i}.example.com/en/{'7' if i % 2 else ''}{i}?track={'yes' if i % 2 else 'no'}#x" for i in range(60)] + ["http://other.org/a?track=yes", "http://other.org/a?track=no", "ftp://other.org/a", "http://other.org/A"]
    rows = {r.page_id: r.score for r in url_filter.judge(pages(spark, urls)).collect()}
    assert rows[60] > rows[61] and len({rows[i] for i in range(60, 64)}) == 4


def test_url_empty(spark):
    assert url_filter.judge(pages(spark, []).limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://a.b/c"])).collect()} == {"allow"}


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.assess(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= quality.CUT for g in good]) > 0.97


def test_quality_never_learns_from_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.assess(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edges(spark):
    schema = "doc_id long, text string, lang string, score int, predicted int"
    docs = spark.createDataFrame([(1, None, "x", 5, 5), (2, "", None, None, 1), (3, "word " * 50_000, "x", 1, 1), (3, "again", "x", 1, 1), (None, "no id", "x", 1, 1)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.assess(docs.limit(0), labels).count() == 0
    assert {round(r.score, 2) for r in quality.assess(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_reads_texts_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), (F.col("n_chars") * 0).alias("n_chars"), "doc_id", F.lit(1.0).alias("score")).toDF("doc_id", "text", "lang", "source", "n_chars", "old_id", "score")
    a = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    b = {r.old_id: r.score for r in quality.score(other, model).collect()}
    assert a == b
    mixed = {r.doc_id: r.score for r in quality.assess(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")), labels).collect()}
    assert mixed == {r.doc_id: r.score for r in quality.assess(docs, labels).collect()}


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i} of many words {i * i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, quality int")
    got = quality.sample(docs, labels, rows=2).collect()
    assert len(got) == len({r.doc_id for r in got}) == 4 and sorted(r.quality for r in got) == [0, 0, 1, 1]
    one = quality.sample(docs, labels, rows=2, cells=1).collect()
    assert sorted(r.quality for r in one) == [0, 1] and {r.doc_id for r in one} <= {r.doc_id for r in got}


def brute_indicators(text):
    """Distinct byte n-grams with digits as 0, and the runs of one word, as plain objects."""
    raw = bytes(48 if 48 <= c <= 57 else c for c in text.encode())
    grams = {raw[i : i + n] for n in quality.ORDERS for i in range(len(raw) - n + 1)}
    words, run, most = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ") if w], 0, 0
    for i, w in enumerate(words):
        run = run + 1 if i and words[i - 1] == w else 1
        most = max(most, run)
    return grams | {("run", n) for n in range(2, min(most, quality.RUN) + 1)}


def test_support_vectors_are_brute_force(spark):
    """Dense projected gradient on the same dual, from n-grams gathered by hand, gives the margins of the fitted model."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [t[:300] if i % 3 else " ".join(t.split()[:3] * 12) for i, t in enumerate(texts)]
    good = np.arange(len(texts)) % 3 != 0
    sets = [brute_indicators(t) for t in texts]
    names = sorted(set().union(*sets), key=repr)
    dense = np.array([[n in s for n in names] for s in sets], float)
    # the table of hashed indicators also has room for those of no text, which the log-count ratio counts from 1
    empty = quality.SIZE - len(names)
    p, q = 1 + dense[good].sum(axis=0), 1 + dense[~good].sum(axis=0)
    ratio = np.log((p / (p.sum() + empty)) / (q / (q.sum() + empty)))
    x = dense * ratio
    x = np.hstack([x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True)), np.ones((len(x), 1))])
    y = np.where(good, 1.0, -1.0)
    upper = np.where(good, len(y) / (2 * good.sum()), len(y) / (2 * (~good).sum()))
    kernel = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - rate * (kernel @ alpha - 1), 0, upper)
    want = x @ ((alpha * y) @ x)

    found, bounds = quality.indicators(pa.array(texts))
    rows = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    values = quality.log_count_ratio(rows, good, quality.SIZE)
    weights, bias = quality.dual_descent(rows, values, good, epochs=2000)
    margin = quality.margins(found, bounds, weights, values, bias)
    assert np.abs(margin - want).max() < 0.02
    assert ((margin > 0) == (want > 0)).all()


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate((rng.integers(0, 50, 8), [60 if i % 2 else 61]))) for i in range(80)]
    good = np.arange(80) % 2 == 1
    values = quality.log_count_ratio(rows, good, 64)
    weights, bias = quality.dual_descent(rows, values, good)
    margin = quality.margins(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), weights, values, bias)
    assert ((margin > 0) == good).all()


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_indicators_of_a_slice_read_its_own_bytes():
    texts = pa.array([f"row {i} " + "abcdefg " * 120 for i in range(20_000)])  # 20 MB
    part = texts.slice(10_000, 8)
    assert peak_mb(lambda: quality.indicators(part)) < 5
    found, bounds = quality.indicators(part)
    again = quality.indicators(pa.array(part.to_pylist()))
    assert found.tolist() == again[0].tolist() and bounds.tolist() == again[1].tolist()


def test_a_score_is_the_same_in_any_batch():
    rng = np.random.default_rng(3)
    texts = pa.array([None, "", *("".join(rng.choice(list("abcdef 01"), n)) for n in rng.integers(1, 900, 300)), None])
    model = quality.QualityModel([], np.zeros(0, bool))
    model.values, model.weights, model.curve = rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=quality.SIZE).astype(np.float32), (1.0, 0.1)
    alone = np.concatenate([model.scores(texts.slice(i, 1)) for i in range(len(texts))])
    assert model.scores(texts).tolist() == alone.tolist() and alone[0] == alone[1] == 1 / (1 + np.exp(-0.1))


@pytest.mark.parametrize("work", ["score", "facts", "heads"])
def test_a_batch_of_long_texts_takes_little_memory(work):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(words, 330)) for _ in range(4000)]  # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    def scored():
        class Docs:  # takes the function that Spark would send to its workers
            schema = quality.StructType([])

            def drop(self, name):
                return self

            def mapInArrow(self, run, schema):
                return run

        model = quality.QualityModel([], np.zeros(0, bool))
        return quality.score(Docs(), model)([batch])

    run = {"score": scored, "facts": lambda: jaccard_join._facts(5, 80)([batch]), "heads": lambda: jaccard_join._heads(5, 80, np.arange(1 << 16), np.ones(1 << 16, bool))([batch])}[work]
    assert peak_mb(lambda: [None for _ in run()]) < 45


def test_longest_runs():
    assert quality.longest_runs(pa.array(["a a a b", None, "", "x", "a b a", "z " * 40])).tolist() == [3, 0, 0, 1, 1, quality.RUN]


def test_license_edges(spark):
    texts = [(1, "some words before it\nReleased under the MIT license!\nand some more words"), (2, licenses.TEMPLATES["ISC"].replace(". ", ".\n")), (3, None), (4, ""), (5, "Licensed under the Apache License"), (6, "word " * 50_000), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, license string")
    found = {(r.doc_id, r.license): (r.dice, r.hits) for r in licenses.scan(docs).collect()}
    assert found[1, "MIT-notice"] == (1.0, 1) and found[2, "ISC"] == (1.0, 1) and found[7, "CC-BY-NC-4.0-notice"] == (1.0, 3)  # both lines, and their paragraph
    assert not {3, 4, 6} & {i for i, _ in found}
    for (i, name), (dice, _) in found.items():
        assert dice >= licenses.LEAST
    assert licenses.scan(docs.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.

You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.

See the License for the specific language governing permissions and
limitations under the License."""


def test_license_over_paragraphs(spark):
    isc = licenses.TEMPLATES["ISC"].replace("copies. THE", "copies.\n\nTHE")
    around = "\n".join(f"line {i} says nothing" for i in range(30))
    texts = [MIT, APACHE, f"The MIT License\n\nCopyright (c) 2020 Some One\n\n{MIT}\n\n\n{around}", f"{MIT}\n\n{MIT}", isc, f"{around}\n{MIT.replace(chr(10) * 2, chr(10))}\n{around}", MIT.split("\n\n")[0], MIT.replace("\n\n", "\r\n \t\r\n" + "foo\n\n" * 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.license): (r.dice, r.hits) for r in licenses.scan(docs).collect()}
    # runs over several paragraphs, so no line or paragraph matches by itself, but in one paragraph it does
    assert found[0, "MIT"] == (1.0, 0) and found[1, "Apache-2.0-header"] == (1.0, 0) and found[2, "MIT"] == (1.0, 0)
    assert found[3, "MIT"] == (1.0, 0) and found[4, "ISC"][0] == 1.0 and found[5, "MIT"] == (1.0, 1)
    assert (6, "MIT") not in found and found[7, "MIT"][0] > 0.95


def test_license_size_bounds():
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n, 0.8)
        fits = [m for m in range(1, 200) if 2 * min(m, n) / (m + n) >= 0.8]
        assert (lo, hi) == (fits[0], fits[-1])


def test_telling_words_lose_nothing():
    words = licenses.telling_words(licenses.TEMPLATES)
    for text in licenses.TEMPLATES.values():
        grams = licenses.template_bigrams(text)
        left = [g for g in grams if not any(w.startswith(t) for w in g.split() for t in words)]
        # without a telling word even the largest part of the template stays below the threshold
        assert 2 * len(left) / (len(left) + len(grams)) < licenses.LEAST


def published(text, mark=""):
    """A template as a source file has it: an empty line after every second sentence, lines of 70 characters."""
    sentences = text.split(". ")
    blocks = [". ".join(sentences[i : i + 2]) + "." for i in range(0, len(sentences), 2)]
    return f"\n{mark}\n".join("\n".join(mark + line for line in textwrap.wrap(b, 70)) for b in blocks)


def test_every_template_is_found_as_published(spark):
    assert len(licenses.TEMPLATES) >= 25
    names = sorted(licenses.TEMPLATES)
    texts = [f"Copyright 2021 A. Uthor\n\n{published(licenses.TEMPLATES[n], mark)}\n\nThe rest of the file says this." for n in names for mark in ("", "// ", " * ")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    for i in range(len(texts)):
        assert (i, names[i // 3]) in found, names[i // 3]


def test_license_scan_equals_sql(spark):
    notice = "Released under the MIT License."
    texts = [f"_{notice.replace(' ', '_')}_", notice.replace(" ", "-"), f"é{notice}", f"x\u00a0{notice}", f"日{notice}日", notice.replace(" ", "\u2003"), f"a{notice}", notice.upper(), MIT, APACHE, f"{MIT}\n\n{MIT}", "\n".join(["Released", "under the", "", "MIT", "License"] * 3), None, "", "word " * 3000, "\n" * 500 + notice,
        f"one line\r\n{notice}\r\n\r\n{notice}\r\nlast", published(licenses.TEMPLATES["Zlib"], "# "), published(licenses.TEMPLATES["BSD-2-Clause"]), "This work is\nlicensed under the GNU\nGeneral Public License,\nversion 3."]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, notice, "a"), (3, notice, "a"), (None, notice, "b"), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    order = lambda x: repr(x)
    found = sorted(((r.doc_id, r.license, r.dice, r.hits) for r in licenses.scan(docs).collect()), key=order)
    assert found == sorted(con.sql(licenses.SQL).fetchall(), key=order)
    assert {(0, "MIT-notice"), (1, "MIT-notice"), (5, "MIT-notice"), (8, "MIT"), (11, "MIT-notice"), (None, "MIT-notice")} <= {f[:2] for f in found}
    assert next(f for f in found if f[0] == 3)[3] == 3


def test_license_runs_of_repeating_lines(spark):
    rng = np.random.default_rng(9)
    words = licenses.TEMPLATES["ISC"].split()
    lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    texts = ["\n".join(lines * 3), "\n\n".join(lines[1:] + lines[:4] + lines[2:])]
    for _ in range(4):
        mine = list(lines)
        for at in rng.integers(0, len(mine), 5):
            mine.insert(int(at), str(rng.choice([*lines, "some other words here", ""])))
        texts.append("\n".join(mine))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    wanted = con.execute(licenses.SQL).fetchall()
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, round(r.dice, 6), r.hits) for r in found) == sorted((a, b, round(c, 6), d) for a, b, c, d in wanted) and len({r.doc_id for r in found}) == len(texts)
