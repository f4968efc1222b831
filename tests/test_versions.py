"""Versioned publications: crashes, conflicts, names, shared buckets, events; and the user extractors' contract."""

import datetime
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle

from placeloom.operators import extractors, versions
from placeloom.sources import files

DAY = datetime.date(2024, 2, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def result(spark, rows):
    """Rows (place_id, main_min, action) as publish.publish gives them."""
    full = [(p, DAY, "fajr", 1, action, 100 + p, m, None, None, "Europe/London", p % 3, "verified") for p, m, action in rows]
    return spark.createDataFrame(full, "place_id long, slot_date date, slot string, session_no int, action string, candidate_id long, main_min int, start_min int, label string, timezone string, source_id long, confidence string")


def times(df):
    return sorted((r.place_id, r.main_min) for r in df.collect())


@pytest.fixture
def table(spark):
    return versions.VersionedTable(spark, files.shared_folder(spark, "versions"), buckets=4)


def test_versions_events_and_shared_buckets(spark, table):
    assert table.current() is None and table.rows().count() == 0 and table.events().count() == 0
    rows = [(p, 300, "published") for p in range(20)]
    first = table.publish(lambda old: result(spark, rows), "2024-02-01")
    assert (first.number, first.name, first.rows, first.first_event_id, first.last_event_id) == (1, "2024-02-01.1", 20, 1, 20)
    changed = [(7, 310, "published"), *[(p, 300, "carried") for p in range(20) if p not in (7, 8)], (8, 300, "removed")]
    second = table.publish(lambda old: result(spark, changed), "2024-02-01")
    assert second.name == "2024-02-01.2" and second.last_event_id == 22
    assert times(table.rows()) == sorted((p, 310 if p == 7 else 300) for p in range(20) if p != 8)
    assert times(table.rows(table.version(1))) == [(p, 300) for p in range(20)]
    # the buckets of places 7 and 8 alone are written anew
    anew = {k for k, b in second.buckets.items() if b.path != first.buckets.get(k, b).path}
    assert 1 <= len(anew) <= 2 and set(second.buckets) == set(first.buckets)
    assert [r.kind for r in table.events(20).orderBy("event_id").collect()] == ["occurrence_published", "occurrence_removed"]
    third = table.publish(lambda old: result(spark, [(p, m, "carried") for p, m in times(old)]), "2024-02-02")
    assert third.name == "2024-02-02.1" and third.events is None and third.buckets == second.buckets
    fourth = table.publish(lambda old: result(spark, [(p, m, "removed") for p, m in times(old)]), "2024-02-01")
    assert fourth.name == "2024-02-01.3" and fourth.buckets == {} and table.rows().count() == 0


def test_crash_before_the_log_entry_leaves_the_old_version(spark, table, monkeypatch):
    table.publish(lambda old: result(spark, [(1, 300, "published")]), "2024-02-01")
    for step in ("stage", "commit", "create_once"):
        with monkeypatch.context() as m:
            def stop(*args, **kwargs):
                raise RuntimeError("stopped")

            if step == "stage":
                m.setattr(versions.publish, "events", stop)  # the rows' files are written, nothing else
            elif step == "commit":
                m.setattr(table, "commit", stop)  # all files but the manifest
            else:
                m.setattr(versions.files, "create_once", stop)  # the manifest too
            with pytest.raises(RuntimeError):
                table.publish(lambda old: result(spark, [(2, 400, "published")]), "2024-02-01")
        assert table.current().number == 1 and times(table.rows()) == [(1, 300)] and table.events().count() == 1
    assert table.vacuum(24) == []
    lost = table.vacuum(0)
    assert lost and times(table.rows()) == [(1, 300)] and table.vacuum(0) == []
    assert table.publish(lambda old: result(spark, [(1, 300, "carried"), (2, 400, "published")]), "2024-02-01").name == "2024-02-01.2"
    assert times(table.rows()) == [(1, 300), (2, 400)]


def test_writers_at_once_lose_nothing(spark, table):
    table.publish(lambda old: result(spark, [(p, 300, "published") for p in range(3)]), "2024-02-01")

    def write(place):
        return table.publish(lambda old: result(spark, [(p, m + 1 if p == place else m, "published" if p == place else "carried") for p, m in times(old)]), "2024-02-01")

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(write, range(3)))
    assert sorted(v.number for v in got) == [2, 3, 4] and sorted(v.name for v in got) == [f"2024-02-01.{k}" for k in (2, 3, 4)]
    assert times(table.rows()) == [(0, 301), (1, 301), (2, 301)]
    assert sorted(r.event_id for r in table.events().collect()) == list(range(1, 7))


def test_a_second_writer_with_the_same_base_gets_a_conflict(spark, table):
    one, two = (table.stage(result(spark, [(p, 300, "published")]), None, "2024-02-01") for p in (1, 2))
    table.commit(one)
    with pytest.raises(versions.Conflict):
        table.commit(two)
    assert times(table.rows()) == [(1, 300)]


def test_create_once(spark, tmp_path):
    assert files.create_once(spark, f"file://{tmp_path}/a.json", "one") and not files.create_once(spark, f"file://{tmp_path}/a.json", "two")
    assert files.read_text(spark, f"file://{tmp_path}/a.json") == "one" and files.names_in(spark, f"file://{tmp_path}") == ["a.json"]
    assert files.names_in(spark, f"file://{tmp_path}/none") == []
    # any other store: a rename that doesn't replace
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./x", f"file://{tmp_path}")
    assert files.create_once(spark, "viewfs://store/x/b.json", "one") and not files.create_once(spark, "viewfs://store/x/b.json", "two")
    assert files.read_text(spark, "viewfs://store/x/b.json") == "one"


class Odd(extractors.Extractor):
    key, version, targets = "odd", "1", ("times",)

    def __init__(self, make):
        super().__init__()
        self.make = make

    def extract(self, found):
        return self.make(self, found)


def row(extractor, found, **change):
    return extractors.SlotRow(**{"slot_date": DAY, "slot": "fajr", "main_min": 300, "evidence": found.evidence(extractor, "times", notes="n"), **change})


CASES = {
    "good": lambda e, c: extractors.Result([row(e, c, more={"seen": 2})], [extractors.Warned("odd", "one")]),
    "empty": lambda e, c: extractors.Result(no_schedule_reason="jumuah_only"),
    "silent": lambda e, c: extractors.Result(),
    "undeclared": lambda e, c: extractors.Result([row(e, c, more={"unknown": 1})]),
    "late": lambda e, c: extractors.Result([row(e, c), row(e, c, main_min=1440)]),
    "slotless": lambda e, c: extractors.Result([row(e, c, slot="noon")]),
    "undated": lambda e, c: extractors.Result([row(e, c, slot_date="2024-02-01")]),
    "unproved": lambda e, c: extractors.Result([row(e, c, evidence={})]),
    "list": lambda e, c: [row(e, c)],
    "other_page": lambda e, c: c.artifact("menu"),
}


def test_extractor_contract(spark):
    sources = spark.createDataFrame([(i, "A place", "https://a.example", None, k) for i, k in enumerate([*CASES, "gone", "good"])], "source_id long, name string, url string, timezone string, extractor string")
    pages = spark.createDataFrame([(i, label, "https://a.example/t", "text/html", f"<p>{a}</p>", a) for i in range(len(CASES)) for label, a in (("times", 1), ("times", 2), ("menu", 3))], "source_id long, label string, url string, content_type string, body string, artifact_id long")
    found = extractors.run(sources, pages, {k: Odd(f) for k, f in CASES.items()}, "seen int").collect()
    by = {}
    for r in found:
        by.setdefault((r.source_id, r.extractor), []).append(r)
    good, names = by[0, "good"], list(CASES)
    assert sorted(r.record for r in good) == ["row", "warning"]
    kept = next(r for r in good if r.record == "row")
    assert (kept.slot_date, kept.main_min, kept.seen, kept.timezone) == (DAY, 300, 2, "Europe/London") and '"artifact_id": "2"' in kept.evidence and '"contract": "site_extractor/v1"' in kept.evidence
    assert [(r.record, r.message) for r in by[1, "empty"]] == [("no_schedule", "jumuah_only")]
    errors = {k: by[i, k] for i, k in enumerate(names) if i > 1}
    assert all(len(rs) == 1 and rs[0].record == "error" for rs in errors.values())
    assert {k: rs[0].code for k, rs in errors.items()} == {"silent": "ValueError", "undeclared": "ValueError", "late": "ValueError", "slotless": "ValueError", "undated": "TypeError", "unproved": "ValueError", "list": "TypeError", "other_page": "LookupError"}
    assert by[len(names), "gone"][0].message == "unknown extractor"
    # a source without pages
    assert by[len(names) + 1, "good"][0].code == "LookupError"
    with pytest.raises(ValueError):
        extractors.Extractor()
