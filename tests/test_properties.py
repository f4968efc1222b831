"""Properties that hold whatever the data: publishing twice, streams against batches, blocking against brute force."""

import datetime
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.similarity import token_sort
from placeloom.operators import contributions, crawl, export, publish, reports, resolve, websites
from placeloom.plans.directory import batch_of
from placeloom.plans.feeds import j02
from placeloom.plans.registry import frame
from placeloom.streaming import changes, outcomes

SF = "/root/testdata/sf0.001"
KEY = list(publish.KEY)


def test_publishing_twice_changes_nothing(spark):
    candidates, sources = frame(spark, SF, "candidates"), frame(spark, SF, "sources")
    batch = batch_of(candidates, sources)
    empty = batch.select(*KEY, "candidate_id", *publish.VALUES, "confidence").limit(0)
    first = publish.publish(batch, empty, sources)
    assert {r[0] for r in first.select("action").distinct().collect()} == {"published"}
    again = publish.publish(batch, first.drop("action"), sources)
    assert {r[0] for r in again.select("action").distinct().collect()} == {"carried"}
    assert publish.events(again, 0).count() == 0


def test_publish_covers_all_keys(spark):
    candidates, sources, previous = (frame(spark, SF, n) for n in ("candidates", "sources", "previous"))
    batch = batch_of(candidates, sources)
    public = sources.where("policy = 'public_redistribution_allowed'").select("source_id")
    wanted = batch.select(*KEY).union(previous.join(public, "source_id", "left_semi").select(*KEY)).distinct().count()
    result = publish.publish(batch, previous, sources)
    assert result.count() == wanted == result.select(*KEY).distinct().count()


def test_stream_of_outcomes_is_the_batch(spark):
    fetches = frame(spark, SF, "fetches")
    batch = {(r.source_id, r.failures, r.state) for r in crawl.trailing_failures(fetches).collect()}
    assert {(r.source_id, r.failures, r.state) for r in j02(fetches).collect()} == batch


def test_range_join_is_brute_force(spark):
    points = [(i, 51.0 + (i * 7919 % 997) / 30000, -1.0 + (i * 104729 % 991) / 20000) for i in range(150)] + [(900, None, 1.0), (901, 89.99, 179.9), (902, 89.99, -179.9)]
    points += [(903, 51.0, 179.9999), (904, 51.0, -179.9999), (905, 51.001, -180.0), (906, 51.0, 180.0), (907, -89.9999, 10.0), (908, -89.9999, -170.0), (909, 90.0, 0.0), (910, 89.9985, 90.0)]
    df = spark.createDataFrame(points, "a long, lat double, lon double")
    found = {(r.a, r.b) for r in resolve.within(df, df.withColumnRenamed("a", "b"), "a", "b", 700.0).collect()}
    other = df.select(F.col("a").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    every = df.crossJoin(other).where(geo.metres_between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 700.0)
    assert found == {(r.a, r.b) for r in every.collect()}
    assert {(901, 902), (903, 904), (905, 906), (907, 908), (909, 910)} <= found


def test_empty_tables(spark):
    places, records, aliases = (frame(spark, SF, n).limit(0) for n in ("places", "records", "aliases"))
    assert resolve.resolve(records, places, aliases).count() == 0
    assert {r.decision for r in resolve.resolve(frame(spark, SF, "records").limit(5), places, aliases).collect()} == {"create"}
    assert reports.source_overlap(frame(spark, SF, "sources").limit(0)).count() == 0


def test_decision_rules(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (4,)], "record_id long")
    row = lambda r, p, s, strong, ident, best: (r, p, s, ["x"], strong, ident, best)
    scored = spark.createDataFrame(
        [row(1, 10, 0.9, 2, True, 95), row(1, 11, 0.3, 1, False, 20), row(2, 10, 0.8, 2, True, 95), row(2, 11, 0.75, 2, True, 95), row(3, 10, 0.6, 1, False, 40), row(3, 12, 0.45, 1, False, 90)],
        "record_id long, place_id long, score double, reasons array<string>, strong int, identity boolean, best_ratio int",
    )
    found = {r.record_id: (r.decision, r.place_id) for r in resolve.decide(records, scored).collect()}
    assert found == {1: ("auto_link", 10), 2: ("review", 10), 3: ("review", 12), 4: ("create", None)}


def test_decisions_and_alternatives_are_those_of_all_candidates(spark):
    """Ties, equal kinds of candidates and promoted ones against a plain ranking."""
    rng = random.Random(11)
    rows = [(r, p, rng.choice((0.3, 0.5, 0.55, 0.75, 0.8)), rng.randrange(1, 4), rng.random() < 0.5, rng.choice((40, 84, 85, 95))) for r in range(120) for p in rng.sample(range(50), rng.randrange(0, 9))]
    table = spark.createDataFrame(rows, "record_id long, place_id long, score double, strong int, identity boolean, best_ratio int")
    records = spark.range(120).withColumnRenamed("id", "record_id")
    found = {r.record_id: (r.decision, r.place_id, r.score, r.alternatives) for r in resolve.decide(records, table).collect()}
    short = {r.record_id: (r.decision, r.place_id, r.score) for r in resolve.decide(records, table, alternatives=False).collect()}
    for i in range(120):
        ranked = sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1]))
        if not ranked:
            assert found[i] == ("create", None, None, None)
            continue
        best = ranked[0]
        named = next((r for r in ranked if r[5] >= 85), None)
        if best[5] < 85 and named and best[2] - named[2] <= 0.25 + 1e-9:
            best = named
        others = [r for r in ranked if r is not best]
        unclear = others and others[0][2] >= 0.5 and best[2] - others[0][2] < 0.1 - 1e-9
        decision = "auto_link" if not unclear and best[2] >= 0.75 and best[3] >= 2 and best[4] else "review"
        assert found[i] == (decision, best[1], best[2], [r[1] for r in [best, *others][:3]] if decision == "review" else None)
        assert short[i] == found[i][:3]


def test_ratios_of_names_and_aliases_are_those_of_all_pairs(spark):
    """Where a ratio rounds to 85 it is there and exact, whatever number of aliases a place has; a lower one may lack."""
    names = ["green lane hall", "hall green lane", "east centre 3", "eastern centre 33", "abab ab a", "é 12", "mosque of the east", "mosque off the eastt", ""]
    sides = lambda key: spark.createDataFrame([(i, n, "AB1 2CD", None, "GB", None, None, None, "precise", "high", "mosque") for i, n in enumerate(names)], f"{key} long, name string, postcode string, city string, country string, website string, lat double, lon double, precision string, confidence string, class string")
    other = {i: names[: i % 4] for i in range(len(names))}
    aliases = spark.createDataFrame([(i, n) for i, ns in other.items() for n in ns] + [(0, None)], "place_id long, alias string")
    found = {(r.record_id, r.place_id): (r.ratio, r.alias_ratio) for r in resolve.with_ratios(resolve.pairs_to_score(sides("record_id"), sides("place_id"), aliases)).collect()}
    assert len(found) == len(names) ** 2
    met = 0
    for (r, p), got in found.items():
        for have, wanted in zip(got, (token_sort(names[r], names[p]), max([token_sort(names[r], n) for n in other[p]], default=0.0)), strict=True):
            assert have == (pytest.approx(wanted) if wanted >= 84.5 or have is not None else None)
            met += have is not None
    assert met > 10


def test_upsert_outcomes(spark):
    day = datetime.date(2024, 1, 5)
    schema = "place_id long, source_id long, slot_date date, slot string, session_no int, candidate_id long, main_min int, start_min int, label string, timezone string, run_id long, status string"
    old = spark.createDataFrame([(1, 1, day, "fajr", 1, 5, 300, None, None, "UTC", 1, "approved"), (1, 1, day, "asr", 1, 6, 900, None, None, "UTC", 1, "approved"), (1, 1, day, "isha", 1, 7, 1200, None, None, "UTC", 2, "approved")], schema)
    new = spark.createDataFrame([(1, 1, day, "fajr", 1, 15, 300, None, None, "UTC", 2, "pending"), (1, 1, day, "asr", 1, 16, 905, None, None, "UTC", 2, "pending"), (1, 1, day, "isha", 1, 17, 1205, None, None, "UTC", 2, "pending"), (1, 1, day, "dhuhr", 1, 18, 800, None, None, "UTC", 2, "pending")], schema)
    found = {r.slot: (r.outcome, r.status) for r in publish.upsert(old, new).collect()}
    assert found == {"fajr": ("unchanged", "approved"), "asr": ("superseded", "pending"), "isha": ("updated", "pending"), "dhuhr": ("inserted", "pending")}


def test_promising_pairs_lose_nothing(spark):
    records, places, aliases = (frame(spark, SF, n) for n in ("records", "places", "aliases"))
    facts = resolve.pair_facts(resolve.block(records, places), records, places).where(resolve.plausible())
    scored = resolve.score(resolve.with_ratios(facts, aliases))
    kept = resolve.promising(records, places, aliases)
    assert kept.count() < facts.count()
    assert scored.join(kept, ["record_id", "place_id"], "left_anti").count() == 0


def test_name_marks_bound_the_ratio(spark):
    names = ["green lane hall", "hall green lane", "east centre 3", "eastern centre 33", "aaa bbb", "abab ab a", "", "é 12", "mosque of the east", "mosque off the eastt"]
    pairs = spark.createDataFrame([(a, b, token_sort(a, b)) for a in names for b in names], "a string, b string, ratio double")
    for least in (85, 92):
        fits = resolve.may_reach(resolve.name_mark(F.col("a")), resolve.name_mark(F.col("b")), least)
        assert pairs.where(F.col("ratio") >= least).where(~fits).count() == 0
        assert pairs.where(~fits).count() > 0


def test_days_by_zone():
    days = publish.days_by_zone("2024-06-04 13:00:00")
    assert len(publish.ZONES) > 300 and sum(map(len, days.values())) == len(publish.ZONES)
    assert "Pacific/Auckland" in days[datetime.date(2024, 6, 5)] and "Europe/London" in days[datetime.date(2024, 6, 4)]


def test_validation_in_a_zone(spark):
    schema = "place_id long, source_id long, candidate_id long, slot_date date, slot string, session_no int, main_min int, start_min int, timezone string, status string, evidence string, run_kind string"
    day = datetime.date(2024, 5, 28)  # seven days before 4 June
    rows = [(1, 1, k, day, "fajr", k, 300, None, z, "pending", None, "parser") for k, z in enumerate(["Europe/London", "Pacific/Auckland", "Nowhere/Else", None], 1)]
    sources = spark.createDataFrame([(1, "partner_feed", "public_redistribution_allowed")], "source_id long, source_type string, policy string")
    codes = lambda as_of: {r.candidate_id: [x.code for x in r.issues] for r in publish.validate(spark.createDataFrame(rows, schema), sources, as_of).collect()}
    assert codes("2024-06-04") == {1: [], 2: [], 3: ["invalid_timezone"], 4: []}
    # at that instant it is the fifth in Auckland already
    assert codes("2024-06-04 13:00:00") == {1: [], 2: ["date_out_of_range"], 3: ["invalid_timezone"], 4: []}


def test_late_events_come_through(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string"
    at = lambda d: datetime.datetime(2024, 1, d)
    parts = [[(5, at(20), "a"), (6, at(21), "b")], [(7, at(1), "c"), (6, at(21), "b"), (5, at(20), "a")], [(8, at(25), "d"), (8, at(25), "d"), (3, at(2), "e")]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        feed = changes.change_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 4)
        changes.drain(feed, f"{tmp_path}/out", f"{tmp_path}/cursor")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [5, 6, 7, 8]


def test_a_batch_reads_the_folders_of_its_ids_only(spark, tmp_path):
    schema = "event_id long, event_type string"
    make = lambda ids: spark.createDataFrame([(i, "a") for i in ids], schema)
    for ids in ([1, 2, 150, 999], [1000, 1001, 150]):
        make(ids).write.mode("append").parquet(f"{tmp_path}/in")
        changes.drain(changes.change_feed(spark, f"{tmp_path}/in", make([1]).schema, 0), f"file://{tmp_path}/out", f"{tmp_path}/cursor", ids=100)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 150, 999, 1000, 1001]
    read = lambda ids: {f.split("id_range=")[1].split("/")[0] for f in changes.known_ids(make(ids), f"file://{tmp_path}/out", 100).inputFiles()}
    assert read([1002]) == {"10"} and read([7, 180]) == {"0", "1"}
    assert changes.known_ids(make([5000]), f"file://{tmp_path}/out", 100) is None and changes.known_ids(make([1]), f"file://{tmp_path}/none", 100) is None


def test_outcomes_in_any_order(spark, tmp_path):
    schema = "source_id long, ts timestamp, event_id long, success boolean"
    at = lambda d: datetime.datetime(2024, 1, d)
    ahead = datetime.datetime(2124, 1, 1)
    parts = [[(1, at(20), 5, True), (2, at(9), 9, False), (3, at(1), 20, False)], [(1, at(3), 1, False), (1, at(21), 6, False), (2, at(10), 10, False)], [(2, at(8), 8, True), (2, at(11), 11, False), (1, at(22), 7, True), (3, ahead, 21, False)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        outcomes.drain_rows(outcomes.fold_outcomes(stream, 36_600), f"{tmp_path}/out", f"{tmp_path}/state")
    found = {r.source_id: tuple(r)[1:] for r in outcomes.latest_health(spark, f"{tmp_path}/out").collect()}
    assert found == {1: (0, "healthy", 24), 2: (3, "source_failed", 8), 3: (2, "degraded", 4)}
    # source 3 was due once, until its next outcome
    due = {r.source_id: (r.failures, r.due_at) for r in outcomes.due_sources(spark, f"{tmp_path}/out").collect()}
    assert due == {1: (0, at(23)), 2: (3, at(11) + datetime.timedelta(hours=8))}
    assert spark.read.parquet(f"{tmp_path}/out").where("record = 'due' and source_id = 3").count() == 1


def test_settled_failures_become_a_number(spark, tmp_path):
    schema = "source_id long, ts timestamp, event_id long, success boolean"
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    parts = [[(1, day(d), d, False) for d in range(1, 5)], [(1, day(100), 100, False)], [(1, day(101), 101, False), (1, day(99), 99, False)]]
    for n, part in enumerate(parts, 1):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        outcomes.drain_rows(outcomes.fold_outcomes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 30), f"{tmp_path}/out", f"{tmp_path}/state")
        assert outcomes.latest_health(spark, f"{tmp_path}/out").first().failures == (4, 5, 7)[n - 1]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "failed").load()
    assert state.count() == 3  # the four old ones are a number
    spark.createDataFrame([(1, day(102), 102, True)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    outcomes.drain_rows(outcomes.fold_outcomes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 30), f"{tmp_path}/out", f"{tmp_path}/state")
    assert outcomes.latest_health(spark, f"{tmp_path}/out").first().failures == 0


def test_unchanged_pages_are_skipped_after_a_success_only(spark, tmp_path):
    pages, runs = "source_id long, hash string, at timestamp, page_id long", "source_id long, hash string, at timestamp, success boolean"
    at = lambda d: datetime.datetime(2024, 1, d)
    steps = [
        ([(1, "a", at(1), 1)], [(9, "z", at(1), True)], {1: "extract"}),
        ([(1, "a", at(3), 2)], [(1, "a", at(2), False)], {2: "extract"}),  # a failed run, then the same body
        ([(1, "a", at(5), 3), (1, "b", at(5), 4), (2, "a", at(5), 5), (1, "a", at(3), 6)], [(1, "a", at(4), True)], {3: "skip", 4: "extract", 5: "extract", 6: "extract"}),
        ([(1, "a", at(7), 7)], [(1, "a", at(6), False)], {7: "skip"}),
    ]
    wanted = {}
    for stored, ran, actions in steps:
        spark.createDataFrame(stored, pages).write.mode("append").parquet(f"{tmp_path}/pages")
        spark.createDataFrame(ran, runs).write.mode("append").parquet(f"{tmp_path}/runs")
        stream = outcomes.changed_pages(spark.readStream.schema(pages).parquet(f"{tmp_path}/pages"), spark.readStream.schema(runs).parquet(f"{tmp_path}/runs"))
        outcomes.drain_rows(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        wanted |= actions
        assert {r.page_id: r.action for r in spark.read.parquet(f"{tmp_path}/out").collect()} == wanted


def test_sources_of_a_bucket_are_folded_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outcomes, "BUCKETS", 3, raising=False)
    schema, rng = "source_id long, ts timestamp, event_id long, success boolean", random.Random(5)
    # a tenth of the sources have a success in each part, many are touched by one part only; null is a source too
    rows = [(rng.choice([None, *range(60)]), datetime.datetime(2024, 1, rng.randint(1, 28)), n, rng.random() < 0.3) for n in range(400)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
        outcomes.drain_rows(outcomes.fold_outcomes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    wanted, due = {}, {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        ok = max([(r[1], r[2]) for r in own if r[3]], default=(datetime.datetime.min, 0))
        wanted[s] = sum((r[1], r[2]) > ok for r in own if not r[3])
        due[s] = (wanted[s], max(r[1] for r in own) + datetime.timedelta(hours=outcomes.health_of(wanted[s])[1]))
    assert {r.source_id: r.failures for r in outcomes.latest_health(spark, f"{tmp_path}/out").collect()} == wanted
    assert {r.source_id: (r.failures, r.due_at) for r in outcomes.due_sources(spark, f"{tmp_path}/out").collect()} == due
    # the state has a key for each bucket (and one for null), not for each source
    heads = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "heads").load()
    assert heads.count() == 4


class _Kept:
    """A value or a list as a state store keeps it, and timers."""

    def __init__(self, failed=None):
        self.rows, self.timers, self.now, self.failed = [], set(), 0, failed

    def getValueState(self, *_):  # noqa: N802
        return self

    def getListState(self, *_):  # noqa: N802
        return self.failed

    exists = lambda self: bool(self.rows)
    update = lambda self, row: self.rows.__setitem__(slice(None), row)
    get = lambda self: self.rows
    put = lambda self, rows: self.rows.__setitem__(slice(None), rows)
    appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731, N815
    clear = lambda self: self.rows.clear()
    listTimers = lambda self: list(self.timers)  # noqa: E731, N815
    deleteTimer = lambda self, at: self.timers.discard(at)  # noqa: E731, N815
    registerTimer = lambda self, at: self.timers.add(at)  # noqa: E731, N815
    getCurrentProcessingTimeInMs = lambda self: self.now  # noqa: E731, N815


def test_a_forgotten_source_starts_anew_beside_others():
    store = _Kept(_Kept())
    fold = outcomes.OutcomeFold(60, 400)
    fold.init(store)
    day = outcomes.DAY

    def failed(now: int, *at: tuple[int, int]) -> dict:
        store.now = now * day // 1000
        rows = pd.DataFrame([(s, d * day, d, False) for s, d in at], columns=["source_id", "ts", "event_id", "success"]).astype({"ts": "datetime64[us]"})
        return {r.source_id: r.failures for r in next(fold.handleInputRows((0,), iter([rows]), store)).itertuples()}

    assert failed(10, (1, 1), (2, 2), (1, 3)) == {1: 2, 2: 1}
    assert failed(300, (2, 299)) == {2: 2}
    assert failed(450, (2, 449)) == {2: 3}  # source 1 is forgotten
    assert failed(451, (1, 450)) == {1: 1}
    # one timer, for the first that is due
    assert store.timers == {(449 * day // 1000) + 8 * 3_600_000}


def test_bodies_of_a_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outcomes, "BUCKETS", 2, raising=False)
    pages, runs = "source_id long, hash string, at timestamp, page_id long", "source_id long, hash string, at timestamp, success boolean"
    at = lambda d: datetime.datetime(2024, 1, d)
    big = 2**53 + 1
    bodies = [(s, h) for s in (None, 1, big) for h in (None, "a", 'q"x')]
    spark.createDataFrame([(s, h, at(1), big + n) for n, (s, h) in enumerate(bodies)], pages).write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(*b, at(1), n % 2 == 0 or None) for n, b in enumerate(bodies)], runs).write.parquet(f"{tmp_path}/runs")
    outcomes.drain_rows(outcomes.changed_pages(spark.readStream.schema(pages).parquet(f"{tmp_path}/pages"), spark.readStream.schema(runs).parquet(f"{tmp_path}/runs")), f"{tmp_path}/out", f"{tmp_path}/state")
    found = {(r.page_id, r.source_id, r.hash, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(big + n, *b, "extract" if n % 2 else "skip") for n, b in enumerate(bodies)}


def test_merges_follow_chains_and_refuse_circles(spark):
    merges = lambda pairs: spark.createDataFrame(pairs, "duplicate_id long, canonical_id long")
    assert {tuple(r) for r in resolve.final_targets(merges([(4, 3), (3, 2), (2, 1), (9, 8)])).collect()} == {(4, 1), (3, 1), (2, 1), (9, 8)}
    with pytest.raises(ValueError, match="circle"):
        resolve.final_targets(merges([(1, 2), (2, 1)]), rounds=5)


def test_created_places_are_overwritten(spark):
    place = "place_id long, name string, postcode string, city string, country string, website string, lat double, lon double"
    places = spark.createDataFrame([(1, "Old", None, "Here", "GB", " ", 1.0, 2.0), (2, "Old", "A", "Here", "GB", "w", 1.0, 2.0), (3, "Old", None, None, None, None, None, None)], place)
    linked = spark.createDataFrame([(1, 1, True, False, "New", "P", "There", None, "site", 8.0, 9.0), (2, 2, True, True, "New", None, "There", "", "site", 8.0, None), (3, 3, False, True, "New", "P", "There", "IE", "site", 8.0, 9.0)],
        "place_id long, record_id long, public boolean, created boolean, name string, postcode string, city string, country string, website string, lat double, lon double")
    found = {r.place_id: tuple(r)[1:] for r in resolve.survive(places, linked).collect()}
    assert found == {1: ("Old", "P", "Here", "GB", "site", 1.0, 2.0), 2: ("New", "A", "There", "GB", "site", 1.0, 2.0), 3: ("Old", None, None, None, None, None, None)}


def test_snapshot_manifest_and_gate(spark, tmp_path):
    places, sources, aliases, previous, versions = (frame(spark, SF, n) for n in ("places", "sources", "aliases", "previous", "versions"))
    export.write_snapshot(export.export_places(places, aliases, sources), export.export_occurrences(previous, places, sources), f"file://{tmp_path}/snap")
    found = {r.file: (r.bytes, r.sha256) for r in export.manifest(spark, f"file://{tmp_path}/snap").collect()}
    files = [f for f in (tmp_path / "snap").rglob("part-*")]
    assert len(files) == len(found) > 1
    assert found == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files}
    assert export.version_to_export(versions).first().status == "published"
    draft = versions.where("status = 'draft'").first().version
    with pytest.raises(ValueError, match="not published"):
        export.version_to_export(versions, draft)
    with pytest.raises(ValueError, match="not found"):
        export.version_to_export(versions, "none")


def test_long_pages_are_searched_whole(spark):
    body = "<title>North Hall</title><p>" + "filler words " * 20_000 + "</p><footer>12 Long&nbsp;Road</footer>"
    pages = spark.createDataFrame([("https://n.org/", body)], "url string, html string")
    leads = spark.createDataFrame([(1, "https://n.org/", "North Hall", None, "12 long road", False), (2, "https://n.org/", "North Hall", "AB1 2CD", None, None)], "lead_id long, url string, name string, postcode string, address string, trusted boolean")
    assert {r.lead_id: r.outcome for r in websites.verify(leads, pages).collect()} == {1: "verified", 2: "no_match"}


def test_contact_details_stay_private(spark):
    existing = spark.createDataFrame([(1, 5, "done", ("a", "b"))], "claim_id long, place_id long, status string, contact struct<name:string,email:string>")
    sent = spark.createDataFrame([(1, 5, "x", "y"), (2, 5, "x", "y"), (3, 99, "x", "y")], "claim_id long, place_id long, name string, email string")
    out = contributions.appended(existing, sent, spark.createDataFrame([(5,)], "place_id long"), "claim_id")
    assert sorted((r.claim_id, r.status) for r in out.collect()) == [(1, "done"), (2, "pending")]
    assert contributions.public_view(out).columns == ["claim_id", "place_id", "status"]
