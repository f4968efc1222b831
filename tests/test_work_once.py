"""What several parts of a query use is worked out once: counted in the plans of the queries, not by the clock."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeloom import plans
from placeloom.functions import html
from placeloom.operators import export
from placeloom.plans import directory, registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plan_of(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_d15_a_url_has_its_host_and_class_once(spark):
    # the three lists of the class, and the scheme
    assert plan_of(spark, "d15_policy_verdicts").count("RLIKE") <= 4


@needs_tables
def test_f08_notes_are_read_once(spark):
    assert "inline(" not in plan_of(spark, "f08_lead_analysis")


@needs_tables
def test_f14_and_p07_candidates_are_validated_once(spark):
    # the frame of the last version is one of them, where it isn't written
    assert plan_of(spark, "f14_publish_summary").count("o_orderstatus") <= 1
    assert "o_orderstatus" not in plan_of(spark, "p07_change_events")


@needs_tables
def test_s05_both_files_of_a_snapshot_have_the_same_rows(spark, tmp_path):
    places, aliases, sources, previous = (registry.frame(spark, SF, n) for n in ("places", "aliases", "sources", "previous"))
    # a label of its own for each time that a row is worked out
    rows = export.export_occurrences(previous, places, sources).withColumn("label", F.expr("uuid()"))
    export.write_snapshot(export.export_places(places, aliases, sources), rows, f"file://{tmp_path}/snap")
    lines = spark.read.json(f"file://{tmp_path}/snap/snapshot.ndjson").where("record_type = 'occurrence'").select("session_label")
    table = spark.read.csv(f"file://{tmp_path}/snap/occurrences.csv", header=True).select("session_label")
    assert lines.count() > 0 and lines.exceptAll(table).count() == 0


@needs_tables
def test_s05_the_digests_are_of_every_file_of_the_snapshot(spark):
    found = {r.file: r.lines for r in plans.QUERIES["s05_snapshot_digests"](spark, SF).collect()}
    lines = {r.kind: r.lines for r in plans.QUERIES["s02_snapshot_ndjson"](spark, SF).collect()}
    assert found == {"occurrences.csv": lines["occurrence"], "snapshot.ndjson": lines["occurrence"] + lines["place"]} and lines["place"] > 0


@needs_tables
@pytest.mark.parametrize("name", ["p05_versioned_publish", "p07_committed_events"])
def test_publications_validate_their_candidates_once(spark, monkeypatch, name):
    calls, batch_of = [], directory.batch_of
    monkeypatch.setattr(directory, "batch_of", lambda *tables: calls.append(1) or batch_of(*tables))
    plans.QUERIES[name](spark, SF)
    assert len(calls) == 1


@needs_tables
def test_k03_and_k05_pages_are_made_and_parsed_once(spark):
    assert plan_of(spark, "k03_table_timetable").count("ArrowEvalPython") == 1
    assert plan_of(spark, "k03_carried_timetable").count("ArrowEvalPython") == 1
    assert plan_of(spark, "k05_year_calendar").count("o_orderstatus") == 1


def test_k03_a_batch_of_pages_is_parsed_in_parts():
    parts = list(html._tables_in_parts(iter([pd.Series(["<table><tr><td>1</td></tr></table>"] * 1000), pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= html.PAGES and sum(map(len, parts)) == 1000
    assert parts[0].iloc[0] == [[["1"]]]


@needs_tables
@pytest.mark.parametrize("name", ["e01_pair_score", "e01_scores_of_ratios", "e01_pair_score_given_ratios", "e03_decide_given_ratios", "e03_decisions_of_ratios"])
def test_a_pair_is_measured_once_and_its_names_are_read_before_it(spark, name):
    plan = plan_of(spark, name)
    # a distance in each of the two joins by key; that of near points stands in the join's condition too
    assert plan.count("ATAN2") == 4
    # what a name, website or postcode tells alone is read from the written sides, so no pair tries patterns
    assert "RLIKE" not in plan and "regexp_replace" not in plan
    assert "BROUND" not in plan.upper()


@needs_tables
def test_names_of_pairs_are_compared_without_another_join(spark):
    for name, joins in (("e01_pair_score", 3), ("e04_resolve_batch", 8)):
        plan = plan_of(spark, name)
        assert plan.count("ArrowEvalPython") == 1
        # three joins make pairs; those of the batch with its sources and decisions come beside, and the marks of heavy keys
        assert sum("Join" in line and "rightHint=(strategy=merge)" in line for line in plan.splitlines()) == joins


@needs_tables
def test_candidates_are_counted_before_they_are_ranked(spark):
    lines = plan_of(spark, "e03_decisions_of_ratios").splitlines()
    last = max(i for i, line in enumerate(lines) if "Window [" in line)
    assert any("Aggregate [record_id" in line and "min(place_id" in line for line in lines[last:])
