"""Unit tables of the scalar functions, and doctests of the plain helpers."""

import doctest

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.functions import html, similarity, text, times


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_doctests():
    for module in (html, similarity):
        assert doctest.testmod(module).failed == 0


def test_names_and_postcodes(spark):
    assert column(spark, [" St. Mary's  HALL ", "Écoles-Nord", None, ""], text.normalise_name) == ["st mary s hall", "écoles nord", None, ""]
    assert column(spark, ["sw1a1aa", "e1 6 an", "d02x285", "AB1", "", None, "zz99 9999z"], text.normalise_postcode) == ["SW1A 1AA", "E1 6AN", "D02 X285", "AB1", None, None, "ZZ999999Z"]


def test_urls(spark):
    urls = ["https://WWW.a.org:80/x/?q", "b.org", "", None, " http://c.org "]
    assert column(spark, urls, text.domain_of) == ["a.org:80", "b.org", None, None, "c.org"]
    assert column(spark, urls, text.canonical_homepage) == ["https://a.org:80/x", "https://b.org/", None, None, "http://c.org/"]
    assert column(spark, ["fedex.com", "x.com", "ok.org", None], text.is_denied_host) == [True, True, False, False]
    assert column(spark, ["fedex.com", "x.com", "Yell.com", "a.yell.com", None], text.is_directory_host) == [False, True, True, False, False] and len(text.DIRECTORY_HOSTS) == 39
    assert column(spark, ["salah.com", "a.salah.com", "notsalah.com", "ismaili.net", "mawaqit.net", None], text.domain_class) == ["aggregator", "aggregator", "own", "umbrella", "widget", "own"]


def test_times(spark):
    assert column(spark, ["9:45", "24:00", "", None, "9.45"], times.minutes_of) == [585, None, None, None, None]
    assert column(spark, ["7.30pm", "12 am", "12:15 PM.", "5", "25", "x", None], times.minutes_loose) == [1170, 0, 735, 300, None, None, None]
    assert column(spark, [585, 300, 700, 1300, None], lambda c: times.afternoon_where_due(c, F.lit("isha")), "int") == [1305, 1020, 1420, 1300, None]
    assert column(spark, ["Jummah 1", "Friday night", "sunrise", ""], times.slot_of_label) == ["jumuah", "isha", None, None]
    assert column(spark, ["10 mins after", "+20", "5m", "minutes"], times.offset_minutes) == [10, None, 5, None]


def test_dates(spark):
    found = column(spark, ["1/6", "31/02/2024", "1-6-24", "1st June", "June 3, 2026", "Mon", None, "29 Feb"], lambda c: times.british_date(c, 2025).cast("string"))
    assert found == ["2025-06-01", None, "2024-06-01", "2025-06-01", "2026-06-03", None, None, None]
    assert column(spark, ["1", "Mon 21st", "1 6", "32", "May 1", None], times.day_of_month) == [1, 21, None, None, None, None]


def slow_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == slow_common(a, b)


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 100.0), ("east hall", "hall east", 100.0), ("abc", "abd", 200 * 2 / 6), ("abc", "", 0.0)])
def test_token_sort(a, b, want):
    assert similarity.token_sort(a, b) == pytest.approx(want)


def test_ratio_columns(spark):
    rows = spark.createDataFrame([("a b", "b a"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100.0, None, 100.0]


def test_html_helpers():
    page = '<title>T</title><a href="/own">Website</a><a href="https://other.org">Visit website</a>'
    assert html.official_site("https://dir.org/p", page) is None  # the first that is found decides, and it loops
    assert html.official_site("https://dir.org/p", '<a href="https://other.org">Visit website</a>') == "https://other.org"
    assert html.tables_of(None) == [] and html.page_text(None) == ("", "")
