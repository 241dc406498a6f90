"""Hand-written cases for the column functions and operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates, links, numbers, text
from gristmill.operators import entity, lifecycle, merging, querying


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("£25,000 - £30,000 a year", (25000, 30000)), ("20k", (20000, None)), ("£12 per hour", (23400, None)), ("£500 per week", (26000, None)), ("£24 k a year", (24000, None)), ("£450 pw", (23400, None)), ("£1,900 p.c.m", (22800, None)), ("£1,234,567", (None, None)), ("19514.00 - 19514.00", (19514, None)), ("£11.44 an hour", (22308, None)), ("competitive", (None, None)), ("£1", (None, None)), ("", (None, None))],
)
def test_salary(spark, given, want):
    assert tuple(one(spark, given, numbers.parse_salary)) == want


@pytest.mark.parametrize(
    ("given", "want"), [("2026-03-01", "2026-03-01"), ("1/2/2026", "2026-01-02"), ("2026-07-01T23:30:00Z", "2026-07-02"), ("2026-99-01T00:00", None), ("Fri Oct 09 02:01:00 UTC 2026", "2026-10-09"), ("Wed, 01 Jul 2026 23:30:00 GMT", "2026-07-02"), ("October 9th, 2026", "2026-10-09"), ("Posted 3+ Days Ago", "2026-05-07"), ("Just posted", "2026-05-10"), ("3 March 2026", "2026-03-03"), ("yesterday", "2026-05-09"), ("2 weeks ago", "2026-04-26"), ("5 hours ago", None), ("40/1/2026", None), ("soon", None), (None, None)]
)
def test_dates(spark, given, want):
    got = one(spark, given, lambda c: dates.parse_date(c, F.lit("2026-05-10").cast("date")))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("given", "want"), [("1/2/2026", "2026-02-01"), ("2 days ago", "2026-05-08"), ("31/31/2026", None), (None, None)])
def test_day_first(spark, given, want):
    got = one(spark, given, lambda c: dates.parse_day_first(c, F.lit("2026-05-10").cast("date")))
    assert (str(got) if got else None) == want


def test_hours_ago_are_today(spark):
    assert str(one(spark, "5 hours ago", lambda c: dates.ago_to_date(c, F.lit("2026-05-10").cast("date")))) == "2026-05-10"


def test_london_date_after_midnight(spark):
    assert str(one(spark, "2026-07-01 23:30:00", lambda c: dates.london_date(c.cast("timestamp")))) == "2026-07-02"


@pytest.mark.parametrize(("given", "want"), [("Acme & Sons Ltd", "acme and sons"), ("00123 Foo plc", "foo"), ("The Acme Company Corp.", "acme"), ("3M UK", "3m"), ("Marks &amp; Co (UK)", "marks and"), ("Theo Inc", "theo"), ("Group", ""), ("A B  Group Holdings", "a b"), ("", "")])
def test_employer(spark, given, want):
    assert one(spark, given, text.normalise_employer) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("&pound;5 &#39;a&#x27; &rsquo;", "£5 'a' ’"), ("&amp;lt;", "&lt;"), ("&AMP; &nope; &#1114112; &#xD800;", "& &nope; &#1114112; &#xD800;"), ("&#x1F600;&hellip;", "😀…"), ("a & b", "a & b"), ("&;&#;&#x;", "&;&#;&#x;"), ("", ""), (None, None)],
)
def test_entities(spark, given, want):
    assert one(spark, given, text.decode_entities) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Apprentice Data & AI Analyst L4 Programme", "data and ai analyst"), ("2027 Level 6 Degree Apprenticeship Scheme", "degree"), ("Apprentice", "apprentice"), ("Apprenticeship Scheme", "scheme"), ("Programme Manager", "manager"), ("Level-4 xl4", "level 4 xl4"), ("", "")],
)
def test_title(spark, given, want):
    assert one(spark, given, text.normalise_title) == want


@pytest.mark.parametrize(
    ("given", "places", "want"),
    [("Data Scientist Apprentice 2027 - York", ["York"], {"science", "data"}), ("Machine Learning Engineers (Level 6)", None, {"machinelearning", "engineer"}), ("Artificial Intelligence & Analytics", [], {"ai", "analysis"}), ("Business glass classes", [None], {"business", "glass", "classe"}), ("Apprentice", None, set())],
)
def test_title_tokens(spark, given, places, want):
    row = spark.createDataFrame([(given, places)], "t string, p array<string>").select(text.title_tokens(F.col("t"), F.col("p")).alias("w")).first()
    assert set(row.w) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Join us. Salary: £24,500 per annum. Fees of £9,000.", ("£24,500 per annum", 24500, None)),
        ("A bonus of £6,000. You will earn £20k to £22k.", ("£20k to £22k", 20000, 22000)),
        ("Graduates earn an average salary of £52,500", None),
        ("Turnover is £12,000 million", None),
        ("£25,200 a year", ("£25,200 a year", 25200, None)),
        ("We won £30,000", None),
        ("Pay: £12.50 per hour", ("£12.50 per hour", 24375, None)),
        ("", None),
        (None, None),
    ],
)
def test_salary_in_text(spark, given, want):
    got = one(spark, given, numbers.salary_in_text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("a", "b", "want"), [("airbus", "airbus operations", True), ("thales", "thales", True), ("air", "airbus", False), ("", "x", False)])
def test_same_employer(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.same_employer(F.col("a"), F.col("b")).alias("y")).first().y is want


@pytest.mark.parametrize(("given", "want"), [("sw1a1aa", "SW1A 1AA"), ("M1 1AE", "M1 1AE"), ("nowhere", None)])
def test_postcode(spark, given, want):
    assert one(spark, given, numbers.normalise_postcode) == want


def test_half_goes_up(spark):
    assert one(spark, -2.5, lambda c: numbers.round_half_up(c), "double") == -2


@pytest.mark.parametrize(("given", "want"), [("https://www.jobs.example.com/x", "own"), ("http://example.org", "board"), ("http://badexample.com", "other"), ("nothing", None)])
def test_link_kind(spark, given, want):
    assert one(spark, given, lambda c: links.link_kind(c, ["example.com"], ["example.org"])) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Data Analyst", "data analyst 2026", True), ("Data Analyst", "Data Engineer", False), ("Analyst", "Data Analyst", False), ("", "", False), ("Senior Data Analyst", "Data Analyst", True)])
def test_similar_titles(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.similar_titles(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("y")).first()
    assert row["y"] is want


def test_edit_with_null_wins(spark):
    rows = spark.createDataFrame([("x", 1.0, {"a": None}), ("y", 2.0, {"b": "3"}), ("z", 3.0, None)], "a string, b double, e map<string,string>")
    assert [tuple(r)[:2] for r in lifecycle.apply_edits(rows, "e", ["a", "b"]).collect()] == [(None, 1.0), ("y", 3.0), ("z", 3.0)]


def test_listing_without_sources_closes(spark):
    listings = spark.createDataFrame([(1, True, None, None), (2, False, "gone", None)], "listing_id int, is_active boolean, closed_reason string, closing_date date")
    sources = spark.createDataFrame([], "listing_id int, last_seen date, missed_runs int, incremental boolean, link_ok boolean")
    closed, _ = lifecycle.mark_missing(listings, sources, F.lit("2026-01-01").cast("date"), F.lit("2026-01-01").cast("date"))
    assert sorted((r.listing_id, r.is_active, r.closed_reason) for r in closed.collect()) == [(1, False, "gone"), (2, False, "gone")]


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    once = merging.upsert(rows.limit(0), rows, "k", ["v"]).drop("change")
    assert sorted(map(tuple, merging.upsert(once, rows, "k", ["v"]).drop("change").collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("partitions", [1, 5])
def test_fold_does_not_depend_on_partitions(spark, partitions):
    rows = [("e", 1, "k1", ["a", "b", "c"]), ("e", 2, "k2", ["a", "b"]), ("e", 3, "k3", ["b", "x"]), ("f", 4, "k4", ["a", "b"]), ("e", 5, "k1", ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "block string, at int, key string, words array<string>").repartition(partitions)
    got = {r["at"]: r["assigned"] for r in entity.assign_keys(df, "block", "at", "key", "words").collect()}
    assert got == {1: "k1", 2: "k1", 3: "k3", 4: "k4", 5: "k1"}


def test_filters_keep_unknown(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "s string, n int")
    chosen = querying.Filters(excluded={"s": ["a"]})
    assert [r["n"] for r in rows.filter(chosen.predicate()).collect()] == [2]
    assert chosen.active() == 1
