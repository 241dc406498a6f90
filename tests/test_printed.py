"""Printed listings: hand-written pages of both layouts, wrapped cells, editions."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.plans import source_queries
from gristmill.sources import printed
from gristmill.sources.printed import Cards, Table

TABLE = Table(
    head=r"\bEmployer\s+Role\s+Level\s+Location",
    labels={"employer": r"\bEmployer\b", "role": r"\bRole\b", "level": r"\bLevel\b", "location": r"\bLocation", "salary": r"\bSalary\b", "start": r"\bStart Date\b"},
    below={"opens": r"\bOpen\b", "closes": r"\bClose\b"},
    below_line=r"\bOpen\b\s+\bClose\b",
    footer=r"^\s*(?:Notes for readers|Questions and answers)",
    skip=r"^\s*(?:Salary|Open\s+Close)\s*$",
)
CARDS = Cards(role="Role", location=r"Location\(s\)", opens="Applications open", closes="Applications close", start="Start Date", salary="Starting salary", link="Link to application details", section="^(?:Digital$|Health|Legal)")

PAGE = """
   Vacancy Listing: January 2026

Digital
 Employer              Role                          Level   Location            Salary              Applications            Start Date      Link
                                                                                                     Open        Close
 Brook & Sons          Data Analyst Apprentice       4       Leeds               £22,500             January     March       September       jobs.example.uk/a1
                                                                                                     2026        2026        2026
 - Northern Data       Digital Solutions - Data      6       Newcastle-under-    £21,000 -           Open now    March 2026  Ongoing         jobs.example.uk/a2
   Partnership         Analytics Degree                      Lyme, Oldbury       £28,808
                       Apprentice
 Ashdown Group         Site Supervisor               4 or 5  Head office is York, the role is on site Competitive Open now March 2026 Autumn 2026 careers@ashdown.example.uk
 Redhill Widgets and Co Junior Tester                4       Hull                at the usual rates  when ready  TBC         2027            www.example.com/x
 12
Health
 Employer              Role                          Level   Location            Salary              Applications            Start Date      Link
                                                                                                     Open        Close
 Mercy Trust           Nurse                         6       Bath, York          £20,000             July 2026   Sept 2026   Spring 2027     jobs.example.uk/n1
 Notes for readers
 Mercy Trust           Not a row                     6       Bath                £20,000             July 2026   Sept 2026   Spring 2027     jobs.example.uk/n2
"""

CARD_PAGE = """
Digital
Neptune Works
 Role        Digital Solutions Degree Apprentice          Level   6
             (Operations)
 Location(s) Newcastle Upon
             Tyne
 Applications open    Open now              Applications close   May 2026
 Start Date           September 2026        Starting salary      Competitive, with
                                                                 benefits
 Link to application details   jobs.example.uk/c1 (opens soon)
7
Harbour Law
 Role Solicitor Apprentice Level
                                                                7
 Location(s)          London
 Applications open    Applications close
 March                Ongoing
 Start Date    2027              Starting salary   £24,000
 Link to application details

   careers@harbour.example.uk
"""


def read(spark, text, **layouts):
    docs = spark.createDataFrame([("d", text)], "name string, text string")
    found = printed.entries(docs, "text", "name", **(layouts or {"table": TABLE, "cards": CARDS}))
    return [r.asDict() for r in found.orderBy("i").collect()]


def test_table_rows_and_wrapped_cells(spark):
    rows = read(spark, PAGE)
    assert [(r["section"], r["employer"], r["role"], r["level"]) for r in rows] == [
        ("Digital", "Brook & Sons", "Data Analyst Apprentice", 4),
        ("Digital", "Northern Data Partnership", "Digital Solutions - Data Analytics Degree Apprentice", 6),
        ("Digital", "Ashdown Group", "Site Supervisor", 5),
        ("Digital", "Redhill Widgets and Co", "Junior Tester", 4),
        ("Health", "Mercy Trust", "Nurse", 6),
    ]
    brook, north, ash, red, mercy = rows
    assert (brook["opens"], brook["closes"], brook["start"], brook["salary"], brook["link"]) == ("January 2026", "March 2026", "September 2026", "£22,500", "jobs.example.uk/a1")
    assert (north["location"], north["salary"], north["start"]) == ("Newcastle-under-Lyme, Oldbury", "£21,000 - £28,808", "Ongoing")
    assert (ash["location"], ash["salary"], ash["start"], ash["link"]) == ("Head office is York, the role is on site", "Competitive", "Autumn 2026", "careers@ashdown.example.uk")
    assert (red["location"], red["salary"], red["opens"], red["closes"], red["start"], red["link"]) == ("Hull", "at the usual rates", "when ready", "TBC", "2027", "www.example.com/x")
    assert (mercy["opens"], mercy["closes"], mercy["start"]) == ("July 2026", "Sept 2026", "Spring 2027")


def test_cards(spark):
    neptune, harbour = read(spark, CARD_PAGE)
    assert neptune["section"] == harbour["section"] == "Digital"
    assert (neptune["employer"], neptune["role"], neptune["level"], neptune["location"]) == ("Neptune Works", "Digital Solutions Degree Apprentice (Operations)", 6, "Newcastle Upon Tyne")
    assert (neptune["opens"], neptune["closes"], neptune["start"], neptune["salary"], neptune["link"]) == ("Open now", "May 2026", "September 2026", "Competitive, with benefits", "jobs.example.uk/c1")
    assert (harbour["employer"], harbour["role"], harbour["level"], harbour["location"]) == ("Harbour Law", "Solicitor Apprentice", 7, "London")
    assert (harbour["opens"], harbour["closes"], harbour["start"], harbour["salary"], harbour["link"]) == ("March", "Ongoing", "2027", "£24,000", "careers@harbour.example.uk")


def test_repeated_entries_count_once_and_documents_each_for_itself(spark):
    docs = spark.createDataFrame([("a", PAGE + "\f" + PAGE), ("b", PAGE), ("b", PAGE), ("c", None), ("d", ""), ("e", "no table here\n 4 ")], "name string, text string")
    counts = {r.key: r["count"] for r in printed.entries(docs, "text", "name", TABLE, CARDS).groupBy("key").count().collect()}
    assert counts == {"a": 5, "b": 10}
    assert printed.entries(docs.limit(0), "text", "name", TABLE).collect() == []


def test_runs_and_joined_cells(spark):
    (r,) = spark.createDataFrame([("  ab c   d  ",)], "x string").select(printed.runs(F.col("x")).alias("r"), printed.join_wrapped(F.array(F.lit("a-"), F.lit(" b/ "), F.lit(""), F.lit("c "), F.lit("1-"), F.lit("2"))).alias("j")).collect()
    assert [tuple(x) for x in r.r] == [(2, "ab c"), (9, "d")]
    assert r.j == "a-b/c 1- 2"


def test_runs_equal_a_loop(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice(["a", "bc", "£1", "\x1c", "\u2003", " ", " ", "  ", "   ", "\t", "\x0b", "\r"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", " ", "\t ", "x" + " " * 50000, None]
    docs = spark.createDataFrame(list(enumerate(lines)), "i int, x string")
    got = {r.i: r.r and [tuple(c) for c in r.r] for r in docs.select("i", printed.runs(F.col("x")).alias("r")).collect()}
    white = r"[^ \t\n\x0b\f\r]"
    for i, line in enumerate(lines):
        assert (got[i] or []) == [(m.start(), m.group()) for m in re.finditer(f"{white}+(?: {white}+)*", line or "")], line


def test_a_row_is_put_together_once(spark):
    """No filter works the fold over a row's runs out again."""
    docs = spark.createDataFrame([("d", PAGE)], "name string, text string")
    plan = printed.entries(docs, "text", "name", TABLE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_editions_of_a_larger_table_are_no_longer(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size = 1").limit(2)
    many = part.crossJoin(spark.range(300).withColumnRenamed("id", "again")).withColumn("p_partkey", F.col("p_partkey") + F.col("again") * 50000).drop("again")
    sizes = source_queries._editions(many).select(F.size(F.split("text", "\n")).alias("n"))
    # two adverts in a window of 50,000 keys, each of two lines
    assert sizes.agg(F.max("n")).first()[0] < 12
    assert source_queries._editions(many).agg(F.sum(F.size(F.split("text", "jobs[/0-9]")) - 1)).first()[0] == many.count()


@pytest.mark.parametrize(
    "text,year,month,want",
    [("May 2026", 2026, 1, "2026-05-01"), ("March", 2026, 4, "2026-03-01"), ("mid-Feb", 2026, 4, "2027-02-01"), ("Sept", 2026, 1, "2026-09-01"), ("Ongoing", 2026, 1, None), (None, 2026, 1, None), ("January", None, None, None), ("January 2027", None, None, "2027-01-01")],
)
def test_bare_months_follow_the_edition(spark, text, year, month, want):
    df = spark.createDataFrame([(text, year, month)], "t string, year int, month int")
    (r,) = df.select(printed.month_of(F.col("t"), F.struct("year", "month")).alias("m")).collect()
    assert r.m == (want and datetime.date.fromisoformat(want))


def test_editions(spark):
    rows = [("x Vacancy Listing: March 2026", "https://e.uk/2025/01/a.pdf"), ("", "https://e.uk/u/2025/10/Degree-Listing-October-2026.pdf"), (None, "https://e.uk/u/2025/10/list.pdf"), ("", "list.pdf"), (None, None)]
    df = spark.createDataFrame(rows, "t string, u string")
    got = [r.e and tuple(r.e) for r in df.select(printed.edition_of(F.col("t"), F.col("u"), "Vacancy Listing").alias("e")).collect()]
    assert got == [(2026, 3), (2026, 10), (2025, 10), None, None]
    urls = ["/u/2025/10/a.pdf", "/u/2026/01/b.pdf", "/u/2026/01/c.pdf", "/u/2025/10/a.pdf", "z"]
    (r,) = spark.createDataFrame([(urls,)], "u array<string>").select(printed.newest_first(F.col("u")).alias("u")).collect()
    assert r.u == ["/u/2026/01/b.pdf", "/u/2026/01/c.pdf", "/u/2025/10/a.pdf", "z"]


def test_newest_edition_and_places(spark):
    found = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new"), ("s", 2, "new too"), ("t", None, "only")], "series string, edition int, role string")
    assert sorted(r.role for r in printed.newest_edition(found, ["series"], "edition").collect()) == ["new", "new too", "only"]
    texts = [("Bath, York and Leeds",), ("Nationwide",), ("various locations",), ("Head office of a rather long name, Hull",), ("",), (None,)]
    got = [(r.p.places, r.p.is_national) for r in spark.createDataFrame(texts, "t string").select(printed.split_places(F.col("t")).alias("p")).collect()]
    assert got == [(["Bath", "York", "Leeds"], False), ([], True), ([], False), (["Head office of a rather long name, Hull"], False), ([], False), ([], False)]


def test_sources_are_read_again_when_due_and_changed(spark):
    day = datetime.date(2026, 5, 10)
    ago = lambda n: day - datetime.timedelta(n)
    stored = spark.createDataFrame([("fresh", "u1", ago(2), ["a"]), ("same", "u1", ago(7), ["a"]), ("gone", "u1", ago(9), ["a"]), ("changed", "u1", ago(6), ["a"])], "source string, url string, checked date, entries array<string>")
    fresh = spark.createDataFrame([("fresh", "u2", ["b"]), ("same", "u1", ["b"]), ("gone", None, None), ("changed", "u2", ["b"]), ("first", "u0", ["c"])], "source string, url string, entries array<string>")
    now, state = printed.re_emitted(stored, fresh, F.lit(day))
    assert {r.source: (r.url, r.entries, r.how) for r in now.collect()} == {"fresh": ("u1", ["a"], "not due"), "same": ("u1", ["a"], "unchanged"), "gone": ("u1", ["a"], "not found"), "changed": ("u2", ["b"], "new"), "first": ("u0", ["c"], "new")}
    assert {r.source: r.checked for r in state.collect()} == {"fresh": ago(2), "same": day, "gone": ago(9), "changed": day, "first": day}
