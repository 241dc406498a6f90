"""Hand-written adverts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import adverts, text
from gristmill.operators import skills


def today():
    return F.lit("2026-10-01").cast("date")


def one(spark, values, column, kind="string"):
    schema = ", ".join(f"x{i} {kind}" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column(*(F.col(f"x{i}") for i in range(len(values)))).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("title", "body", "want"),
    [
        (None, "Start date: 6 September 2027. More text", ("2027-09-06", "day")),
        (None, "Starting on Monday 6th Sept, 2027", ("2027-09-06", "day")),
        (None, "commencing September 6, 2027", ("2027-09-06", "day")),
        (None, "The start date is 06/09/2027", ("2027-09-06", "day")),
        (None, "Our September 2027 intake", ("2027-09-01", "month")),
        (None, "Starts in 2027", ("2027-01-01", "year")),
        ("Analyst - September 2027", "Nothing here", ("2027-09-01", "month")),
        ("2027 Analyst", "start date: 6 September 2027", ("2027-09-06", "day")),
        (None, "Start: closing date 6 September 2027", None),
        (None, "Start date: 31 June 2027", None),
        (None, "Start date: 1 September 2012", None),
        (None, "", None),
        (None, None, None),
    ],
)
def test_start_date(spark, title, body, want):
    got = one(spark, (title, body), lambda t, b: adverts.start_date(t, b, today()))
    assert (got and (str(got["date"]), got["precision"])) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("This vacancy will close on 8th November 2026", "2026-11-08"),
        ("Closing Date: Monday 30 November 2026. Start 1 January 2027", "2026-11-30"),
        ("Open until November 8, 2026", "2026-11-08"),
        ("deadline 08/11/2026", "2026-11-08"),
        ("The final application date is 4th March", "2027-03-04"),
        ("Closing date: 20 September", None),
        ("Closes after interviews on 3 December 2026", None),
        (None, None),
    ],
)
def test_closing_date(spark, body, want):
    got = one(spark, (body,), lambda b: adverts.closing_date(b, today()))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "but", "want"),
    [
        ("University of York, then University of Leeds and the university of  leeds", None, "University of Leeds"),
        ("Queen Mary University of London", None, "Queen Mary University of London"),
        ("University of York or University of Leeds", None, "University of York"),
        ("University of York", "University of York", None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_most_named(spark, text, but, want):
    names = ["University of London", "Queen Mary University of London", "University of Leeds", "University of York"]
    assert one(spark, (text, but), lambda t, b: adverts.most_named(t, names, b)) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("""<script type="application/ld+json">{"@type":"JobPosting","title":"A &amp; B","hiringOrganization":{"name":"Acme"},"validThrough":"2026-11-08T00:00","jobLocation":{"address":{"addressLocality":"York"}}}</script>""", ("A & B", "Acme", "2026-11-08", "York")),
        ("""<script type='application/ld+json'>{"@graph":[{"@type":"WebPage"},{"@type":["JobPosting"],"title":"C","hiringOrganization":"Foo","jobLocationType":"TELECOMMUTE"}]}</script>""", ("C", "Foo", None, "Remote")),
        ("""<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"JobPosting","title":"D"}]</script>""", ("D", None, None, None)),
        ("<p>none</p>", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_job_posting(spark, html, want):
    got = one(spark, (html,), lambda h: adverts.job_posting(h, today()))
    assert (got["title"], got["employer"], str(got["closing"]) if got["closing"] else None, got["place"]) == want


def test_labels(spark):
    assert [one(spark, (n,), adverts.ordinal, "int") for n in (1, 2, 3, 11, 22, 113)] == ["1st", "2nd", "3rd", "11th", "22nd", "113th"]
    assert [one(spark, (n,), text.display_case) for n in ("ACME TRADING OF YORK UK", "McDonald", "IBM", "OF MICE AND MEN")] == ["Acme Trading of York UK", "McDonald", "IBM", "Of Mice and Men"]
    assert one(spark, ("employer:acme",), adverts.source_key) == "employer"
    assert one(spark, ('<a "b"> & c',), adverts.escape_html) == "&lt;a &quot;b&quot;&gt; &amp; c"


def test_mentions(spark):
    filler = "Lorem ipsum dolor sit amet consectetur. " * 20
    body = f"{filler}\nYou will learn:\n• Python and testing\nStrong SQL.\nA level Maths in Python.\nOur values: teamwork.\nDo you like Excel?"
    rows = [(1, body), (2, "Python, SQL"), (3, None), (1, body)]
    words = {"python": r"(?i)\bpython\b", "sql": r"(?i)\bsql\b", "team": r"(?i)\bteamwork\b", "excel": r"(?i)\bexcel\b"}
    got = skills.mentions(spark.createDataFrame(rows, "listing_id int, text string"), words).collect()
    assert sorted((r["listing_id"], r["id"], r["ctx"]) for r in got) == [(1, "excel", "job"), (1, "python", "taught"), (1, "sql", "asked")]


def plain_mentions(text, words):
    """Contexts by a loop over all matches."""
    space = r"[ \t\n\x0b\f\r]"
    marked = re.sub(r"(?<=[.!?:;])[ \t\x0b\f\r]+(?=[A-Z0-9(])|[ \t\x0b\f\r]*[•▪●◦*][ \t\x0b\f\r]+", "\n", text)
    parts = [p for p in (re.sub(rf"{space}+", " ", line).strip(" ") for line in re.split(r"\n+", marked)) if p]
    any_cue = re.compile(r"(?i)\b(?:" + "|".join(skills.CUES.values()) + r")\b")
    kind = lambda cue: next(k for k, p in skills.CUES.items() if re.fullmatch(f"(?i)(?:{p})", cue))
    cues = [[(m.start(), kind(m[0])) for m in any_cue.finditer(p)] for p in parts]
    rank, best = {"job": 0, "taught": 1, "asked": 2}, {}
    for i, part in enumerate(parts):
        if re.search(skills.QUALIFICATIONS, part):
            continue
        for name, p in words.items():
            for m in re.finditer(p, part):
                ctx = next((k for at, k in reversed(cues[i]) if at <= m.start()), None)
                back, j = 0, i - 1
                while ctx is None and j >= max(0, i - 12) and back < 1200:
                    ctx = cues[j][-1][1] if cues[j] else None
                    back, j = back + len(parts[j]), j - 1
                ctx = "job" if part.endswith("?") else ctx or (cues[i][0][1] if cues[i] else "job")
                if ctx != "ignore" and (name not in best or rank[ctx] > rank[best[name]]):
                    best[name] = ctx
    return best


WORDS = {"python": r"(?i)\bpython\b", "ml": r"(?i)\bmachine learning\b", "training": r"(?i)\b(?:staff )?training\b", "sql": r"SQL", "c": r"\bC\b"}


def test_every_place_of_a_skill_counts(spark):
    filler = "Lorem ipsum dolor sit amet consectetur. " * 20
    rows = [(1, filler + "You'll learn Python, and it is essential to know Python"), (2, filler + "Benefits include Python lunches, and you must have Python"), (3, filler + "Benefits include Python lunches")]
    got = skills.mentions(spark.createDataFrame(rows, "listing_id int, text string"), WORDS).collect()
    assert sorted((r["listing_id"], r["id"], r["ctx"]) for r in got) == [(1, "python", "asked"), (2, "python", "asked")]


def test_mentions_equal_plain_loop(spark):
    rng = random.Random(3)
    bits = ["python", "Python", "machine learning", "training", "staff training", "SQL", "SQLSQL", "C", "benefits", "about us", "you'll learn", "learning", "essential", "must have", "duties", "this role", "and", "so", "A levels", "thé", "lorem ipsum dolor sit amet", "x" * 150]
    joins = [" "] * 12 + [", ", ". ", "\n", "? ", " • ", ". A "]
    rows = [(n, "".join(rng.choice(bits) + rng.choice(joins) for _ in range(rng.randrange(80, 200)))) for n in range(150)]
    rows = [(n, t) for n, t in rows if len(t) >= skills.LEAST_CHARS]
    got = skills.mentions(spark.createDataFrame(rows, "listing_id int, text string"), WORDS).collect()
    want = {(n, k, c) for n, t in rows for k, c in plain_mentions(t, WORDS).items()}
    assert len(want) > 300
    assert len(got) == len(want)
    assert {(r["listing_id"], r["id"], r["ctx"]) for r in got} == want


def test_mentions_of_documents_equal_plain_loop(spark, sf_dir):
    from gristmill.plans import listing_queries, registry

    docs = registry.table(spark, sf_dir, "documents").select("doc_id", "text").distinct().collect()
    want = {(r.doc_id, k, c) for r in docs if r.text and len(r.text) >= skills.LEAST_CHARS for k, c in plain_mentions(r.text, listing_queries._WORDS).items()}
    assert {tuple(r) for r in registry.QUERIES["skill_mentions"](spark, sf_dir).collect()} == want


def test_cues_of_a_segment_are_looked_for_once(spark):
    """Once for a segment's first and last cue, and for their places by matches and gaps in segments with skills."""
    rows = [(1, "You zzneed data. " + "x " * 400), (2, "Here you zzlearn things.\nThen data. " + "x " * 400)]
    got = skills.mentions(spark.createDataFrame(rows, "k int, text string"), {"data": r"\bdata\b"}, "k", cues={"asked": "zzneed", "taught": "zzlearn"})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("zzneed|zzlearn") <= 4
    assert sorted((r.k, r.id, r.ctx) for r in got.collect()) == [(1, "data", "asked"), (2, "data", "taught")]
