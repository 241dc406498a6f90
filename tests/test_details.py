"""Pages of single adverts: the budget against a loop, nothing asked twice, what pages say."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from gristmill.sources import details
from tests.test_markup import JOB


def plain_run(items, cache, known, landed, budget):
    """One source's items in order, one after another."""
    listings, kept, asked = {}, {}, []
    for id_, sig, own in items:
        hit = cache.get(id_)
        if hit and hit[0] == sig and (hit[1] is None or id_ in known):
            kept[id_] = hit
            listing = hit[1]
        else:
            listing = None
            if len(asked) < budget:
                asked.append(id_)
                if id_ in landed:
                    listing = landed[id_]
                    kept[id_] = (sig, listing)
                elif hit:
                    kept[id_] = hit
            elif hit:
                kept[id_] = hit
            listing = listing or (hit and hit[1]) or own
        if listing:
            listings[id_] = listing
    return listings, kept, asked


def test_budget_equals_a_loop(spark):
    rng = random.Random(7)
    sources = {}
    for s in ("a", "b", "c"):
        items = [(f"{s}{i}", rng.choice(["x", "y", None]), rng.choice([None, f"list {i}"])) for i in range(30)]
        cache = {i: (rng.choice(["x", "y", None]), rng.choice([None, f"old {i}"])) for i, _, _ in items if rng.random() < 0.6}
        known = {i for i, _, _ in items if rng.random() < 0.5}
        landed = {i: rng.choice([None, f"new {i}"]) for i, _, _ in items if rng.random() < 0.7}
        sources[s] = (items, cache, known, landed)
    items = spark.createDataFrame([(s, i, sig, k, own) for s, x in sources.items() for k, (i, sig, own) in enumerate(x[0])], "source string, id string, sig string, place int, own_text string").repartition(3)
    cache = spark.createDataFrame([(s, i, *v) for s, x in sources.items() for i, v in x[1].items()], "source string, id string, sig string, listing string")
    known = spark.createDataFrame([(s, i) for s, x in sources.items() for i in x[2]], "source string, id string")
    planned = details.plan(items, cache, known, budget=6)
    landed = spark.createDataFrame([(s, i, v, False) for s, x in sources.items() for i, v in x[3].items()] + [("a", "none", None, True)], "source string, id string, listing string, failed boolean")
    asked = {(r.source, r.id) for r in planned.filter("how = 'ask'").collect()}
    listings, kept = details.with_details(planned, cache, landed, F.col("own_text"))
    want = {s: plain_run(*x, 6) for s, x in sources.items()}
    assert asked == {(s, i) for s, w in want.items() for i in w[2]}
    assert {(r.source, r.id): r.listing for r in listings.collect()} == {(s, i): v for s, w in want.items() for i, v in w[0].items()}
    assert {(r.source, r.id): (r.sig, r.listing) for r in kept.collect()} == {(s, i): v for s, w in want.items() for i, v in w[1].items()}


def test_nothing_is_asked_twice(spark):
    items = spark.createDataFrame([("s", str(i), "x", i) for i in range(10)], "source string, id string, sig string, place int")
    cache = spark.createDataFrame([], "source string, id string, sig string, listing string")
    none, seen = spark.createDataFrame([], "source string, id string"), []
    for _ in range(4):
        planned = details.plan(items, cache, none, budget=4)
        asked = planned.filter("how = 'ask'").select("source", "id", F.lit(None).cast("string").alias("listing"), F.lit(False).alias("failed"))
        seen += [r.id for r in asked.collect()]
        _, kept = details.with_details(planned, cache, asked, F.lit(None).cast("string"))
        cache = spark.createDataFrame(kept.collect(), cache.schema)
    assert seen == [str(i) for i in range(10)] or sorted(seen, key=int) == [str(i) for i in range(10)]
    assert len(seen) == len(set(seen))


def test_candidates(spark):
    found = spark.createDataFrame([("s", "https://old.uk/job/data-analyst-apprentice/123", 2), ("s", "https://old.uk/job/data-analyst-apprentice/123/", 1), ("s", "https://old.uk/job/cook/5", 3), ("s", "https://old.uk/about", 4), ("t", None, 1)], "source string, url string, place int")
    got = details.candidates(found, "/job/", "apprentic|data", ("old.uk", "new.uk")).collect()
    assert [(r.source, r.id, r.url, r.place) for r in got] == [("s", "https://new.uk/job/data-analyst-apprentice/123", "https://new.uk/job/data-analyst-apprentice/123/", 1)]


def test_what_pages_say(spark):
    both = '<script type="application/ld+json">{"@type":"JobPosting","title":"By data","hiringOrganization":"O","validThrough":"2026-05-01"}</script>' + JOB
    docs = spark.createDataFrame([(1, both), (2, JOB), (3, "<p>nothing</p>"), (4, None), (5, "")], "id int, html string")
    got = {r.id: r.posting for r in details.postings(docs, "html", F.lit("2026-01-01").cast("date")).collect()}
    assert (got[1].title, got[1].via, got[1].closes) == ("By data", "json", datetime.date(2026, 5, 1))
    assert (got[2].title, got[2].via, got[2].place, got[2].closes) == ("Data & AI Apprentice", "microdata", "York, GB", datetime.date(2026, 3, 1))
    assert got[3] is got[4] is got[5] is None


def test_whose_page(spark):
    pages = [('<meta property="og:site_name" content="A &amp; B">',), ('<meta content="C" property="og:site_name">',), ("<title>Job - Careers | The D Group</title>",), ("<title>" + "x" * 80 + "</title>",), ("",), (None,)]
    got = [r.e for r in spark.createDataFrame(pages, "h string").select(details.employer_of(F.col("h")).alias("e")).collect()]
    assert got == ["A & B", "C", "The D Group", None, None, None]
