"""Tags matched by depth: hidden parts and microdata against a stack-based loop."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from gristmill.sources import markup

JOB = """<html><body><div itemscope itemtype="https://schema.org/WebPage"><meta itemprop="name" content="not the job">
<div itemscope itemtype="http://schema.org/JobPosting"><h1 itemprop="title">Data &amp; AI <b>Apprentice</b></h1>
<meta itemprop="datePosted" content="2026-01-05"/><meta content='2026-03-01' itemprop=validThrough>
<span itemprop="hiringOrganization" itemscope itemtype="http://schema.org/Organization"><a itemprop="url" href="https://o.example">x</a><i itemprop="name">Brook <i>and</i> Sons</i></span>
<div itemprop="jobLocation" itemscope><div>at <div itemprop="address" itemscope><span itemprop="addressLocality">York</span>, <span itemprop="addressCountry">GB</span></div></div></div>
<div itemprop="description"><div>Learn <div>on the job</div></div> <script>var x = "<div itemprop='title'>no</div>";</script>daily</div>
<span itemprop="identifier">J-7</span></div><p itemprop="late">after</p></div>"""
FLAT = """<div itemscope itemtype="https://schema.org/JobPosting"><span itemprop="title">Tester</span><span itemprop="jobLocation">Hull, Leeds</span><span itemprop="hiringOrganization">Widgets</span><link itemprop="url" href="/j/1"><div itemprop="description">never closed"""


def test_nested_scopes(spark):
    docs = spark.createDataFrame([(1, JOB), (2, FLAT), (3, None), (4, ""), (5, "<p itemprop='x'>no item</p></div></div>"), (1, JOB)], "id int, html string")
    found = markup.microdata(docs, "html").withColumn("job", markup.posting(F.col("items")))
    rows = found.orderBy("id").collect()
    assert [r.id for r in rows] == [1, 1, 2, 3, 4, 5]
    job = rows[0].job
    assert rows[0].job == rows[1].job
    assert (job.title, job.posted, job.closes, job.employer, job.city, job.country, job.place, job.identifier) == ("Data & AI Apprentice", "2026-01-05", "2026-03-01", "Brook and Sons", "York", "GB", "York, GB", "J-7")
    assert job.description.startswith("<div>Learn") and job.description.endswith("daily")
    page = rows[0]["items"][0]
    assert [(p.name, p.value) for p in page.props] == [("name", "not the job"), ("late", "after")]
    assert [i.parent for i in rows[0]["items"]].count(None) == 2
    flat = rows[2].job
    assert (flat.title, flat.place, flat.employer, flat.url, flat.description) == ("Tester", "Hull, Leeds", "Widgets", "/j/1", None)
    assert [r.job for r in rows[3:]] == [None] * 3 and all(not r["items"] for r in rows[3:])


def test_texts_of_properties_are_read_once(spark):
    """Not for each item, nor again for each condition on them."""
    docs = spark.createDataFrame([(1, JOB)], "id int, html string")
    plan = markup.microdata(docs, "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<(script|style)[^>]*>") == 1
    n = 600
    page = "".join(f'<div itemscope><b itemprop="name">N {i}</b><p itemprop="about">{"about <i>it</i> " * 20}</p></div>' for i in range(n))
    began = time.perf_counter()
    (r,) = markup.microdata(spark.createDataFrame([(page,)], "html string"), "html").collect()
    assert [[p.value for p in i.props] for i in r["items"]] == [[f"N {i}", " ".join(["about it"] * 20)] for i in range(n)]
    assert time.perf_counter() - began < 20


def plain_hidden(html, mark):
    """The outermost marked div or section goes, its end found by counting tags of its name."""
    out, at = [], 0
    tags = list(re.finditer(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[a-z][^>]*>", html))
    k = 0
    while k < len(tags):
        tag = tags[k].group()
        name = re.match(r"<([a-zA-Z0-9]+)", tag)
        if name and name[1].lower() in ("div", "section") and mark in tag.lower():
            depth, j = 1, k + 1
            while j < len(tags) and depth:
                other = re.match(r"<(/?)([a-zA-Z0-9]+)", tags[j].group())
                if other and other[2].lower() == name[1].lower():
                    depth += -1 if other[1] else 1
                j += 1
            out.append(html[at : tags[k].start()])
            at = len(html) if depth else tags[j - 1].end()
            k = j if not depth else len(tags)
        else:
            k += 1
    return " ".join([*out, html[at:]])


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        name = rng.choice(["div", "section", "p", "b"])
        mark = ' state="expired"' if rng.random() < 0.2 else ""
        inner = random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else f"t{rng.randint(0, 99)}"
        parts.append(f"<{name} class='x'{mark}>{inner}</{name.upper() if rng.random() < 0.2 else name}>")
        if rng.random() < 0.2:
            parts.append(rng.choice(["<br>", "<img src='a'>", "<!-- <div> -->", "<script>'</div>'</script>", "text & more"]))
    return "".join(parts)


def test_hidden_parts_equal_a_loop(spark):
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(120)] + ["", None, "</div></section>a", '<div state="expired">never closed <div>b</div>', '<div state="expired"><div>x</div>filled</div>kept', "</div><div state='expired'>a</div>b"]
    docs = spark.createDataFrame([(i, p, "other") for i, p in enumerate(pages)], "page int, html string, k string").repartition(3)
    got = {r.page: r.html for r in markup.without_hidden(docs, "html", "state=[\"']expired[\"']").collect()}
    assert len(got) == len(pages)
    for i, p in enumerate(pages):
        want = p if p is None else plain_hidden(p.replace("'expired'", '"expired"'), 'state="expired"')
        assert (got[i] or "").replace("'expired'", '"expired"') == (want or ""), p
    assert markup.without_hidden(docs.limit(0), "html", "x").collect() == []


def test_deep_pages_take_linear_time(spark):
    def took(n):
        docs = spark.createDataFrame([("<div itemscope><div>" * n + "x" + "</div></div>" * n,)], "html string")
        began = time.perf_counter()
        assert markup.without_hidden(docs, "html", "nothing").count() == 1
        (r,) = markup.microdata(docs, "html").select(F.size("items").alias("n")).collect()
        assert r.n == n
        return time.perf_counter() - began

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.5)
