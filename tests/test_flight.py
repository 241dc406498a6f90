"""Pushed page data: cut anywhere it reads the same; references, objects by their brackets, almost-JSON."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import pages
from gristmill.sources import flight

LINES = '0:{"page":["$1","$L2"],"no":"$z","lost":"$ff"}\n1:{"opportunity":{"title":"Data \\"Analyst\\" {x}","tags":["a]","$3"],"pay":{"min":1}},"x":2}\n2:T9,two\nlines\n3:"three"\n4:{"self":"$5"}\n5:["$4"]\nb:{broken\n'


def page(text, cuts):
    ends = [0, *sorted(cuts), len(text)]
    pushed = [f"<script>self.__next_f.push({json.dumps([1, text[a:b]])})</script>" for a, b in zip(ends, ends[1:], strict=False)]
    return "<html><script>self.__next_f.push([0])</script>" + "<p>between</p>".join(pushed) + "<script>self.__next_f.push([broken])</script></html>"


def test_cut_anywhere_reads_the_same(spark):
    rng = random.Random(3)
    docs = [(i, page(LINES, rng.sample(range(1, len(LINES)), i % 7))) for i in range(40)] + [(98, None), (99, "<p>none</p>")]
    df = spark.createDataFrame(docs, "id int, html string").repartition(3)
    texts = {r.id: r.p for r in df.select("id", flight.payload(F.col("html")).alias("p")).collect()}
    assert all(texts[i] == LINES for i in range(40)) and texts[98] == texts[99] == ""
    rows = flight.resolved(flight.lines(df, "html", "id"))
    by_page = {}
    for r in rows.collect():
        by_page.setdefault(r.key, {})[r.id] = json.loads(r.value)
    assert set(by_page) == set(range(40))
    assert all(found == by_page[0] for found in by_page.values())
    found = by_page[0]
    assert found["0"]["page"] == [{"opportunity": {"title": 'Data "Analyst" {x}', "tags": ["a]", "three"], "pay": {"min": 1}}, "x": 2}, "two\nlines"]
    assert (found["0"]["no"], found["0"]["lost"]) == ("$z", "$ff") and "b" not in found
    assert (found["4"], found["5"]) == ({"self": "$5"}, ["$4"])
    assert {r.id for r in flight.resolved(flight.lines(df, "html", "id"), ["3"]).collect()} == {"3"}


def test_objects_by_their_brackets(spark):
    rows = [('x "opportunity" : {"a":"}\\\\\\"{","b":[1,{"c":2}]} y',), ('"opportunity":{"a":1',), ('"other":{}',), (None,), ('"opportunity":{"deep":' + "[" * 3000 + "]" * 3000 + ',"s":"' + "\\n" * 20000 + '"}',)]
    got = [r.o for r in spark.createDataFrame(rows, "t string").select(F.to_json(flight.record(F.col("t"), "opportunity")).alias("o")).collect()]
    assert json.loads(got[0]) == {"a": '}\\"{', "b": [1, {"c": 2}]}
    assert got[1] is got[2] is got[3] is None
    cut = [r.o for r in spark.createDataFrame(rows, "t string").select(pages.embedded_json(F.col("t"), "opportunity").alias("o")).collect()]
    assert json.loads(cut[4])["s"] == "\n" * 20000


def test_almost_json(spark):
    rows = [('{"a": "x // y /* z */", // note\n "b": 1 /* more\n lines */}',), ('{"a":"\t"}',), ("{'a':1}",), ("",), (None,), ('{"u":"http://e.x/a"}',), ('{"s":"' + "a\\\\" * 50000 + '"} // end',)]
    got = [r.j and json.loads(r.j) for r in spark.createDataFrame(rows, "t string").select(F.to_json(pages.lenient_json(F.col("t"))).alias("j")).collect()]
    assert got[:6] == [{"a": "x // y /* z */", "b": 1}, {"a": " "}, None, None, None, {"u": "http://e.x/a"}]
    assert len(got[6]["s"]) == 100000


@pytest.mark.parametrize("total,complete", [("2 Opportunities", True), ("1,200 opportunities", False), ("Opportunities", False)])
def test_item_lists_and_completeness(spark, total, complete):
    body = {"@graph": [{"@type": "WebPage"}, {"@type": "ItemList", "name": total, "itemListElement": [{"url": "u1", "name": "n1"}, {"item": {"url": "u2", "name": "n2"}}, {"name": "no url"}]}]}
    df = spark.createDataFrame([(f'<script type="application/ld+json">{json.dumps(body)}</script>',), ("",)], "h string").select(flight.item_list(F.col("h")).alias("l"))
    first, empty = df.withColumn("c", flight.is_complete(F.size("l.items"), F.col("l.total"), F.lit(False))).collect()
    assert [tuple(i) for i in first.l["items"]] == [("u1", "n1"), ("u2", "n2")] and first.c == complete
    assert empty.l["items"] == [] and not empty.c
