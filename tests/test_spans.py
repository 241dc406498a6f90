"""Names of a large dictionary against a plain loop."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gristmill.operators import spans


def plain(text, names):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    by_first = {}
    for spelling, name in names.items():
        by_first.setdefault(spelling[0], []).append((spelling, name))
    out, i = [], 0
    while i < len(words):
        hits = [(len(s), n) for s, n in by_first.get(words[i], []) if tuple(words[i : i + len(s)]) == s]
        if hits:
            n, name = max(hits)
            out.append((name, i, n))
            i += n
        else:
            i += 1
    return out


def test_a_large_dictionary_equals_a_loop(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(300)] + ["of", "the", "university", "college"] * 10
    names = {}
    for i in range(100_000):
        names.setdefault(tuple(rng.choices(pool, k=rng.choice([1, 2, 2, 3, 4, 5])) if i > 200 else [f"only{i}"]), f"n{i:06d}")
    texts = [" ".join(rng.choices(pool + ["only7", "Only8"], k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "...", "University, of-the W1"]
    table = spark.createDataFrame([(n, " ".join(s)) for s, n in names.items()], "name string, spelling string")
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in enumerate(texts)], "id int, text string, word string, n int, name string").repartition(4)
    got = {r.id: [tuple(s) for s in r.spans] for r in spans.named(docs, "text", table).collect()}
    assert got == {i: plain(t, names) for i, t in enumerate(texts)}


def test_overlaps_aliases_and_counts(spark):
    names = spark.createDataFrame([("Leeds", "University of Leeds"), ("Leeds", "Leeds Uni"), ("Beckett", "Leeds Beckett University"), ("City", "leeds"), ("None", " - "), ("York", "University of York")], "name string, spelling string")
    docs = spark.createDataFrame([(1, "Leeds Beckett University of York; university of leeds uni. LEEDS, Leeds"), (1, "Leeds Beckett University of York; university of leeds uni. LEEDS, Leeds"), (2, None)], "id int, text string")
    rows = spans.named(docs, "text", names).withColumn("most", spans.most_named(F.col("spans"))).withColumn("other", spans.most_named(F.col("spans"), F.lit("City"))).collect()
    assert [r.id for r in sorted(rows)] == [1, 1, 2]
    first = [r for r in rows if r.id == 1]
    assert first[0] == first[1]
    assert [s.name for s in first[0].spans] == ["Beckett", "Leeds", "City", "City"] and first[0].most == "City" and first[0].other == "Beckett"
    assert next(r for r in rows if r.id == 2).most is None
    assert spans.named(docs.limit(0), "text", names).collect() == []
