"""Free ids against giving them out one after another; grades with subjects; a person's own parts."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import scoring
from gristmill.operators import naming


def plain(names, taken):
    taken, out = set(taken), {}
    for ordinal, name in sorted(names):
        base = re.sub(r"^-+|-+$", "", re.sub("[^a-z0-9]+", "-", (name or "").lower()))[:40] or "company"
        id_, n = base, 1
        while id_ in taken:
            n += 1
            id_ = f"{base}-{n}"
        taken.add(id_)
        out[ordinal] = id_
    return out


def test_free_ids_equal_one_after_another(spark):
    rng = random.Random(6)
    pool = ["Acme", "ACME!", "Acme 2", "acme-3", "Bolt & Co", "Bolt Co", "", None, "Zed 1", "Zed", "Solo"]
    names = [(i * 3, rng.choice(pool)) for i in range(150)]
    taken = ["acme", "acme-4", "acme-2-2", "bolt-co-2", "bolt-co-3", "bolt-co-7", "company", "zed-1", "other", "solo-x", "solo-2"]
    df = spark.createDataFrame(names, "ordinal long, name string").repartition(3)
    got = {r.ordinal: r.id for r in naming.free_ids(df, spark.createDataFrame([(t,) for t in taken], "id string")).collect()}
    assert got == plain(names, taken) and len(set(got.values())) == len(names)
    none = spark.createDataFrame([], "id string")
    assert naming.free_ids(df.limit(0), none).collect() == []
    assert [r.id for r in naming.free_ids(spark.createDataFrame([(1, "x")], "ordinal long, name string"), none).collect()] == ["x"]


@pytest.mark.parametrize(
    ("points", "least", "n", "subjects", "about", "mine", "predicted", "want"),
    [
        (112, None, None, ["Maths"], None, ["History", "English"], "AAA", "subject"),
        (112, None, None, ["Maths"], None, ["Further Maths"], "AAA", "meets"),
        (112, None, None, ["Maths"], None, None, "AAA", "meets"),
        (None, "B", 3, None, ["ICT"], ["Computer Science", "Maths"], "ABB", "meets"),
        (None, "B", 3, None, ["ICT"], ["Maths", "Physics", "Art"], "ABB", "subject"),
        (None, "B", 3, None, ["a science"], ["Physics", "Art", "Music"], "ABC", None),
        (None, "B", 3, None, ["Maths"], ["Maths", "Art", "Music"], "CCC", "below"),
        (None, None, 3, None, None, ["Maths", "Art"], "AB", "below"),
        (None, None, 2, None, None, ["Maths", "Art"], None, "meets"),
        (112, None, None, None, None, ["Maths"], None, None),
    ],
)
def test_grades_with_subjects(spark, points, least, n, subjects, about, mine, predicted, want):
    df = spark.createDataFrame([(points, least, n, subjects, about, mine, predicted)], "p int, l string, n int, s array<string>, a array<string>, m array<string>, g string")
    fit = scoring.grade_fit(F.col("p"), F.col("l"), F.col("n"), F.lit(None).cast("boolean"), F.col("g"), F.col("s"), F.col("a"), F.col("m"))
    assert df.select(fit.alias("f")).first().f == want


def test_own_parts_and_derived_rows(spark):
    day = datetime.date(2026, 5, 1)
    rows = [("meets", True, datetime.date(2026, 9, 1), "month", 20000, "e1", 5, day + datetime.timedelta(3), day), ("subject", False, datetime.date(2027, 1, 1), "year", 0, "e2", 200, None, day - datetime.timedelta(4)), (None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "fit string, degree boolean, date date, precision string, pay int, employer string, rank int, closes date, seen date")
    weights = {"meets": 5, "close": -2, "below": -10, "subject": -20, "degree": 4, "early": -15, "low_pay": -8, "favourite": 9}
    parts = scoring.own_parts(F.col("fit"), F.col("degree"), F.struct("date", "precision"), F.col("pay"), F.col("employer"), weights, F.lit(True), F.lit("2026-10-01").cast("date"), F.lit(22000), F.array(F.lit("e1")), F.col("rank"), [(10, 8), (50, 3)], F.lit(0.5))
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in parts)).collect()]
    assert [n for n, _ in parts] == ["university", "grades", "degree", "early", "low_pay", "favourite"]
    assert got == [(4, 5, 4, -15, -8, 9), (None, -20, None, None, None, None), (None,) * 6]
    told = scoring.derived(df, F.lit(day), "closes", "seen").select("days_to_close", "is_new").collect()
    assert [tuple(r) for r in told] == [(3, True), (None, False), (None, False)]
