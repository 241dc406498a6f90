"""Hand-written cases of the rule tables, scores and places."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import mining
from gristmill.functions import entry, places, scoring
from gristmill.functions.classify import Rules, classify, matches_any
from gristmill.operators import normalising

SPEC = {
    "apprenticeship": ["trainee", "\\blevel [3-7]\\b"],
    "noise": {"title": ["\\b(mentor|tutor)\\b"], "graduateOnly": "graduates only"},
    "roles": [{"role": "data", "patterns": ["data scien", {"re": "\\bAI\\b", "cs": True}]}, {"role": "software_tech", "patterns": ["software"]}],
    "weakTitle": {"role": "data", "patterns": ["\\bdata\\b"], "exclude": "data entry"},
    "dataWords": "statistic",
    "level": {"title": [{"re": "\\blevel\\s*([2-7])\\b", "group": 1}, {"re": "degree", "level": 6}], "text": [{"re": "\\blevel\\s*([2-7])\\b", "group": 1}]},
    "degree": {"title": "degree", "text": "honours"},
    "interest": ["register your interest", "expression of interest", "\\bpre-?register\\b"],
}


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("Data Science Trainee Level 6", "with honours", (True, None, 6, "title", True, "data", "title", True)),
        ("Trainee Data Officer", None, (True, None, None, None, None, "data", "title_weak", True)),
        ("Trainee Data Entry clerk", "we use AI", (True, None, None, None, None, "data", "description", False)),
        ("Trainee ai clerk", "Level 3 qualification needed", (True, None, None, None, None, "other", None, False)),
        ("Trainee clerk", "a Level 3 apprenticeship in software", (True, None, 3, "text", None, "other", None, False)),
        ("Software Mentor trainee", "", (True, "mentor", None, None, None, "software_tech", "title", False)),
        ("Software trainee, graduates only", "", (True, "graduate scheme", None, None, None, "software_tech", "title", False)),
        ("Software Engineer", "", (False, None, None, None, None, "software_tech", "title", False)),
        (None, None, (False, None, None, None, None, "other", None, False)),
    ],
)
def test_classify(spark, title, text, want):
    rules = Rules.from_json(json.dumps(SPEC))
    row = spark.createDataFrame([(title, text)], "title string, text string").select(classify(F.col("title"), rules, F.col("text")).alias("k")).first().k
    assert (row.wanted_kind, row.noise, row.level, row.level_source, row.is_degree, row.role, row.role_via, row.relevant) == want


def test_source_and_standard_come_first(spark):
    rules = Rules.from_json(json.dumps(SPEC))
    standard = F.struct(F.lit(7).alias("level"), F.lit("ops").alias("role"), F.lit(False).alias("degree"), F.lit("Trainee x").alias("title"))
    row = spark.range(1).select(classify(F.lit("Clerk level 5"), rules, level=F.lit(None).cast("int"), standard=standard).alias("a"), classify(F.lit("Clerk level 5"), rules, level=F.lit(4), standard=standard, known=F.lit(True)).alias("b")).first()
    assert (row.a.level, row.a.level_source, row.a.role, row.a.role_via, row.a.is_degree, row.a.relevant) == (7, "lars", "ops", "standard", False, True)
    assert (row.b.level, row.b.level_source) == (4, "source")


@pytest.mark.parametrize(("title", "want"), [("Register your interest - Data", True), ("Expression of interest", True), ("Pre-register now", True), ("An interesting role", False)])
def test_registers_interest(spark, title, want):
    rules = Rules.from_json(json.dumps(SPEC))
    assert spark.range(1).select(matches_any(F.lit(title), rules.interest).alias("y")).first().y is want


@pytest.mark.parametrize(
    ("country", "text", "known", "want"),
    [("GB", None, False, True), (" Scotland ", "Paris", False, True), ("DE", "London", True, False), ("SW1A 1AA", "Leeds", True, True), (None, "Derry, Northern Ireland", False, True), (None, "Cork, Ireland", True, False), (None, "Leeds", None, None), ("", "", True, None)],
)
def test_is_uk(spark, country, text, known, want):
    df = spark.createDataFrame([(country, text, known)], "c string, t string, k boolean")
    assert df.select(places.is_uk(F.col("c"), F.col("t"), F.col("k"), ("Paris", "Ireland")).alias("y")).first().y is want


@pytest.mark.parametrize(("given", "want"), [([False, False], True), ([False, None], False), ([], False), ([True, False], False)])
def test_all_abroad(spark, given, want):
    assert spark.createDataFrame([(given,)], "p array<boolean>").select(places.all_abroad(F.col("p")).alias("y")).first().y is want


@pytest.mark.parametrize(
    ("points", "least", "n", "none", "mine", "want"),
    [(120, None, None, None, "BBB", "meets"), (128, None, None, None, "BBB", "close"), (136, None, None, None, "BBB", "below"), (120, None, None, None, "", None), (None, None, None, True, "E", "meets"), (None, None, None, True, "", None), (None, "B", None, None, "ABC", "close"), (None, "C", None, None, "ABC", "meets"), (None, "A*", 2, None, "BCC", "below"), (None, None, 3, None, "AA", "below"), (None, None, 2, None, "AA", "meets"), (None, None, None, None, "AA", None)],
)
def test_grade_fit(spark, points, least, n, none, mine, want):
    df = spark.createDataFrame([(points, least, n, none, mine)], "p int, l string, n int, o boolean, m string")
    assert df.select(scoring.grade_fit(F.col("p"), F.col("l"), F.col("n"), F.col("o"), F.col("m")).alias("y")).first().y == want


def test_highers(spark):
    row = spark.range(1).select(scoring.grades_to_points(scoring.split_grades(F.lit("BBCC")), True).alias("h"), scoring.grades_to_points(scoring.split_grades(F.lit("A* A b c"))).alias("a")).first()
    assert (row.h, row.a) == (96, 144)


@pytest.mark.parametrize(
    ("connector", "blocked", "error", "before", "relevant", "want"),
    [("manual", True, "x", "open", 1, "manual"), ("feed", True, "x", "open", 1, "blocked"), ("feed", None, "HTTP 503", "open", 0, "open"), ("feed", False, "request timed out", "unknown", 0, "error"), ("feed", False, "bad config", "open", 3, "error"), ("feed", False, None, "closed", 2, "open"), ("feed", False, None, None, 0, "closed")],
)
def test_employer_status(spark, connector, blocked, error, before, relevant, want):
    df = spark.createDataFrame([(connector, blocked, error, before, relevant)], "c string, b boolean, e string, s string, n int")
    assert df.select(normalising.employer_status(*(F.col(c) for c in "cbesn"), passing=("(?i)http 5[0-9]{2}", "(?i)timed out")).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("text", "kind", "points", "summary"),
    [
        ("You'll want ABB-BBC at A-Level, with B in Maths. Statistics would be nice.", "grades", 112, "ABB–BBC at A level, incl. Maths"),
        ("a minimum of 112 UCAS points, or BBC at A level", "grades", 112, "112 UCAS points (BBC at A level)"),
        ("At least 96 UCAS tariff points from three subjects", "points", 96, "96 UCAS points"),
        ("UCAS points of 128 including Computer Science", "points", 128, "128 UCAS points, incl. Computer Science"),
        ("999 UCAS points", None, None, None),
        ("104 UCAS points (A Level BCC) or like", "grades", 104, "104 UCAS points (BCC at A level)"),
        ("SQA Highers at ABBB including Maths and English.", "highers", 114, "ABBB at Higher, incl. Maths"),
        ("Four Highers (BBCC) including Maths or Computing", "highers", 96, "BBCC at Higher, incl. Maths"),
        ("3 A-Levels as grade C/4 or above, with at least one in Maths, Sciences and IT", "each", 96, "3 A levels at C or above"),
        ("Two A Levels Grade B or above or, BTEC Extended Diploma (DDM)", "each", 80, "2 A levels at B or above"),
        ("Three A levels at grade B or above in Maths", "each", None, "3 A levels, incl. Maths at B or above"),
        ("A Levels Three A Levels Grade C or above in Physics At least one other", "each", None, "3 A levels, incl. Physics at C or above"),
        ("Level 3 Qualification (Apprenticeship/A Levels/BTEC etc.) or work", "any", None, "Any Level 3 (A levels, BTEC…)"),
        ("You will need 2 A levels.", "count", None, "2 A levels (any grades)"),
        ("Five GCSEs including English and Maths.", "gcse", None, "GCSEs only"),
        ("A great place to join our data team. ABC Ltd", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_requirement(spark, text, kind, points, summary):
    r = spark.createDataFrame([(text,)], "t string").select(entry.requirement(F.col("t")).alias("r")).first().r
    assert (r.kind, r.points, r.summary) == (kind, points, summary) if kind else r is None


@pytest.mark.parametrize(
    ("listed", "want"),
    [
        ([("A Level", "Maths", "BBC", None)], ("grades", 112, None, None, None)),
        ([("A Level", "Any x3", "A-D", "Essential")], ("listed", None, 3, "D", None)),
        ([("GCSE", "Maths", "4", None), ("A Level", "ICT", "C, or above", "Essential")], ("listed", None, None, "C", ["ICT"])),
        ([("A Level", "Maths, Science or similar", "B", "Desired")], ("listed", None, None, None, None)),
        ([("GCSE or equivalent", "English", "4", "Essential")], ("gcse", None, None, None, None)),
        ([], None),
        (None, None),
    ],
)
def test_listed_qualifications(spark, listed, want):
    df = spark.createDataFrame([(None, listed)], f"t string, q {entry.QUALIFICATION}")
    r = df.select(entry.requirement(F.col("t"), F.col("q")).alias("r")).first().r
    assert (r and (r.kind, r.points, r.n_levels, r.least_grade, r.grade_subjects)) == want


def test_phrases_are_made_from_the_texts_once(spark, tmp_path):
    """What is found is read twice, so it is written first: the result no longer reads the texts."""
    spark.createDataFrame([("a", 1, ["x", "y", "z"]), ("b", 2, ["x", "y", "z"]), ("c", 3, ["x", "y"])], "owner string, id long, words array<string>").write.parquet(f"{tmp_path}/rows")
    got = mining.phrases(spark.read.parquet(f"{tmp_path}/rows"), "words", "owner", (2, 3), 2, "id")
    assert sorted(map(tuple, got.collect())) == [("x y", 3, 1), ("x y z", 2, 1)]
    assert got.inputFiles() and not [f for f in got.inputFiles() if str(tmp_path) in f]


def test_phrases_travel_as_packed_hashes(spark):
    """Few packs whatever the number of phrases; owners, examples and null ones as by the plain count."""
    rows = [("a", 5, ["p", "q", "p", "q"]), (None, 3, ["p", "q", "r"]), ("b", None, ["p", "q", "r"]), ("c", 4, ["q", "r", "s"]), ("c", 4, ["q", "r", "s"]), ("d", None, ["t", "u"]), (None, None, ["t", "u"]), ("e", 9, []), ("e", 9, ["p"])]
    got = mining.phrases(spark.createDataFrame(rows, "owner string, id long, words array<string>"), "words", "owner", (2, 3), 2, "id")
    assert sorted(map(tuple, got.collect())) == [("p q", 3, 3), ("p q r", 2, 3), ("q r", 3, 3), ("t u", 2, None)]
    few = np.array([7, -3, 7, 7], np.int64)
    assert mining._unpack_few(mining._pack_few(few)).tolist() == few.tolist()
    many = np.arange(4000, dtype=np.int64) % 20 * (1 << 58)
    assert len(mining._pack_few(many)) < 4000
