"""Registered queries of rules, scores, places and the smaller operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import dates, entry, labels, links, numbers, pages, places, scoring, text
from gristmill.functions.classify import LevelRule, Rules, classify
from gristmill.operators import discovery, entity, lifecycle, merging, mining, normalising, querying, views
from gristmill.plans.registry import query, table
from gristmill.sources import markup

DAY = "1997-01-15"


def _day() -> Column:
    return F.lit(DAY).cast("date")


# rules and scores

#: Invented rules for the parts' names.
RULES = Rules(
    wanted=("widget", "bolt", "gear"),
    noise=("small", "cold w"),
    roles=(("tools", ("bolt",)), ("gadgets", ("widget",)), ("thrift", ("economy",))),
    weak_role="metal",
    weak=("gear",),
    weak_but="large gear",
    data_words="economy|promo",
    title_levels=(LevelRule(r"\bL([2-7])\b", group=1), LevelRule("large", level=6)),
    text_levels=(LevelRule(r"level ([2-7])\b", group=1),),
    degree_title="hot",
    degree_text="promo",
)
POINTS = scoring.Points(roles={"tools": 40, "gadgets": 25, "thrift": 10}, levels={4: 10, 5: 12, 6: 20}, no_level=5, weak_role=8, role_with_data={"gadgets": 30}, description_factor=0.5, degree=10, title_specific=7, fresh_days=400, fresh=5, closing_passed=-30, lead_cap=50, penalties=((r"large", -5, "large"), (r"economy", -60, "cheap")))


def _adverts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as adverts."""
    asks = F.when(F.col("p_partkey") % 2 == 0, " standard for ").otherwise(" qualification for ")
    title = F.concat("p_name", F.lit(" L"), (F.col("p_size") % 9).cast("string"))
    body = F.concat(F.lit("a level "), (F.col("p_size") % 8).cast("string"), asks, F.lower("p_type"))
    day = lambda n: F.date_add(_day(), (F.col("p_partkey") % n - n // 2).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size", title.alias("title"), body.alias("body"), F.date_sub(_day(), (F.col("p_partkey") % 900).cast("int")).alias("posted"), day(60).alias("closing"), (F.col("p_partkey") % 11 == 0).alias("lead"))


_SQL_ADVERTS = f"""t AS (SELECT p_partkey, p_brand, p_size, p_name || ' L' || (p_size % 9) AS title, 'a level ' || (p_size % 8) || CASE WHEN p_partkey % 2 = 0 THEN ' standard for ' ELSE ' qualification for ' END || lower(p_type) AS body,
    DATE '{DAY}' - CAST(p_partkey % 900 AS INTEGER) AS posted, DATE '{DAY}' + CAST(p_partkey % 60 - 30 AS INTEGER) AS closing, p_partkey % 11 = 0 AS lead FROM part),
  l AS (SELECT *, CASE WHEN p_size % 9 BETWEEN 2 AND 7 THEN p_size % 9 WHEN contains(title, 'large') THEN 6 END AS tl,
    CASE WHEN p_size % 8 BETWEEN 2 AND 7 AND (p_size % 8 >= 4 OR p_partkey % 2 = 0) THEN p_size % 8 END AS xl FROM t),
  k AS (SELECT *, regexp_matches(title, 'widget|bolt|gear') AS kind, CASE WHEN contains(title, 'small') THEN 'small' WHEN contains(title, 'cold w') THEN 'cold w' END AS noise,
    CAST(coalesce(tl, xl) AS INTEGER) AS level, CASE WHEN tl IS NOT NULL THEN 'title' WHEN xl IS NOT NULL THEN 'text' END AS level_source,
    CASE WHEN contains(title, 'bolt') THEN 'tools' WHEN contains(title, 'widget') THEN 'gadgets' WHEN contains(title, 'gear') AND NOT contains(title, 'large gear') THEN 'metal' WHEN contains(body, 'economy') THEN 'thrift' ELSE 'other' END AS role,
    CASE WHEN regexp_matches(title, 'bolt|widget') THEN 'title' WHEN contains(title, 'gear') AND NOT contains(title, 'large gear') THEN 'title_weak' WHEN contains(body, 'economy') THEN 'description' END AS role_via,
    regexp_matches(body, 'economy|promo') AS data_words,
    CASE WHEN contains(title, 'hot') THEN true WHEN coalesce(tl, xl) >= 6 AND contains(body, 'promo') THEN true END AS is_degree FROM l),
  c AS (SELECT *, kind AND noise IS NULL AND (level IS NULL OR level >= 4) AND coalesce(role_via <> 'description', false) AS relevant FROM k)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    rows = _adverts(spark, d)
    return rows.withColumn("kind", classify(F.col("title"), RULES, F.col("body")))


@query(f"WITH {_SQL_ADVERTS} SELECT p_partkey, kind AS wanted_kind, noise, level, level_source, is_degree, role, role_via, data_words, relevant FROM c")
def classify_listings(spark: SparkSession, d: str) -> DataFrame:
    """Kind, role, level, degree and relevance of adverts by a table of rules."""
    return _classified(spark, d).select("p_partkey", "kind.*").drop("has_standard")


_SQL_SCORED = """p AS (SELECT *, CASE WHEN role_via = 'title_weak' THEN 8 WHEN role_via = 'description' THEN 5 WHEN role = 'tools' THEN 40 WHEN role = 'gadgets' AND data_words THEN 30 WHEN role = 'gadgets' THEN 25 ELSE 0 END AS role_p,
    CASE level WHEN 4 THEN 10 WHEN 5 THEN 12 WHEN 6 THEN 20 ELSE 5 END AS level_p, CASE WHEN is_degree THEN 10 ELSE 0 END AS degree_p, CASE WHEN role_via = 'title' THEN 7 ELSE 0 END AS spec_p,
    CASE WHEN date_diff('day', posted, DATE '1997-01-15') <= 400 THEN 5 ELSE 0 END AS fresh_p,
    CASE WHEN contains(title, 'large') THEN -5 ELSE 0 END + CASE WHEN contains(title || body, 'economy') THEN -60 ELSE 0 END + CASE WHEN closing < DATE '1997-01-15' THEN -30 ELSE 0 END AS pen_p FROM c),
  s AS (SELECT *, CAST(CASE WHEN lead THEN least(50, t) ELSE t END AS BIGINT) AS total FROM (SELECT *, greatest(0, least(100, role_p + level_p + degree_p + spec_p + fresh_p + pen_p)) AS t FROM p))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).withColumn("score", scoring.base_score(F.col("title"), F.col("body"), F.col("kind"), F.col("posted"), F.col("closing"), F.col("lead"), _day(), POINTS))


@query(
    f"""WITH {_SQL_ADVERTS}, {_SQL_SCORED} SELECT p_partkey, CAST(role_p AS BIGINT) AS role, CAST(level_p AS BIGINT) AS level, CAST(degree_p AS BIGINT) AS degree, CAST(spec_p AS BIGINT) AS specificity, CAST(fresh_p AS BIGINT) AS freshness, CAST(pen_p AS BIGINT) AS penalties, total,
    array_to_string(list_filter([CASE WHEN contains(title, 'large') THEN 'large' END, CASE WHEN contains(title || body, 'economy') THEN 'cheap' END, CASE WHEN closing < DATE '{DAY}' THEN 'closing date passed' END], lambda x: x IS NOT NULL), ',') AS labels FROM s"""
)
def scored_listings(spark: SparkSession, d: str) -> DataFrame:
    """The base score of adverts, part by part."""
    return _scored(spark, d).select("p_partkey", "score.*").withColumn("labels", F.array_join("labels", ","))


@query(
    f"""WITH {_SQL_ADVERTS}, {_SQL_SCORED},
    f AS (SELECT *, CASE role WHEN 'tools' THEN 'high' WHEN 'thrift' THEN 'no' ELSE 'maybe' END AS rp, CASE WHEN level IS NULL THEN NULL WHEN level = 6 THEN 'high' WHEN level = 4 THEN 'no' ELSE 'maybe' END AS lp,
      CASE role WHEN 'tools' THEN 40 WHEN 'gadgets' THEN 30 WHEN 'thrift' THEN 10 ELSE 0 END AS full_ FROM s),
    g AS (SELECT *, CASE WHEN full_ > 0 THEN CAST(floor(CASE WHEN rp = 'high' THEN 50 ELSE 20 END * least(1.0, role_p / full_) + 0.5) AS BIGINT) ELSE 0 END + CASE WHEN lp IS NULL THEN 5 WHEN lp = 'high' THEN 30 ELSE 10 END
      + degree_p + spec_p + fresh_p + pen_p + CASE WHEN p_size % 5 = 0 THEN 6 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN -12 ELSE 0 END AS raw FROM f),
    h AS (SELECT *, CASE WHEN total < greatest(0, least(100, role_p + level_p + degree_p + spec_p + fresh_p + pen_p)) THEN least(raw, total) ELSE raw END AS sc FROM g)
    SELECT p_partkey, CAST(CASE WHEN total <= 0 OR sc <= 0 THEN 0 ELSE greatest(0, least(100, sc)) END AS BIGINT) AS score, CAST(CASE WHEN total <= 0 OR sc <= 0 THEN 0 ELSE sc END AS BIGINT) AS rank, CASE WHEN rp = 'no' THEN 'role' WHEN lp = 'no' THEN 'level' END AS excluded FROM h"""
)
def personal_scores(spark: SparkSession, d: str) -> DataFrame:
    """A person's own score of adverts, its unclamped form for ranks, and what their preferences exclude."""
    prefs = F.create_map(F.lit("tools"), F.lit("high"), F.lit("thrift"), F.lit("no"))
    level_prefs = F.create_map(F.lit("6"), F.lit("high"))
    role = scoring.role_pref(prefs, F.col("kind.role"), {})
    level = scoring.level_pref(level_prefs, F.col("kind.level"), {"4": "no"})
    full = F.when(F.col("kind.role") == "tools", 40).when(F.col("kind.role") == "gadgets", 30).when(F.col("kind.role") == "thrift", 10).otherwise(0)
    weights = {"role_high": 50, "role_maybe": 20, "level_high": 30, "level_maybe": 10, "near": 6}
    parts = scoring.personal_parts(F.col("score"), F.col("kind.role"), full, role, level, 5, weights, F.col("p_size") % 5 == 0, [("pay", F.when(F.col("p_size") % 7 == 0, -12))])
    rows = _scored(spark, d).withColumns({"parts": parts, "excluded": scoring.excluded_by(role, level)})
    return rows.select("p_partkey", scoring.personal_score(F.col("score"), F.col("parts")).alias("score"), scoring.personal_score(F.col("score"), F.col("parts"), False).alias("rank"), "excluded")


_TARIFF = "CASE g WHEN 'A*' THEN 56 WHEN 'A' THEN 48 WHEN 'B' THEN 40 WHEN 'C' THEN 32 WHEN 'D' THEN 24 WHEN 'E' THEN 16 END"


@query(
    f"""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'A*AB' WHEN 1 THEN 'b b c' WHEN 2 THEN '' WHEN 3 THEN 'CDE A' WHEN 4 THEN NULL ELSE 'AA' END AS grades, CASE WHEN s_suppkey % 5 < 3 THEN CAST(96 + s_nationkey * 2 AS INTEGER) END AS points,
      CASE WHEN s_suppkey % 5 = 3 THEN 'B' END AS least_grade, CASE WHEN s_nationkey % 3 = 0 THEN 2 END AS n_levels, s_nationkey % 7 = 0 AS no_grades FROM supplier),
    g AS (SELECT *, regexp_extract_all(regexp_replace(upper(coalesce(grades, '')), '\\s+', '', 'g'), 'A\\*|[A-E]') AS mine FROM s),
    p AS (SELECT *, list_sum((list_reverse_sort(list_transform(mine, lambda g: {_TARIFF})))[1:3]) AS own, len(list_filter(mine, lambda g: g IN ('A*', 'A', 'B'))) AS reached, least(coalesce(n_levels, 3), len(mine)) AS need FROM g)
    SELECT s_suppkey, CAST(own AS INTEGER) AS points, CASE WHEN points IS NOT NULL THEN CASE WHEN points - own <= 0 THEN 'meets' WHEN points - own <= 8 THEN 'close' WHEN own IS NOT NULL THEN 'below' END
      WHEN no_grades THEN CASE WHEN len(mine) > 0 THEN 'meets' END WHEN n_levels > len(mine) AND len(mine) > 0 THEN 'below'
      WHEN least_grade IS NOT NULL AND len(mine) > 0 THEN CASE WHEN reached >= need THEN 'meets' WHEN reached = need - 1 THEN 'close' ELSE 'below' END WHEN n_levels <= len(mine) THEN 'meets' END AS fit FROM p"""
)
def grade_fits(spark: SparkSession, d: str) -> DataFrame:
    """Tariff points of grades, and how they fit what is asked for."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    grades = F.element_at(F.array(*map(F.lit, ["A*AB", "b b c", "", "CDE A", None, "AA"])), (key % 6 + 1).cast("int"))
    points = F.when(key % 5 < 3, (96 + nation * 2).cast("int"))
    fit = scoring.grade_fit(points, F.when(key % 5 == 3, "B"), F.when(nation % 3 == 0, 2), nation % 7 == 0, F.coalesce(grades, F.lit("")))
    return table(spark, d, "supplier").select("s_suppkey", scoring.grades_to_points(scoring.split_grades(F.coalesce(grades, F.lit("")))).alias("points"), fit.alias("fit"))


@query(
    """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS c, CASE WHEN s_suppkey % 3 = 0 THEN 12 END AS m, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey + 50 END AS o FROM supplier)
    SELECT s_suppkey, CAST(CASE WHEN c IS NOT NULL AND (m IS NULL OR c <= m) THEN c WHEN m IS NOT NULL THEN m ELSE coalesce(o, 999) END AS INTEGER) AS rank, CASE WHEN c IS NOT NULL AND (m IS NULL OR c <= m) THEN 'computer science' WHEN m IS NOT NULL THEN 'maths' ELSE 'overall' END AS "table" FROM r"""
)
def best_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place that counts of several tables."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    best = scoring.best_rank(F.when(key % 2 == 0, nation), F.when(key % 3 == 0, 12), F.when(key % 5 != 0, nation + 50))
    return table(spark, d, "supplier").select("s_suppkey", best["rank"].alias("rank"), best["table"].alias("table"))


# places, normalising, states

_COUNTRIES = ["GB", "england", "FR", "", None, "Ireland", "BS1 4DJ"]
_TEXTS = ["Belfast, Northern Ireland", "Dublin", "Leeds, UK", "Somewhere", None]


@query(
    """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 5 THEN false
      ELSE CASE s_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN true END END END AS in_uk FROM supplier"""
)
def uk_places(spark: SparkSession, d: str) -> DataFrame:
    """Whether places are in the country: true, false or null where nothing tells."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    known = places.is_uk(pick(_COUNTRIES, F.col("s_suppkey") % 7), pick(_TEXTS, F.col("s_nationkey") % 5), F.col("s_suppkey") % 2 == 0, ("Dublin", "Ireland"))
    return table(spark, d, "supplier").select("s_suppkey", known.alias("in_uk"))


@query(
    f"""WITH {_SQL_ADVERTS}, r AS (SELECT *, p_partkey % 13 = 0 AS by_hand, CASE WHEN p_partkey % 5 = 0 THEN 'board' ELSE 'own' END AS source, CASE WHEN p_partkey % 10 = 0 THEN p_brand || '@x.org' ELSE 'The ' || p_brand || ' Ltd' END AS employer,
      CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS where_ FROM c)
    SELECT p_partkey, trim(regexp_replace(lower(replace(p_brand, '#', ' ')), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN p_partkey % 10 = 0 THEN ' x org' ELSE '' END AS employer_norm, CAST(10000 + p_size * 100 AS BIGINT) AS least,
      CASE WHEN closing <= DATE '{DAY}' + 730 THEN closing END AS closing_date FROM r
    WHERE (by_hand OR (relevant AND where_ <> 1)) AND NOT (source = 'board' AND (contains(employer, '@') OR p_brand IN ('Brand#1', 'Brand#2')))"""
)
def normalised_listings(spark: SparkSession, d: str) -> DataFrame:
    """Raw adverts that are wanted, in the one schema: rules, country, boards and providers decide."""
    key = F.col("p_partkey")
    place = lambda t, c: F.struct(F.lit(t).alias("text"), F.lit(c).alias("country"), F.lit(t).alias("city"), F.lit(False).alias("in_uk"))
    where = F.when(key % 4 == 0, F.array().cast("array<struct<text:string,country:string,city:string,in_uk:boolean>>")).when(key % 4 == 1, F.array(place("Paris", "FR"), place("Berlin", None))).otherwise(F.array(place("Paris", "FR"), place("Somewhere", None)))
    raw = _adverts(spark, d).select(
        "p_partkey",
        F.when(key % 5 == 0, "board").otherwise("own").alias("source"),
        F.concat(F.lit(" "), "title", F.lit("  ")).alias("title"),
        F.when(key % 10 == 0, F.concat("p_brand", F.lit("@x.org"))).otherwise(F.concat(F.lit("The "), "p_brand", F.lit(" Ltd"))).alias("employer"),
        F.col("body").alias("description"),
        F.lit(None).cast("int").alias("level"),
        F.concat(F.lit("£"), F.format_number(10000 + F.col("p_size") * 100, 0), F.lit(" a year")).alias("salary_text"),
        F.col("closing").alias("closing_date"),
        (key % 13 == 0).alias("by_hand"),
        where.alias("locations"),
    )
    providers = spark.createDataFrame([("The Brand#1 Company",), ("BRAND#2 plc",)], "name string")
    return normalising.normalise(raw, RULES, _day(), providers, ["board"], ("Paris", "Berlin")).select("p_partkey", "employer_norm", "pay.least", "closing_date")


@query(
    """WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS title FROM part), g(name, place, lat, is_point) AS (VALUES ('cold', 'Cold', 51.0, true), ('cold bolt', 'Coldbolt', 52.0, true), ('promo', 'Promo Area', 53.0, false), ('promo', 'Promoton', 54.0, true), ('widget', 'Widgetham', 55.0, true)),
    k AS (SELECT name, arg_min(place, (NOT is_point, place)) AS place, arg_min(lat, (NOT is_point, place)) AS lat FROM g GROUP BY 1),
    m AS (SELECT p_partkey, place, lat, row_number() OVER (PARTITION BY p_partkey ORDER BY len(string_split(name, ' ')) DESC, position(' ' || name || ' ' IN ' ' || lower(title) || ' ')) AS n FROM p JOIN k ON contains(' ' || lower(title) || ' ', ' ' || name || ' '))
    SELECT p.p_partkey, m.place, m.lat FROM p LEFT JOIN m ON m.p_partkey = p.p_partkey AND n = 1"""
)
def places_in_titles(spark: SparkSession, d: str) -> DataFrame:
    """The longest name of a gazetteer that a title has."""
    gazetteer = spark.createDataFrame([("Cold", ["cold"], True, 51.0, 0.0), ("Coldbolt", ["Cold Bolt"], True, 52.0, 0.0), ("Promo Area", ["promo"], False, 53.0, 0.0), ("Promoton", ["Promo"], True, 54.0, 0.0), ("Widgetham", ["widget", ""], True, 55.0, 0.0)], "place string, names array<string>, is_point boolean, lat double, lon double")
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return places.find_places(rows, "title", gazetteer).select("p_partkey", "place", "lat")


@query(
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN 50 + s_suppkey % 50 * 0.2 END AS lat, s_suppkey % 80 * 0.1 - 5 AS lon FROM supplier), g AS (SELECT n_name AS place, 50 + n_nationkey * 0.4 AS plat, n_nationkey * 7 % 25 * 0.3 - 5 AS plon FROM nation),
    m AS (SELECT s_suppkey, place, 2 * 3958.8 * asin(sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2))) AS miles FROM s CROSS JOIN g)
    SELECT s.s_suppkey, arg_min(place, (miles, place)) FILTER (WHERE miles <= 40) AS place, round(min(miles) FILTER (WHERE miles <= 40), 3) AS miles FROM s LEFT JOIN m ON m.s_suppkey = s.s_suppkey GROUP BY 1"""
)
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """The nearest place within forty miles, by cells."""
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(key % 9 != 0, 50 + key % 50 * 0.2).alias("lat"), (key % 80 * 0.1 - 5).alias("lon"))
    gazetteer = table(spark, d, "nation").select(F.col("n_name").alias("place"), (50 + nation * 0.4).alias("place_lat"), (nation * 7 % 25 * 0.3 - 5).alias("place_lon"))
    return places.nearest(rows, gazetteer, 40).select("s_suppkey", "place", F.round("miles", 3).alias("miles"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'manual' WHEN c_custkey % 5 = 0 THEN 'blocked' WHEN c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'error' ELSE 'open' END WHEN c_custkey % 4 = 2 THEN 'error' WHEN c_acctbal > 5000 THEN 'open' ELSE 'closed' END AS status,
      CAST(CASE WHEN c_custkey % 7 = 0 THEN 30 ELSE least(30, greatest(3, c_nationkey + 2)) END AS INTEGER) AS days FROM customer"""
)
def employer_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The state of employers after a run, and how far a feed is read back."""
    key = F.col("c_custkey")
    error = F.when(key % 4 == 1, "HTTP 503").when(key % 4 == 2, "bad config")
    status = normalising.employer_status(F.when(key % 6 == 0, "manual").otherwise("feed"), key % 5 == 0, error, F.when(key % 3 == 0, "unknown").otherwise("open"), F.when(F.col("c_acctbal") > 5000, 2).otherwise(0), ("(?i)http 5[0-9]{2}",))
    days = normalising.look_back_days(F.when(key % 7 != 0, F.date_sub(_day(), F.col("c_nationkey"))), _day())
    return table(spark, d, "customer").select("c_custkey", status.alias("status"), days.alias("days"))


# texts

@query("SELECT c_custkey, c_name || ' & £5 ''q'' ’ 😀 &nope; &lt; –' AS decoded FROM customer")
def decoded_entities(spark: SparkSession, d: str) -> DataFrame:
    """Character references of all kinds, each decoded once."""
    return table(spark, d, "customer").select("c_custkey", text.decode_entities(F.concat("c_name", F.lit(" &amp; &pound;5 &#39;q&#x27; &RSQUO; &#128512; &nope; &amp;lt; &ndash;"))).alias("decoded"))


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(replace(c_name, '#', ' ')) WHEN 1 THEN lower(replace(c_name, '#', ' ')) || ' and sons' ELSE 'the' END AS employer,
      'data and ' || lower(c_mktsegment) || ' analyst' AS title, replace(upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)), ' ', ' ') || ' of York UK' AS shown FROM customer"""
    .replace("ELSE 'the' END", "ELSE lower(replace(c_name, '#', ' ')) END")
)
def tidied_names(spark: SparkSession, d: str) -> DataFrame:
    """Employers and titles in the form in which they are compared, and shouting names for display."""
    key = F.col("c_custkey")
    employer = F.when(key % 3 == 0, F.concat(F.lit("The "), "c_name", F.lit(" Company Corp"))).when(key % 3 == 1, F.concat(F.lit("3631 "), "c_name", F.lit(" &amp; Sons Ltd."))).otherwise(F.concat("c_name", F.lit(" (UK) Holdings plc")))
    title = F.concat(F.lit("Apprentice Data & "), F.col("c_mktsegment"), F.lit(" Analyst L4 2027 Level 6 Programme"))
    return table(spark, d, "customer").select("c_custkey", text.normalise_employer(employer).alias("employer"), text.normalise_title(title).alias("title"), text.display_case(F.concat("c_mktsegment", F.lit(" OF YORK UK"))).alias("shown"))


@query(
    """WITH o AS (SELECT o_orderkey, 10000 + o_orderkey % 90000 AS pay FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(CASE o_orderkey % 4 WHEN 1 THEN floor(pay / 1000) * 1000 ELSE pay END AS BIGINT) END AS least, CASE WHEN o_orderkey % 4 = 0 THEN CAST(pay + 500 AS BIGINT) END AS most FROM o"""
)
def salaries_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Pay that adverts state among bonuses, fees and other people's pay."""
    key, pay = F.col("o_orderkey"), 10000 + F.col("o_orderkey") % 90000
    written = lambda c: F.concat(F.lit("£"), F.format_number(c, 0))
    body = (
        F.when(key % 4 == 0, F.concat(F.lit("Fees of £9,250 are paid. Salary: "), written(pay), F.lit(" to "), written(pay + 500), F.lit(" per annum. Apply.")))
        .when(key % 4 == 1, F.concat(F.lit("A bonus of £6,000! You will earn £"), F.floor(pay / 1000).cast("string"), F.lit("k with us")))
        .when(key % 4 == 2, F.concat(F.lit("We won £20,000. It is "), written(pay), F.lit(" a year")))
        .otherwise(F.concat(F.lit("Graduates earn an average salary of "), written(pay)))
    )
    return table(spark, d, "orders").select("o_orderkey", numbers.salary_in_text(body).alias("pay")).select("o_orderkey", "pay.least", "pay.most")


@query(
    """SELECT p_partkey, sha1(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '|' || array_to_string(list_sort(list_distinct([CASE WHEN p_size % 2 = 0 THEN 'science' ELSE 'engineer' END, 'data', split_part(p_name, ' ', 2)])), ' ') || '|' || split_part(p_name, ' ', 1)) AS key FROM part"""
)
def vacancy_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which one vacancy meets itself on other boards: stems, without stop words and the town's name."""
    role = F.when(F.col("p_size") % 2 == 0, "Scientists").otherwise("Engineering")
    noun, town = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    title = F.concat_ws(" ", F.lit("2027 Data"), role, F.lit("Apprenticeship for the"), noun, F.lit("L4 -"), town)
    return table(spark, d, "part").select("p_partkey", text.dedupe_key(F.col("p_brand"), title, town).alias("key"))


# smaller joins, windows and maps

@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) WHEN 2 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS sorts_as FROM orders"""
)
def start_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """Start dates as they sort: months and years at their end."""
    four, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    precision = F.when(four == 1, "year").when(four == 2, "month").otherwise("day")
    return table(spark, d, "orders").select("o_orderkey", dates.period_end(F.when(four != 0, day), precision).alias("sorts_as"))


@query(
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1"""
)
def latest_good_run(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user that was no error."""
    good = table(spark, d, "events").filter("event_type != 'error'").withColumn("at", F.struct("ts", "event_id"))
    return merging.pick(good, ["user_id"], "at", last=True).select("event_id", "user_id")


@query(
    """WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(n, 0) = 0 AS empty_board, coalesce(failed = n, false) AS failing, coalesce(kinds > 1, false) AS several FROM customer LEFT JOIN g ON o_custkey = c_custkey"""
)
def health_flags(spark: SparkSession, d: str) -> DataFrame:
    """Boards that are empty or fail, and those with several kinds of source."""
    found = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_distinct("o_orderpriority").alias("kinds"))
    false = F.lit(False)
    rows = table(spark, d, "customer").select("c_custkey").join(found, "c_custkey", "left")
    return rows.select("c_custkey", (F.coalesce("n", F.lit(0)) == 0).alias("empty_board"), F.coalesce(F.col("failed") == F.col("n"), false).alias("failing"), F.coalesce(F.col("kinds") > 1, false).alias("several"))


@query(
    """SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS BIGINT) AS rank FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""
)
def ranked_types(spark: SparkSession, d: str) -> DataFrame:
    """Event types by how many there are, with their place; a row for each type, so the window is small."""
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))


@query(
    """SELECT o_orderkey, coalesce(c.c_name, 'Customer of old') AS name, CASE WHEN c.c_custkey IS NULL THEN 'listing' WHEN o_orderkey IS NULL THEN 'sitemap' ELSE 'both' END AS seen, c.c_custkey
    FROM (SELECT * FROM orders WHERE o_orderkey % 5 = 0) o FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o.o_custkey = c.c_custkey"""
)
def cards_and_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Cards and sitemap entries, whichever has them."""
    cards, entries = table(spark, d, "orders").filter("o_orderkey % 5 = 0"), table(spark, d, "customer").filter("c_custkey % 3 != 0")
    met = cards.join(entries, F.col("o_custkey") == F.col("c_custkey"), "full_outer")
    seen = F.when(F.col("c_custkey").isNull(), "listing").when(F.col("o_orderkey").isNull(), "sitemap").otherwise("both")
    return met.select("o_orderkey", F.coalesce("c_name", F.lit("Customer of old")).alias("name"), seen.alias("seen"), "c_custkey")


@query(
    """SELECT o.o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN 'kept' ELSE 'fetched' END AS page FROM orders o LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus || o_orderpriority END AS sig FROM orders WHERE o_orderkey % 2 = 0) s
      ON s.o_orderkey = o.o_orderkey AND s.sig = o.o_orderstatus || o.o_orderpriority"""
)
def cached_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose signature is the stored one are kept, others fetched."""
    pages = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("sig"))
    stored = pages.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("sig")).alias("sig"), F.lit("kept").alias("page"))
    return pages.join(stored, ["o_orderkey", "sig"], "left").select("o_orderkey", F.coalesce("page", F.lit("fetched")).alias("page"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS extra, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n FROM orders"""
)
def overlaid_details(spark: SparkSession, d: str) -> DataFrame:
    """Maps laid over each other: later keys win, null and empty values count for nothing."""
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("none"), F.lit(""))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("new"), F.lit("extra"), F.lit("x"), F.lit("gone"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    laid = merging.overlay(old, new)
    return table(spark, d, "orders").select("o_orderkey", laid.alias("m")).select("o_orderkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("status", "priority", "extra")), F.size("m").alias("n"))


@query(
    """WITH b AS (SELECT p_partkey, p_name || ' - ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' works' ELSE '' END AS title FROM part),
    t AS (SELECT *, split_part(title, ' - ', 1) AS role, split_part(title, ' - ', 2) AS client FROM b)
    SELECT p_partkey, CASE WHEN client = 'promo' OR split_part(client, ' ', 1) = 'economy' THEN role ELSE title END AS title, CASE WHEN client = 'promo' THEN 'promo' WHEN split_part(client, ' ', 1) = 'economy' THEN 'economy' END AS employer FROM t"""
)
def reattributed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that end in a known employer's name give their advert to it; a short name must be the whole end."""
    end = F.when(F.col("p_partkey") % 2 == 0, " works").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" - "), F.lower("p_type"), end).alias("title"))
    known = spark.createDataFrame([("promo",), ("economy",)], "known_name string")
    split = rows.select("p_partkey", "title", F.substring_index("title", " - ", 1).alias("role"), F.substring_index("title", " - ", -1).alias("name"))
    found = entity.prefix_match(split.select("name"), known, shorter=False)
    met = split.join(found, "name", "left")
    return met.select("p_partkey", F.when(F.col("known_name").isNotNull(), F.col("role")).otherwise(F.col("title")).alias("title"), F.col("known_name").alias("employer"))


@query(
    """SELECT c_custkey, row_number() OVER (ORDER BY next_closing ASC NULLS LAST, c_name) AS place FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey) END AS next_closing FROM customer) QUALIFY place <= 50"""
)
def companies_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty companies by their next closing date, those without one last, then by name."""
    nexts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("next_closing")).filter("c_custkey % 4 = 0")
    rows = table(spark, d, "customer").select("c_custkey", "c_name").join(nexts, "c_custkey", "left")
    first = rows.orderBy(*querying.ordering("next_closing", False, [F.col("c_name")])).limit(50)  # a report of fifty
    return first.withColumn("place", F.row_number().over(Window.orderBy(*querying.ordering("next_closing", False, [F.col("c_name")]))).cast("long")).select("c_custkey", "place")


# views, labels, closing rules


@query(
    """WITH s AS (SELECT l_orderkey AS id, string_agg(l_returnflag || ':' || l_linenumber || ':' || (l_returnflag = 'R'), ',' ORDER BY CAST(l_shipdate AS DATE), l_returnflag, l_linenumber) AS sources FROM lineitem GROUP BY 1),
    n AS (SELECT user_id AS id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'none' END AS status, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS hidden, coalesce(sources, '') AS sources, coalesce(n, 0) AS notes_count,
      o_orderkey % 5 = 0 AS pre_register, o_orderkey % 7 = 0 AS is_manual, CASE WHEN o_orderkey % 2 = 0 THEN 'a:asked' END AS skills FROM orders LEFT JOIN s ON s.id = o_orderkey LEFT JOIN n ON n.id = o_orderkey"""
)
def listings_view(spark: SparkSession, d: str) -> DataFrame:
    """Listings with tracking, sources in order, notes and flags."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    details = F.create_map(F.lit("preRegister"), F.when(key % 5 == 0, "true"), F.lit("manual"), F.when(key % 7 == 0, "true").otherwise("false"), F.lit("other"), F.lit("x"))
    skills = F.when(key % 2 == 0, F.array(F.struct(F.lit("a").alias("id"), F.lit("asked").alias("ctx"), F.lit("long text").alias("quote"))))
    tracking = orders.filter("o_orderkey % 3 = 0").select(key.alias("listing_id"), F.col("o_orderpriority").alias("status"), (key % 2 == 0).alias("hidden"), F.lit(None).cast("timestamp").alias("hidden_at"), F.lit(None).cast("timestamp").alias("applied_at"))
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").cast("string").alias("url"), F.when(F.col("l_returnflag") == "R", "dead").alias("link_status"), F.to_date("l_shipdate").alias("first_seen_at"))
    notes = table(spark, d, "events").select(F.col("user_id").alias("listing_id"))
    seen = views.listings_view(orders.select(key.alias("id"), details.alias("details"), skills.alias("skills")), tracking, item, notes)
    told = lambda name, one: F.array_join(F.transform(name, one), ",").alias(name)
    return seen.select("id", "status", "hidden", told("sources", lambda s: F.concat_ws(":", s["source"], s["url"], s["dead"].cast("string"))), "notes_count", "pre_register", "is_manual", told("skills", lambda s: F.concat_ws(":", s["id"], s["ctx"])))


@query(
    f"""WITH l AS (SELECT o_custkey, o_orderstatus <> 'F' AS on_, o_orderkey % 5 = 0 AS reg, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS closing, CAST(o_orderdate AS DATE) - 40 AS first_, CAST(o_orderdate AS DATE) - 3 AS last_ FROM orders)
    SELECT c_custkey AS id, count(*) FILTER (WHERE on_ AND NOT reg) AS active_listings, count(*) FILTER (WHERE on_ AND reg) AS interest_listings, min(closing) FILTER (WHERE on_ AND closing >= DATE '{DAY}') AS next_closing,
      min(first_) FILTER (WHERE NOT on_) AS last_season_first_seen, max(coalesce(closing, last_)) FILTER (WHERE NOT on_) AS last_season_closed, coalesce(any_value(n), 0) AS notes_count
    FROM customer LEFT JOIN l ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey GROUP BY 1"""
)
def employers_view(spark: SparkSession, d: str) -> DataFrame:
    """Employers with their open listings, those to register for, and their last season."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("employer_id"), (F.col("o_orderstatus") != "F").alias("is_active"), (key % 5 == 0).alias("pre_register"), F.when(key % 3 != 0, day).alias("closing_date"), F.date_sub(day, 40).alias("first_seen_at"), F.date_sub(day, 3).alias("last_seen_at"))
    return views.employers_view(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), rows, table(spark, d, "events").select(F.col("user_id").alias("employer_id")), _day())


@query(
    f"""WITH k AS (SELECT p_partkey, p_partkey % 40 - 3 AS days, CAST(p_partkey % 900 AS INTEGER) AS back, CASE WHEN p_size % 3 <> 0 THEN p_size % 8 END AS level, p_size % 2 = 0 AS deg, p_retailprice FROM part)
    SELECT p_partkey, CASE WHEN days < 0 THEN 'Closed' WHEN days = 0 THEN 'Closes today' WHEN days = 1 THEN 'Closes tomorrow' WHEN days <= 30 THEN 'Closes in ' || days || ' days' END AS closing,
      CASE WHEN level IS NULL THEN CASE WHEN deg THEN 'Degree' ELSE 'Level ?' END ELSE 'L' || level || CASE WHEN deg THEN ' · Degree' ELSE '' END END AS level,
      CASE WHEN back <= 0 THEN 'today' WHEN back = 1 THEN 'yesterday' WHEN back < 14 THEN back || ' days ago' WHEN year(DATE '{DAY}' - back) = 1997 THEN strftime(DATE '{DAY}' - back, '%-d %b') ELSE strftime(DATE '{DAY}' - back, '%-d %b %Y') END AS seen,
      CASE p_partkey % 4 WHEN 0 THEN 'Nationwide' WHEN 1 THEN 'A +1' WHEN 2 THEN 'Wales' ELSE 'Location unknown' END AS place, CASE WHEN p_partkey % 5 = 0 THEN '£' || format('{{:,}}', CAST(floor(p_retailprice) AS BIGINT)) WHEN p_partkey % 5 = 1 THEN '£' || format('{{:,}}', CAST(floor(p_retailprice) AS BIGINT)) || '–£' || format('{{:,}}', CAST(floor(p_retailprice) AS BIGINT) + 2000) WHEN p_partkey % 5 = 2 THEN 'Competitive' END AS pay FROM k"""
)
def listing_labels(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of adverts: deadline, level, last seen, place and pay."""
    key, size = F.col("p_partkey"), F.col("p_size")
    cities = F.when(key % 4 == 1, F.array(F.lit("A"), F.lit("B"), F.lit("A"), F.lit(None))).otherwise(F.array(F.lit(None).cast("string")))
    floor = F.floor("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey",
        labels.closing_label(key % 40 - 3).alias("closing"),
        labels.level_label(F.when(size % 3 != 0, size % 8), size % 2 == 0).alias("level"),
        labels.ago_label(F.date_sub(_day(), (key % 900).cast("int")), _day()).alias("seen"),
        labels.place_label(cities, F.lit(None).cast("string"), F.when(key % 4 == 2, "Wales").otherwise("Unknown"), key % 4 == 0).alias("place"),
        labels.salary_label(F.when(key % 5 < 2, floor).otherwise(0), F.when(key % 5 == 1, floor + 2000), F.when(key % 5 == 2, "Competitive").when(key % 5 == 3, "x" * 50)).alias("pay"),
    )


@query(
    """SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'grades' WHEN 1 THEN 'points' WHEN 2 THEN 'highers' WHEN 3 THEN 'each' WHEN 4 THEN 'any' WHEN 5 THEN 'count' WHEN 6 THEN 'gcse' END AS kind,
      CAST(CASE s_suppkey % 8 WHEN 0 THEN 112 WHEN 1 THEN 96 + s_nationkey WHEN 2 THEN 96 WHEN 3 THEN 120 END AS INTEGER) AS points, CASE s_suppkey % 8 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Computer Science,Physics' WHEN 7 THEN NULL ELSE '' END AS subjects, CAST(CASE s_suppkey % 8 WHEN 3 THEN 3 WHEN 5 THEN 2 END AS INTEGER) AS n_levels FROM supplier"""
)
def entry_requirements(spark: SparkSession, d: str) -> DataFrame:
    """What adverts ask for, in the order in which it counts."""
    key = F.col("s_suppkey") % 8
    points = (96 + F.col("s_nationkey")).cast("string")
    written = (
        F.when(key == 0, "You need ABB-BBC at A level, including Mathematics")
        .when(key == 1, F.concat(points, F.lit(" UCAS  points, incl. Computer Science, with a B in Physics")))
        .when(key == 2, "Highers at (BBCC) or like")
        .when(key == 3, "Three A-Levels at grade B or above")
        .when(key == 4, "A levels / BTEC welcome")
        .when(key == 5, "Two A levels please")
        .when(key == 6, "Five GCSEs with Maths")
        .otherwise("Nothing asked")
    )
    return table(spark, d, "supplier").select("s_suppkey", entry.requirement(written).alias("r")).select("s_suppkey", "r.kind", "r.points", F.array_join("r.subjects", ",").alias("subjects"), "r.n_levels")


@query(
    f"""WITH s AS (SELECT l_orderkey AS id, bool_and(l_returnflag = 'R') AS dead, bool_or(l_returnflag <> 'N' AND CAST(l_shipdate AS DATE) >= DATE '{DAY}' - 2) AS sure FROM lineitem GROUP BY 1),
    a AS (SELECT o_orderkey AS id, o_orderstatus <> 'F' AS on_, CASE WHEN o_orderkey % 2 = 0 THEN 'dead' END AS apply, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 8 END AS level, o_orderkey % 10 = 1 AS manual, coalesce(dead, false) AS dead, coalesce(sure, false) AS sure FROM orders LEFT JOIN s ON s.id = o_orderkey),
    b AS (SELECT *, coalesce(on_ AND level < 4 AND NOT manual, false) AS low FROM a), c AS (SELECT *, on_ AND NOT low AS still FROM b)
    SELECT id AS listing_id, still AND NOT dead AND NOT (coalesce(apply = 'dead', false) AND NOT sure) AS is_active, CASE WHEN still AND dead THEN 'link_dead' WHEN still AND coalesce(apply = 'dead', false) AND NOT sure THEN 'apply_closed' WHEN low THEN 'below_min_level' END AS closed_reason FROM c"""
)
def closed_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """Listings after those below the least level, with dead links, and with closed applications are closed."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("listing_id"), (F.col("o_orderstatus") != "F").alias("is_active"), F.lit(None).cast("string").alias("closed_reason"), F.when(key % 2 == 0, "dead").alias("apply_status"), F.when(key % 3 != 0, key % 8).alias("level"), (key % 10 == 1).alias("is_manual"))
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.when(F.col("l_returnflag") == "R", "dead").alias("link_status"), (F.col("l_returnflag") == "N").alias("incremental"), F.to_date("l_shipdate").alias("last_seen"))
    return lifecycle.close_by_links(lifecycle.close_below_level(rows), sources, _day()).select("listing_id", "is_active", "closed_reason")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE lower(o_orderstatus) END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""
)
def rederived_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that change when their derived columns are worked out anew, but for what was edited."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = rows.withColumn("edits", F.when(key % 3 == 0, F.create_map(F.lit("o_orderstatus"), F.lit("x"))))
    derived = rows.select("o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"), (F.col("o_totalprice") + F.when(key % 2 == 0, 1).otherwise(0)).alias("o_totalprice"))
    return lifecycle.rederived(stored, derived, "o_orderkey", ["o_orderstatus", "o_totalprice"], "edits")


@query(
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE l_linenumber END AS INTEGER) AS missed_runs FROM lineitem"""
)
def misses_reset(spark: SparkSession, d: str) -> DataFrame:
    """Misses of sources after a run that has seen some of them."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_linenumber").alias("missed_runs"))
    seen = items.filter("l_returnflag = 'N' AND l_linestatus = 'O'")
    return lifecycle.reset_misses(items, seen, ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "missed_runs")


@query(
    """SELECT page_id, url || '/a?x=1' AS plain, url || '/data-role-' || page_id || '.html?key=***&y=2' AS hidden, 'data,role' AS words, CASE WHEN page_id % 2 = 0 THEN 'own,gov' ELSE 'own,gov,board' END AS ranked FROM (SELECT page_id, 'https://e.x/' || page_id AS url FROM pages)"""
)
def link_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Links without session tokens and keys, the words of their last part, and several in order of their kind."""
    base = F.concat(F.lit("https://e.x/"), F.col("page_id").cast("string"))
    slug = F.concat(base, F.lit("/data-role-"), F.col("page_id").cast("string"), F.lit(".html"))
    one = lambda url, kind, dead=F.lit(False): F.struct(F.lit(url).alias("url"), F.lit(kind).alias("kind"), dead.alias("dead"))
    found = F.array(one("board", "board"), one("gov", "government"), one("own", "official"), one("board", "board", F.col("page_id") % 2 == 0), one("gov", "government"))
    return table(spark, d, "pages").select(
        "page_id",
        links.strip_session(F.concat(base, F.lit("/a;jsessionid=1F?x=1&sid=9&PHPSESSID=q"))).alias("plain"),
        links.redact(F.concat(slug, F.lit("?key=secret&y=2")), ["key", "token"]).alias("hidden"),
        F.array_join(links.slug_words(slug), ",").alias("words"),
        F.array_join(links.rank_links(found, ["official", "government", "provider", "board"]), ",").alias("ranked"),
    )


# pages and discovery


@query(
    """SELECT page_id, '<h3>T' || page_id || ' &amp; &lt;x</h3><p>a<br />b</p>' || CASE WHEN page_id % 2 = 0 THEN '<a href="https://e.x/?a=1&amp;b=2" target="_blank" rel="noopener noreferrer nofollow">go</a>' ELSE '<a target="_blank" rel="noopener noreferrer nofollow">go</a>' END || '<ul><li>one</li></ul>' AS html FROM pages"""
)
def safe_html(spark: SparkSession, d: str) -> DataFrame:
    """HTML with simple formatting and links only."""
    link = F.when(F.col("page_id") % 2 == 0, "https://e.x/?a=1&amp;b=2").otherwise("javascript:alert(1)")
    html = F.concat(F.lit("<script>x('<p>')</script><h1 class=big>T"), F.col("page_id").cast("string"), F.lit(" &amp; &lt;x</h1><p onclick=y>a<br>b</p><p></p><div><a href='"), link, F.lit("' style=z>go</a></div><ul><li>one</ul><style>p{}</style>"))
    return table(spark, d, "pages").select("page_id", pages.sanitise(html).alias("html"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE 'T ' || page_id END AS title, 'M & ' || page_id AS marked, '{"a":[1,"}"],"b":' || page_id || '}' AS embedded, CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 4 = 1 THEN true WHEN page_id % 4 = 2 THEN page_id + 1000 > 999 ELSE false END AS gone,
      'apply for data ' || page_id AS lines FROM pages"""
)
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Almost-JSON, embedded JSON, marked fields, headlines, and pages that say their job has gone."""
    key = F.col("page_id").cast("string")
    four = F.col("page_id") % 4
    almost = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"title": "T '), key, F.lit('", // the name\n "x": "a\tb"}'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"title":"T '), key, F.lit('"}'))).otherwise("{broken")
    marked = F.concat(F.lit('<meta itemprop="other" content="no"><span class=x itemprop="title"> M &amp;\n '), key, F.lit("</span>"))
    script = F.concat(F.lit('<script>var x = 1; window.state = {"a":[1,"}"],"b":'), key, F.lit("};</script>"))
    hidden = F.concat(F.lit('<div ph-state="expired"><p>has been filled</p></div><p>'), F.when(four == 1, "This job is no longer available").otherwise("Come"), F.lit("</p>"))
    asked = F.concat(F.lit("https://e.x/jobs/"), (F.col("page_id") + 1000).cast("string"))
    gone = pages.looks_gone(F.col("seen"), F.when(four == 0, 404).otherwise(200), ["no longer available", "has been filled"], asked, F.when(four == 2, "https://e.x/search").otherwise(asked))
    lines = pages.headlines(F.concat(F.lit("<ul><li>Apply for data "), key, F.lit("</li><li>Other</li></ul><script>apply</script><p>Apply for data "), key), "(?i)apply")
    shown = markup.without_hidden(table(spark, d, "pages").select("page_id", hidden.alias("seen")), "seen", 'ph-state="expired"')
    return shown.select("page_id", F.try_variant_get(pages.lenient_json(almost), "$.title", "string").alias("title"), pages.marked_field(marked, "title").alias("marked"), pages.embedded_json(script, "window.state").alias("embedded"), gone.alias("gone"), F.lower(F.array_join(lines, "|")).alias("lines"))


@query(
    """WITH l AS (SELECT o_custkey AS e, o_orderkey, CAST(floor(o_totalprice / 4000) AS BIGINT) AS score, CASE o_orderkey % 3 WHEN 0 THEN 'https://jobs.' || o_custkey || '.x.org/a/' || o_orderkey WHEN 1 THEN 'https://www.board.com/' || o_orderkey ELSE 'https://acme.greenhouse.io/' || o_orderkey END AS link FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0),
    k AS (SELECT * FROM l WHERE score >= 45 AND NOT contains(link, 'board.com') AND e % 5 <> 0)
    SELECT 'c ' || e AS name_norm, arg_max(link, (score, link)) AS url, CASE WHEN contains(arg_max(link, (score, link)), 'greenhouse') THEN 'greenhouse' END AS system, max(score) AS score FROM k GROUP BY e"""
)
def employer_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Employers of good adverts that are not watched yet."""
    key, name = F.col("o_orderkey"), F.concat(F.lit("c "), F.col("o_custkey").cast("string"))
    link = F.when(key % 3 == 0, F.concat(F.lit("https://jobs."), F.col("o_custkey").cast("string"), F.lit(".x.org/a/"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("https://www.board.com/"), key.cast("string"))).otherwise(F.concat(F.lit("https://acme.greenhouse.io/"), key.cast("string")))
    rows = table(spark, d, "orders").select(F.when(key % 7 == 0, 1).alias("employer_id"), (key % 11 == 0).alias("is_lead"), F.upper(name).alias("employer"), name.alias("employer_norm"), F.floor(F.col("o_totalprice") / 4000).alias("score"), F.lit("https://x.board.com/1").alias("apply_url"), link.alias("url"))
    ignored = table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.concat(F.lit("c "), F.col("c_custkey").cast("string")).alias("employer_norm"))
    return discovery.suggestions(rows, ignored, ["board.com"], [("greenhouse", r"greenhouse\.io"), ("lever", r"lever\.co")]).select("name_norm", "url", "system", "score")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS name_norm, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 4 = 1 THEN 'approved' ELSE 'pending' END WHEN c_custkey % 6 = 0 THEN 'dismissed' WHEN c_custkey % 6 = 2 AND c_custkey % 4 = 0 THEN 'approved' ELSE 'pending' END AS status,
      CASE WHEN c_custkey % 2 = 1 THEN 'new,both' WHEN c_custkey % 6 = 0 THEN 'both,old' WHEN c_custkey % 4 = 0 THEN 'new,both,old' ELSE 'both,old' END AS evidence,
      CASE WHEN c_custkey % 2 = 1 THEN 'insert' WHEN c_custkey % 6 <> 0 AND c_custkey % 4 = 0 THEN 'update' ELSE 'keep' END AS change FROM customer
    WHERE NOT (c_custkey % 6 = 4 AND c_custkey % 4 = 0)
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'watched', 'new,both,old', 'update' FROM customer WHERE c_custkey % 6 = 4 AND c_custkey % 4 = 0"""
    .replace("ELSE 'pending' END AS status,", "WHEN c_custkey % 6 = 4 THEN 'watched' ELSE 'pending' END AS status,")
)
def merged_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Stored suggestions after a run's new ones."""
    key, name = F.col("c_custkey"), F.col("c_custkey").cast("string").alias("name_norm")
    rows = table(spark, d, "customer")
    status = F.when(key % 6 == 0, "dismissed").when(key % 6 == 4, "watched").otherwise("pending")
    stored = rows.filter("c_custkey % 2 = 0").select(name, status.alias("status"), F.array(F.lit("both"), F.lit("old")).alias("evidence"))
    fresh = rows.filter("c_custkey % 2 = 1 OR c_custkey % 4 = 0").select(name, (key % 4 < 2).alias("approved"), F.array(F.lit("new"), F.lit("both")).alias("evidence"))
    return discovery.merge_suggestions(stored, fresh).withColumn("evidence", F.array_join("evidence", ","))


# orders and shares


@query(
    """WITH r AS (SELECT s_suppkey AS id, s_nationkey AS g, s_suppkey % 17 AS rank, 'T' || s_suppkey % 13 AS title, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS pay, CASE s_suppkey % 5 WHEN 0 THEN 'below' WHEN 1 THEN 'meets' WHEN 2 THEN 'subject' WHEN 3 THEN 'close' END AS fit, CASE s_suppkey % 3 WHEN 0 THEN 'saved' WHEN 1 THEN 'offer' ELSE 'none' END AS status FROM supplier)
    SELECT id, row_number() OVER (PARTITION BY g ORDER BY rank DESC, lower(title), id) AS by_score, row_number() OVER (PARTITION BY g ORDER BY pay DESC NULLS LAST, rank DESC, lower(title), id) AS by_salary, row_number() OVER (PARTITION BY g ORDER BY pay ASC NULLS LAST, rank DESC, lower(title), id) AS by_salary_up,
      row_number() OVER (PARTITION BY g ORDER BY lower(title), rank DESC, id) AS by_title, row_number() OVER (PARTITION BY g ORDER BY CASE fit WHEN 'meets' THEN 1 WHEN 'close' THEN 2 WHEN 'below' THEN 3 WHEN 'subject' THEN 4 END ASC NULLS LAST, rank DESC, lower(title), id) AS by_grades,
      row_number() OVER (PARTITION BY g ORDER BY CASE status WHEN 'offer' THEN 1 WHEN 'saved' THEN 4 END ASC NULLS LAST, rank DESC, lower(title), id) AS by_status FROM r"""
)
def listing_sorts(spark: SparkSession, d: str) -> DataFrame:
    """Places of listings by several sorts, unknown values last either way."""
    key = F.col("s_suppkey")
    fit = F.when(key % 5 == 0, "below").when(key % 5 == 1, "meets").when(key % 5 == 2, "subject").when(key % 5 == 3, "close")
    status = F.when(key % 3 == 0, "saved").when(key % 3 == 1, "offer").otherwise("none")
    rows = table(spark, d, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("g"), (key % 17).alias("rank"), F.concat(F.lit("T"), (key % 13).cast("string")).alias("title"), F.when(key % 4 != 0, F.col("s_acctbal")).alias("pay"), fit.alias("fit"), status.alias("status"))
    place = lambda sort, reverse=False: F.row_number().over(Window.partitionBy("g").orderBy(*querying.listing_order(sort, reverse))).cast("long")
    return rows.select("id", place("score").alias("by_score"), place("salary").alias("by_salary"), place("salary", True).alias("by_salary_up"), place("title").alias("by_title"), place("grades").alias("by_grades"), place("status").alias("by_status"))


@query(
    """WITH r AS (SELECT s_suppkey, s_suppkey % 5 + 1 AS w, CASE WHEN s_suppkey % 6 <> 0 THEN list_distinct([{'id': 'k' || s_suppkey % 4, 'ctx': CASE WHEN s_suppkey % 3 = 0 THEN 'asked' ELSE 'taught' END}, {'id': 'k' || s_suppkey % 7, 'ctx': 'job'}]) END AS s FROM supplier),
    e AS (SELECT w, unnest(s) AS s FROM r), k AS (SELECT s.id AS id, sum(w) AS w, count(*) AS n, count(*) FILTER (WHERE s.ctx = 'asked') AS asked, count(*) FILTER (WHERE s.ctx = 'taught') AS taught, count(*) FILTER (WHERE s.ctx = 'job') AS job FROM e GROUP BY 1)
    SELECT id, round(w / (SELECT sum(w) FROM r WHERE s IS NOT NULL), 9) AS share, n, asked, taught, job, CAST(row_number() OVER (ORDER BY w DESC, n DESC, id) AS INTEGER) AS place FROM k WHERE id <> 'k6'"""
)
def skill_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Skills by their weighted share among the adverts that list any, with the contexts in which they are named."""
    key = F.col("s_suppkey")
    one = lambda n, ctx: F.struct(F.concat(F.lit("k"), (key % n).cast("string")).alias("id"), ctx.alias("ctx"))
    listed = F.when(key % 6 != 0, F.array(one(4, F.when(key % 3 == 0, "asked").otherwise("taught")), one(7, F.lit("job"))))
    dictionary = spark.createDataFrame([(f"k{i}", i) for i in range(6)], "id string, ordinal int")
    rows = table(spark, d, "supplier").select((key % 5 + 1).alias("w"), listed.alias("s"))
    return mining.skill_shares(rows, "s", "w", dictionary).withColumn("share", F.round("share", 9))
