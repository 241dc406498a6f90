"""Feeds from invented payloads, and streams against batch."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.plans import feed_queries, listing_queries, registry
from gristmill.sources import feeds
from gristmill.streaming import merging

assert feed_queries
assert listing_queries


def today():
    return F.lit("2026-05-10").cast("date")


def landed(spark, *payloads):
    return spark.createDataFrame([(str(i), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "file string, body string")


def test_greenhouse(spark):
    body = {"jobs": [{"id": 1, "title": "Data &amp; AI", "absolute_url": "u", "location": {"name": "Leeds"}, "first_published": "2026-01-02T03:04:05Z", "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;"}, {"id": 2, "title": " "}]}
    (r,) = feeds.parse(landed(spark, body), "greenhouse", today(), "Acme").collect()
    assert (r.source_id, r.title, r.employer, r.description, str(r.posted), r.place) == ("1", "Data & AI", "Acme", "Hi & bye", "2026-01-02", "Leeds")


def test_last_of_an_id_wins_and_bad_bodies(spark):
    body = {"results": [{"jobId": 5, "jobTitle": "a", "date": "3/4/2026"}, {"jobId": 5, "jobTitle": "b", "date": "3/4/2026", "minimumSalary": 20000.4, "maximumSalary": 20000.4}]}
    rows = landed(spark, body, "{broken", None, {"other": 1})
    (r,) = feeds.parse(rows, "reed", today()).collect()
    assert (r.title, str(r.posted), r.salary_min, r.salary_max) == ("b", "2026-04-03", 20000, None)
    assert feeds.rejects(rows, "reed").count() == 3


def test_lever_epoch_and_array_body(spark):
    (r,) = feeds.parse(landed(spark, [{"id": "x", "text": "T", "hostedUrl": "u", "createdAt": 1782948600000, "categories": {"location": "York"}}]), "lever", today()).collect()
    assert (str(r.posted), r.place) == ("2026-07-02", "York")


def test_ids_from_content_and_unlisted(spark):
    body = {"jobs_results": [{"title": "T", "company_name": "C", "location": "L"}] * 2}
    assert feeds.parse(landed(spark, body), "google_jobs", today()).count() == 1
    body = {"jobs": [{"id": "a", "title": "T", "isListed": False}, {"id": "b", "title": "T"}]}
    assert [r.source_id for r in feeds.parse(landed(spark, body), "ashby", today()).collect()] == ["b"]


def test_ties_between_files_go_by_file(spark):
    rows = landed(spark, {"results": [{"jobId": 5, "jobTitle": "a"}, {"jobId": 5, "jobTitle": "b"}]}, {"results": [{"jobId": 5, "jobTitle": "c"}]})
    assert [r.title for r in feeds.parse(rows.repartition(3), "reed", today()).collect()] == ["c"]


def test_levels_and_guessed_pay(spark):
    body = {"vacancies": [{"vacancyReference": k, "title": "T", "course": {"level": c}, "apprenticeshipLevel": a} for k, (c, a) in enumerate([(5, "Degree"), (1, "Higher"), (None, "advanced"), (None, "odd")])]}
    assert [r.level for r in feeds.parse(landed(spark, body), "faa", today()).orderBy("source_id").collect()] == [5, 4, 3, None]
    body = {"results": [{"id": 1, "title": "T", "salary_min": 30000, "salary_is_predicted": "1"}, {"id": 2, "title": "T", "salary_min": 30000, "salary_is_predicted": "0"}]}
    assert [r.salary_min for r in feeds.parse(landed(spark, body), "adzuna", today()).orderBy("source_id").collect()] == [None, 30000]
    body = {"data": [{"id": 1, "title": "T", "coordinates": "51.5, -3.2", "apprenticeshipLevel": 3}, {"id": 2, "title": "T", "coordinates": "x", "apprenticeshipLevel": 7}]}
    assert [(r.lat, r.lon, r.level) for r in feeds.parse(landed(spark, body), "wales", today()).orderBy("source_id").collect()] == [(51.5, -3.2, 4), (None, None, None)]


def test_xml_feeds(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<workzag-jobs><position><id>7</id><office>ACME-Leeds </office><name>Data  role</name><createdAt>2026-01-02T03:00:00</createdAt><jobDescriptions><jobDescription><name>Tasks</name><value>&lt;p&gt;Do&lt;/p&gt;</value></jobDescription></jobDescriptions></position><position><id>8</id><name>B</name></position></workzag-jobs>")
    got = sorted(map(tuple, feeds.xml_positions(spark, str(tmp_path / "p.xml")).collect()))
    assert [(r[0], r[1], r[2], str(r[3]), r[4]) for r in got] == [("7", "Data role", "Leeds", "2026-01-02", "Tasks Do"), ("8", "B", None, "None", "")]
    (tmp_path / "r.xml").write_text("<rss><channel><title>x</title><item><title>A &amp;amp; B</title><link>https://e.x/jobs/12-a</link><pubDate>Wed, 01 Jul 2026 23:30:00 GMT</pubDate></item><item><title>C</title><guid>g</guid></item></channel></rss>")
    assert [(r.source_id, r.title, str(r.posted)) for r in feeds.rss(spark, str(tmp_path / "r.xml"), today()).orderBy("source_id").collect()] == [("12", "A & B", "2026-07-02"), ("g", "C", "None")]


def test_anchors(spark):
    html = """<a class=x href="/a?b=1&amp;c=2">One <b>two</b></a><A HREF='u'>T</A><a name=q>none</a>"""
    (r,) = spark.createDataFrame([(html,)], "h string").select(feeds.anchors(F.col("h")).alias("a")).collect()
    assert [tuple(a) for a in r.a] == [("/a?b=1&c=2", "One two"), ("u", "T")]


def test_windows_and_first_seen(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in (("windows", lambda s: merging.windowed_counts(s, "ts", "event_type", "1 day", "30 days")), ("first", lambda s: merging.first_seen(s.withColumn("ts", F.col("ts")), "user_id", "ts", "900 days"))):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {r.user_id for r in spark.table("first").collect()} == {r.user_id for r in events.select("user_id").distinct().collect()}
    assert spark.table("first").count() == events.select("user_id").distinct().count()
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert all(want[k] == n for k, n in got.items())


def test_every_feed_has_known_columns():
    assert all(set(f.paths) <= set(feeds.COLUMNS) for f in feeds.FEEDS.values())


def test_files_and_sitemap(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"offers": [{"id": 1, "title": "T", "careers_url": "u"}]}))
    assert feeds.parse(feeds.bodies(spark, str(tmp_path)), "recruitee", today()).count() == 1
    site = tmp_path / "s.xml"
    site.write_text("<urlset><url><loc> https://e.x/1 </loc><lastmod>2026-01-02T00:00:00Z</lastmod></url><url><loc>https://e.x/2</loc></url></urlset>")
    assert sorted((r.url, str(r.lastmod)) for r in feeds.sitemap(spark, str(site)).collect()) == [("https://e.x/1", "2026-01-02"), ("https://e.x/2", "None")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = merging.upsert_stream(stream, str(tmp_path / "out"), "user_id", "event_id", str(tmp_path / "check"))
    query.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()}
    assert last == 2
    assert got == {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def several_pages(spark, folder):
    """Pages of which two and two share a URL, two of those also their text; titles with references."""
    rows = [(0, "u", "<title>A &quot;b&quot; &amp; c</title>x"), (1, "u", "<title>\u00a0A &AMP; b</title>x &pound;1 &lt;"), (2, "v", "<p>y</p>"), (3, "v", "<p>z</p>"), (4, "w", "<p>y</p>"), (5, "w", "<p>y</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["changed_boards", "jobs_by_hand", "html_to_text"])
def test_several_pages_of_one_url(spark, tmp_path, name):
    con = several_pages(spark, tmp_path)
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_pages_by_url(spark):
    pages = spark.createDataFrame([("u", "b"), ("u", "a"), ("v", None)], "url string, title string")
    typed = spark.createDataFrame([("u", ""), ("u", "t"), ("v", None), ("x", None)], "url string, title string")
    assert sorted((r.url, r.title or "-") for r in feeds.by_hand(typed, pages, ("title",)).collect()) == [("u", "a"), ("u", "t"), ("v", "-"), ("x", "-")]
