"""Landed JSON feeds and XML sitemaps to one listing schema.

A feed is declared: where its items are, and from which paths of an item each column comes.  Bodies are whole files
or rows of text; an unreadable body gives no listings and is told of by :func:`rejects`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.dates import london_date, parse_date, parse_day_first
from gristmill.functions.text import collapse_spaces, decode_entities, html_to_text

COLUMNS = ("source_id", "url", "apply_url", "title", "employer", "description", "salary_min", "salary_max", "posted", "closing", "place", "lat", "lon", "level")


@dataclass(frozen=True)
class Feed:
    """``paths``: column to paths of which the first non-empty one counts.  ``items``: path of the array, or "" for a
    body that is the array.  ``escaped``: the description is HTML with escaped marks.  ``keep``: which items count.
    ``day_first``: dates are D/M/Y.  ``coords``: path of "lat,lon".  ``levels``: words or numbers of the level's path and
    what level they mean; other numbers from 2 to 7 mean themselves.  ``predicted``: path of a mark of pay that the feed
    has guessed, which counts for none."""

    name: str
    items: str
    paths: dict[str, tuple[str, ...]]
    epoch: bool = False
    escaped: bool = False
    keep: Callable[[Column], Column] | None = None
    employer: str | None = None
    day_first: bool = False
    coords: str = ""
    levels: dict[str, int] = field(default_factory=dict)
    predicted: str = ""


def _get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


# Field names of the public feeds.
FEEDS = {
    f.name: f
    for f in (
        Feed("adzuna", "results", {"source_id": ("id",), "url": ("redirect_url",), "title": ("title",), "employer": ("company.display_name",), "description": ("description",), "salary_min": ("salary_min",), "salary_max": ("salary_max",), "posted": ("created",), "place": ("location.display_name",), "lat": ("latitude",), "lon": ("longitude",)}, predicted="salary_is_predicted"),
        Feed("reed", "results", {"source_id": ("jobId",), "url": ("jobUrl",), "title": ("jobTitle",), "employer": ("employerName",), "description": ("jobDescription",), "salary_min": ("minimumSalary",), "salary_max": ("maximumSalary",), "posted": ("date",), "closing": ("expirationDate",), "place": ("locationName",)}, day_first=True),
        Feed("faa", "vacancies", {"source_id": ("vacancyReference",), "url": ("vacancyUrl",), "title": ("title",), "employer": ("employerName",), "description": ("description",), "posted": ("postedDate",), "closing": ("closingDate",), "place": ("addresses[0].postcode",), "lat": ("addresses[0].latitude",), "lon": ("addresses[0].longitude",), "level": ("course.level", "apprenticeshipLevel")}, levels={"intermediate": 2, "advanced": 3, "higher": 4, "degree": 6}),
        Feed("greenhouse", "jobs", {"source_id": ("id",), "url": ("absolute_url",), "title": ("title",), "description": ("content",), "posted": ("first_published", "updated_at"), "place": ("location.name",)}, escaped=True),
        Feed("lever", "", {"source_id": ("id",), "url": ("hostedUrl",), "apply_url": ("applyUrl",), "title": ("text",), "description": ("description",), "posted": ("createdAt",), "place": ("categories.allLocations[0]", "categories.location")}, epoch=True),
        Feed("ashby", "jobs", {"source_id": ("id",), "url": ("jobUrl",), "apply_url": ("applyUrl",), "title": ("title",), "description": ("descriptionHtml",), "posted": ("publishedAt",), "place": ("location",)}, keep=lambda j: F.coalesce(_get(j, "isListed", "boolean"), F.lit(True))),
        Feed("workable", "jobs", {"source_id": ("shortcode",), "url": ("url",), "apply_url": ("application_url",), "title": ("title",), "description": ("description",), "posted": ("published_on",), "place": ("city", "country")}),
        Feed("recruitee", "offers", {"source_id": ("id",), "url": ("careers_url",), "apply_url": ("careers_apply_url",), "title": ("title",), "description": ("description",), "posted": ("published_at",), "closing": ("close_at",), "place": ("location",)}),
        Feed("pinpoint", "data", {"source_id": ("id",), "url": ("url",), "title": ("title",), "description": ("description",), "closing": ("deadline_at",), "place": ("location.city", "location.name")}),
        Feed("wales", "data", {"source_id": ("id",), "url": ("slug",), "title": ("title",), "employer": ("employer",), "closing": ("closingDate",), "place": ("location",), "level": ("apprenticeshipLevel",)}, coords="coordinates", levels={"1": 2, "2": 3, "3": 4, "4": 6}),
        Feed("workday", "jobPostings", {"source_id": ("bulletFields[0]",), "url": ("externalPath",), "title": ("title",), "place": ("locationsText",)}),
        Feed("google_jobs", "jobs_results", {"url": ("apply_options[0].link",), "title": ("title",), "employer": ("company_name",), "place": ("location",), "description": ("description",)}),
        Feed("eightfold", "data.positions", {"source_id": ("id",), "url": ("positionUrl",), "title": ("name",), "place": ("locations[0]",)}),
        Feed("oracle", "items[0].requisitionList", {"source_id": ("Id",), "title": ("Title",), "posted": ("PostedDate",), "closing": ("PostingEndDate",), "place": ("PrimaryLocation",)}),
        Feed("jibe", "jobs", {"source_id": ("data.req_id",), "url": ("data.slug", "data.apply_url"), "apply_url": ("data.apply_url",), "title": ("data.title",), "description": ("data.description",), "posted": ("data.posted_date",), "place": ("data.full_location", "data.city")}),
        Feed("wordpress", "", {"source_id": ("acf.job_requisition_id", "id"), "url": ("link",), "apply_url": ("acf.apply_link",), "title": ("title.rendered",), "description": ("acf.job_description", "content.rendered"), "posted": ("date_gmt", "date"), "place": ("acf.city_1", "acf.location_from_ats", "city")}),
        Feed("jobstream", "data", {"source_id": ("ref", "id"), "url": ("apply_job_url",), "title": ("title",), "description": ("description",), "posted": ("updated_at",), "place": ("location",)}),
        Feed("scotland", "results", {"source_id": ("document.RefCode",), "title": ("document.JobTitle",), "lat": ("document.GeoLocationLat",), "lon": ("document.GeoLocationLong",), "level": ("document.ModernApprenticeshipLevel",)}, levels={"SCQF level 5": 2, "SCQF level 6": 3, "SCQF level 7": 3, "SCQF level 8": 4, "SCQF level 9": 6, "SCQF level 10": 6, "SCQF level 11": 7}),
        Feed("phenom", "refineSearch.data.jobs", {"source_id": ("jobId",), "apply_url": ("applyUrl",), "title": ("title",), "description": ("descriptionTeaser",), "posted": ("postedDate",), "place": ("city", "country")}),
    )
}


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one row a file: file, body."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def parse(landed: DataFrame, feed: str | Feed, today: Column, employer: str | None = None) -> DataFrame:
    """Listings of the bodies of one feed, with ``COLUMNS`` and ``source``.

    Of items with one id the last counts, by file and place in its body; a feed without ids gets the hash of employer, title and place.
    """
    spec = FEEDS[feed] if isinstance(feed, str) else feed
    body = F.try_parse_json("body")
    items = F.try_variant_get(body, f"$.{spec.items}" if spec.items else "$", "array<variant>")
    rows = landed.select("file", F.posexplode(items).alias("at", "item"))
    if spec.keep:
        rows = rows.filter(spec.keep(F.col("item")))

    def value(column: str) -> Column:
        found = [F.nullif(F.trim(_get(F.col("item"), p)), F.lit("")) for p in spec.paths.get(column, ())]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def day(column: str) -> Column:
        if spec.epoch:
            return london_date(F.timestamp_millis(value(column).try_cast("long")))
        iso = F.to_date(F.try_to_timestamp(F.substring(value(column), 1, 10), F.lit("yyyy-MM-dd")))
        return F.coalesce(iso, (parse_day_first if spec.day_first else parse_date)(value(column), today))

    def coordinate(column: str, part: int) -> Column:
        found = F.get(F.split(_get(F.col("item"), spec.coords), ","), F.lit(part)) if spec.coords else value(column)
        return F.nullif(F.trim(found).try_cast("double"), F.lit(0.0))

    level = F.lit(None).cast("int")
    for path in reversed(spec.paths.get("level", ())):
        said = F.lower(F.trim(_get(F.col("item"), path)))
        meant = F.when(said.try_cast("int").between(2, 7) & F.lit(not set(spec.levels) & set("1234567")), said.try_cast("int"))
        for word, number in spec.levels.items():
            meant = F.when(said == word.lower(), number).otherwise(meant)
        level = F.coalesce(meant, level)

    description = decode_entities(value("description")) if spec.escaped else value("description")
    guessed = F.coalesce(_get(F.col("item"), spec.predicted).isin("1", "true"), F.lit(False)) if spec.predicted else F.lit(False)
    pay = {c: F.when(~guessed, F.floor(value(c).try_cast("double") + 0.5).cast("long")) for c in ("salary_min", "salary_max")}
    made = rows.select(
        F.lit(spec.name).alias("source"),
        value("source_id").alias("source_id"),
        value("url").alias("url"),
        value("apply_url").alias("apply_url"),
        collapse_spaces(decode_entities(value("title"))).alias("title"),
        F.coalesce(collapse_spaces(decode_entities(value("employer"))), F.lit(employer or spec.employer)).alias("employer"),
        html_to_text(description).alias("description"),
        pay["salary_min"].alias("salary_min"),
        F.when(pay["salary_max"] != pay["salary_min"], pay["salary_max"]).alias("salary_max"),
        day("posted").alias("posted"),
        day("closing").alias("closing"),
        value("place").alias("place"),
        coordinate("lat", 0).alias("lat"),
        coordinate("lon", 1).alias("lon"),
        level.cast("int").alias("level"),
        F.struct("file", "at").alias("at"),
    ).filter("title IS NOT NULL AND title != ''")
    named = made.withColumn("source_id", F.coalesce("source_id", F.substring(F.sha1(F.concat_ws("|", "employer", "title", "place")), 1, 20)))
    whole = F.struct(*(c for c in named.columns))
    return named.groupBy("source", "source_id").agg(F.max_by(whole, "at").alias("row")).select("row.*").drop("at")


def rejects(landed: DataFrame, feed: str | Feed) -> DataFrame:
    """Bodies that hold no array of items where the feed has it."""
    spec = FEEDS[feed] if isinstance(feed, str) else feed
    items = F.try_variant_get(F.try_parse_json("body"), f"$.{spec.items}" if spec.items else "$", "array<variant>")
    return landed.filter(items.isNull())


def questions(landed: DataFrame, jobs: str = "Jobs.Job") -> DataFrame:
    """file, at and a map of each job of boards that give it as a list of questions and values; the last of a name counts."""
    listed = F.try_variant_get(F.try_parse_json("body"), f"$.{jobs}", "array<variant>")
    asked = F.try_variant_get(F.col("job"), "$.Questions", "array<struct<QuestionName:string,Value:string>>")
    named = F.filter(asked, lambda q: q["QuestionName"].isNotNull())
    last = F.filter(named, lambda q, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["QuestionName"] == q["QuestionName"]))
    pairs = F.map_from_entries(F.transform(last, lambda q: F.struct(q["QuestionName"].alias("key"), q["Value"].alias("value"))))
    return landed.select("file", F.posexplode(listed).alias("at", "job")).select("file", "at", pairs.alias("answers"))


def anchors(html: Column) -> Column:
    """Links of a page in order: array of (url, text), without those that have no target."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    target = lambda t: F.regexp_extract(t, r"""(?i)^<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    found = F.transform(tags, lambda t: F.struct(decode_entities(target(t)).alias("url"), html_to_text(t).alias("text")))
    return F.filter(found, lambda a: a["url"] != "")


def xml_positions(spark: SparkSession, path: str) -> DataFrame:
    """source_id, title, place, posted and description of landed XML position lists."""
    schema = "id string, office string, name string, createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
    read = spark.read.format("xml").option("rowTag", "position").schema(schema).load(path)
    parts = F.transform(F.coalesce("jobDescriptions.jobDescription", F.array().cast("array<struct<name:string,value:string>>")), lambda d: F.concat_ws(" ", d["name"], html_to_text(d["value"])))
    office = F.regexp_replace(F.trim("office"), "^[^-]+-", "")
    day = F.to_date(F.try_to_timestamp(F.substring("createdAt", 1, 10), F.lit("yyyy-MM-dd")))
    return read.select(F.trim("id").alias("source_id"), collapse_spaces("name").alias("title"), F.trim(office).alias("place"), day.alias("posted"), F.array_join(parts, "\n").alias("description"))


def rss(spark: SparkSession, path: str, today: Column) -> DataFrame:
    """source_id, url, title, posted and description of landed RSS feeds; the id is the number in a job's address."""
    read = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    number = F.nullif(F.regexp_extract("link", "/jobs/([0-9]+)", 1), F.lit(""))
    return read.select(F.coalesce(number, F.trim("guid"), F.trim("link")).alias("source_id"), F.trim("link").alias("url"), collapse_spaces(decode_entities(F.col("title"))).alias("title"), parse_date(F.col("pubDate"), today).alias("posted"), html_to_text(decode_entities(F.col("description"))).alias("description"))


def changed_pages(pages: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """``pages`` whose text isn't a stored one's, with hash in place of html; scripts, styles and white space don't count.

    :param pages: ``key``, html and what else they have; ``stored`` ``key``, hash.  Where a URL has several pages,
        another key tells them apart.
    """
    hashed = pages.withColumn("hash", F.sha2(html_to_text(F.coalesce("html", F.lit(""))), 256)).drop("html")
    return hashed.join(stored.select(key, "hash"), [key, "hash"], "left_anti")


def by_hand(typed: DataFrame, pages: DataFrame, columns: tuple[str, ...], key: str = "url") -> DataFrame:
    """Adverts added by hand, one row for each: what was typed counts, else what their page says (both by ``key``).

    Of several pages of one key the least counts, by what they say in the order of ``columns``; nulls come first.
    """
    read = pages.groupBy(key).agg(F.min(F.struct(*columns)).alias("page"))
    met = typed.join(read, key, "left")
    return met.select(key, *(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"page.{c}")).alias(c) for c in columns))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url and lastmod of landed sitemaps."""
    read = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return read.select(F.trim("loc").alias("url"), F.to_date(F.try_to_timestamp(F.substring("lastmod", 1, 10), F.lit("yyyy-MM-dd"))).alias("lastmod")).filter("url IS NOT NULL")
