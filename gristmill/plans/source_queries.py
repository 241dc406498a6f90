"""Sources of pages and printed lists, over pages and lists that are written from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import entity, snapshots
from gristmill.plans.registry import query, table
from gristmill.sources import details, flight, markup, printed
from gristmill.streaming import state

_EDITION = printed.Table(
    head=r"\bEmployer\s+Role\s+Level\s+Location",
    labels={"employer": r"\bEmployer\b", "role": r"\bRole\b", "level": r"\bLevel\b", "location": r"\bLocation", "salary": r"\bSalary\b", "start": r"\bStart Date\b"},
    below={"opens": r"\bOpen\b", "closes": r"\bClose\b"},
    below_line=r"\bOpen\b\s+\bClose\b",
    footer=r"^\s*Notes for readers",
    skip=r"^\s*(?:Salary|Open\s+Close)\s*$",
)


def _columns(*cells: tuple[Column | str, int]) -> Column:
    """One line: each cell padded to its width."""
    return F.concat(*(F.rpad(F.lit(c) if isinstance(c, str) else c, width, " ") for c, width in cells))


@query(
    """SELECT p_partkey, 'Listing of size ' || p_size AS section, split_part(p_brand, '#', 1) || ' works ' || split_part(p_brand, '#', 2) AS employer, p_name || ' apprentice' || CASE WHEN p_partkey % 4 = 0 THEN ' no' || p_partkey ELSE '' END AS role, CAST(4 + p_partkey % 3 AS INTEGER) AS level,
      CASE WHEN p_partkey % 2 = 0 THEN 'York' ELSE 'Newcastle-under-Lyme' END AS location, '£' || CAST(20000 + p_partkey AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN ' with bonus' ELSE '' END AS salary,
      make_date(CASE WHEN p_partkey % 12 + 1 >= 2 THEN 2026 ELSE 2027 END, CAST(p_partkey % 12 + 1 AS INTEGER), 1) AS opens_on, last_day(make_date(2026, CAST(p_partkey % 7 + 6 AS INTEGER), 1)) AS closes_on, p_partkey % 4 = 0 AS by_mail FROM part"""
)
def printed_listings(spark: SparkSession, d: str) -> DataFrame:
    """Entries of printed editions, one for each size and 10,000 keys: cells wrapped onto further lines, months with years
    below them or none at all, runs that touch."""
    found = printed.entries(_editions(table(spark, d, "part")), "text", "p_size", _EDITION)
    edition = F.struct(F.lit(2026).alias("year"), F.lit(3).alias("month"))
    rows = printed.listings(found, edition, F.lit(None).cast("string"))
    own = F.regexp_extract("link", "([0-9]+)", 1).cast("long")
    opened = printed.month_of(F.col("opens"), edition)
    return rows.select(own.alias("p_partkey"), "section", "employer", "role", "level", "location", "salary", opened.alias("opens_on"), F.col("closing_date").alias("closes_on"), F.col("apply_url").isNotNull().alias("by_mail"))


def _editions(p: DataFrame) -> DataFrame:
    """p_size and text.  A larger table gives more editions, not longer ones: each is read by one task, whose
    windows keep up to 4096 lines without asking for memory that a sort beside them may hold."""
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    months = F.array(*map(F.lit, printed.MONTH_NAMES))
    odd = key % 2 == 1
    opens, closes = F.get(months, (key % 12).cast("int")), F.get(months, (key % 7 + 5).cast("int"))
    number = F.substring_index("p_brand", "#", -1)
    link = F.when(key % 4 == 0, F.concat(F.lit("jobs"), key, F.lit("@example.org"))).otherwise(F.concat(F.lit("example.org/jobs/"), key))
    first = _columns(("", 1), (F.substring_index("p_brand", "#", 1), 20), (F.get(words, F.lit(0)), 40), ((4 + key % 3).cast("string"), 8), (F.when(odd, "Newcastle-under-").otherwise("York"), 24), (F.concat(F.lit("£"), (20000 + key).cast("string")), 16), (opens, 12), (closes, 12), ("Spring", 12), (link, 40))
    rest = F.concat_ws(" ", F.slice(words, 2, 9), F.lit("apprentice"), F.when(key % 4 == 0, F.concat(F.lit("no"), key.cast("string"))))
    second = _columns(("", 1), (F.concat(F.lit("works "), number), 20), (rest, 40), ("", 8), (F.when(odd, "Lyme").otherwise(""), 24), (F.when(key % 5 == 0, "with bonus").otherwise(""), 16), ("", 12), ("2026", 12), ("2027", 12))
    head = _columns(("", 1), ("Employer", 20), ("Role", 40), ("Level", 8), ("Location", 24), ("Salary", 16), ("Applications", 24), ("Start Date", 12), ("Link", 4))
    below = _columns(("", 109), ("Open", 12), ("Close", 12))
    lines = p.groupBy("p_size", (key - F.pmod(key, F.lit(10000))).alias("from")).agg(F.array_sort(F.collect_list(F.struct(key, F.concat_ws("\n", first, second).alias("rows")))).alias("lines"))
    title = F.concat(F.lit("Listing of size "), F.col("p_size").cast("string"))
    page = F.concat_ws("\n", F.lit("Vacancy Listing: March 2026\n"), title, head, below, F.array_join(F.transform("lines", lambda x: x["rows"]), "\n"), F.lit("Notes for readers\n 7"))
    return lines.select("p_size", page.alias("text"))


# pages


@query(
    """WITH b AS (SELECT page_id, replace(replace(html, '<', '('), '>', ')') AS body FROM pages)
    SELECT page_id, sha256('<div class="x"> kept ' || page_id || CASE WHEN page_id % 3 = 0 THEN '<section>shown</section>' ELSE ' ' END || '</div>') AS shown, CAST(length(body) AS BIGINT) AS hidden_chars FROM b"""
)
def hidden_parts(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose own text is in hidden elements that hold others of their name."""
    body = F.translate("html", "<>", "()")
    key = F.col("page_id").cast("string")
    mark = F.when(F.col("page_id") % 3 == 0, "").otherwise(' state="expired"')
    page = F.concat(F.lit('<div class="x"><div state="expired"><div>'), body, F.lit("</div><div state='expired'><div>b</div></div> more</div> kept").substr(F.lit(1), F.lit(1000)), F.lit(" "), key, F.lit("<section"), mark, F.lit(">shown</section></div>"))
    pages = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("hidden_chars"), page.alias("page"))
    return markup.without_hidden(pages, "page", "state=[\"']expired[\"']").select("page_id", F.sha2(F.regexp_replace("page", '^<div class="x"> +kept', '<div class="x"> kept'), 256).alias("shown"), "hidden_chars")


@query(
    """WITH b AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(html, '<', '('), '>', ')'), '&', '+'), '\\s+', ' ', 'g')) AS body FROM pages)
    SELECT page_id, 'Advert ' || page_id AS title, CASE WHEN page_id % 4 = 0 THEN 'json' ELSE 'microdata' END AS via, CASE WHEN page_id % 4 <> 3 THEN 'Works ' || page_id % 7 END AS employer,
      CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Town ' || page_id % 5 || ', GB' WHEN 2 THEN 'at Town here' END AS place, CAST(DATE '2026-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE) AS closes, CASE WHEN page_id % 4 = 0 THEN NULL ELSE sha256(body) END AS text FROM b"""
)
def page_postings(spark: SparkSession, d: str) -> DataFrame:
    """Adverts of pages that give structured data, microdata with scopes in scopes, or microdata without."""
    key = F.col("page_id").cast("string")
    four = F.col("page_id") % 4
    body = F.translate("html", "<>&", "()+")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    works = F.concat(F.lit("Works "), (F.col("page_id") % 7).cast("string"))
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Advert '), key, F.lit('","hiringOrganization":{"name":"'), works, F.lit('"},"validThrough":"'), day, F.lit('"}</script>'))
    town = F.concat(F.lit('<div itemprop="jobLocation" itemscope><div itemprop="address" itemscope><b itemprop="addressLocality">Town '), (F.col("page_id") % 5).cast("string"), F.lit('</b><i itemprop="addressCountry">GB</i></div></div>'))
    where = F.when(four == 1, town).when(four == 2, F.lit('<div itemprop="jobLocation">at <i>Town</i> here</div>')).otherwise("")
    who = F.when(four == 3, "").when(four == 1, F.concat(F.lit('<span itemprop="hiringOrganization" itemscope><u itemprop="title">no</u><u itemprop="name">'), works, F.lit("</u></span>"))).otherwise(F.concat(F.lit('<span itemprop="hiringOrganization">'), works, F.lit("</span>")))
    job = F.concat(F.lit('<div itemscope itemtype="https://schema.org/WebPage"><i itemprop="title">page</i><div itemscope itemtype="http://schema.org/JobPosting">'), who, where, F.lit('<h1 itemprop="title">Advert '), key, F.lit('</h1><meta itemprop="validThrough" content="'), day, F.lit('"><div itemprop="description"><div>'), body, F.lit("</div></div></div></div>"))
    page = F.when(four == 0, F.concat(data, job)).otherwise(job)
    read = details.postings(table(spark, d, "pages").select("page_id", page.alias("page")), "page", F.lit("2026-01-01").cast("date"))
    p = F.col("posting")
    return read.select("page_id", p["title"].alias("title"), p["via"].alias("via"), p["employer"].alias("employer"), F.nullif(p["place"], F.lit("")).alias("place"), p["closes"].alias("closes"), F.when(p["via"] == "microdata", F.sha2(details.plain_description(p), 256)).alias("text"))


@query(
    """WITH i AS (SELECT o_custkey AS source, o_orderkey AS id, o_orderstatus AS sig, o_orderkey % 3 = 0 AS has, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS old, o_orderkey % 2 = 0 AS unwanted, o_orderkey % 7 <> 0 AS stored FROM orders),
    f AS (SELECT *, has AND sig = old AND (unwanted OR stored) AS same FROM i)
    SELECT CAST(source AS VARCHAR) AS source, CAST(id AS VARCHAR) AS id, CASE WHEN same THEN 'cached' WHEN row_number() OVER (PARTITION BY source, same ORDER BY id) <= 3 THEN 'ask' ELSE 'left' END AS how FROM f"""
)
def detail_budget(spark: SparkSession, d: str) -> DataFrame:
    """Which pages each source asks for: three a run, none that is remembered."""
    key = F.col("o_orderkey")
    items = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source"), key.cast("string").alias("id"), F.col("o_orderstatus").alias("sig"), key.alias("place"))
    cache = table(spark, d, "orders").filter(key % 3 == 0).select(F.col("o_custkey").cast("string").alias("source"), key.cast("string").alias("id"), F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("sig"), F.when(key % 2 != 0, "old").alias("listing"))
    known = items.filter("place % 7 <> 0").select("source", "id")
    return details.plan(items, cache, known, 3).select("source", "id", "how")


@query(
    """WITH b AS (SELECT page_id, url, translate(html, '"\\', ''' ') AS body FROM pages)
    SELECT page_id, 'Advert {' || page_id || '}' AS title, url, sha256(trim(regexp_replace(body, '[\\x00-\\x20]+', ' ', 'g'))) AS text, CAST(page_id % 9 AS BIGINT) AS total, page_id % 9 <= 1 AS complete FROM pages JOIN b USING (page_id, url)"""
)
def pushed_listings(spark: SparkSession, d: str) -> DataFrame:
    """Records of page data that is pushed in pieces, cut at a place of its own in each page, with references."""
    key = F.col("page_id").cast("string")
    body = F.to_json(F.struct(F.translate("html", '"\\', "' ").alias("t")))
    text = F.regexp_extract(body, r"(?s)^\{\"t\":(.*)\}$", 1)
    told = F.concat(F.lit('0:["$1"]\n1:{"opportunity":{"title":"Advert {'), key, F.lit('}","more":"$2","url":"$a"}}\n2:{"text":'), text, F.lit('}\na:"'), F.col("url"), F.lit('"\n'))
    cut = (F.col("page_id") * 37 % 90 + 1).cast("int")
    pushed = lambda a: F.concat(F.lit("<script>self.__next_f.push("), F.to_json(F.array(F.lit("1"), a)), F.lit(")</script>"))
    listed = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","name":"'), (F.col("page_id") % 9).cast("string"), F.lit(' Opportunities","itemListElement":[{"url":"'), F.col("url"), F.lit('"}]}</script>'))
    page = F.concat(listed, pushed(F.substring(told, F.lit(1), cut)), F.lit("<p>x</p>"), pushed(F.substring(told, cut + 1, F.length(told))))
    docs = table(spark, d, "pages").select("page_id", "url", page.alias("page"))
    rows = flight.resolved(flight.lines(docs, "page", "page_id"), ["1"]).select(F.col("key").alias("page_id"), flight.record(F.col("value"), "opportunity").alias("o"))
    search = docs.select("page_id", flight.item_list(F.col("page")).alias("s"))
    get = lambda path: F.try_variant_get("o", path, "string")
    plain = F.trim(F.regexp_replace(get("$.more.text"), r"[\x00-\x20]+", " "))
    return rows.join(search, "page_id").select("page_id", get("$.title").alias("title"), get("$.url").alias("url"), F.sha2(plain, 256).alias("text"), F.col("s.total").alias("total"), flight.is_complete(F.size("s.items").cast("long"), F.col("s.total"), F.lit(False)).alias("complete"))


# state and runs


@query(
    """SELECT event_id, user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAYS, true) AS fresh FROM (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM events)"""
)
def seen_lately(spark: SparkSession, d: str) -> DataFrame:
    """Events of users who weren't met within two days before."""
    return state.unseen_lately(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2)


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS service, CAST(o_orderdate AS DATE) AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 10 WHEN '5-LOW' THEN NULL ELSE 5 END AS budget FROM orders),
    t AS (SELECT *, row_number() OVER (PARTITION BY service, date_trunc('month', day) ORDER BY day, id) AS turn FROM r)
    SELECT id, service, CAST(least(turn, coalesce(budget, 0)) AS BIGINT) AS used, turn <= coalesce(budget, 0) AS granted, least(turn, coalesce(budget, 0)) * 100 >= coalesce(budget, 0) * 80 AS alert FROM t"""
)
def monthly_budget(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a month's budget grants, refuses, or nearly uses up."""
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("service"), F.to_date("o_orderdate").alias("day"))
    limits = requests.select("service").distinct().filter("service <> '5-LOW'").withColumn("limit", F.expr("CASE service WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 10 ELSE 5 END"))
    return state.within_budget(requests, limits, "service", "day", "id").select("id", "service", "used", "granted", "alert")


@query(
    """SELECT o_orderstatus AS source, count(*) AS rows, count(*) FILTER (WHERE o_totalprice > 100000) AS relevant FROM orders GROUP BY 1"""
)
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    """A run's counts by source, gathered while its rows are written."""
    orders = table(spark, d, "orders")
    known = [r[0] for r in orders.select("o_orderstatus").distinct().collect()]  # a run's sources: three here
    flags = {"rows": F.lit(True), "relevant": F.col("o_totalprice") > 100000}
    watched, seen = snapshots.counted(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "raw", flags, "o_orderstatus", known)
    watched.write.format("noop").mode("overwrite").save()
    row = snapshots.run_row("today", {"raw": seen})
    told = spark.createDataFrame([(row["run"], row["totals"], row["sources"])], snapshots.RUNS)
    listed = told.select(F.explode("sources").alias("source", "n"))
    return listed.select("source", F.col("n")["raw_rows"].alias("rows"), F.col("n")["raw_relevant"].alias("relevant"))


@query(
    """WITH RECURSIVE w AS (SELECT p_partkey AS id, 'b' || substr(p_brand, 7, 1) || CASE WHEN p_partkey % 3 = 0 THEN ' works' ELSE '' END AS e, substr(p_brand, 7, 1) AS block,
        list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w,
        CASE WHEN p_partkey % 11 = 0 THEN [] WHEN p_partkey % 4 = 0 THEN [p_size % 25, p_size * 3 % 25] ELSE [p_size % 25] END AS sites, p_partkey % 17 = 0 AS stored FROM part),
    k AS (SELECT *, e || '|' || array_to_string(w, ' ') || '|' || coalesce(CAST(sites[1] AS VARCHAR), '') AS key FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY NOT stored, id) AS n FROM k),
    fold AS (
      SELECT block, n, id, key, key AS assigned, [{'e': e, 'w': w, 'sites': sites, 'key': key}] AS pool, [key] AS keys FROM r WHERE n = 1
      UNION ALL
      SELECT block, n, id, key, coalesce(hit, key), CASE WHEN hit IS NULL AND (stored OR NOT known) THEN list_append(pool, {'e': e, 'w': w, 'sites': sites, 'key': key}) ELSE pool END, CASE WHEN hit IS NULL AND NOT known THEN list_append(keys, key) ELSE keys END
      FROM (SELECT r.block, r.n, r.id, r.key, r.e, r.w, r.sites, r.stored, f.pool, f.keys, list_contains(f.keys, r.key) AS known,
          CASE WHEN r.stored OR list_contains(f.keys, r.key) THEN NULL ELSE list_filter(f.pool, lambda p: (p.e = r.e OR starts_with(p.e, r.e || ' ') OR starts_with(r.e, p.e || ' '))
            AND (len(p.sites) = 0 OR len(r.sites) = 0 OR len(list_filter(p.sites, lambda s: len(list_filter(r.sites, lambda q: abs(s - q) <= 1)) > 0)) > 0)
            AND ((len(list_intersect(p.w, r.w)) = least(len(p.w), len(r.w)) AND least(len(p.w), len(r.w)) >= 2) OR len(list_intersect(p.w, r.w)) / (len(p.w) + len(r.w) - len(list_intersect(p.w, r.w))) >= 0.7))[1].key END AS hit
        FROM fold f JOIN r ON r.block = f.block AND r.n = f.n + 1))
    SELECT id AS p_partkey, key, assigned FROM fold"""
)
def vacancy_fold(spark: SparkSession, d: str) -> DataFrame:
    """The vacancy that each advert is one of: employers by prefix, titles by words, places a degree's tenth apart."""
    key = F.col("p_partkey")
    brand = F.substring("p_brand", 7, 1)
    site = lambda c: F.concat(F.lit("Site "), c.cast("string"))
    first, second = F.col("p_size") % 25, F.col("p_size") * 3 % 25
    places = F.when(key % 11 == 0, F.array().cast("array<string>")).when(key % 4 == 0, F.array(site(first), site(second))).otherwise(F.array(site(first)))
    words = F.array_sort(text.tokens(F.concat_ws(" ", "p_name", "p_type")))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("b"), brand, F.when(key % 3 == 0, " works").otherwise("")).alias("employer"), words.alias("words"), places.alias("places"), (key % 17 == 0).alias("stored"), F.when(key % 11 != 0, first.cast("string")).otherwise("").alias("town"))
    rows = rows.withColumn("key", F.concat_ws("|", "employer", F.array_join("words", " "), "town")).withColumn("ordinal", F.when(F.col("stored"), key).otherwise(key + (1 << 40)))
    gazetteer = spark.range(25).select(site(F.col("id")).alias("place"), F.array(site(F.col("id"))).alias("names"), F.lit(True).alias("is_point"), (50 + F.col("id") * 0.1).alias("lat"), F.lit(0.0).alias("lon"))
    return entity.assign_vacancies(rows, gazetteer).select("p_partkey", "key", "assigned")
