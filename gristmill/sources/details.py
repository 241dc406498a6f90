"""Pages of single adverts: which to ask for within a budget, what they say, and what is remembered of them.

A list gives items; each has a page with more.  A page is asked for once: as long as its item's signature stays and the
advert is stored (or its page showed that it isn't wanted), what is remembered counts.  Of the others each source may ask
for so many a run, in the order of its list; the rest keep what is remembered of them or what the list says, and are
asked for in a later run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.adverts import job_posting
from gristmill.functions.dates import parse_date
from gristmill.functions.links import slug_words
from gristmill.functions.text import collapse_spaces, decode_entities, html_to_text, let
from gristmill.sources.markup import microdata, posting

KEYS = ["source", "id"]


def candidates(found: DataFrame, job: str, wanted: str | None = None, rewrite: tuple[str, str] | None = None) -> DataFrame:
    """source, url, id, lastmod of the links that are jobs, each once (the first place).

    :param found: source, url, place (its order), and lastmod if there.
    :param job: an expression that a job's URL matches.
    :param wanted: words of its last part, one of which it must have; without it all are wanted.
    :param rewrite: a host that is listed, and the one that is asked in its place.

    A slash at the end makes no other page.  Null URLs are none.
    """
    url = F.col("url")
    if rewrite:
        url = F.replace(url, F.lit(f"//{rewrite[0]}/"), F.lit(f"//{rewrite[1]}/"))
    lastmod = F.col("lastmod") if "lastmod" in found.columns else F.lit(None).cast("date")
    rows = found.select("source", url.alias("url"), "place", lastmod.alias("lastmod")).filter(F.rlike("url", F.lit(job)))
    if wanted:
        rows = rows.filter(F.rlike(F.array_join(slug_words(F.regexp_replace("url", "/[0-9]+/?$", "")), " "), F.lit(f"(?i){wanted}")))
    rows = rows.withColumn("id", F.regexp_replace("url", "/$", ""))
    first = rows.groupBy(*KEYS).agg(F.min_by(F.struct("url", "place", "lastmod"), "place").alias("f"))
    return first.select(*KEYS, "f.*")


def plan(items: DataFrame, cache: DataFrame, known: DataFrame, budget: int = 40) -> DataFrame:
    """``items`` with ``how``: cached, ask or left.

    :param items: source, id, sig, place (its order in the source's list), and other columns; one row an id.
    :param cache: source, id, sig, listing (null for a page that showed nothing wanted).
    :param known: source, id of stored adverts.

    A null signature is one like others.  The first ``budget`` of each source by place are kept in every task before
    they meet, so a large source isn't sorted as a whole.
    """
    old = cache.select(*KEYS, F.col("sig").alias("old_sig"), F.col("listing").isNull().alias("unwanted"), F.lit(True).alias("has"))
    met = items.join(old, KEYS, "left").join(known.select(*KEYS).distinct().withColumn("stored", F.lit(True)), KEYS, "left")
    same = F.coalesce(F.col("has") & F.col("sig").eqNullSafe(F.col("old_sig")) & (F.col("unwanted") | F.coalesce("stored", F.lit(False))), F.lit(False))
    met = met.withColumn("same", same)
    turn = F.row_number().over(Window.partitionBy("source").orderBy("place", "id"))
    asked = met.filter("NOT same").select(*KEYS, "place").withColumn("turn", turn).filter(F.col("turn") <= budget).select(*KEYS, F.lit(True).alias("asked"))
    how = F.when(F.col("same"), "cached").when(F.col("asked"), "ask").otherwise("left")
    return met.join(asked, KEYS, "left").select(*(F.col(f"`{c}`") for c in items.columns if c != "how"), how.alias("how"))


def with_details(planned: DataFrame, cache: DataFrame, landed: DataFrame, fallback: Column) -> tuple[DataFrame, DataFrame]:
    """Listings of a run, and the cache after it.

    :param planned: what ``plan`` gave.
    :param cache: source, id, sig, listing.
    :param landed: source, id, listing, failed: what came back of the pages that were asked for.
    :param fallback: what the list itself says of an item, of the type of listing; may be null.
    :return: (source, id, listing, how), (source, id, sig, listing).

    A page that failed, didn't come, or was left gives what is remembered, else the fallback, and keeps what is
    remembered as it was.  Items that the list no longer has are forgotten.
    """
    old = cache.select(*KEYS, F.col("sig").alias("old_sig"), F.col("listing").alias("old"), F.lit(True).alias("has"))
    new = landed.filter(~F.coalesce("failed", F.lit(False))).select(*KEYS, F.col("listing").alias("new"), F.lit(True).alias("came"))
    met = planned.withColumn("own", fallback).join(old, KEYS, "left").join(new, KEYS, "left")
    came = (F.col("how") == "ask") & F.coalesce("came", F.lit(False))
    # a page that came and shows nothing wanted is no reason to take the list's word
    given = F.when(F.col("how") == "cached", F.col("old")).when(came, F.coalesce("new", "old", "own")).otherwise(F.coalesce("old", "own"))
    met = met.withColumns({"given": given, "came": came})
    listings = met.filter("given IS NOT NULL").select(*KEYS, F.col("given").alias("listing"), "how")
    kept = met.filter("came OR has").select(*KEYS, F.when(F.col("came"), F.col("sig")).otherwise(F.col("old_sig")).alias("sig"), F.when(F.col("came"), F.col("new")).otherwise(F.col("old")).alias("listing"))
    return listings, kept


def employer_of(html: Column) -> Column:
    """Whose page it is: what it says of its site, else the last part of its title, if that is short."""
    meta = lambda a, b: F.regexp_extract(html, rf"""(?is)<meta[^>]+{a}=["']([^"']+)["'][^>]+{b}""", 1)
    site = F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)["']""", 1), F.lit(""))
    site = F.coalesce(site, F.nullif(meta("content", """property=["']og:site_name"""), F.lit("")))
    title = decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    tail = F.trim(F.element_at(F.split(title, r"\s+[|–-]\s+", -1), -1))
    return F.coalesce(collapse_spaces(decode_entities(site)), F.when((tail != "") & (F.length(tail) <= 60), tail))


def postings(pages: DataFrame, html: str, today: Column) -> DataFrame:
    """``pages`` with ``posting``: title, description, posted, closes, place, employer, and ``via`` (json, microdata).

    A page's structured data counts first, its microdata next; pages with neither have null.  Days that are none are
    null.  Null and empty pages have null.
    """
    data = job_posting(F.col(f"`{html}`"), today)
    read = microdata(pages.withColumn("structured posting", data), html)
    day = lambda c: parse_date(c, today)
    second = lambda marked: F.struct(marked["title"].alias("title"), marked["description"].alias("description"), day(marked["posted"]).alias("posted"), day(marked["closes"]).alias("closes"), marked["place"].alias("place"), marked["employer"].alias("employer"), F.lit("microdata").alias("via"))
    j = F.col("`structured posting`")
    first = F.struct(j["title"].alias("title"), j["description"].alias("description"), j["posted"].alias("posted"), j["closing"].alias("closes"), j["place"].alias("place"), j["employer"].alias("employer"), F.lit("json").alias("via"))
    # items are named once, so those of pages with structured data needn't be read
    told = F.when(j["title"].isNotNull(), first).otherwise(let(F.col("items"), lambda items: let(posting(items), lambda m: F.when(m.isNotNull(), second(m)))))
    return read.select(*(F.col(f"`{c}`") for c in pages.columns if c not in ("posting", "items")), told.alias("posting"))


def plain_description(posting_: Column) -> Column:
    return html_to_text(posting_["description"])
