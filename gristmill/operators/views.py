"""The two views that readers ask: listings with what is known of them, and employers with their season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listings_view(listings: DataFrame, tracking: DataFrame, sources: DataFrame, notes: DataFrame) -> DataFrame:
    """All columns of ``listings`` with status, hidden, hidden_at, applied_at, sources, notes_count, and the flags of details.

    :param listings: id, details (map), skills (array of id, ctx, quote) and other columns.
    :param tracking: listing_id (at most one row each), status, hidden, hidden_at, applied_at.
    :param sources: listing_id, source, url, link_status, first_seen_at.
    :param notes: listing_id.

    Sources and notes are summed up before they are joined.  A listing without tracking has status none and isn't
    hidden; one without sources has an empty array.  Quotes of skills are left out.
    """
    one = F.struct("first_seen_at", "source", "url", F.coalesce(F.col("link_status") == "dead", F.lit(False)).alias("dead"))
    held = sources.groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("held"))  # one listing's
    held = held.select("id", F.transform("held", lambda s: F.struct(s["source"].alias("source"), s["url"].alias("url"), s["dead"].alias("dead"))).alias("sources"))
    noted = notes.groupBy(F.col("listing_id").alias("id")).agg(F.count("*").cast("int").alias("notes_count"))
    tracked = tracking.select(F.col("listing_id").alias("id"), "status", "hidden", "hidden_at", "applied_at")
    joined = listings.join(tracked, "id", "left").join(held, "id", "left").join(noted, "id", "left")
    flag = lambda k: F.coalesce(F.try_element_at("details", F.lit(k)).try_cast("boolean"), F.lit(False))
    return joined.withColumns({
        "status": F.coalesce("status", F.lit("none")),
        "hidden": F.coalesce("hidden", F.lit(False)),
        "sources": F.coalesce("sources", F.array().cast("array<struct<source:string,url:string,dead:boolean>>")),
        "notes_count": F.coalesce("notes_count", F.lit(0)),
        "pre_register": flag("preRegister"),
        "is_lead": flag("lead"),
        "is_manual": flag("manual"),
        "skills": F.transform("skills", lambda s: F.struct(s["id"].alias("id"), s["ctx"].alias("ctx"))),
    }).drop("details")


def employers_view(employers: DataFrame, listings: DataFrame, notes: DataFrame, today: Column) -> DataFrame:
    """``employers`` with their open and interest listings, next closing date, last season and notes.

    :param listings: employer_id, is_active, pre_register, closing_date, first_seen_at, last_seen_at.
    """
    open_, interest = F.col("is_active"), F.coalesce("pre_register", F.lit(False))
    season = listings.groupBy(F.col("employer_id").alias("id")).agg(
        F.count_if(open_ & ~interest).alias("active_listings"),
        F.count_if(open_ & interest).alias("interest_listings"),
        F.min(F.when(open_ & (F.col("closing_date") >= today), F.col("closing_date"))).alias("next_closing"),
        F.min(F.when(~open_, F.col("first_seen_at"))).alias("last_season_first_seen"),
        F.max(F.when(~open_, F.coalesce("closing_date", F.to_date("last_seen_at")))).alias("last_season_closed"),
    )
    noted = notes.groupBy(F.col("employer_id").alias("id")).agg(F.count("*").alias("notes_count"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("active_listings", "interest_listings", "notes_count")}
    return employers.join(season, "id", "left").join(noted, "id", "left").withColumns(counts)
