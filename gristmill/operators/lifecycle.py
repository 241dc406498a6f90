"""Rules that close, reopen and edit stored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close_without(listings: DataFrame, sources: DataFrame, alive: Column, reason: str) -> DataFrame:
    """Close active listings none of whose ``sources`` (by listing_id) is ``alive``; one without sources closes too."""
    held = sources.groupBy("listing_id").agg(F.bool_or(F.coalesce(alive, F.lit(False))).alias("__alive"))
    joined = listings.join(held, "listing_id", "left")
    closing = F.col("is_active") & ~F.coalesce("__alive", F.lit(False))
    return joined.withColumn("closed_reason", F.when(closing, reason).otherwise(F.col("closed_reason"))).withColumn("is_active", F.col("is_active") & ~closing).drop("__alive")


def mark_missing(listings: DataFrame, sources: DataFrame, run_started: Column, today: Column, grace: int = 3) -> tuple[DataFrame, DataFrame]:
    """Count a miss for sources not seen in this run, close listings without a live source, then those past their date.

    The first reason sticks, since later rules see only what is still active.

    :param listings: listing_id, is_active, closed_reason, closing_date.
    :param sources: listing_id, last_seen, missed_runs, incremental, link_ok.
    """
    missed = sources.withColumn("missed_runs", F.col("missed_runs") + F.when(F.col("last_seen") < run_started, 1).otherwise(0))
    dated = missed.join(listings.select("listing_id", "closing_date"), "listing_id")
    recent = F.datediff(run_started, F.col("last_seen")) <= 7
    kept = (F.col("closing_date") >= today) & F.col("link_ok")
    alive = F.when(F.col("incremental"), recent | F.coalesce(kept, F.lit(False))).otherwise(F.col("missed_runs") < grace)
    closed = close_without(listings, dated, alive, "gone")
    past = F.col("is_active") & (F.col("closing_date") < today)
    late = F.coalesce(past, F.lit(False))
    return closed.withColumn("closed_reason", F.when(late, "deadline").otherwise(F.col("closed_reason"))).withColumn("is_active", F.col("is_active") & ~late), missed


def expire_stale(listings: DataFrame, sources: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Close active listings without a closing date that no source has seen for ``days``."""
    undated = listings.filter(F.col("closing_date").isNull())
    seen = F.datediff(today, F.col("last_seen")) <= days
    return close_without(undated, sources, seen, "stale").unionByName(listings.filter(F.col("closing_date").isNotNull()))


def every_link_dead(sources: DataFrame) -> DataFrame:
    """listing_id and whether each of its links is known to be dead; an unchecked one is not."""
    return sources.groupBy("listing_id").agg(F.bool_and(F.coalesce(F.col("link_status") == "dead", F.lit(False))).alias("all_dead"))


def apply_edits(listings: DataFrame, edits: str, columns: list[str]) -> DataFrame:
    """Edited values win where their key is present, even with a null value; other keys are ignored."""
    return listings.select(
        *(F.when(F.map_contains_key(edits, F.lit(c)), F.element_at(edits, F.lit(c)).try_cast(listings.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in listings.columns)
    )


def inherit(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Fill a null value with that of the group, if all its known values agree."""
    agreed = rows.groupBy(group).agg(F.min(value).alias("__low"), F.max(value).alias("__high")).filter("__low = __high")
    return rows.join(agreed, group, "left").withColumn(value, F.coalesce(F.col(value), F.col("__low"))).drop("__low", "__high")


def transitions(events: DataFrame, key: str, order: list[str], value: str, to: str) -> DataFrame:
    """Rows at which a value becomes ``to`` from something else (or from nothing)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("__before", before).filter((F.col(value) == to) & ~F.col("__before").eqNullSafe(to)).withColumnRenamed("__before", "before")


def close_below_level(listings: DataFrame, least: int = 4) -> DataFrame:
    """Close active listings below a level, but those added by hand; an unknown level stays."""
    below = F.col("is_active") & (F.col("level") < least) & ~F.coalesce("is_manual", F.lit(False))
    low = F.coalesce(below, F.lit(False))
    return listings.withColumn("closed_reason", F.when(low, "below_min_level").otherwise(F.col("closed_reason"))).withColumn("is_active", F.col("is_active") & ~low)


def close_by_links(listings: DataFrame, sources: DataFrame, today: Column, recent: int = 2) -> DataFrame:
    """Close active listings whose links are all dead, and those whose application is closed.

    :param listings: listing_id, is_active, closed_reason, apply_status.
    :param sources: listing_id, link_status, incremental, last_seen.

    A closed application counts only where no full feed has shown the listing within ``recent`` days.
    """
    seen = ~F.col("incremental") & (F.col("last_seen") >= F.date_sub(today, recent))
    held = sources.groupBy("listing_id").agg(F.bool_and(F.coalesce(F.col("link_status") == "dead", F.lit(False))).alias("all_dead"), F.bool_or(F.coalesce(seen, F.lit(False))).alias("sure"))
    joined = listings.join(held, "listing_id", "left")
    dead = F.col("is_active") & F.coalesce("all_dead", F.lit(False))
    shut = F.col("is_active") & ~dead & F.coalesce(F.col("apply_status") == "dead", F.lit(False)) & ~F.coalesce("sure", F.lit(False))
    reason = F.when(dead, "link_dead").when(shut, "apply_closed").otherwise(F.col("closed_reason"))
    return joined.withColumn("closed_reason", reason).withColumn("is_active", F.col("is_active") & ~dead & ~shut).drop("all_dead", "sure")


def reset_misses(sources: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Sources seen in a run start to count misses anew."""
    marked = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return sources.join(marked, keys, "left").withColumn("missed_runs", F.when(F.col("__seen"), 0).otherwise(F.col("missed_runs"))).drop("__seen")


def rederived(stored: DataFrame, derived: DataFrame, key: str, columns: list[str], edits: str) -> DataFrame:
    """Rows whose derived columns differ from the stored ones, with the new values; edited columns stay as they are."""
    new = derived.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    met = stored.join(new, key)
    edited = {c: F.coalesce(F.map_contains_key(edits, F.lit(c)), F.lit(False)) for c in columns}
    value = {c: F.when(edited[c], F.col(c)).otherwise(F.col(f"__{c}")) for c in columns}
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(value[c])
    return met.filter(differs).select(key, *(value[c].alias(c) for c in columns))
