"""Employers worth watching, found in adverts: suggestions, what is known of them, and their job systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.links import host, under

#: Pieces of evidence that a suggestion keeps.
MOST_EVIDENCE = 10


def job_system(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule (name, expression) that a URL matches, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(url, F.lit(pattern)), name).otherwise(out)
    return out


def suggestions(listings: DataFrame, ignored: DataFrame, aggregators: Sequence[str], rules: Sequence[tuple[str, str]], least: int = 45) -> DataFrame:
    """name_norm, name, url, system, score: employers of adverts that are not watched yet.

    :param listings: employer_id, is_lead, employer, employer_norm, score, apply_url, url.
    :param ignored: employer_norm of names that are never suggested.

    An advert counts if it names an employer, is no lead, scores ``least`` or more and has a link off the aggregators; of
    an employer's the best one is taken.
    """
    open_ = listings.filter(F.col("employer_id").isNull() & ~F.coalesce("is_lead", F.lit(False)) & (F.coalesce("employer_norm", F.lit("")) != "") & (F.col("employer_norm") != "unknown") & (F.col("score") >= least))
    own = F.coalesce(*(F.when(~under(host(F.col(c)), aggregators), F.col(c)) for c in ("apply_url", "url")))
    kept = open_.withColumn("link", own).filter("link IS NOT NULL").join(ignored.select("employer_norm").distinct(), "employer_norm", "left_anti")
    best = kept.groupBy("employer_norm").agg(F.max_by(F.struct("employer", "link", "score"), F.struct("score", "link")).alias("best"))
    return best.select(F.col("employer_norm").alias("name_norm"), F.col("best.employer").alias("name"), F.col("best.link").alias("url"), job_system(F.col("best.link"), rules).alias("system"), F.col("best.score").alias("score"))


def merge_suggestions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored suggestions after new ones: name_norm, status, evidence (the newest first, each once), change.

    :param stored: name_norm, status, evidence (array); ``fresh`` name_norm, approved, evidence (array).

    A pending one that is approved now becomes approved; any other status stays. Dismissed ones get no evidence.
    """
    met = stored.alias("s").join(fresh.alias("f"), "name_norm", "full_outer")
    approved = F.coalesce(F.col("f.approved"), F.lit(False))
    status = F.when(F.col("s.status").isNull(), F.when(approved, "approved").otherwise("pending")).when((F.col("s.status") == "pending") & approved, "approved").otherwise(F.col("s.status"))
    none = F.array().cast(stored.schema["evidence"].dataType)
    new = F.when(F.coalesce(F.col("s.status") == "dismissed", F.lit(False)), none).otherwise(F.coalesce("f.evidence", none))
    evidence = F.slice(F.array_distinct(F.concat(new, F.coalesce("s.evidence", none))), 1, MOST_EVIDENCE)
    change = F.when(F.col("s.status").isNull(), "insert").when(~status.eqNullSafe(F.col("s.status")) | ~evidence.eqNullSafe(F.col("s.evidence")), "update").otherwise("keep")
    return met.select("name_norm", status.alias("status"), evidence.alias("evidence"), change.alias("change"))
