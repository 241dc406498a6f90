"""Merging rows of one key: within a run, into what is stored, and across feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_known(value: str, ordinal: str) -> Column:
    """The first non-null value by ordinal."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(ordinal)))


def pick(rows: DataFrame, keys: Sequence[str], ordinal: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ordinal.  Sums up before the shuffle, unlike a window."""
    whole = F.struct(*rows.columns)
    chosen = F.max_by(whole, ordinal) if last else F.min_by(whole, ordinal)
    return rows.groupBy(*keys).agg(chosen.alias("__row")).select("__row.*")


def merge_within_run(rows: DataFrame, key: str, ordinal: str, first: Sequence[str] = (), known: Sequence[str] = (), longest: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = (), any_of: Sequence[str] = (), every: Sequence[str] = ()) -> DataFrame:
    """One row a key: a rule for each column.

    ``first``: of the first row, even null; ``known``: first non-null; ``longest``: longest text, first among equals;
    ``least``/``most``: of the non-null; ``any_of``/``every``: of booleans.
    """
    aggs = [F.min_by(c, ordinal).alias(c) for c in first] + [first_known(c, ordinal).alias(c) for c in known]
    aggs += [F.min_by(c, F.struct(-F.length(c), F.col(ordinal))).alias(c) for c in longest]
    aggs += [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    aggs += [F.bool_or(c).alias(c) for c in any_of] + [F.bool_and(c).alias(c) for c in every]
    return rows.groupBy(key).agg(*aggs)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, overwrite: Sequence[str] = (), fill: Sequence[str] = (), earliest: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """The next snapshot of a stored table: a full outer merge with a rule for each column.

    ``overwrite``: incoming wins where its row exists; ``fill``: stored wins unless null; ``earliest``/``latest`` skip
    nulls.  ``change`` says insert, update or keep.
    """
    old, new = stored.alias("s"), incoming.alias("i")
    joined = old.join(new, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    came, held = F.col(f"i.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    out = [F.coalesce(f"s.{key}", f"i.{key}").alias(key)]
    out += [F.when(came, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in overwrite]
    out += [F.coalesce(f"s.{c}", f"i.{c}").alias(c) for c in fill]
    out += [F.least(f"s.{c}", f"i.{c}").alias(c) for c in earliest] + [F.greatest(f"s.{c}", f"i.{c}").alias(c) for c in latest]
    return joined.select(*out, F.when(~held, "insert").when(came, "update").otherwise("keep").alias("change"))


def unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def keyed_union(feeds: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all feeds, of each key those of the earliest feed; ``feed`` tells which."""
    parts = [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return pick(out, keys, "feed")


def overlay(old: Column, new: Column) -> Column:
    """Two maps as one: keys of the new one win, null and empty values of either count for nothing."""
    told = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    fresh = told(F.coalesce(new, F.create_map().cast("map<string,string>")))
    kept = F.map_filter(told(F.coalesce(old, F.create_map().cast("map<string,string>"))), lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)
