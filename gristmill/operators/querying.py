"""Filters, orders, ranks and facets of the listings view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Filters:
    """Conjuncts of a view; what is None or empty doesn't filter."""

    words: str = ""
    text_columns: Sequence[str] = ()
    one_of: Mapping[str, Sequence] = field(default_factory=dict)
    at_least: Mapping[str, object] = field(default_factory=dict)
    at_most: Mapping[str, object] = field(default_factory=dict)
    excluded: Mapping[str, Sequence] = field(default_factory=dict)  # unknown values stay

    def predicate(self) -> Column:
        parts = [F.contains(F.lower(F.concat_ws(" ", *self.text_columns)), F.lit(w)) for w in self.words.lower().split()]
        parts += [F.col(c).isin(list(v)) for c, v in self.one_of.items() if v]
        parts += [F.col(c) >= F.lit(v) for c, v in self.at_least.items()]
        parts += [F.col(c) <= F.lit(v) for c, v in self.at_most.items()]
        parts += [F.col(c).isNull() | ~F.col(c).isin(list(v)) for c, v in self.excluded.items() if v]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def active(self) -> int:
        """How many filters differ from their default."""
        return bool(self.words) + sum(bool(v) for v in self.one_of.values()) + len(self.at_least) + len(self.at_most) + sum(bool(v) for v in self.excluded.values())


def ordering(column: str, descending: bool, ties: Sequence[Column]) -> list[Column]:
    """Nulls last in either direction, then the tie-breakers."""
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *ties]


def top_in_group(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n for several columns in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


#: What each sort of the listings view compares, and whether the smallest comes first.  ``grades`` and ``status`` go by
#: the order of their values, the rest by the column.
SORTS: dict[str, tuple[str, bool]] = {
    "score": ("rank", False),
    "closing": ("days_to_close", True),
    "newest": ("first_seen_at", False),
    "salary": ("pay", False),
    "distance": ("miles", True),
    "title": ("title", True),
    "location": ("place", True),
    "level": ("level", False),
    "role": ("role", True),
    "grades": ("fit", True),
    "posted": ("posted", False),
    "start": ("starts", True),
    "status": ("status", True),
}
# The order of how grades fit and of an application's states.
FITS, STATUSES = ("meets", "close", "below", "subject"), ("offer", "interview", "applied", "saved", "rejected")


def listing_order(sort: str, reverse: bool = False, rank: str = "rank", title: str = "title", id_: str = "id") -> list[Column]:
    """The order of a sort of the listings view: unknown values last either way, then the best rank, title and id."""
    column, up = SORTS.get(sort, SORTS["score"])
    listed = {"grades": FITS, "status": STATUSES}.get(sort)
    value = F.col(column)
    if listed:
        value = F.nullif(F.array_position(F.array(*map(F.lit, listed)), value), F.lit(0))
    elif sort in ("title", "location", "role"):
        value = F.lower(value)
    first = value.asc_nulls_last() if up != reverse else value.desc_nulls_last()
    return [first, F.desc_nulls_last(rank), F.asc_nulls_last(F.lower(F.col(title))), F.asc_nulls_last(id_)]
