"""Names of a large dictionary in texts: which are named where, the longest first, none over another.

Each name is posted under one of its words, the one that fewest names have.  A text asks by its own words, so it meets
only names whose posted word it has; what is met is then compared word by word at its place.  Neither the dictionary nor a
text is held against the other as a whole, and no expression grows with the number of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """Words of a text in lower case: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def posted(names: DataFrame) -> DataFrame:
    """name, words, word, offset: each spelling under its rarest word, the first in order of letters among equals.

    :param names: name, spelling; a name may have several.  Spellings without words are left out; of several names with
        one spelling the first counts.
    """
    spelled = names.select("name", words_of(F.col("spelling")).alias("words")).filter("size(words) > 0").groupBy("words").agg(F.min("name").alias("name"))
    each = spelled.select("name", "words", F.posexplode("words").alias("offset", "word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("word", "offset"), F.struct("n", "word", "offset"))
    return each.join(counts, "word").groupBy("words").agg(F.min("name").alias("name"), best.alias("b")).select("name", "words", "b.word", "b.offset")


def named(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: name, at (its first word, from 0) and n (words), in order.

    Of names that overlap the one that begins first counts, of those that begin together the longest; the next begins
    after it.  Null and empty texts have none.  Repeated rows are rows of their own.
    """
    kept = [c for c in rows.columns if c != "spans"]
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), words_of(F.col(f"`{text}`")).alias("own"))
    # the row itself goes along once, with a word that nothing is posted under
    first = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("word"))
    listed = F.concat(F.array(first), F.transform("own", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))))
    asked = numbered.select("row", "doc", "own", F.explode(listed).alias("w"))
    head = F.col("w.pos") == -1
    asked = asked.select("row", F.when(head, F.struct("doc", "own")).alias("held"), F.col("w.pos").alias("pos"), F.col("w.word").alias("word"))
    met = asked.join(posted(names), "word", "left").filter("pos = -1 OR name IS NOT NULL")
    found = met.groupBy("row").agg(
        F.first("held", ignorenulls=True).alias("held"),
        F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct((F.col("pos") - F.col("offset")).alias("at"), (-F.size("words")).alias("less"), "name", "words")))).alias("met"),  # one text's
    )
    here = F.filter("met", lambda m: (m["at"] >= 0) & (F.slice(F.col("held.own"), m["at"] + 1, F.size(m["words"])) == m["words"]))
    none = F.array().cast("array<struct<name:string,at:int,n:int>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("out"))

    def take(state: Column, m: Column) -> Column:
        n = -m["less"]
        free = m["at"] >= state["end"]
        out = F.when(free, F.concat(state["out"], F.array(F.struct(m["name"].alias("name"), m["at"].alias("at"), n.alias("n"))))).otherwise(state["out"])
        return F.struct(F.when(free, m["at"] + n).otherwise(state["end"]).alias("end"), out.alias("out"))

    spans = F.aggregate(here, start, take, lambda s: s["out"])
    return found.select(*(F.col(f"held.doc.`{c}`") for c in kept), spans.alias("spans"))


def most_named(spans: Column, but: Column | None = None) -> Column:
    """The name that a text has most often, the earliest on a tie; ``but`` doesn't count.  Null without any."""
    told = spans if but is None else F.filter(spans, lambda s: ~s["name"].eqNullSafe(but))
    names = F.transform(told, lambda s: s["name"])
    counted = F.transform(F.array_distinct(names), lambda x: F.struct(F.size(F.filter(names, lambda y: y == x)).alias("n"), (-F.array_position(names, x)).alias("first"), x.alias("name")))
    return F.array_max(counted)["name"]


def without_names(text: Column, known: Column) -> Column:
    """A list of names without those that a text's spans have already."""
    return F.filter(text, lambda x: ~F.exists(known, lambda s: s["name"] == x))
