"""Sharding by weighted rendezvous hashing.

Every shard draws a number from the hash of a record's key and the shard's own number; the highest draw takes the
record.  A draw is -weight / ln(u), u in (0, 1) being the hash, so shards take rows in proportion to their weights; with
equal weights the hash itself is compared.  A draw doesn't depend on what other shards there are.  So a shard that is
added, or whose weight grows, takes rows only into itself, and one that is removed gives away only its own rows.

The shard is decided by the key alone, row by row, without an exchange.  Places within a shard (``numbered``) are dealt
out by buckets of a hash of key, size and text: equal rows are counted where they are read, running sums are those of a
bucket, and only bucket totals are summed up by shard.  So neither a key nor a text that a third of the rows have
becomes one task's.  Texts are never exchanged for the numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.columns import text_or_empty
from gristmill.session import materialise

SHARDS = 24
#: What a record takes besides its text (its id).
RECORD_BYTES = 8
#: Rows that one running sum covers, about.
BUCKET_ROWS = 100_000
#: Rows that one counted row is turned into at a time.
STEP = 10_000


def equal_weights(shards: int) -> dict[int, float]:
    return dict.fromkeys(range(shards), 1.0)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that draws highest for ``key``; of equal draws the later shard's.

    Shards without weight take nothing.  A null key is a key like others: all its rows have one shard.
    """
    drawing = {s: w for s, w in weights.items() if w > 0}
    if not drawing or any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite, none below 0, and one above 0")
    listed = F.array(*(F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(drawing.items())))
    level = len(set(drawing.values())) == 1

    def drawn(one: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, one["shard"]), 11)
        score = bits.cast("double") if level else -one["weight"] / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))
        return F.struct(score.alias("score"), one["shard"].alias("shard"))

    return F.array_max(F.transform(listed, drawn))["shard"]


def assign(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with its shard in column ``name``, which is replaced if it is there."""
    return docs.withColumn(name, shard_of(F.col(key), weights))


def moved(docs: DataFrame, before: Mapping[int, float], after: Mapping[int, float], key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that have another shard under ``after``, with ``from_shard`` and ``to_shard``."""
    both = docs.withColumns({"from_shard": shard_of(F.col(key), before), "to_shard": shard_of(F.col(key), after)})
    return both.filter("from_shard <> to_shard")


def numbered(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """Size, checksum, shard and place of every document.

    :param docs: doc_id, text; other columns may be there and are not looked at.
    :param weights: shard to weight.
    :param grown: weights under which ``grown_shard`` is worked out; without it the column is null.
    :return: doc_id, size (bytes of UTF-8, and RECORD_BYTES), text_crc32, shard, slot, grown_shard: a row for each row
        of ``docs``.

    Null and empty texts have RECORD_BYTES and checksum 0.  Rows with one doc_id, or none, have one shard and places of
    their own.  Slots are 0, 1, ... in each shard, in an order that depends on hashes of the rows and not on where they
    are read; of rows equal in doc_id, size and checksum any may have any of their places.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part"))
    same = rows.groupBy("doc_id", "size", "text_crc32", "part").agg(F.count("*").alias("n"))
    # the hash that orders the rows isn't the one that places them
    placed = materialise(same.withColumns({"h": F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), "shard": shard_of(F.col("doc_id"), weights)}), "sharded")
    buckets = max(1, math.ceil(placed.count() / (len(weights) * BUCKET_ROWS)))
    bucket = F.pmod("h", F.lit(buckets)).alias("bucket")
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", bucket).agg(F.sum("n").alias("held")).select("shard", "bucket", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("bucket", bucket).withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    at = begun.join(firsts, ["shard", "bucket"]).withColumn("at", F.col("first") + F.col("before"))
    steps = at.withColumn("step", F.explode(F.expr(f"sequence(0L, (n - 1) div {STEP})")))
    slot = F.explode(F.expr(f"sequence(at + step * {STEP}, at + least(n, (step + 1) * {STEP}) - 1)")).alias("slot")
    later = shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    return steps.withColumn("grown_shard", later).select("doc_id", "size", "text_crc32", "shard", slot, "grown_shard")


def write(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id", files: int = 1) -> None:
    """Write ``docs`` as Parquet, a folder ``shard=N`` for each shard that has rows, about ``files`` files in each.

    Rows are dealt to a shard's files by the input's partitions, not by their values, so no common key or text fills one
    file.  A column ``shard`` of ``docs`` is replaced.
    """
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), shard_of(F.col(f"`{key}`"), weights).alias("shard"), F.pmod(F.spark_partition_id(), F.lit(files)).alias("file"))
    dealt = rows.repartition(len(weights) * files, "shard", "file")
    dealt.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)
