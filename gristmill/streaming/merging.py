"""Structured Streaming forms of the daily merge: the same rules, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.merging import pick
from gristmill.operators.snapshots import Snapshot
from gristmill.session import remove


def first_seen(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows with a key not seen within the watermark; state older than ``delay`` is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str, delay: str) -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``delay`` are dropped."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def upsert_stream(incoming: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet snapshot of the latest row of each key, a new directory for each batch.

    A batch that is run again writes the same directory again, so a lost driver or executor changes nothing.  The
    snapshots before the last two are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}").unionByName(batch)
        pick(batch, [key], order, last=True).write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            remove(spark, f"{path}/{number - 2}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest ``order``, a stored one before an incoming one of equal order, and ``change``.

    Rows without an order come before all others.
    """
    names = incoming.columns
    both = stored.select(*names, F.lit(0).alias("came")).unionByName(incoming.select(*names, F.lit(1).alias("came")))
    last = F.max_by(F.struct(*names, "came"), F.struct(F.col(order), -F.col("came")))
    held = both.groupBy(F.col(key).alias("of")).agg(last.alias("row"), F.min("came").alias("was"))
    change = F.when(F.col("was") == 1, "insert").when(F.col("row.came") == 1, "update").otherwise("keep")
    return held.select(*(F.col(f"row.`{c}`") for c in names), change.alias("change"))


def snapshot_stream(incoming: DataFrame, table: Snapshot, order: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key in a bucketed table: a batch rewrites only the buckets that it has keys of.

    A batch that is run again after a loss counts once: its number is in the table's manifest.  Each version's change
    feed says what the batch has changed.  Old versions stay until ``table.vacuum``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in batch.columns)), F.struct(order))
        table.commit(batch.groupBy(F.col(table.key).alias("of")).agg(last.alias("row")).select("row.*"), lambda stored, fresh: newest(stored, fresh, table.key, order), f"{checkpoint}#{number}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
