"""Streams with state against the batch rules: several batches, a restart, keys that expire, months that start anew."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gristmill.streaming import state


@pytest.fixture(scope="module")
def rocks(spark):
    name, provider = state.PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, parts, build, order):
    """Each part lands as a file; the stream is started, stopped and started again half-way."""
    schema = parts[0].schema
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"land{k}"))
    inbox = tmp_path / "in"
    inbox.mkdir()
    for half in (range(len(parts) // 2), range(len(parts) // 2, len(parts))):
        for k in half:
            (file,) = (tmp_path / f"land{k}").glob("*.parquet")
            file.rename(inbox / f"{k:03d}.parquet")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(inbox))
        query = build(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=order)


def test_seen_lately_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2026, 1, 1)
    rows = sorted({(start + datetime.timedelta(hours=rng.randrange(24 * 300)), f"u{rng.randrange(12)}") for _ in range(160)})
    df = rocks.createDataFrame([(u, t) for t, u in rows], "url string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    parts = [df.filter(F.col("at").between(F.lit(start + datetime.timedelta(days=50 * k)), F.lit(start + datetime.timedelta(days=50 * k + 50)) - F.expr("INTERVAL 1 SECOND"))) for k in range(6)]
    got = run(rocks, tmp_path, parts, lambda s: state.unseen_stream(s, "url", "at", "1 day"), repr)
    want = sorted(map(tuple, state.unseen_lately(df, "url", "at").select("url", "at", "fresh").collect()), key=repr)
    assert got == want and {f for _, _, f in want} == {True, False}


def test_budget_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2026, 1, 1)
    rows = sorted((start + datetime.timedelta(hours=rng.randrange(24 * 100)), i, rng.choice(["serp", "tavily", "none"])) for i in range(200))
    df = rocks.createDataFrame([(k, t, i) for t, i, k in rows], "service string, at timestamp, id long")
    limits = {"serp": 20, "tavily": 7}
    third = len(rows) // 4
    parts = [df.filter(F.col("id").isin([i for _, i, _ in rows[k * third : (k + 1) * third if k < 3 else None]])) for k in range(4)]
    got = run(rocks, tmp_path, parts, lambda s: state.budget_stream(s, limits, "service", "at", "id"), lambda r: r[2])
    table = rocks.createDataFrame(list(limits.items()), "service string, limit long")
    batch = state.within_budget(df, table, "service", "at", "id").select("service", "at", "id", "used", "granted", "alert").collect()
    assert got == sorted(map(tuple, batch), key=lambda r: r[2])
    assert max(r.used for r in batch if r.service == "serp") == 20 and not any(r.granted for r in batch if r.service == "none")


def test_remembered(spark):
    day = datetime.date(2026, 5, 1)
    stored = spark.createDataFrame([("a", day - datetime.timedelta(59)), ("b", day - datetime.timedelta(60)), ("c", day - datetime.timedelta(70))], "url string, seen date")
    met = spark.createDataFrame([("c",), ("d",), ("d",)], "url string")
    assert sorted((r.url, r.seen) for r in state.remembered(stored, met, "url", F.lit(day)).collect()) == [("a", day - datetime.timedelta(59)), ("c", day), ("d", day)]


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", None), (None, datetime.datetime(2026, 1, 1)), (None, datetime.datetime(2026, 1, 1))], "url string, at timestamp")
    got = sorted((r.url or "", r.fresh) for r in state.unseen_lately(df, "url", "at").collect())
    assert got == [("", False), ("", True), ("a", False)]
    assert state.unseen_lately(df.limit(0), "url", "at").collect() == []
