"""Stored upserts: only touched buckets are written, lost writes change nothing; counts gathered with a write."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gristmill.operators import merging, snapshots
from gristmill.streaming import merging as streams

SCHEMA = "key long, title string, seen int"


def merge(stored, incoming):
    return merging.upsert(stored, incoming, "key", overwrite=["title"], latest=["seen"])


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def size(tmp_path, folder):
    return sum(f.stat().st_size for f in (tmp_path / "t" / "data").glob(f"{folder}-*/**/*.parquet"))


def table(spark, tmp_path, buckets=64):
    return snapshots.Snapshot(spark, str(tmp_path / "t"), "key", rows(spark, []).schema, buckets)


def test_commits_equal_one_merge_after_another(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and t.read().collect() == []
    batches = [[(i, f"a{i}", 1) for i in range(300)], [(5, "b5", 2), (500, "b500", 2)], [], [(5, "c5", 1), (-9, "minus", 1)]]
    want = {}
    for k, items in enumerate(batches):
        t.commit(rows(spark, items), merge, f"run {k}")
        for key, title, seen in items:
            want[key] = (title, max(seen, want.get(key, ("", 0))[1]))
        assert {r.key: (r.title, r.seen) for r in t.read().collect()} == want
    assert t.version() == 3
    assert {(r.key, r.change) for r in t.changes(2).collect()} == {(5, "update"), (500, "insert")}
    assert t.changes(1).count() == 300
    assert {r.key: r.title for r in t.read(2).filter("key IN (5, 500)").collect()} == {5: "b5", 500: "b500"}


def test_bytes_written_grow_with_the_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit(rows(spark, [(i, f"{i:0200d}", 1) for i in range(3000)]), merge)
    t.commit(rows(spark, [(7, "x", 2)]), merge)
    assert size(tmp_path, 2) * 20 < size(tmp_path, 1)
    assert t.read().count() == 3000


def test_a_lost_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.commit(rows(spark, [(1, "a", 1), (2, "b", 1)]), merge)
    monkeypatch.setattr(snapshots.Snapshot, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.commit(rows(spark, [(1, "lost", 2)]), merge)
    monkeypatch.undo()
    assert t.version() == 1 and sorted(r.title for r in t.read().collect()) == ["a", "b"]
    t.commit(rows(spark, [(1, "c", 2)]), merge, "again")
    assert t.commit(rows(spark, [(1, "d", 3)]), merge, "again") == 2
    assert sorted(r.title for r in t.read().collect()) == ["b", "c"]
    t.vacuum(1)
    assert sorted(r.title for r in t.read().collect()) == ["b", "c"]
    assert len(list((tmp_path / "t" / "data").iterdir())) == len({*t.manifest()["buckets"].values()})


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    t = table(spark, tmp_path)

    def late(stored, incoming):
        table(spark, tmp_path).commit(rows(spark, [(1, "first", 1)]), merge)
        return merge(stored, incoming)

    with pytest.raises(RuntimeError):
        t.commit(rows(spark, [(1, "second", 1)]), late)
    assert [r.title for r in t.read().collect()] == ["first"]


def test_counts_are_gathered_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([("a", True, "x"), ("a", None, "y"), ("b", False, None), (None, True, "z")], "source string, relevant boolean, skills string")
    watched, seen = snapshots.counted(df, "raw", {"relevant": F.col("relevant"), "skills": F.col("skills").isNotNull()}, "source", ["a", "b"])
    watched.write.parquet(str(tmp_path / "out"))
    row = snapshots.run_row("2026-01-01", {"raw": seen})
    assert row["totals"] == {"raw_rows": 4, "raw_relevant": 2, "raw_skills": 3}
    assert row["sources"] == {"a": {"raw_relevant": 1, "raw_skills": 2}, "b": {"raw_relevant": 0, "raw_skills": 0}}
    snapshots.append_run(spark, str(tmp_path / "runs"), row)
    snapshots.append_run(spark, str(tmp_path / "runs"), {**row, "run": "2026-01-02"})
    assert sorted(r.run for r in snapshots.runs(spark, str(tmp_path / "runs")).collect()) == ["2026-01-01", "2026-01-02"]


def test_a_stream_equals_one_merge(spark, tmp_path):
    batches = [[(i, f"a{i}", i % 5) for i in range(40)], [(3, "late", 1), (4, "new", 9), (90, "x", None)], [(4, "older", 8), (90, "y", 0), (7, "same", 2)]]
    inbox = tmp_path / "in"
    inbox.mkdir()
    t = table(spark, tmp_path, 16)
    for k, items in enumerate(batches):
        rows(spark, items).coalesce(1).write.parquet(str(tmp_path / f"land{k}"))
        (file,) = (tmp_path / f"land{k}").glob("*.parquet")
        file.rename(inbox / f"{k}.parquet")
        stream = spark.readStream.schema(t.schema).parquet(str(inbox))
        streams.snapshot_stream(stream, t, "seen", str(tmp_path / "check")).awaitTermination(120)
    want = {}
    for items in batches:
        for key, title, seen in items:
            if key not in want or (-1 if seen is None else seen) > (-1 if want[key][1] is None else want[key][1]):
                want[key] = (title, seen)
    assert {r.key: (r.title, r.seen) for r in t.read().collect()} == want
    assert {(r.key, r.change) for r in t.changes(2).collect()} == {(4, "update"), (90, "insert")}
    assert {(r.key, r.change) for r in t.changes(3).collect()} == {(90, "update")}
