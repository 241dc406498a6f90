"""Stored tables that a batch changes in part: bucketed snapshots with versions, and counts of a run.

A table is dealt into buckets by a hash of its key.  A commit reads and rewrites only the buckets that its batch has keys
of, into a folder of its own, and writes a change feed.  What makes it the current version is one small manifest, put in
place by a rename: it names, for each bucket, the version whose folder holds it.  A write that is lost half-way leaves
files that no manifest names, so the version before is read on.

    <path>/manifest/00000007.json      {"buckets": {"0": 3, "1": 7, ...}, "batch": "..."}
    <path>/data/7-<id>/bucket=1/*.parquet
    <path>/changes/7-<id>/*.parquet       key, change (insert, update)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of a table of 100 TB a bucket has about 25 GB, spread over files.
BUCKETS = 4096
CHANGED = ("insert", "update")


class Snapshot:
    """A table under a path that all machines share.

    :param key: the column whose hash deals rows out.  Null keys have a bucket; what becomes of them is the merge's rule.
    :param schema: of the table.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _path(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self) -> JavaObject:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        folder = self._path("manifest")
        files = self._files()
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Which folder holds each bucket, and the batch that was committed last."""
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "batch": None}
        (row,) = self.spark.read.text(f"{self.path}/manifest/{version:08d}.json", wholetext=True).collect()  # one small file
        return json.loads(row[0])

    def _read(self, held: Mapping[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in held.items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it was at a version, or is now."""
        return self._read(self.manifest(version)["buckets"])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commit(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> int:
        """Merge a batch in, and give the new version.

        :param merge: (stored rows of the touched buckets, incoming) to the merged rows with the table's columns and
            ``change``, as ``merging.upsert`` gives them.
        :param batch: a name; if the last commit has it, nothing is done, so a batch that is run again counts once.

        An empty batch makes no version.  Of two commits at once one fails.
        """
        now = self.version()
        held = self.manifest(now)
        if batch is not None and held["batch"] == batch:
            return now
        touched = [str(r[0]) for r in incoming.select(self.bucket(F.col(self.key))).distinct().collect()]  # BUCKETS at most
        if not touched:
            return now
        folder = f"{now + 1}-{uuid.uuid4().hex}"
        merged = merge(self._read({b: held["buckets"][b] for b in touched if b in held["buckets"]}), incoming)
        columns = [F.col(f"`{f.name}`") for f in self.schema]
        rows = merged.select(*columns, "change", self.bucket(F.col(self.key)).alias("bucket"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        # the changes come from what has been written, not from a second merge
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("change", T.StringType())])).parquet(*(f"{self.path}/data/{folder}/bucket={b}" for b in touched))
        written.filter(F.col("change").isin(*CHANGED)).select(self.key, "change").write.parquet(f"{self.path}/changes/{folder}")
        self._publish(now + 1, {"buckets": {**held["buckets"], **dict.fromkeys(touched, folder)}, "batch": batch})
        return now + 1

    def _publish(self, version: int, content: dict) -> None:
        files, draft, target = self._files(), self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{version:08d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def changes(self, version: int) -> DataFrame:
        """key and change (insert, update) of one version; rows that were kept aren't in it."""
        folders = {f for f in self.manifest(version)["buckets"].values() if f.startswith(f"{version}-")}
        schema = T.StructType([self.schema[self.key]]).add("change", "string")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/changes/{f}" for f in folders))

    def vacuum(self, keep: int = 2) -> None:
        """Remove the folders that none of the last ``keep`` versions names; those of writers at work go too."""
        now = self.version()
        named = {f for v in range(max(1, now - keep + 1), now + 1) for f in self.manifest(v)["buckets"].values()}
        files = self._files()
        for place in ("data", "changes"):
            if files.exists(self._path(place)):
                for status in files.listStatus(self._path(place)):
                    if status.getPath().getName() not in named:
                        files.delete(status.getPath(), True)
        for v in range(1, now - keep + 1):
            files.delete(self._path(f"manifest/{v:08d}.json"), False)


# counts of a run


def counted(rows: DataFrame, name: str, flags: Mapping[str, Column], by: str, values: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``rows``, and counts that are gathered as they are written: no second pass.

    :param flags: name to condition: of how many rows it holds.
    :param by: a column; each flag is also counted for each of its ``values`` (a run's sources, which are few).

    Null conditions don't hold.  Rows of other values are in the totals only.
    """
    seen = Observation(name)
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f) for f, c in flags.items()]
    counts += [F.count_if(F.coalesce(c & (F.col(by) == v), F.lit(False))).alias(f"{f}:{v}") for f, c in flags.items() for v in values]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def run_row(run: str, seen: Mapping[str, Observation]) -> dict:
    """A run's totals and its counts by source, from what its steps have observed: {run, totals, sources}."""
    totals: dict[str, int] = {}
    sources: dict[str, dict[str, int]] = {}
    for step, observation in seen.items():
        for name, n in observation.get.items():
            flag, colon, value = name.partition(":")
            if colon:
                sources.setdefault(value, {})[f"{step}_{flag}"] = n
            else:
                totals[f"{step}_{flag}"] = n
    return {"run": run, "totals": totals, "sources": sources}


RUNS = "run string, totals map<string,long>, sources map<string,map<string,long>>"


def append_run(spark: SparkSession, path: str, row: dict) -> None:
    """Add a run to the table of runs (JSON, a file each)."""
    spark.createDataFrame([(row["run"], row["totals"], row["sources"])], RUNS).coalesce(1).write.mode("append").json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).json(path)
