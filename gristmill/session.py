"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the library expects of a session.  Sizes (shuffle partitions, file splits) stay the cluster's own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_written: dict[str, SparkSession] = {}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where a session of one machine names none is a temporary folder made and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="gristmill-code-")
        shutil.copytree(home, f"{folder}/code/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", f"{folder}/code"))
        _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read from it, not the work before this table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


class Scratch:
    """Tables that a job writes for itself: each can be dropped once it has been read, the rest go at the end.

        with Scratch(spark) as keep:
            table = keep(df, "table")
            ...
            return materialise(result, "result")
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if id(table) in self.held:
                remove(self.spark, self.held.pop(id(table))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(t for t, _ in self.held.values()))


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):
            remove(spark, path)
