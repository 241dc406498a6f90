"""Corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Rows are never sampled or capped.  A stage's own module says what nulls, empty texts, ties and repeated rows give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, mixing, secret_scan
from gristmill.llm.minhash import near_duplicates
from gristmill.llm.quality_rules import judge
from gristmill.session import materialise

#: Near duplicates of the pipeline: five-word shingles, 80 % of common shingles or more.
PERCENT = 80
#: With 70 bands of 8 rows a pair of similarity 0.80 is missed with a probability of 2.6e-6.
BANDS, ROWS = 70, 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return judge(docs).filter("rejected_by IS NULL").drop("rejected_by")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: that of the least doc_id, a row with an id before one without.

    Each row has a key of its own, so repeated rows and rows without an id are told apart; of rows with one doc_id any
    may be the one.  Rows without shingles stay.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("doc")), "rows")
    order = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), "key")
    judged = near_duplicates(rows.select(order.alias("doc_id"), F.col("doc.text").alias("text")), percent=PERCENT, bands=BANDS, rows=ROWS)
    kept = judged.filter("kept").select(F.col("doc_id.key").alias("key"))
    return rows.join(kept, "key", "left_semi").select("doc.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; the document stays, its n_chars that of the new text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix takes documents by blocks: a row for each document and epoch of which something is taken."""
    return mixing.mixture(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of the decoded text."""
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]
#: SQL can't express seeded block selection or BPE: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
