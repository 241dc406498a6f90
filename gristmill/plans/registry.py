"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    """
    SELECT c.c_custkey AS employer_id, CAST(count(o.o_orderkey) AS BIGINT) AS listings,
           CAST(count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'O') AS BIGINT) AS open_listings,
           min(CAST(o.o_orderdate AS DATE)) FILTER (WHERE o.o_orderstatus = 'O') AS next_closing,
           max(CAST(o.o_orderdate AS DATE)) FILTER (WHERE o.o_orderstatus <> 'O') AS last_closed
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1
    """
)
def employer_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per employer: listings, open ones, next closing date and last closed date."""
    orders = table(spark, sf_dir, "orders")
    day, open_ = F.to_date("o_orderdate"), F.col("o_orderstatus") == "O"
    stats = orders.groupBy(F.col("o_custkey").alias("employer_id")).agg(
        F.count("o_orderkey").alias("listings"),
        F.count_if(open_).alias("open_listings"),
        F.min(F.when(open_, day)).alias("next_closing"),
        F.max(F.when(~open_, day)).alias("last_closed"),
    )
    employers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employer_id"))
    return employers.join(stats, "employer_id", "left").select(
        "employer_id",
        F.coalesce("listings", F.lit(0)).alias("listings"),
        F.coalesce("open_listings", F.lit(0)).alias("open_listings"),
        "next_closing",
        "last_closed",
    )
