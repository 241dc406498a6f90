"""Free ids for many new names at once, with the outcome of giving them out one after another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import slugify

#: Letters of a name that its id has at most, and the id of a name without any.
ID_CHARS, NAMELESS = 40, "company"
_NUMBER = r"-([2-9]|[1-9][0-9]+)$"


def base_id(name: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(slugify(name), 1, ID_CHARS), F.lit("")), F.lit(NAMELESS))


def family(id_: Column) -> Column:
    """An id without the numbers at its end: only ids of one family can be each other's."""
    return F.regexp_replace(id_, r"(?:-(?:[2-9]|[1-9][0-9]+))+$", "")


def _one_by_one(names: pd.DataFrame) -> pd.DataFrame:
    """A family whose names have several bases: the taken ids first (no ordinal), then the names in order."""
    taken = set(names.loc[names["ordinal"].isna(), "base"])
    new = names[names["ordinal"].notna()].sort_values("ordinal")
    least: dict[str, int] = {}
    out = []
    for base in new["base"]:
        n, id_ = least.get(base, 1), base if base not in least else f"{base}-{least[base]}"
        while id_ in taken:
            n += 1
            id_ = f"{base}-{n}"
        least[base] = n
        taken.add(id_)
        out.append(id_)
    return pd.DataFrame({"ordinal": new["ordinal"].astype("int64"), "id": out})


def free_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """ordinal, id: for each name its slug, or the slug with the least number from 2 on that is free.

    :param names: ordinal (unique; the order in which ids are given out), name.
    :param taken: id.

    The k-th new name of a slug has its k-th free number.  Of the taken numbers t1 < t2 < ..., t_i - i free ones lie
    below t_i; so the k-th free number is k and as many as there are taken ones with t_i - i < k: a running count over
    both, by windows of the slug.  Where ids of one family could be each other's (a name that ends in a number itself),
    which is rare, the family is given out one by one.  A null or empty name is called NAMELESS.
    """
    new = names.select(F.col("ordinal").cast("long").alias("ordinal"), base_id(F.col("name")).alias("base"))
    new = new.withColumn("family", family(F.col("base")))
    held = taken.select("id").distinct().withColumn("family", family(F.col("id"))).join(new.select("family").distinct(), "family", "left_semi")
    bases = new.groupBy("family").agg(F.min("base").alias("one"), (F.min("base") == F.max("base")).alias("single"))
    single = bases.filter("single").select("family", F.col("one").alias("base"))
    # a taken id is a number of the base, or another id of its family
    tail = F.expr("substring(id, length(base) + 1)")
    number = F.when(F.col("id") == F.col("base"), 1).when(tail.rlike("^" + _NUMBER) & F.startswith("id", F.col("base")), F.regexp_extract(tail, _NUMBER, 1).try_cast("long"))
    met = held.join(single, "family").select("base", number.alias("number")).filter("number IS NOT NULL")
    by_base = Window.partitionBy("base")
    marks = met.select("base", (F.col("number") - F.row_number().over(by_base.orderBy("number"))).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ordinal"))
    turns = new.join(single.select("base"), "base", "left_semi").select("base", F.row_number().over(by_base.orderBy("ordinal")).cast("long").alias("at"), F.lit(0).alias("kind"), "ordinal")
    below = F.sum("kind").over(by_base.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    given = marks.unionByName(turns).withColumn("n", F.col("at") + below).filter("kind = 0")
    easy = given.select("ordinal", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("id"))
    rest = bases.filter("NOT single").select("family")
    mixed = new.select("family", "ordinal", "base").unionByName(held.select("family", F.lit(None).cast("long").alias("ordinal"), F.col("id").alias("base"))).join(rest, "family", "left_semi")
    return easy.unionByName(mixed.groupBy("family").applyInPandas(_one_by_one, "ordinal long, id string"))

