"""Every registered query with SQL gives the SQL's rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from gristmill.plans import feed_queries, listing_queries, registry, rule_queries, source_queries

assert listing_queries
assert rule_queries
assert feed_queries
assert source_queries


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_pay_of_every_order(spark, sf_dir, duck):
    got = {r.o_orderkey: (r.least, r.most) for r in registry.QUERIES["parse_salary_all"](spark, sf_dir).collect()}
    orders = duck.execute("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) FROM orders").fetchall()
    assert len(got) == len(orders)
    for key, pay in orders:
        kept = [v for v in ([pay, pay + 1000] if key % 2 == 0 else [pay]) if 5000 <= v <= 250000]
        assert got[key] == (kept[0] if kept else None, kept[1] if len(kept) == 2 else None)
    assert (None, None) in got.values()
