"""The numbered queries against their SQL, and the pipeline against a plain version of its filtering stages."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest

from gristmill.llm import registry


def canonical(value):
    return None if value is None or value != value else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(canonical(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(canonical, r)) for r in want.fetchall()), key=repr)


def test_pipeline(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    ruled = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert ruled.columns == columns
    unique = corpus_pipeline.near_dedup(spark, ruled, sf_dir)
    assert unique.columns == columns
    texts = {r.doc_id: r.text for r in ruled.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, component = sorted(sets), {i: i for i in sets}

    def find(i):
        while component[i] != i:
            i = component[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * len(sets[a] | sets[b]) and common:
                component[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r.doc_id for r in unique.collect()) == [i for i in ids if find(i) == i]
    clean = corpus_pipeline.secret_scans(spark, unique, sf_dir)
    assert clean.columns == columns
    assert clean.count() == unique.count()
    assert not [r for r in clean.collect() if re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text)]
    mixed = corpus_pipeline.source_mix(spark, clean, sf_dir)
    assert mixed.columns == columns
    coded = corpus_pipeline.bpe_encoding(spark, mixed, sf_dir)
    assert coded.count() == mixed.count()
    assert all(len(r.ids) == r.n_tokens for r in coded.collect())


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
