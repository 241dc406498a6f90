"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from gristmill.llm import minhash
from gristmill.llm.shingles import shingle_sets
from tests.llm.test_registry import shingles

SCHEMA = "doc_id long, text string, keys string, cls int, set string"


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def groups(seed):
    """A group of near copies of one text with and without its original, copies of copies, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    base = [word() for _ in range(120)]
    rows = [(1, " ".join(base))]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = word()
        if rng.random() < 0.3:
            own = own[: rng.randrange(95, 120)]
        rows.append((len(rows) + 1, " ".join(own)))
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = word()
            rows.append((len(rows) + 1, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two WORDS"), (905, "two words"), (905, "two words"), (None, "two words"), (None, "alone here"), (906, " ".join(word() for _ in range(3000)))]
    return rows


def lineages(seed):
    """A base that is not there itself, with copies that are too far from it, cut at one end or changed alike in families."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    base = [word() for _ in range(200)]
    rows = []
    for family in range(8):
        own = list(base[: 200 - rng.choice([0, 30, 45])])
        for _ in range(rng.randrange(2, 7)):
            own[rng.randrange(len(own))] = word()
        for _ in range(18):
            one = list(own)
            for _ in range(rng.randrange(0, 5)):
                one[rng.randrange(len(one))] = word()
            rows.append((len(rows) * 7 % 150 + 150 * family, " ".join(one)))
    return rows


@pytest.mark.parametrize(("make", "seed", "small"), [(groups, 1, 2), (groups, 2, 12), (lineages, 3, 2), (lineages, 4, 12)])
def test_components_equal_all_pairs(spark, make, seed, small):
    rows = make(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = minhash.near_duplicates(docs, small=small, later=small).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_agrees_as_often_as_sets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    same = (minhash.sketch(np.unique(a), 1024) == minhash.sketch(np.unique(b), 1024)).mean()
    assert abs(same - 300 / 500) < 0.08
    tiny = minhash.sketch(np.array([7], np.uint64), 320)
    assert (tiny != np.uint64(2**64 - 1)).all()


def test_parity_bits_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for size in (1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.union1d(a[size // 5 :], rng.integers(0, 2**63, size // 4 + 1, dtype=np.uint64))
        bits = np.bitwise_count(minhash.parity(a).view(np.uint64) ^ minhash.parity(b).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))
        assert size < 30 or bits > 0


def test_shingle_counts():
    text = "A b c d e f a b c d e\tf é".encode()
    found = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(found[0]) == len(shingles(text.decode()))


def test_stage_keeps_one_row_of_each_component(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(5)]
    near = texts[0] + " tail"
    rows = [(1, texts[0]), (1, texts[0]), (1, near), (2, near)]  # repeated rows, and a copy with the kept row's id
    rows += [(7, texts[1]), (7, texts[0]), (6, texts[1])]  # id 7 is rejected twice
    rows += [(None, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (None, None), (None, None), (9, ""), (9, texts[4])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, None if r.text == near else r.text) for r in got.collect()]
    assert [d for d, t in kept if d == 1] == [1]
    rest = [(6, texts[1]), (None, texts[2]), (None, texts[3]), (None, None), (None, None), (9, ""), (9, texts[4])]
    assert sorted([k for k in kept if k[0] != 1], key=repr) == sorted(rest, key=repr)


def test_stage_meets_pairs_at_its_threshold():
    """Sets of similarity 0.80 share a band; with 40 bands about one of 1600 pairs has none."""
    assert (1 - 0.8**corpus_pipeline.ROWS) ** corpus_pipeline.BANDS < 3e-6


def test_a_bucket_lent_as_reference_has_a_set_of_its_own(spark):
    """The middle one of three buckets is compared with the largest, and is itself the reference of the least."""
    held = {1: range(4), 2: range(3, 9), 3: range(8, 20)}
    large = spark.createDataFrame([(b, c, 10, c, len(held[b])) for b in held for c in held[b]], "bucket long, cls long, n int, part long, size long")
    sets = spark.createDataFrame([(c, [100, 200, c]) for c in range(20)], "cls long, set array<long>")
    placed = minhash._placed(large, True)
    assert {r["ref"] for r in placed.select("ref").collect()} == {2, 3}
    made = {r["ref"]: sorted(r["ref_set"]) for r in minhash._references(placed, large, sets).collect()}
    assert made == {2: [100, 200], 3: [100, 200]}


def test_few_texts_are_exchanged_for_sets_and_none_that_is_wanted_is_lost(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS doc_id, 'null' AS text"))
    ids = spark.range(0, 20000, 40).selectExpr("id AS doc_id").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS doc_id"))
    left = [r["doc_id"] for r in minhash._likely(rows, ids).collect()]
    assert None in left and set(range(0, 20000, 40)) <= set(left)
    assert len(left) < 600
