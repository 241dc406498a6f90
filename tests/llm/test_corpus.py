"""Alignment, sharding and collocations against plain versions, over odd rows, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import alignment, collocations, registry, sharding

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, shard string, block int, groups int, phrase string, n int"
ODD = [None, "", " ", "  two  spaces ", "a", "naïve café 😀 日本語", "<|endoftext|> <s> </s> <unk>", "▁ piece", "ﬁ ﬀ ＡＢ", "x\ny\tz\x1c\x85", "tail ", "a b" * 4000, "ԱԲ Ա’ 𐐀 ١٢", "it's we'll 12 3.5"]
WORDY = ["New York is big. New York, new york! in new\nyork", "in New York", "in new york in NEW YORK", "é New York", "in\tnew  york"]


def rows(spark, texts):
    made = [(i if i % 4 else None, t, ("en", None, "und", "fr")[i % 4], "s", "x", 1, 2, "p", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(made + made[:3], SCHEMA)


# alignment


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    read = alignment.byte_alphabet()
    both = []
    for text in texts:
        spaced = " " + (text or "")
        x = [(i, bytes(read[c] for c in a.id_to_token(i))) for i in a.encode(spaced, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        same = b"".join(t for _, t in x) == b"".join(t for _, t in y) == spaced.encode()
        both.append((x, y) if text and same else ([], []))
    out, counts = [], Counter()
    for x, y in both:
        ends, at = [{}, {}], [0, 0]
        for side, tokens in enumerate((x, y)):
            for i, data in tokens:
                at[side] += len(data)
                ends[side][at[side]] = i
        cuts = sorted(ends[0].keys() & ends[1].keys())
        own = [(ends[0][c], ends[1][c]) for c in cuts]
        counts.update(own)
        spelled, before = [], 0
        for c in cuts:
            spelled.append("|".join(",".join(str(i) for e, i in e_.items() if before < e <= c) for e_ in ends))
            before = c
        out.append((len(x), len(y), len(cuts), own, hashlib.sha256(";".join(spelled).encode()).hexdigest() if x else ""))
    most = {}
    for (i, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(n_a, n_b, g, len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), sha) for n_a, n_b, g, own, sha in out]


def test_alignment_equals_plain_version(spark, sf_dir, monkeypatch):
    docs = rows(spark, ODD).select("doc_id", "text", "block", "groups", "n").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    listed = docs.collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, *w) for r, w in zip(listed, plain_alignment([r.text for r in listed]), strict=True))
    got = alignment.align(docs.repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got.collect()) == want
    assert alignment.align(docs.limit(0), A, B).collect() == []
    nothing = alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r[1:]) for r in nothing) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_blocks_make_no_difference():
    both = alignment.aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    x = [ids for ids in both.tokens(["one two three", "four", "one two"])]
    split = alignment._Block(0)
    for ids in x:
        split.add(*ids, both.spell(*ids))
    assert [r[2] for r in split.rows] == [len(both.spell(*ids).split(";")) for ids in x]


def test_group_texts(spark):
    docs = rows(spark, ODD)
    for r in alignment.groups(docs, A, B).collect():
        assert (r.groups == "") == (plain_alignment([r.text])[0][0] == 0)
        assert hashlib.sha256(r.groups.encode()).hexdigest() == plain_alignment([r.text])[0][-1] or not r.groups
        assert (r.block, r.n) == (1, 3)


# sharding


def test_shards_and_slots(spark, sf_dir):
    docs = rows(spark, ODD).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars"), allowMissingColumns=True)
    got = sharding.numbered(docs, sharding.equal_weights(24), sharding.equal_weights(25)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by_shard, by_id = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_id.values())
    again = sharding.numbered(docs.repartition(5), sharding.equal_weights(24), sharding.equal_weights(25)).collect()
    assert Counter(got) == Counter(again)
    assert sharding.numbered(docs.limit(0), sharding.equal_weights(3)).collect() == []


def test_common_rows_have_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    docs = spark.range(300).select(F.expr("if(id % 3 = 0, 7, id)").alias("doc_id"), F.expr("if(id % 3 = 0, 'same', string(id))").alias("text"))
    got = sharding.numbered(docs, sharding.equal_weights(4)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard is None
    assert len(got) == 300 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    held = {r.shard: r["count"] for r in sharding.assign(docs, {0: 1.0, 1: 3.0, 2: 0.0}).groupBy("shard").count().collect()}
    assert held.keys() == {0, 1} and abs(held[1] - 15_000) < 400
    before, after = {0: 1.0, 1: 1.0, 2: 1.0}, {0: 1.0, 1: 1.0, 2: 2.0}
    moves = sharding.moved(docs, before, after).collect()
    assert moves and {r.to_shard for r in moves} == {2} and abs(len(moves) - 20_000 / 6) < 300
    gone = sharding.moved(docs, before, {0: 1.0, 1: 1.0}).collect()
    assert {r.from_shard for r in gone} == {2}
    for bad in ({}, {0: -1.0, 1: 1.0}, {0: 0.0}, {0: float("inf")}):
        with pytest.raises(ValueError):
            sharding.assign(docs, bad)


def test_written_shards(spark, tmp_path):
    docs = rows(spark, ODD + WORDY)
    sharding.write(docs, str(tmp_path / "out"), sharding.equal_weights(3), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.text for r in back.collect()) == Counter(r.text for r in docs.collect())
    want = {(r.doc_id, r.text): r.shard for r in sharding.assign(docs, sharding.equal_weights(3)).collect()}
    assert all(want[r.doc_id, r.text] == r.shard for r in back.collect())


# collocations


def plain_collocations(listed, least, top=2000):
    counts, n = {}, Counter()
    for text, lang in listed:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(found)
            own.update(tuple(found[i : i + k]) for k in range(1, 6) for i in range(len(found) - k + 1))
    out = []
    for lang, own in counts.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in many.items():
            for i in range(len(p)):
                for j in range(i + 2, min(len(p) + 1, i + len(p))):
                    within[p[i:j]] = max(within[p[i:j]], a)
        kept = []
        for p, a in many.items():
            if within[p] < a:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(3, 2000), (2, 5)])
def test_collocations_equal_plain_counts(spark, least, top):
    docs = rows(spark, ODD[:-3] + WORDY * 3 + ["a a a a a a", "b b b"])
    want = plain_collocations([(r.text, r.lang) for r in docs.collect()], least, top)
    got = collocations.collocations(docs.repartition(3), top=top, least=least).collect()
    assert want and sorted(map(tuple, got)) == want


def test_collocations_over_documents_in_small_shards(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_collocations([(r.text, r.lang) for r in docs.collect()], 8)
    assert sorted(map(tuple, collocations.collocations(docs.repartition(9), least=8).collect())) == want
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_shards_number_words():
    shard = collocations._Shard()
    shard.add("Two one. TWO")
    places, words = shard.nodes()
    assert words == [b"two", b"one"] and places.tolist() == [-1, 0, 1, -1, 0, -1]
    for numbers in (places, places * 70_000 * (places > 0) - (places < 0), places[:0]):
        assert collocations._unpacked(collocations._packed(numbers)).tolist() == numbers.tolist()


def test_merge_over_batches_and_parts(monkeypatch):
    """Groups that end in the middle of a batch, fill several, or are dealt into parts give the same sums."""
    monkeypatch.setattr(collocations, "PART", 4)
    monkeypatch.setattr(collocations, "PACKED", 8)
    rng, shards, want = random.Random(4), [], Counter()
    for number in range(6):
        shard = collocations._Shard()
        texts = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(5)]
        for t in texts:
            shard.add(t)
            want.update(zip(t.split(), t.split()[1:], strict=False))
        places, words = shard.nodes()
        rank = np.append(np.argsort(np.argsort(words)), -1)
        level = collocations._Level(rank[places], pa.array(sorted(words), pa.binary()).cast(pa.string()), np.arange(len(words)) * 3, packs=2)
        shards.append((level, level.rows(number, "en")))
    rows = pa.concat_tables([t.slice(1) for _, t in shards]).sort_by([(c, "ascending") for c in ("lang", "stem", "part")])
    rows = rows.select(["shard", "lang", "stem", "part", "base", "follows", "counts"])
    for size in (1, 3, 7, 1000):
        out = list(collocations._merge(12)(iter(rows.to_batches(max_chunksize=size))))
        found = {p: a for b in out for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if p}
        assert found == {" ".join(p): a for p, a in want.items() if a >= 12}
        for number, (level, _) in enumerate(shards):
            at = np.frombuffer(b"".join(a for b in out for s, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if s == number), "<u4").astype(int)
            weights = np.frombuffer(b"".join(a for b in out for s, a in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True) if s == number), "<i8")
            deeper = level.deeper(at, weights)
            assert deeper.packs == 2 and deeper.phrases.to_pylist() == sorted(p for p in found if p in set(deeper.phrases.to_pylist()))
            assert dict(zip(deeper.phrases.to_pylist(), deeper.weights.tolist(), strict=True)).items() <= found.items()
            assert all(deeper.phrases[int(x)].as_py() in found for x in deeper.places if x >= 0)


def test_large_products_are_exact(spark):
    a, n = 10**15, 9 * 10**17 - 1
    level = spark.createDataFrame([("en", "x y", a, [a + 1], [a + 3])], "lang string, phrase string, a long, lefts array<long>, rights array<long>")
    none = spark.createDataFrame([], level.schema)
    (r,) = collocations.scored(spark.createDataFrame([("en", n)], "lang string, n long"), [none, level]).collect()
    assert r.score == 1000 * a * n // ((a + 1) * (a + 3))


def test_queries_of_the_three(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharded = registry.QUERIES["op12_sharding"](spark, sf_dir)
    assert sharded.count() == docs.count() and {r.law for r in sharded.select("law").distinct().collect()} == {"key"}
    assert registry.QUERIES["op11_alignment"](spark, sf_dir).count() == docs.count()
    assert {f.simpleString() for f in registry.QUERIES["op13_collocations"](spark, sf_dir).schema} == {"lang:string", "rank:bigint", "phrase:string", "a:bigint", "l:bigint", "r:bigint", "n:bigint", "score:bigint"}
