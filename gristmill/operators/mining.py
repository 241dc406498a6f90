"""Aggregates over texts: weighted shares and phrases."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import materialise, ship

#: Words of one pass, about, and bits of a hash by which phrases are dealt out.
CHUNK, BUCKET_BITS = 1_000_000, 12
#: Stands for a null place, after all others.
NONE = 2**63 - 1


def weighted_shares(rows: DataFrame, items: str, weight: str) -> DataFrame:
    """item, share of the weight of all rows that have a list, and count.  Rows with a null list are no basis."""
    basis = rows.filter(F.col(items).isNotNull())
    whole = basis.agg(F.sum(weight).alias("whole"))
    sums = basis.select(F.explode(F.array_distinct(items)).alias("item"), F.col(weight).alias("w")).groupBy("item").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return sums.join(F.broadcast(whole)).select("item", (F.col("w") / F.col("whole")).alias("share"), "n")


def skill_shares(rows: DataFrame, skills: str, weight: str, dictionary: DataFrame) -> DataFrame:
    """id, share of the weight of all rows with a list, n, and how many by each context; ranked by share, count, dictionary.

    :param rows: ``skills`` an array of (id, ctx), null for rows that are no basis.
    :param dictionary: id, ordinal: ids that aren't in it are left out.
    """
    basis = rows.filter(F.col(skills).isNotNull())
    whole = basis.agg(F.sum(weight).alias("whole"))
    each = basis.select(F.col(weight).alias("w"), F.explode(F.array_distinct(skills)).alias("s")).select("w", "s.id", "s.ctx")
    sums = each.groupBy("id").agg(F.sum("w").alias("w"), F.count("*").alias("n"), *(F.count_if(F.col("ctx") == c).alias(c) for c in ("asked", "taught", "job")))
    met = sums.join(dictionary.select("id", "ordinal"), "id").join(F.broadcast(whole))
    ranked = met.withColumn("share", F.col("w") / F.col("whole"))
    # a row for each entry of the dictionary, so the window is small
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("share"), F.desc("n"), "ordinal"))).drop("w", "whole", "ordinal")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _hashed(words: pa.ListArray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: where phrases begin among the words, their row and a 64-bit hash."""
    ends = np.asarray(words.offsets, np.int64)
    flat = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    known = np.asarray(flat.dictionary.to_pylist(), object)
    own = (pd.util.hash_array(known, categorize=False) if len(known) else np.empty(0, np.uint64))[np.asarray(flat.indices)]
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(words)), np.diff(ends))
    for size in sizes:
        at = np.flatnonzero(np.arange(len(own)) + size <= ends[1:][row])
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + own[at + k])
        yield size, at, row[at], h


def _slices(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about CHUNK words."""
    ends, at = np.asarray(words.offsets, np.int64), 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield at, end - at
        at = end


def _pack(values: np.ndarray) -> bytes:
    """Bytes of 64-bit values, the first of all at first, so that equal ones lie together."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _pack_few(values: np.ndarray) -> bytes:
    """The same of few different values: these, and which of them each is."""
    kinds, code = np.unique(values, return_inverse=True)
    return _pack(np.concatenate([[len(kinds)], kinds, code]).astype(np.int64))


def _unpack_few(data: bytes) -> np.ndarray:
    held = _unpack(data)
    return held[1 : 1 + held[0]][held[1 + held[0] :]]


def _firsts(h: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash and owner once, with the least place, by hash."""
    order = np.lexsort((at, own, h))
    h, own, at = h[order], own[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new], at[new]


def _packs(sizes: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n in _slices(batch.column("words")):
                part = batch.slice(begin, n)
                owners, places = (np.asarray(part.column(c).fill_null(NONE), np.int64) for c in ("owner", "place"))
                found = [(h, owners[row], places[row]) for _, _, row, h in _hashed(part.column("words"), sizes)]
                h, own, at = _firsts(*(np.concatenate(x) for x in zip(*found, strict=True)))
                bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(h) else np.zeros(1, np.int64)
                packed = [(int(bucket[i]), _pack(np.diff(h[i:j], prepend=np.uint64(0))), _pack_few(own[i:j]), _pack(at[i:j])) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "h", "own", "at"), x, strict=True)) for x in packed], schema=pa.schema([("bucket", pa.int64()), ("h", pa.binary()), ("own", pa.binary()), ("at", pa.binary())]))

    return run


def _counted(owners: int) -> Callable[[pa.Table], pa.Table]:
    def run(packs: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(_unpack(x).view(np.uint64), dtype=np.uint64) for x in packs.column("h").to_pylist()])
        own, at = (np.concatenate([f(x) for x in packs.column(c).to_pylist()]) for c, f in (("own", _unpack_few), ("at", _unpack)))
        h, own, at = _firsts(h, own, at)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(first, append=len(h))
        keep = n >= owners
        least = np.minimum.reduceat(at, first)[keep]
        columns = [h[first][keep].view(np.int64), n[keep], pa.array(least, pa.int64(), mask=least == NONE), np.bitwise_xor.reduceat(own, first)[keep]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["h", "owners", "place", "who"])

    return run


def _named(sizes: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n in _slices(batch.column("words")):
                part = batch.slice(begin, n)
                words, wanted = part.column("words"), part.column("wanted")
                texts = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py())
                ends = np.asarray(wanted.offsets, np.int64)
                asked = np.asarray(wanted.values, np.int64)[ends[0] : ends[-1]]
                asked_row = np.repeat(np.arange(n), np.diff(ends))
                for size, at, row, h in _hashed(words, sizes):
                    # a row's own hashes only: row and hash are told apart by one more mixing
                    tell = lambda r, x: _mix(x.view(np.uint64) + r.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    hit = np.flatnonzero(np.isin(tell(row, h), tell(asked_row, asked)))
                    hit = hit[np.unique(h[hit], return_index=True)[1]]
                    parts = [texts.take(pa.array(at[hit] + k)) for k in range(size)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pc.binary_join_element_wise(*parts, " ")], names=["h", "phrase"])

    return run


def phrases(rows: DataFrame, words: str, owner: str, sizes: Sequence[int] = (2, 3), owners: int = 3, example: str | None = None) -> DataFrame:
    """phrase, owners and, if asked for, example: phrases that at least ``owners`` different owners use.

    A phrase within a longer one that the very same owners use is left out.  The example, a whole number, is the least one.

    Phrases are exchanged as packed 64-bit hashes, each owner's once from each run of texts; those of enough owners get
    their words back from the text of their example.  Words are not null and hold no spaces.
    """
    spark = rows.sparkSession
    ship(spark)
    place = F.col(example).cast("long") if example else F.xxhash64(words)
    texts = rows.filter(F.size(words) >= min(sizes)).select(F.xxhash64(owner).alias("owner"), place.alias("place"), F.col(words).alias("words"))
    packs = texts.mapInArrow(_packs(sizes), "bucket long, h binary, own binary, at binary")
    counted = materialise(packs.groupBy("bucket").applyInArrow(_counted(owners), "h long, owners long, place long, who long"), "counted")
    wanted = counted.groupBy(F.col("place").alias("at")).agg(F.collect_list("h").alias("wanted"))  # what one text is the example of
    joined = texts.select("place", F.array_join("words", " ").alias("text")).join(wanted, F.col("place").eqNullSafe(F.col("at")))
    named = joined.select(F.split("text", " ").alias("words"), "wanted").mapInArrow(_named(sizes), "h long, phrase string")
    found = counted.join(named.groupBy("h").agg(F.min("phrase").alias("phrase")), "h").select("phrase", "owners", F.col("place").alias("example"), "who")
    if len(sizes) > 1:
        found = materialise(found, "phrases")  # read twice below, and far smaller than what it is made of
        inner = F.split("phrase", " ")

        def within(size: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(inner) - size + 1), lambda k: F.array_join(F.slice(inner, k, size), " "))

        parts = F.flatten(F.array(*(within(s) for s in sizes if s < max(sizes))))
        longer = found.filter(F.size(inner) > min(sizes)).select(F.explode(parts).alias("phrase"), "owners", "who", F.col("phrase").alias("longer")).filter("phrase != longer").select("phrase", "owners", "who").distinct()
        found = found.join(longer, ["phrase", "owners", "who"], "left_anti")
    return found.select("phrase", "owners", *(["example"] if example else []))
