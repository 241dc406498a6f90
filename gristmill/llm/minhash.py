"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

*Sketch.*  Each shingle set fills ``bands * rows`` coordinates in rounds.  In round i below the number of
coordinates every shingle is thrown into one coordinate by a fresh hash and leaves its value, later rounds losing to
earlier ones; in the following rounds coordinate i takes the least hash of all shingles.  So every coordinate fills,
two sets agree in a coordinate with a probability equal to their similarity, and the count of agreements is
concentrated about its mean.  Most sets are full after the few first rounds.

*Banding.*  Sets that agree in all rows of a band share a bucket.  With 40 bands of 8 rows a pair of similarity 0.85
is missed with a probability of 3e-6, and a pair of similarity 0.5 is met with one of 0.14.

*Verification.*  Documents with equal sets are one class from the start, so that copies cost nothing further.  Small
buckets give all pairs of their classes that may be linked by their sizes and, later on, by their parity bits: two sets
differ in at least as many shingles as the XORs of their shingles' places do in bits.  A large bucket never does.  Its members are compared with a reference set R,
the shingles that most of a sample of them have (any R gives the same links, a good one less work).  Let S be the
shingles in which a member x differs from R, own ones and missing ones told apart.  The difference of two members has
|S_x| + |S_y| - 2 |S_x & S_y| shingles, so with slack_x = (100 + percent) |S_x| - (100 - percent) |x| two members are
linked exactly if

    slack_x + slack_y <= 2 (100 + percent) |S_x & S_y|.

Let c be the member with the least slack.  Hence

- x with slack_x + slack_c <= 0 is linked with c; any two members that are linked without a common element of S are;
- another x needs (slack_x + slack_c) / (2 (100 + percent)) elements of S in common with any partner, and, since two linked sets
  x and y differ in at most (100 - percent) / (100 + percent) (|x| + |y|) shingles, |S_x| less that many of them; so does a member of the first kind, with the
  least slack of the others in the place of slack_c.

So a prefix of S is posted as in prefix filtering, the elements that fewest members have first.  Postings with two
members or more are buckets again, and go the same way, small or large, each with a reference set of its own.  An
element that all members have outside R is none, since R would hold it; so every bucket is smaller than the one it
comes from, and the rounds end.  What lies within one part (members known to be linked through one c) is left alone.
This loses no link between components that a shared bucket has shown, and no group is ever gathered.  All links hold
for the full sets.

Components are found by alternating large-star and small-star steps over the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.shingles import WIDTH, mix, shingle_sets, text_chunks
from gristmill.session import Scratch, materialise, ship

PERCENT = 85
BANDS, ROWS = 40, 8
#: Buckets up to this size give all their pairs; larger ones go through their reference set.
SMALL_BUCKET = 12
#: The same for buckets of shared elements, whose pairs are tested by parity bits first.
SMALL_LATER = 256
#: Parity bits of a set, in words of 64.
PARITY_WORDS = 4
#: Members of a bucket, about, from which its reference set is taken.  It decides on work, never on links.
REFERENCE_MEMBERS = 32
#: Members of a reference set, about, that one part of a join by reference set takes.
PART_MEMBERS = 64
#: Parts into which the join of members with their buckets deals each bucket.
BUCKET_PARTS = 8
#: Bits that tell apart, before texts are exchanged, most of those whose sets aren't wanted; in pieces of BITMAP bits, 2 MB in all.
FILTER_BITS, BITMAP = 1 << 24, 1 << 15
#: Rounds after which something must be wrong: sizes of buckets fall in each.
MOST_ROUNDS = 60

_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FULL = np.uint64(2**64 - 1)


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit values; ``size`` coordinates, at most 2048."""
    out = np.full(size, _FULL, np.uint64)
    at, n = 0, len(shingles)
    while at < 2 * size:
        # several rounds in one pass where the set is small
        rounds = np.arange(at, min(2 * size, at + max(1, 2 * size // n)))
        values = mix(shingles[None, :] + _SEEDS[rounds, None])
        low = (values & np.uint64(0xFFFFFFFF)) | (rounds.astype(np.uint64) << np.uint64(32))[:, None]
        bins = ((values >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        late = rounds >= size
        if late.any():
            bins[late] = (rounds[late] - size).astype(np.uint64)[:, None]
        np.minimum.at(out, bins.ravel().astype(np.intp), low.ravel())
        at = int(rounds[-1]) + 1
        if not (out == _FULL).any():
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    grid = mix(coordinates.reshape(bands, rows) + _SEEDS[None, :rows])
    return mix((grid * (_SEEDS[None, rows : 2 * rows] | np.uint64(1))).sum(axis=1, dtype=np.uint64) + _SEEDS[100 : 100 + bands]).view(np.int64)


def set_class(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit digests of a set, a class and its check; none for the empty set."""
    if not len(shingles):
        return None, None
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class with its check, and band keys of each document (null where a copy has them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # one row of each class is enough to carry its keys
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                classes = [set_class(s) for s in sets]
                keys = []
                for (own, _), s in zip(classes, sets, strict=True):
                    if own is None:
                        keys.append(None)
                        continue
                    if own in done:
                        keys.append(None)
                        continue
                    if len(done) > 1 << 20:
                        done.clear()
                    done.add(own)
                    keys.append(band_keys(sketch(s, bands * rows), bands, rows))
                columns = [
                    batch.column("doc_id").slice(at, end - at),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([c for c, _ in classes], pa.int64()),
                    pa.array([c for _, c in classes], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "cls", "check", "keys"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_shingles", "long").add("cls", "long").add("check", "long").add("keys", T.ArrayType(T.LongType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall in each of 64 * PARITY_WORDS places."""
    places = (shingles >> np.uint64(40)) % np.uint64(64 * PARITY_WORDS)
    return np.packbits((np.bincount(places.astype(np.intp), minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """cls, set and parity bits of each document that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                sets = [s for s in shingle_sets(data, offsets, width) if len(s)]
                ends = np.cumsum([0, *map(len, sets)])
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                bits = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([set_class(s)[0] for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), bits], names=["cls", "set", "bits"])

    return docs.select("text").mapInArrow(run, "cls bigint, set array<bigint>, bits array<bigint>")


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    """percent of the union at least, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs within each bucket that are in different parts and whose sizes, and parity bits if there, allow a link."""
    tested = "bits" in members.columns
    lists = members.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "part", *(["bits"] if tested else [])))).alias("all"))
    firsts = lists.select(F.posexplode("all").alias("at", "x"), "all")

    def possible(x: Column, y: Column) -> Column:
        out = (x["part"] != y["part"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
        if tested:
            differ = reduce(Column.__add__, (F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(PARITY_WORDS)))
            out = out & ((100 + percent) * differ <= (100 - percent) * (x["n"] + y["n"]))
        return out

    partners = F.filter(F.slice("all", F.col("at") + 2, F.size("all")), lambda y: possible(F.col("x"), y))
    pairs = firsts.select("x", F.explode(partners).alias("y"))
    return pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).filter("a != b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are linked."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    return both.filter(_linked(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _open_members(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one part, with the bucket's size; of buckets with equal members one.

    The join deals each bucket into some parts, so that a very large one isn't one task's.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), (F.min("part") != F.max("part")).alias("open"), F.bit_xor(F.xxhash64("cls")).alias("who")).filter("open")
    kept = sizes.groupBy("size", "who").agg(F.min("bucket").alias("bucket")).drop("who")
    spread = kept.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_PARTS - 1))))
    return members.withColumn("part_no", F.pmod(F.xxhash64("cls"), F.lit(BUCKET_PARTS)).cast("int")).join(spread, ["bucket", "part_no"]).drop("part_no")


def _placed(large: DataFrame, share: bool) -> DataFrame:
    """ref, ref_size, cls, n, part: which reference set each member of a large bucket is compared with.

    With ``share``, in the first round, a bucket takes that of the largest bucket that any of its members is in, so that the fragments of
    one group are compared with one set.
    """
    if not share:
        return large.select(F.col("bucket").alias("ref"), F.col("size").alias("ref_size"), "cls", "n", "part")
    best = large.groupBy("cls").agg(F.max(F.struct("size", "bucket")).alias("best"))
    refs = large.join(best, "cls").groupBy("bucket").agg(F.max("best").alias("ref"))
    met = large.join(refs, "bucket")
    return met.groupBy(F.col("ref.bucket").alias("ref"), F.col("ref.size").alias("ref_size"), "cls").agg(F.first("n").alias("n"), F.min("part").alias("part"))


def _with_ref(members: DataFrame, by_ref: DataFrame) -> DataFrame:
    """``members`` (ref, ref_size, cls and others) with what ``by_ref`` has for their reference set, null where nothing.

    A reference set of many members is dealt into parts, so no key is one task's.
    """
    parts = 1 + F.floor(F.col("ref_size") / PART_MEMBERS)
    spread = by_ref.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return members.withColumn("part_no", F.pmod(F.xxhash64("cls"), parts)).join(spread, ["ref", "ref_size", "part_no"], "left").drop("part_no")


def _references(placed: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """ref, ref_size and the shingles that most of about REFERENCE_MEMBERS members of that bucket have.

    A bucket's own members tell its set, also where they are themselves compared with that of a larger bucket.
    """
    own = large.select(F.col("bucket").alias("ref"), F.col("size").alias("ref_size"), "cls")
    some = own.filter(F.pmod(F.xxhash64("ref", "cls"), F.col("ref_size")) < REFERENCE_MEMBERS).join(placed.select("ref").distinct(), "ref", "left_semi")
    # the null stands for the member itself
    counted = some.join(sets, "cls").select("ref", "ref_size", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("set"))).alias("e")).groupBy("ref", "ref_size", "e").agg(F.count("*").alias("n"))
    held = counted.groupBy("ref", "ref_size").agg(F.collect_list(F.struct("e", "n")).alias("all"), F.max(F.when(F.col("e").isNull(), F.col("n"))).alias("members"))
    most = F.filter("all", lambda x: x["e"].isNotNull() & (2 * x["n"] > F.col("members")))
    return held.select("ref", "ref_size", F.transform(most, lambda x: x["e"]).alias("ref_set"))


def _differences(placed: DataFrame, references: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """ref, ref_size, cls, n, part, bits, elements (where a member differs from its reference set) and slack."""
    met = _with_ref(placed.join(sets, "cls"), references).withColumn("ref_set", F.coalesce("ref_set", F.array().cast("array<bigint>")))
    missing = F.transform(F.array_except("ref_set", "set"), lambda e: F.bitwise_not(e))
    met = met.select("ref", "ref_size", "cls", "n", "part", "bits", F.sort_array(F.concat(F.array_except("set", "ref_set"), missing)).alias("elements"))
    return met.withColumn("slack", F.lit(100 + percent).cast("long") * F.size("elements") - (100 - percent) * F.col("n"))


def _judged(differences: DataFrame, percent: int) -> DataFrame:
    """``differences`` with centre, where a member is linked with it, and how many elements it has to post."""
    slack = differences.select("ref", "ref_size", "cls", "n", "part", "slack")
    least = slack.groupBy("ref", "ref_size").agg(F.max("n").alias("most"), F.min("slack").alias("least"), F.min_by(F.struct("cls", "part"), F.struct("slack", "cls")).alias("centre"))
    far = _with_ref(slack, least.select("ref", "ref_size", "least")).filter("slack + least > 0").groupBy("ref", "ref_size").agg(F.min("slack").alias("far"))
    met = _with_ref(differences, least.join(far, ["ref", "ref_size"], "left"))
    linked = F.col("slack") + F.col("least") <= 0
    # how much the set of a linked partner, which has at most so many shingles, can differ
    differ = F.floor((100 - percent) * (F.col("n") + F.least(F.col("most"), F.floor(100 * F.col("n") / percent))) / (100 + percent))
    need = F.ceil((F.col("slack") + F.when(linked, F.col("far")).otherwise(F.col("least"))) / (2 * (100 + percent)))
    need = F.greatest(F.lit(1), need, F.size("elements") - differ)
    # without members of the second kind nothing is left to find
    length = F.when(F.col("far").isNull(), 0).otherwise(F.greatest(F.lit(0), F.size("elements") - need + 1))
    return met.select("ref", "cls", "n", F.when(linked, F.col("centre.part")).otherwise(F.col("part")).alias("part"), F.when(linked, F.col("centre.cls")).alias("centre"), "bits", "elements", length.alias("length"))


def _postings(judged: DataFrame) -> DataFrame:
    """bucket, cls, n, part, bits: a bucket for each element that two members or more of a reference set post."""
    every = judged.filter("length > 0").select("ref", "cls", "n", "part", "bits", "length", F.explode("elements").alias("e"))
    shared = every.groupBy("ref", "e").agg(F.count("*").alias("holders"))
    rarest = F.row_number().over(Window.partitionBy("ref", "cls").orderBy("holders", "e"))  # of one member's set
    met = every.join(shared, ["ref", "e"]).withColumn("place", rarest).filter((F.col("place") <= F.col("length")) & (F.col("holders") > 1))
    return met.select(F.xxhash64("ref", "e").alias("bucket"), "cls", "n", "part", "bits")


def links(members: DataFrame, sets: DataFrame, keep: Scratch, percent: int = PERCENT, small: int = SMALL_BUCKET, later: int = SMALL_LATER) -> DataFrame:
    """Verified links between classes.

    :param members: bucket, cls, n (size of the set), part, size: classes in buckets that are open.
    :param sets: cls, set, bits: the full sets of all these classes, with their parity bits.
    :return: a, b: linked classes; a pair may come more than once.
    """
    found: list[DataFrame] = []
    for step in range(MOST_ROUNDS):
        small = small if step == 0 else max(small, later)
        found.append(keep(_verified(_small_pairs(members.filter(F.col("size") <= small), percent), sets, percent), f"pairs{step}"))
        large = members.filter(F.col("size") > small)
        if large.isEmpty():
            keep.drop(members)
            return reduce(DataFrame.unionByName, found)
        placed = keep(_placed(large, step == 0), f"placed{step}")
        differences = keep(_differences(placed, _references(placed, large, sets), sets, percent), f"differences{step}")
        judged = keep(_judged(differences, percent), f"judged{step}")
        keep.drop(members, placed, differences)
        found.append(keep(judged.filter("centre != cls").select(F.col("centre").alias("a"), F.col("cls").alias("b")), f"centres{step}"))
        members = keep(_open_members(_postings(judged)), f"members{step + 1}")
        keep.drop(judged)
    raise RuntimeError(f"buckets of more than {small} classes after {MOST_ROUNDS} rounds")


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Connected components: cls and root (the component's least class) for every class in ``edges`` (a, b).

    Large-star and small-star steps, each a grouping and a join; a class with very many links is only joined, never
    gathered.
    """
    pairs = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    for step in range(MOST_ROUNDS):
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return pairs.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        state = now
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        after = keep(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), f"edges{step}")
        keep.drop(pairs)
        pairs = after
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose doc_id isn't in ``ids``: a bitmap of hashes, of one size whatever their number.

    A row whose doc_id is there stays, also a null one, so a join after this loses nothing and exchanges fewer texts.
    """

    def hashed(what: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
        return what.withColumns({"slot": F.floor(at / BITMAP), "bit": at % BITMAP})

    bits = hashed(ids).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return hashed(rows).join(F.broadcast(bits), "slot").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, small: int = SMALL_BUCKET, later: int = SMALL_LATER) -> DataFrame:
    """Near-duplicate components of documents.

    :param docs: doc_id, text; other columns are ignored.
    :return: doc_id, n_shingles, component_id (least doc_id of the component), kept (doc_id = component_id): a row
        for each row of ``docs``.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows with equal doc_id count as rows of
    their own.  A row with null doc_id takes part, but names a component only if no member has an id; its kept
    compares null-safely.  Texts are processed whole.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as keep:
        light = keep(_sketched(docs, width, bands, rows), "sketched")
        grouped = light.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys", ignorenulls=True).alias("keys"), (F.min("check") != F.max("check")).alias("mixed"))
        classes = keep(grouped, "classes")
        if not classes.filter("mixed").isEmpty():
            raise ValueError("two different shingle sets have one 64-bit class")  # about one in 2^65 / n^2 corpora of n texts
        members = keep(_open_members(classes.select(F.explode("keys").alias("bucket"), "cls", "n", F.col("cls").alias("part"))), "members0")
        # the sets of classes that share a bucket, made again from one text of each class
        wanted = keep(classes.select("cls", "least").join(members.select("cls").distinct(), "cls", "left_semi"), "wanted")
        ids = wanted.select(F.col("least").alias("doc_id")).distinct()
        texts = _likely(docs.select("doc_id", "text"), ids)
        # no semi-join, which Spark would do first; the ids are distinct
        some = texts.join(ids.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own"))).select("text")
        made = _sets(some, width).join(wanted.select("cls"), "cls", "left_semi")
        # of texts with one id, or without, several may have one class
        sets = keep(made.groupBy("cls").agg(F.first("set").alias("set"), F.first("bits").alias("bits")), "sets")
        roots = components(links(members, sets, keep, percent, small, later), keep)
        named = classes.select("cls", "least").join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
        names = named.groupBy("root").agg(F.min("least").alias("component"))
        labels = named.join(names, "root").select("cls", "component")
        out = light.select("doc_id", "n_shingles", "cls").join(labels, "cls", "left")
        component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return materialise(out, "components")
