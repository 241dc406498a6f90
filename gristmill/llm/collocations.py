"""Phrase collocations by count tries.

A shard's texts (about ``SHARD_BYTES`` of one language) are read into a count trie whose nodes are phrases: a node of
depth d has a parent, its first d - 1 words, and a suffix link, its last d - 1 words.  Within a shard a node is the pair
of its parent's and its link's number, both nodes of depth d - 1, numbered in the order of their phrases; every place of
the text knows the node that begins there.  The trie grows by one depth a round, five at most:

- Each shard counts its nodes of the next depth and hands them over sorted: a row for each stem (a word at depth 2, the
  first d - 2 words below), with what follows it in order and how often.  At depth 2 words that aren't very common are
  packed together, by a hash of theirs, into as many rows as they fill.
- The shards' rows meet in ranges of stems, in order, and are merged: what follows one stem is summed up over all shards.
  A stem that comes up very often is dealt into parts by what follows, so that none is one task's.
- Those that come up often enough go back to the shards as positions in their own rows.  A phrase can't come up more
  often than a part of it, so a next node needs a parent and a link that are both left, and what is dropped is never
  asked for.

On what is left, walking down from the root gives each node the counts of its left parts: its parent's and its parent's
own.  Following suffix links gives those of its right parts.  Both are joins of one depth with the one before.

Counts are whole and exact.  Only shards are bounded, by bytes; no list of words or phrases is broadcast or collected
unless Spark finds its written table small.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import Scratch, materialise, ship

#: Words of a phrase at most, and how often a phrase has to come up.
DEPTH, LEAST = 5, 100
#: Phrases that are returned for each language.
TOP = 2000
#: Bytes of text that a task holds about, over all its languages; a longer text is a shard of its own.
SHARD_BYTES = 24 << 20
#: Languages that a task has open at most.
OPEN_LANGS = 256
#: Occurrences of a stem that one part of what follows it has at most, about.
PART = 1 << 20
#: Words that come up less often are packed at depth 2.
PACKED = PART // 8
#: Groups that a language is dealt into before its best phrases are put together.
DEALT = 256
#: A word that stands for the end of a piece; it can't be in a text, since it is cut there.
BREAK = b"."
#: The characters that end pieces (as BREAK), and the tab as a space.
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")

#: Words of shards, and a row for each shard's places (word null).
WORDS = "shard long, lang string, word string, n long, local int, places binary"
#: Stems and what follows them, in rows of shards, and a row for each shard's state (stem null).
TRIES = "shard long, lang string, stem string, part int, base int, follows string, counts binary, places binary, phrases string, weights binary"
#: Nodes that are left (lang, phrase, a), and where shards have them (shard, at, weights).
MERGED = "lang string, phrase string, a long, shard long, at binary, weights binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(ddl: str, rows: int, **columns: object) -> pa.RecordBatch:
    """Rows of a schema; columns that aren't given are null, single values are repeated."""
    fields = [f.split(" ") for f in ddl.split(", ")]

    def column(name: str, kind: pa.DataType) -> pa.Array:
        value = columns.get(name)
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if isinstance(value, (pa.Array, np.ndarray)):
            return (value if isinstance(value, pa.Array) else pa.array(value)).cast(kind)
        return pa.nulls(rows, kind) if value is None else pa.array([value] * rows, kind)

    return pa.RecordBatch.from_arrays([column(n, _KINDS[k]) for n, k in fields], names=[n for n, _ in fields])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed byte plane by byte plane, after their length."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    data = pa.compress(planes, codec="zstd", asbytes=True)
    return len(planes).to_bytes(8, "little") + len(data).to_bytes(8, "little") + data


def _of_planes(data: bytes) -> tuple[np.ndarray, bytes]:
    """The numbers, and the bytes after them."""
    n, held = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    planes = np.frombuffer(pa.decompress(data[16 : 16 + held], decompressed_size=n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64), data[16 + held :]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from -1 on: first which they are, the most common first, then their places in that list."""
    counts = np.bincount(numbers + 1)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.int64)
    rank[order] = np.arange(len(order))
    return _planes(order) + _planes(rank[numbers + 1])


def _unpacked(data: bytes) -> np.ndarray:
    order, rest = _of_planes(data)
    places, _ = _of_planes(rest)
    return order[places] - 1


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Words of one language's texts, numbered; pieces end with BREAK."""

    def __init__(self) -> None:
        self.held, self.numbers, self.places = 0, _Numbers({BREAK: 0}), [np.zeros(1, np.int32)]

    def add(self, text: str) -> None:
        data = text.encode().lower().translate(CUTS).replace(BREAK, b" " + BREAK + b" ")  # bytes.lower is that of A-Z
        words = [w for w in data.split(b" ") if w]
        self.held += len(data)
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.places.append(self.places[0])

    def nodes(self) -> tuple[np.ndarray, list[bytes]]:
        """The word that begins at each place, -1 at ends of pieces, and the words as they were numbered."""
        return np.concatenate(self.places).astype(np.int64) - 1, list(self.numbers)[1:]


def words(docs: DataFrame) -> DataFrame:
    """Depth 1 of each shard's trie: rows of words, and one of its places.

    Numbers of shards are those of partitions, so the table has to be written before it is read twice.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = itertools.count(TaskContext.get().partitionId() << 32)
        open_: dict[str, _Shard] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            places, met = open_.pop(lang).nodes()
            shard, n = next(counter), len(met)
            counts = np.bincount(places[places >= 0], minlength=n)
            spelled = pa.array(met, pa.binary()).cast(pa.string())
            order = pc.sort_indices(spelled)
            yield _batch(WORDS, n, shard=shard, lang=lang, word=spelled.take(order), n=counts[order.to_numpy()], local=order)
            yield _batch(WORDS, 1, shard=shard, lang=lang, places=_packed(places))

        held = 0
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_.setdefault(lang, _Shard())
                before = shard.held
                shard.add(text)
                held += shard.held - before + 64
                if held > SHARD_BYTES:
                    largest = max(open_, key=lambda x: open_[x].held)
                    held -= open_[largest].held
                    yield from close(largest)
                if len(open_) > OPEN_LANGS or held > SHARD_BYTES:  # many languages, or many short texts
                    for other in list(open_):
                        yield from close(other)
                    held = 0
        for lang in list(open_):
            yield from close(lang)

    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, WORDS)


def _hashes(texts: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) for t in texts.to_pylist()], np.int64)


def _last_words(phrases: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(phrases, r"(?s)^.* ", "")


class _Level:
    """A shard's live nodes of one depth: at each place, their phrases in order, their occurrences over all shards.

    :param loads: occurrences of each node's stem.
    :param packs: into how many parts the packed words of the language are dealt.
    """

    def __init__(self, places: np.ndarray, phrases: pa.Array, weights: np.ndarray, loads: np.ndarray | None = None, packs: int = 1) -> None:
        self.places, self.phrases, self.weights, self.packs = places, phrases, weights, packs
        self.loads = weights if loads is None else loads
        self.ends = _last_words(phrases)

    def packed(self) -> np.ndarray:
        """Which nodes are words that are packed, with the empty stem."""
        return ~pc.match_substring(self.phrases, " ").to_numpy(zero_copy_only=False) & (self.weights < PACKED)

    def stems(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The stem of each node's children, numbered in order, its phrase, and what stands before a child's last word."""
        packed = self.packed()
        whole = pc.or_(pc.match_substring(self.phrases, " "), pa.array(packed))
        stems = pc.if_else(pa.array(packed), "", pc.replace_substring_regex(self.phrases, r"(?s) [^ ]*$", ""))
        before = pc.if_else(whole, pc.binary_join_element_wise(self.ends, "", " "), "")
        changed = pc.not_equal(stems[1:], stems[:-1]).to_numpy(zero_copy_only=False) if len(stems) else np.zeros(0, bool)
        return np.where(packed, -1, np.append(0, np.cumsum(changed))[: len(stems)]), stems, before

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """parent, link, part, count and what follows the stem, of the nodes one deeper, in order of stem and part."""
        if len(self.places) < 2:
            none = np.zeros(0, np.int64)
            return none, none, none, none, pa.array([], pa.string())
        both = np.flatnonzero((self.places[:-1] >= 0) & (self.places[1:] >= 0))
        found, counts = np.unique(self.places[both] << 32 | self.places[both + 1], return_counts=True)
        parent, link = found >> 32, found & 0xFFFFFFFF
        group, _, before = self.stems()
        follows = pc.binary_join_element_wise(before.take(pa.array(parent)), self.ends.take(pa.array(link)), "")
        packed = self.packed()
        parts, part = np.where(packed, 0, 1 + self.loads // PART)[parent], np.zeros(len(parent), np.int64)
        many = np.flatnonzero(parts > 1)
        part[many] = _hashes(follows.take(pa.array(many))) % parts[many]
        own = np.zeros(len(self.phrases), np.int64)
        own[packed] = _hashes(self.phrases.filter(pa.array(packed))) % self.packs
        part = np.where(packed[parent], own[parent], part)
        if len(parent):
            order = np.lexsort((link, parent, part, group[parent]))
            parent, link, part, counts, follows = parent[order], link[order], part[order], counts[order], follows.take(pa.array(order))
        return parent, link, part, counts, follows

    def deeper(self, at: np.ndarray, weights: np.ndarray) -> _Level:
        """The nodes one deeper that are left, by their positions in ``pairs``."""
        parent, link, _, _, _ = self.pairs()
        keys = parent[at] << 32 | link[at]
        order = np.argsort(keys)  # of parent and link, so of phrases
        keys, weights = keys[order], weights[order]
        parent, link = keys >> 32, keys & 0xFFFFFFFF
        phrases = pc.binary_join_element_wise(self.phrases.take(pa.array(parent)), self.ends.take(pa.array(link)), " ")
        if not len(keys):
            return _Level(np.full(max(0, len(self.places) - 1), -1, np.int64), phrases, weights)
        pair = self.places[:-1] << 32 | self.places[1:]
        near = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        places = np.where((self.places[:-1] >= 0) & (self.places[1:] >= 0) & (keys[near] == pair), near, -1)
        return _Level(places, phrases, weights, self.weights[parent], self.packs)

    def rows(self, shard: int, lang: str) -> pa.Table:
        """Its own state, and what follows each stem."""
        parent, _, part, counts, follows = self.pairs()
        group, stems, _ = self.stems()
        of = group[parent]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1]))) if len(parent) else np.zeros(0, np.int64)
        offsets = np.append(first, len(parent)).astype(np.int32)
        n = len(first)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), follows), "\n")
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets * 4), pa.py_buffer(counts.astype("<u4").tobytes())])
        numbers = np.concatenate([[self.packs], self.weights, self.loads]).astype("<i8").tobytes()
        own = _batch(TRIES, 1, shard=shard, lang=lang, places=_packed(self.places), phrases="\n".join(self.phrases.to_pylist()), weights=numbers)
        below = _batch(TRIES, n, shard=shard, lang=lang, stem=stems.take(pa.array(parent[first])), part=part[first], base=first, follows=joined, counts=blobs)
        return pa.Table.from_batches([own, below])


def _nothing() -> pa.Table:
    return pa.Table.from_batches([_batch(TRIES, 0)])


def _from_words(own: pa.Table, left: pa.Table) -> pa.Table:
    """Depth 1 with the words that are left (local, word, a), and the nodes of depth 2."""
    if not own.num_rows or not left.num_rows:
        return _nothing()
    met = left.column("word").combine_chunks()
    order = pc.sort_indices(met)
    places, local = _unpacked(own.column("places")[0].as_py()), left.column("local").to_numpy()[order.to_numpy()]
    rank = np.full(max(places.max(initial=0), local.max(initial=0)) + 2, -1, np.int64)
    rank[local] = np.arange(len(local))  # the last entry stands for -1
    level = _Level(rank[places], met.take(order), left.column("a").to_numpy()[order.to_numpy()], packs=own.column("packs")[0].as_py())
    return level.rows(own.column("shard")[0].as_py(), own.column("lang")[0].as_py())


def _from_state(own: pa.Table, left: pa.Table) -> pa.Table:
    """The next depth with the nodes that are left (at, weights), and those one deeper."""
    if not own.num_rows or not left.num_rows:
        return _nothing()
    numbers = np.frombuffer(own.column("weights")[0].as_py(), "<i8").astype(np.int64)
    weights, loads = numbers[1:].reshape(2, -1)
    above = _Level(_unpacked(own.column("places")[0].as_py()), pa.array(own.column("phrases")[0].as_py().split("\n")), weights, loads, int(numbers[0]))
    at, weights = (np.frombuffer(b"".join(left.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("at", "<u4"), ("weights", "<i8")))
    return above.deeper(at, weights).rows(own.column("shard")[0].as_py(), own.column("lang")[0].as_py())


def _sums(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """What follows whole stems, summed up over shards: nodes that are left, and where shards have them."""
    same = np.ones(max(0, rows.num_rows - 1), bool)
    for name in ("lang", "stem", "part"):
        column = rows.column(name).combine_chunks()
        same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    group = np.append(0, np.cumsum(~same))
    lists = pc.split_pattern(rows.column("follows").combine_chunks(), "\n")
    lengths = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(rows.num_rows), lengths)
    coded = lists.flatten().dictionary_encode()
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4")
    keys, which = np.unique(group[row] * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, which, counts.astype(np.int64))
    kept = np.flatnonzero(sums >= least)
    if not len(kept):
        return
    first = np.flatnonzero(np.append(True, ~same))
    of, code = first[keys[kept] // len(coded.dictionary)], pa.array(keys[kept] % len(coded.dictionary))
    stem = rows.column("stem").combine_chunks().take(pa.array(of))
    between = pc.if_else(pc.equal(stem, ""), "", " ")  # packed words have the empty stem
    phrase = pc.binary_join_element_wise(pc.binary_join_element_wise(stem, between, ""), coded.dictionary.take(code), "")
    yield _batch(MERGED, len(kept), lang=rows.column("lang").combine_chunks().take(pa.array(of)), phrase=phrase, a=sums[kept])
    live = np.flatnonzero(sums[which] >= least)
    begins = np.append(0, np.cumsum(lengths))
    at = rows.column("base").to_numpy()[row[live]] + live - begins[row[live]]
    shard = rows.column("shard").to_numpy()[row[live]]
    order = np.argsort(shard, kind="stable")
    shard, at, weights = shard[order], at[order].astype("<u4"), sums[which[live]][order].astype("<i8")
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    offsets = np.append(starts, len(shard)).astype(np.int32)
    blob = lambda x, width: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets * width), pa.py_buffer(x.tobytes())])
    yield _batch(MERGED, len(starts), shard=shard[starts], at=blob(at, 4), weights=blob(weights, 8))


def _merge(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges rows that come in order of lang, stem and part; a group's rows are held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda b, i: tuple(b.column(c)[i].as_py() for c in (1, 2, 3))
            last, cut = key(batch, batch.num_rows - 1), batch.num_rows - 1
            low = 0  # the first row of the last group
            while low < cut:
                mid = (low + cut) // 2
                low, cut = (low, mid) if key(batch, mid) == last else (mid + 1, cut)
            if low:
                yield from _sums(pa.Table.from_batches([*held, batch.slice(0, low)]), least)
                held = [batch.slice(low)]
            elif held and key(held[-1], held[-1].num_rows - 1) != last:
                yield from _sums(pa.Table.from_batches(held), least)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from _sums(pa.Table.from_batches(held), least)

    return run


def merged(tries: DataFrame, least: int) -> DataFrame:
    """Shards' rows brought together in ranges of stems and merged in order."""
    rows = tries.filter("stem IS NOT NULL").select("shard", "lang", "stem", "part", "base", "follows", "counts")
    by = ["lang", "stem", "part"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_merge(least), MERGED)


def phrases(docs: DataFrame, keep: Scratch, depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """Word occurrences (lang, n), and for each depth the phrases that come up ``least`` times or more.

    A phrase's row has lang, phrase, a, lefts (counts of its first 1, 2, ... words) and rights (of what follows these).
    """
    read = keep(words(docs), "words")
    met = read.filter("word IS NOT NULL").select("shard", "lang", "word", "n", "local")
    sizes = keep(met.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    # a word has a row for each shard at most
    often = met.withColumn("a", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("a") >= least)
    left = keep(often.select("shard", "lang", "word", "a", "local"), "left1")
    none = F.array().cast("array<bigint>")
    first = left.groupBy("lang", F.col("word").alias("phrase")).agg(F.max("a").alias("a"))
    levels = [keep(first.select("lang", "phrase", "a", none.alias("lefts"), none.alias("rights")), "phrases1")]
    # how many parts the packed words fill: a number for each language
    packs = keep(levels[0].filter(F.col("a") < PACKED).groupBy("lang").agg(F.ceil(F.sum("a") / (PART // 2)).cast("long").alias("packs")), "packs")
    state = read.filter("word IS NULL").join(packs, "lang", "left").select("shard", "lang", "places", F.coalesce("packs", F.lit(1)).alias("packs"))
    dealt = left.select(F.col("shard").alias("of"), "word", "a", "local")
    tries = keep(state.groupBy("shard").cogroup(dealt.groupBy("of")).applyInArrow(_from_words, TRIES), "tries2")
    keep.drop(read, left, packs)
    for d in range(2, depth + 1):
        found = keep(merged(tries, least), f"merged{d}")
        parent = F.expr("left(phrase, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
        link = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
        above = levels[-1]
        up = above.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("a")).alias("lefts"))
        across = above.select("lang", F.col("phrase").alias("link"), F.concat(F.array("a"), "rights").alias("rights"))
        nodes = found.filter("shard IS NULL").select("lang", "phrase", "a", parent.alias("parent"), link.alias("link"))
        levels.append(keep(nodes.join(up, ["lang", "parent"]).join(across, ["lang", "link"]).select("lang", "phrase", "a", "lefts", "rights", "parent", "link"), f"phrases{d}"))
        if d < depth:
            state = tries.filter("stem IS NULL").select("shard", "lang", "places", "phrases", "weights")
            left = found.filter("shard IS NOT NULL").select(F.col("shard").alias("of"), "at", "weights")
            deeper = keep(state.groupBy("shard").cogroup(left.groupBy("of")).applyInArrow(_from_state, TRIES), f"tries{d + 1}")
            keep.drop(tries, found)
            tries = deeper
        else:
            keep.drop(tries, found)
    return sizes, levels


def scored(sizes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Candidates that no longer one makes needless, with their lowest-scoring cut: lang, phrase, a, l, r, n, score.

    A longer phrase that comes up as often as a part of it has, between the two, phrases that do as well; so the phrases
    one word longer tell all.  Products are decimals of 38 digits: exact for corpora up to 10^17 words.
    """
    out = []
    for d, level in enumerate(levels[1:], 2):
        rows = level.select("lang", "phrase", "a", "lefts", "rights")
        if d < len(levels):
            longer = levels[d]
            inside = longer.select("lang", F.explode(F.array("parent", "link")).alias("phrase"), F.col("a").alias("most"))
            rows = rows.join(inside.groupBy("lang", "phrase").agg(F.max("most").alias("most")), ["lang", "phrase"], "left")
            rows = rows.filter("most IS NULL OR 100 * most < 100 * a").drop("most")
        rows = rows.join(sizes, "lang")
        # cut k has rights[k - 1]: its right part is what follows the first k words
        cuts = F.expr(f"""transform(lefts, (l, i) -> struct(
            (CAST(1000 * a AS decimal(20,0)) * CAST(n AS decimal(18,0))) div (CAST(l AS decimal(18,0)) * CAST(rights[i] AS decimal(18,0))) AS score, i AS k, l AS l, rights[i] AS r))""")
        out.append(rows.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` by score, then a, descending, then phrase in order of its bytes, with their rank.

    The best of each of ``DEALT`` groups come first, so no task sorts a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = TOP, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """The phrases of each language whose words come up together most often for their own frequencies.

    :param docs: text, lang; other columns may be there and are not looked at.
    :param depth: words of a phrase at most, 2 or more.
    :return: lang, rank, phrase, a (its occurrences), l and r (those of the parts of its lowest-scoring cut), n (word
        occurrences of the language), score = floor(1000 a n / (l r)).

    Letters A to Z are lower-cased; phrases lie within pieces, which end at any of ``.,;:!?`` and line ends.  A null
    lang is ``und``.  Null and empty texts have no words.  Each of several equal rows counts.  Equal scores are ordered
    by a, then by phrase, so there are no ties.  A language without candidates has no rows.
    """
    with Scratch(docs.sparkSession) as keep:
        return materialise(best(scored(*phrases(docs, keep, depth, least)), top), "collocations")
