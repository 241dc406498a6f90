"""Alignment of two tokenizers by a dictionary of groups.

A text is encoded by both tokenizers.  Where a token of A and a token of B end at the same byte, the text is cut; what
lies between two cuts is a *group*: some A ids and some B ids over the same bytes, written ``a1,a2|b1``.  Of a group's
tokens only the last of A and the last of B end together (no token is empty), so a group gives one link.

*Interning.*  Texts are taken in blocks.  A block numbers its distinct groups and keeps, for each text, the numbers and
how often each comes up; the rows of its dictionary say how often a group comes up in the block and in how many of its
texts.  Only these rows, not the occurrences, are exchanged.

*Expanding.*  Blocks' rows are summed up by group.  Each distinct group is expanded to its link once; the link counts by
the group's frequency.

*Joining back.*  Each group gets its link's count, and whether that is the highest of its B id.  A block's rows get
theirs by group, and each block is put together again with its own dictionary's figures.

All exchanges are joins or sums that Spark splits; a block is bounded by its texts.  Tokenizer files (a few MB) are the
only broadcasts.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gristmill.session import Scratch, materialise, ship

#: Bytes of text, and distinct groups, that a block holds about; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_GROUPS = 16 << 20, 1_000_000
#: Characters of text that are encoded at a time.
STEP_CHARS = 1 << 19
#: How byte-level files split texts (the pattern is part of the tokenizer), where they say ``use_regex``.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts whose characters are all below are split alike by any version of the Unicode tables since 7.0.
SETTLED = "԰"


def byte_alphabet() -> dict[str, int]:
    """Byte-level spelling: printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library.

    Where its ids are those of its merges, texts of settled characters are encoded from the same vocabulary by tiktoken,
    which is faster; others by the library itself.
    """

    def __init__(self, definition: str) -> None:
        self.slow = Tokenizer.from_str(definition)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        read, spelled = byte_alphabet(), json.loads(definition)
        self.bytes: list[bytes] = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            self.bytes[i] = bytes(map(read.__getitem__, token)) if all(c in read for c in token) else token.encode()
        model, split = spelled["model"], spelled["pre_tokenizer"] or {}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
        in_order = all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merges)) and all(len(self.bytes[i]) == 1 for i in range(256))
        known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spelled["normalizer"]
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if in_order and known else None

    def encode(self, text: str) -> list[int]:
        if self.fast and max(text, default="") < SETTLED:
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: a sentencepiece model.  It puts a space before the text itself."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        spell = self.processor.id_to_piece
        self.bytes = [bytes([int(spell(i)[1:-1], 16)]) if self.processor.is_byte(i) else spell(i).replace("▁", " ").encode() for i in range(self.processor.vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, and the spelling of groups."""

    def __init__(self, definition: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(definition), Pieces(model)
        if not all(self.a.bytes) or not all(self.b.bytes):
            raise ValueError("a token without bytes would end where the one before it ends")
        self.lengths = [np.array(list(map(len, x.bytes))) for x in (self.a, self.b)]
        n, m = len(self.a.bytes), len(self.b.bytes)
        #: what each token adds to the spelling: A within and at the end of its side, then B likewise
        self.spelled = [f"{i}{end}" for ids, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(ids)]
        self.starts = (0, n, 2 * n, 2 * n + m)

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A and B ids of each text; none where either doesn't spell out a space and the text."""
        for text, b in zip(texts, self.b.encode(texts), strict=True):
            spaced = f" {text}"
            data = spaced.encode()
            if text and b"".join(map(self.b.bytes.__getitem__, b)) == data:
                a = self.a.encode(spaced)
                if b"".join(map(self.a.bytes.__getitem__, a)) == data:
                    yield a, b
                    continue
            yield [], []

    def spell(self, a: list[int], b: list[int]) -> str:
        """All groups in order, ``a1,a2|b1;a3|b2,b3``."""
        if not a:
            return ""
        x, y = np.array(a), np.array(b)
        ends = np.cumsum(self.lengths[0][x]), np.cumsum(self.lengths[1][y])
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        before = np.searchsorted(group[1], group[0]), np.searchsorted(group[0], group[1], "right")  # tokens of the other side
        codes = np.empty(len(x) + len(y), np.int64)
        codes[np.arange(len(x)) + before[0]] = x + np.where(last[0], self.starts[1], self.starts[0])
        codes[np.arange(len(y)) + before[1]] = y + np.where(last[1], self.starts[3], self.starts[2])
        return "".join(map(self.spelled.__getitem__, codes.tolist()))[:-1]


_aligners: dict[str, Aligner] = {}


def aligner(definition: str, model: bytes) -> Aligner:
    """The tables, once for each worker process."""
    key = hashlib.sha1(definition.encode() + model).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(definition, model)
    return _aligners[key]


def _steps(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of at most STEP_CHARS, or of one text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > STEP_CHARS:
            yield slice(first, i)
            first, held = i, 0
        held += len(text)
    if texts:
        yield slice(first, len(texts))


def _shared(docs: DataFrame, a: str, b: str) -> tuple:
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    return context.broadcast(Path(a).read_text(encoding="utf-8")), context.broadcast(Path(b).read_bytes())


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``docs`` with ``groups``: the aligned groups of its text in order, ``a1,a2|b1;a3|b2,b3``.

    :param a: a byte-level BPE file of the tokenizers library.
    :param b: a sentencepiece model that puts a space before texts.

    Null and empty texts, and those that the tokenizers don't spell out byte for byte, have ''.  A column ``groups`` of
    ``docs`` is replaced.
    """
    definition, model = _shared(docs, a, b)
    kept = [c for c in docs.columns if c != "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(definition.value, model.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            for part in _steps(texts):
                spelled = [both.spell(*ids) for ids in both.tokens(texts[part])]
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), pa.array(spelled, pa.string())], names=[*kept, "groups"])

    schema = T.StructType([docs.schema[c] for c in kept]).add("groups", "string")
    return docs.select(*(f"`{c}`" for c in kept), F.col("text").alias("aligned text")).mapInArrow(run, schema)


class _Block:
    """Texts that share a dictionary of groups."""

    def __init__(self, number: int) -> None:
        self.number, self.held = number, 0
        self.known: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.keys: list[pa.Array] = []

    def add(self, a: list[int], b: list[int], spelled: str) -> None:
        listed = spelled.split(";") if spelled else []
        counts, known = Counter(listed), self.known
        ids = [known.setdefault(g, len(known)) for g in counts]
        digest = hashlib.sha256(spelled.encode()).hexdigest() if listed else ""
        self.rows.append((len(a), len(b), len(listed), digest, np.array(ids, np.int32), np.array(list(counts.values()), np.int32)))

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The texts' rows, then the dictionary's."""
        ids = np.concatenate([r[4] for r in self.rows])
        times = np.concatenate([r[5] for r in self.rows])
        ends = np.cumsum([0, *(len(r[4]) for r in self.rows)]).astype(np.int32)
        held = [pa.array(column) for column in zip(*(r[:4] for r in self.rows), strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, times)]
        yield self._batch(schema, len(self.rows), dict(zip(("doc_id", "n_a", "n_b", "n_groups", "sha", "ids", "times"), [pa.concat_arrays(self.keys), *held, *lists], strict=True)))
        n = len(self.known)
        if n:
            total = np.zeros(n, np.int64)
            np.add.at(total, ids, times)
            yield self._batch(schema, n, {"local": pa.array(np.arange(n, dtype=np.int32)), "group": pa.array(list(self.known)), "n": pa.array(total), "texts": pa.array(np.bincount(ids, minlength=n))})

    def _batch(self, schema: pa.Schema, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(rows, self.number, np.int64))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def interned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks: a row for each text (doc_id, n_a, n_b, n_groups, sha, ids, times) and one for each distinct group of a
    block (local, group, n, texts), told apart by ``group`` being null.

    The numbers of blocks are those of partitions, so the table has to be written before it is read twice.
    """
    definition, model = _shared(docs, a, b)
    fields = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    fields = T.StructType(fields.fields + T.StructType.fromDDL("n_a long, n_b long, n_groups long, sha string, ids array<int>, times array<int>, local int, group string, n long, texts long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(definition.value, model.value)
        first, schema = TaskContext.get().partitionId() << 32, None
        counter = itertools.count(first)
        block = _Block(next(counter))
        for batch in batches:
            if schema is None:
                own = {"block": pa.int64(), "doc_id": batch.column(0).type, "sha": pa.string(), "group": pa.string(), "ids": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "local": pa.int32()}
                schema = pa.schema([(name, own.get(name, pa.int64())) for name in fields.names])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _steps(texts):
                for ids in both.tokens(texts[part]):
                    block.add(*ids, both.spell(*ids))
                block.keys.append(batch.column(0).slice(part.start, part.stop - part.start))
                block.held += sum(map(len, texts[part]))
                if block.held > BLOCK_BYTES or len(block.known) > BLOCK_GROUPS:
                    yield from block.batches(schema)
                    block = _Block(next(counter))
        if block.rows:
            yield from block.batches(schema)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def dictionary(blocks: DataFrame) -> DataFrame:
    """Distinct groups of all blocks: group, a and b (its link), n (how often it comes up), texts (in how many)."""
    rows = blocks.filter("group IS NOT NULL").groupBy("group").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))

    def last(side: int) -> F.Column:
        return F.substring_index(F.substring_index("group", "|", side), ",", -1).cast("int")

    return rows.select("group", last(1).alias("a"), last(-1).alias("b"), "n", "texts")


def links(known: DataFrame) -> DataFrame:
    """Linked ids of a dictionary: a, b, count, best (no other A id has a higher count with this B id)."""
    pairs = known.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))  # at most A's vocabulary


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Figures of the alignment of every text.

    :param docs: doc_id, text; other columns may be there and are not looked at.
    :return: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their B id's highest, ties included),
        count_sum (counts of its links), groups_sha256: a row for each row of ``docs``.

    Null and empty texts, and those that either tokenizer doesn't spell out byte for byte, have zeros and ''.  Each of
    several equal rows counts.  A count is that of an id pair over all texts.
    """
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        blocks = keep(interned(docs, a, b), "blocks")
        known = keep(dictionary(blocks), "groups")
        valued = known.join(links(known), ["a", "b"]).select("group", F.col("count").alias("value"), "best")
        figures = blocks.filter("group IS NOT NULL").select("block", "local", "group").join(valued, "group").select(F.col("block").alias("of"), "local", "value", "best")
        texts = blocks.filter("group IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "sha", "ids", "times")
        out = T.StructType([docs.schema["doc_id"]])
        for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
            out = out.add(name, "long")
        out = out.add("groups_sha256", "string")

        def together(own: pa.Table, found: pa.Table) -> pa.Table:
            value, best = np.zeros((2, found.num_rows), np.int64)
            at = found.column("local").to_numpy()
            value[at], best[at] = found.column("value").to_numpy(), found.column("best").to_numpy()
            ids, times = own.column("ids").combine_chunks(), own.column("times").combine_chunks()
            flat, n = ids.flatten().to_numpy(), times.flatten().to_numpy()
            ends = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))

            def summed(x: np.ndarray) -> pa.Array:
                sums = np.append(0, np.cumsum(x))
                return pa.array(sums[ends[1:]] - sums[ends[:-1]])

            columns = [own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
            return pa.table([*columns, summed(n * best[flat]), summed(n * value[flat]), own.column("sha")], names=out.names)

        joined = texts.groupBy("block").cogroup(figures.groupBy("of")).applyInArrow(together, out)
        return materialise(joined, "aligned")
