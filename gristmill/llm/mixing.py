"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get token targets by weight, none above ``most_epochs`` times its size.  Every source is dealt into shards by
a hash of its documents, and each shard is a stream: its documents in seeded order, once for every epoch, cut into
blocks of ``block`` tokens wherever they fall, the last one shorter.  The blocks that make up the total are given out
by highest quotients target / (2 k + 1): first to the sources, then within each source to its shards by their tokens.
These integer quotas come before any selection.  What a source's quotas are above or below its target, less than a
block for most, is taken off or added to the tokens of its shards, so that sources smaller than a block get theirs.
Then each shard takes its blocks in the order of a seeded hash until it has its tokens, the last one cut, so that
reruns and lost executors give the same blocks.

Only sources and shards, at most ``MOST_SHARDS`` and one for each source, reach the driver; tables of them are broadcast
up to ``MOST_BROADCAST`` rows and joined by a shuffle beyond.  No window spans a source: the running sums are those of
shards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.columns import text_or_empty, words_of
from gristmill.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_EPOCHS = 2
MOST_SHARDS = 1 << 16
#: Rows of a table of sources or shards that are broadcast at most (a few MB).
MOST_BROADCAST = 100_000
#: Documents that a shard holds about, until there are MOST_SHARDS.
SHARD_ROWS = 5000
#: A block has SMALLEST_BLOCK tokens, and more where a shard would have more than BLOCKS of them.
SMALLEST_BLOCK, BLOCKS = 128, 4096


def targets(sizes: Mapping[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most_epochs: int = MOST_EPOCHS) -> dict[str | None, Fraction]:
    """Tokens that each source should give.

    Sources by code point, null last, weigh ``weights``, repeating.  What a source can't give, being above
    ``most_epochs`` times its size, goes to the others by weight until none is above.  Exact fractions.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())) * share, set(order), {s: Fraction(0) for s in order}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > most_epochs * sizes[s]]
        if not over:
            out |= {s: per * weight[s] for s in open_}
            break
        for s in over:
            out[s] = Fraction(most_epochs * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def sainte_lague(claims: Sequence[Fraction | int], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients claim / (2 k + 1), the earlier claim first among equals; none above its cap.

    Starts from quotas that the method is sure to give and deals the rest from a heap, so the work is that of the
    number of claims, not of seats.
    """
    total = sum(claims)
    caps = [seats] * len(claims) if caps is None else list(caps)
    if not total:
        return [0] * len(claims)
    given = [min(cap, max(0, math.floor(Fraction(c) * seats / total) - 1)) for c, cap in zip(claims, caps, strict=True)]
    queue = [(-Fraction(c) / (2 * g + 1), i) for i, (c, g) in enumerate(zip(claims, given, strict=True)) if c and g < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-Fraction(claims[i]) / (2 * given[i] + 1), i))
    return given


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, to be broadcast if they are few."""
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """key, doc_id, source, size in words, and a seeded hash of id, text and source."""
    text = text_or_empty()
    return docs.select("key", "doc_id", "source", F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("h"))


def token_quotas(target: Fraction, quotas: Sequence[int], tokens: Sequence[int], block: int, most_epochs: int) -> list[int]:
    """Tokens that each shard of a source gives: its blocks' at first, then so changed that they sum up to the target."""
    caps = [most_epochs * t for t in tokens]
    given = [min(q * block, cap) for q, cap in zip(quotas, caps, strict=True)]
    lack = round(target) - sum(given)
    for k in range(len(given)):
        change = max(-given[k], min(lack, caps[k] - given[k]))
        given[k] += change
        lack -= change
        if not lack:
            break
    return given


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most_epochs: int = MOST_EPOCHS, block: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame, int]:
    """Every document's place in its shard's stream, and the blocks that are taken.

    :param docs: key, doc_id, source, text.
    :return: documents (key, doc_id, source, size, shard, start, shard_tokens), blocks (shard, block_no, held) and the
        tokens of a block; block b of a shard gives the stream's tokens from b * block on, ``held`` of them, the stream
        being the shard's tokens repeated ``most_epochs`` times.
    """
    spark = docs.sparkSession
    sized = materialise(_sized(docs, seed), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")).collect()  # one row a source
    rows = max(1, sum(r["rows"] for r in sources))
    shards = min(MOST_SHARDS, math.ceil(rows / SHARD_ROWS))
    order = sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))
    first, dealt = 0, []
    for r in order:
        n = max(1, round(shards * r["rows"] / rows))
        dealt.append((r["source"], first, n))
        first += n
    ranges = _small(spark.createDataFrame(dealt, docs.select("source").schema.add("first", "long").add("n", "long")), len(dealt))
    joined = sized.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    placed = joined.select("d.key", "d.doc_id", "d.source", "d.size", "d.h", (F.col("first") + F.pmod(F.xxhash64("h", F.lit("shard")), F.col("n"))).alias("shard"))
    stream = Window.partitionBy("shard").orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).drop("h")
    own = {r["shard"]: r["tokens"] for r in placed.groupBy("shard").agg(F.sum("size").alias("tokens")).collect()}  # bounded: one row a shard

    goal = targets({r["source"]: r["tokens"] for r in order}, weights, share, most_epochs)
    claims = [goal[s] for s, _, _ in dealt]
    block = block or max(SMALLEST_BLOCK, math.ceil(max(own.values(), default=0) / BLOCKS))
    room = [[math.ceil(most_epochs * own.get(k, 0) / block) for k in range(at, at + n)] for _, at, n in dealt]
    quotas = sainte_lague(claims, round(sum(claims) / block), [sum(x) for x in room])
    taken = []
    for (source, at, n), quota, caps in zip(dealt, quotas, room, strict=True):
        tokens = [own.get(k, 0) for k in range(at, at + n)]
        given = token_quotas(goal[source], sainte_lague(tokens, quota, caps), tokens, block, most_epochs)
        taken += [(k, g, t * most_epochs, t) for k, g, t in zip(range(at, at + n), given, tokens, strict=True)]
    quota = spark.createDataFrame(taken, "shard long, given long, length long, shard_tokens long")
    every = quota.filter("given > 0").select("shard", "given", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("block_no"))
    own_tokens = F.least(F.lit(block), F.col("length") - F.col("block_no") * block)
    before = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "block_no"), "block_no").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("before", F.coalesce(F.sum(own_tokens).over(before), F.lit(0)))
    blocks = every.select("shard", "block_no", F.least(own_tokens, F.col("given") - F.col("before")).alias("held")).filter("held > 0")
    return placed.join(_small(quota.select("shard", "shard_tokens"), len(taken)), "shard"), blocks, block


def pieces(documents: DataFrame, blocks: DataFrame, most_epochs: int, block: int) -> DataFrame:
    """What the taken blocks hold of each document: its rows with epoch, first (word) and n (words), one row a block.

    Each document meets only the blocks that it lies in.
    """
    epochs = documents.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most_epochs - 1).cast("long"))))
    at = epochs.withColumn("at", F.col("start") + F.col("epoch") * F.col("shard_tokens"))
    touched = at.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = touched.join(blocks, ["shard", "block_no"])
    begin = F.greatest(F.col("at"), F.col("block_no") * block)
    end = F.least(F.col("at") + F.col("size"), F.col("block_no") * block + F.col("held"))
    return met.withColumn("first", begin - F.col("at")).withColumn("n", end - begin).filter("n > 0")


def shares(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most_epochs: int = MOST_EPOCHS, block: int | None = None, seed: int = 11) -> DataFrame:
    """How much of each document the mix takes.

    :return: doc_id, size, source_size, target (of its source), taken: a row for each row of ``docs``.

    Null and empty texts have size 0 and nothing taken; sources without words have target 0.  A null source is a
    source, the last one.  Each of several equal rows has a place of its own, so what is taken of them may differ; which
    of them has which place makes no difference.  A source's taken words are its target, rounded.  No row is dropped.
    """
    documents, blocks, block = plan(docs.select(F.lit(None).cast("long").alias("key"), "doc_id", "source", "text"), weights, share, most_epochs, block, seed)
    documents = materialise(documents, "placed")
    sums = pieces(documents, blocks, most_epochs, block).groupBy("shard", "start", "size").agg(F.sum("n").alias("taken"))
    sources = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = {r["source"]: r["source_size"] for r in sources.collect()}  # one row a source
    goal = targets(sizes, weights, share, most_epochs)
    listed = docs.sparkSession.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], docs.select("source").schema.add("source_size", "long").add("target", "double"))
    # a document with words has a place in its shard to itself
    out = documents.join(sums, ["shard", "start", "size"], "left").alias("d").join(_small(listed, len(sizes)).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.size", "s.source_size", "s.target", F.coalesce("d.taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most_epochs: int = MOST_EPOCHS, block: int | None = None, seed: int = 11) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A row for each document and epoch of which something is taken; the text is the document's words that the taken
    blocks hold, each with the white space that follows it.  A document taken whole keeps its text as it is.  Rows have
    a key of their own, written once with them, so equal rows are told apart.  Null, empty and repeated rows are those
    of ``shares``.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("doc")), "rows")
    documents, blocks, block = plan(rows.select("key", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text"))), weights, share, most_epochs, block, seed)
    held = pieces(documents, blocks, most_epochs, block).groupBy("key", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"), F.sum("n").alias("n"))
    # words with the white space that follows them
    tokens = F.regexp_extract_all("doc.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    joined_text = F.array_join(F.transform("parts", lambda p: F.array_join(F.slice(tokens, (p["first"] + 1).cast("int"), p["n"].cast("int")), "")), "")
    text = F.when(F.col("n") < F.col("size"), joined_text).otherwise(F.col("doc.text"))
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.join(held, "key").select(*(changed.get(c, F.col(f"doc.`{c}`")) for c in docs.columns))
