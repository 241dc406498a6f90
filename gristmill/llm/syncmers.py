"""Document fingerprints by closed syncmers, in DataFrame expressions only.

A text is a sequence of pieces: words cut every 16 characters, and single characters of scripts without spaces.  A
k-mer of pieces is a closed syncmer if the least of its inner s-mers, by hash, is its first or its last one.  Whether
a k-mer is chosen depends on nothing outside it, so equal passages give equal anchors wherever they stand.  Every
window of k - s + 1 k-mers has an anchor, and two of them are expected.

A fingerprint lists its anchors in order as ``hash@position`` in hexadecimal, comma-joined; hashes have 40 bits.  A text with
fewer than k pieces has each piece as an anchor; a text without pieces has the empty fingerprint.

Fingerprints are matched by position: an anchor counts as common where both texts have it with the same distance to
the anchor after it.  So a passage matches wherever it stands, and anchors that occur in another order don't.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.columns import let, text_or_empty

K, S = 8, 2
BITS = (1 << 40) - 1
PIECE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\x20\x09-\x0D\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,16}"
ANCHORS = "array<struct<h:bigint,at:int>>"
#: Characters of text that one ordered range of documents holds about, and the most ranges; sampled keys for each.
RANGE_CHARS, MOST_RANGES, SAMPLED = 4 << 20, 65536, 8
#: Bits of a distance between anchors; longer ones count as the longest.
GAP_BITS = 20


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Closed syncmers of a text: array of (h, at), at being the number of the first piece."""

    def smers(pieces: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pieces) - (s - 1))
        return F.transform(starts, lambda i: F.xxhash64(*(F.element_at(pieces, i + j) for j in range(s))))

    def chosen(m: Column) -> Column:
        width = k - s + 1

        def least(i: Column, end: int) -> Column:
            # comparisons stop at the first smaller one, after about two
            out = F.lit(True)
            for j in reversed([j for j in range(width) if j != end]):
                out = (F.element_at(m, i + end) <= F.element_at(m, i + j)) & out
            return out

        def closed(i: Column) -> Column:
            return least(i, 0) | least(i, width - 1)

        def anchor(i: Column) -> Column:
            # s-mers at these places cover all k pieces
            cover = sorted({*range(0, k - s + 1, s), k - s})
            return F.struct(F.xxhash64(*(F.element_at(m, i + j) for j in cover)).bitwiseAND(BITS).alias("h"), (i - 1).cast("int").alias("at"))

        return F.transform(F.filter(F.sequence(F.lit(1), F.size(m) - (width - 1)), closed), anchor)

    def of(pieces: Column) -> Column:
        short = F.transform(pieces, lambda p, i: F.struct(F.xxhash64(p).bitwiseAND(BITS).alias("h"), i.alias("at")))
        return F.when(F.size(pieces) >= k, let(smers(pieces), chosen)).when(F.size(pieces) > 0, short).otherwise(F.array().cast(ANCHORS))

    return let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), of)


def pack(found: Column) -> Column:
    """Anchors as a struct of two plain arrays, h and at, which are smaller to shuffle."""
    return let(found, lambda a: F.struct(F.transform(a, lambda x: x["h"]).alias("h"), F.transform(a, lambda x: x["at"]).alias("at")))


def fingerprint(hashes: Column, places: Column) -> Column:
    """Anchors as text."""
    return F.lower(F.array_join(F.zip_with(hashes, places, lambda h, at: F.concat(F.hex(h), F.lit("@"), F.hex(at.cast("long")))), ","))


def placed(hashes: Column, places: Column) -> Column:
    """Each anchor with its distance to the next one, as one number."""
    gap = lambda i: F.coalesce(F.get(places, i + 1) - F.get(places, i), F.lit(0))
    return F.transform(hashes, lambda h, i: F.shiftleft(h, GAP_BITS) + F.least(gap(i), F.lit((1 << GAP_BITS) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of all different placed anchors that both have, 0 to 1; two empty fingerprints are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_).cast("double")


def _tops(base: DataFrame, range_chars: int) -> list[tuple]:
    """Keys (id, hash) of the table at which ranges begin, the greatest key first; none for an empty table."""
    known = base.agg(F.sum(F.length("text")).alias("chars"), F.max("key").alias("top"), F.count("*").alias("rows")).first()
    n = min(MOST_RANGES, math.ceil((known["chars"] or 0) / range_chars))
    tops = {tuple(known["top"])} if known["rows"] else set()
    if n > 1:
        every = max(1, known["rows"] // (SAMPLED * n))
        keys = {tuple(r["key"]) for r in base.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect()}
        keys = sorted(keys, key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))
        tops |= {keys[len(keys) * i // n] for i in range(1, n) if keys}
    return sorted(tops, key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]), reverse=True)


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS, carry: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, text, next_text: each row with the text that follows by descending doc_id, after the last the first.

    ``carry`` names columns made of the text; each row also has its own and, as next_..., the following one's.

    Rows of equal doc_id follow each other by a hash of their text, null ids come last.  The order is cut into ranges
    whose tops are keys of the table; a range also gets the top rows of the range after it, so no range has to know
    another.  Texts are exchanged once.  Only rows that are equal in id and text always share a range.
    """
    carry = carry or {}
    made = ["text", *carry]
    text = text_or_empty()
    base = docs.select("doc_id", text.alias("text"), F.struct("doc_id", F.xxhash64(text).alias("h")).alias("key"))
    tops = _tops(base, range_chars)
    if not tops:
        base = base.withColumns({c: f(F.col("text")) for c, f in carry.items()})
        return base.select("doc_id", *made, *(F.col(c).alias(f"next_{c}") for c in made))
    side = math.ceil(math.sqrt(len(tops)))
    rows = [[{"doc_id": i, "h": h} for i, h in tops[k : k + side]] for k in range(0, len(tops), side)]
    kind = base.schema["key"].dataType.simpleString()
    # literals: Spark works them out once
    heads, inner = (F.from_json(F.lit(json.dumps(x)), f"{k}<{kind}{'>' * (1 + k.count('<'))}") for x, k in (([r[0] for r in rows], "array"), (rows, "array<array")))

    def number(key: Column) -> Column:
        """How many tops are at least the key, less one: its range."""
        row = F.size(F.filter(heads, lambda t: t >= key)) - 1
        return row * side + F.size(F.filter(F.get(inner, row), lambda t: t >= key)) - 1

    placed_ = base.withColumn("range", number(F.col("key")))
    top = F.get(F.get(inner, F.floor(F.col("range") / side).cast("int")), F.col("range") % side)
    before = F.when(F.col("range") == 0, len(tops) - 1).otherwise(F.col("range") - 1)
    own, guest = F.struct("range", F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest"))
    both = placed_.select("doc_id", "key.h", "text", F.inline(F.when(F.col("key") == top, F.array(own, guest)).otherwise(F.array(own))))
    there = both.repartition("range").withColumns({c: f(F.col("text")) for c, f in carry.items()})
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    return there.withColumns({f"next_{c}": F.lead(c).over(order) for c in made}).filter(~F.col("guest")).drop("guest", "range", "h")


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the text
    that follows by descending doc_id.

    :return: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each
        row of ``docs``.

    Null texts count as empty.  Equal texts have equal fingerprints.  Whole texts are looked at, however long.  Rows of
    equal or null id are rows of their own, in the order of ``with_next``.  Extra columns are ignored.
    """
    pairs = with_next(docs, carry={"own": lambda text: pack(anchors(text, k, s))})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", placed(F.col("next_own.h"), F.col("next_own.at")).alias("next"))
    made = made.withColumn("edited_own", pack(anchors(F.col("edited"), k, s))).withColumn("placed", placed(F.col("own.h"), F.col("own.at")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own.h"), F.col("own.at")).alias("fingerprint"),
        fingerprint(F.col("edited_own.h"), F.col("edited_own.at")).alias("edited_fingerprint"),
        likeness(F.col("placed"), placed(F.col("edited_own.h"), F.col("edited_own.at"))).alias("near_edited"),
        likeness(F.col("placed"), F.col("next")).alias("near_next"),
    )
