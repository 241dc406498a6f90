"""Secret scans over a trigram inverted index, in DataFrame expressions only.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of sets of trigrams that any
match must contain, on text in lower case (so that one index serves rules of either case).  The index holds postings
(gram, key) for the trigrams that some rule can ask for; the postings of all trigrams would be larger than the
corpus.  Intersecting the postings of a query gives candidates, a superset of the texts with a match, and only
candidates are verified with the expression itself.  A rule without a mandatory trigram (a run of hexadecimal
digits) scans every text.

A posting's key is a hash of the row's id and text.  Should two rows ever share a key, one is verified in vain.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.columns import let, text_or_empty
from gristmill.session import materialise

#: How many strings or alternatives an analysis follows before it settles for a weaker query.
MOST = 64
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


# The expressions and lengths that the contract states.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the same matches as of [0-9a-f]+ with 32 characters or more
)
# Well-known token layouts of public services.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# Boolean trigram queries


def _simple(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)  # either alone is still necessary
    return _simple(frozenset(x | y for x in a for y in b))


def _strings_query(strings: frozenset[str]) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _analyse(items: Sequence) -> tuple[frozenset[str] | None, Query]:
    """All strings that a parsed expression matches, if few, and else none; a query that any match satisfies."""
    exact: frozenset[str] | None = frozenset([""])
    strings, query = exact, ANY  # strings: what the last items may read
    for kind, value in items:
        found: frozenset[str] | None = None
        needs = ANY
        if kind is sre.LITERAL:
            found = frozenset([chr(value).lower()])
        elif kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
            found = frozenset(chr(v).lower() for _, v in value)
        elif kind is sre.SUBPATTERN:
            found, needs = _analyse(value[-1])
        elif kind is sre.BRANCH:
            parts = [_analyse(branch) for branch in value[1]]
            if all(e is not None for e, _ in parts):
                found = frozenset().union(*(e for e, _ in parts))
            else:
                needs = _simple(frozenset().union(*(q if e is None else _strings_query(e) for e, q in parts)))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            e, q = _analyse(inner)
            if (low, high) == (0, 1) and e is not None:
                found = e | {""}
            elif low:
                needs = q if e is None else _strings_query(e)
        elif kind is sre.AT:
            found = frozenset([""])
        if found is not None and len(strings) * len(found) <= MOST:
            strings = frozenset(a + b for a in strings for b in found)
            exact = strings if exact is not None else None
            continue
        query = _and(_and(query, _strings_query(strings)), needs if found is None else ANY)
        exact, strings = None, found if found is not None else frozenset([""])
    if exact is not None:
        return exact, ANY
    return None, _and(query, _strings_query(strings))


def trigram_query(pattern: str) -> Query:
    """OR of sets of lower-case trigrams, one of which any match contains in full; the empty set if none is mandatory."""
    exact, query = _analyse(list(sre_parser.parse(pattern)))
    query = query if exact is None else _strings_query(exact)
    return ANY if frozenset() in query or len(query) > MOST else query


# index and candidates


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """gram, key: which texts (key, text) contain which trigrams, in lower case."""
    low = docs.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("key", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key, kinds: for which rules a text satisfies the trigram query.  Intersects postings by key."""
    grams = sorted({g for r in rules for a in r.query for g in a})
    number = F.create_map(*(x for i, g in enumerate(grams) for x in (F.lit(g), F.lit(i))))
    rows = index.filter(F.col("gram").isin(grams)).select("key", F.element_at(number, F.col("gram")).alias("number"))
    masks = [F.bit_or(F.when(F.floor(F.col("number") / 62) == word, F.expr("shiftleft(1L, number % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"m{word}") for word in range(len(grams) // 62 + 1)]
    held = rows.groupBy("key").agg(*masks)

    def satisfied(alternative: frozenset[str]) -> Column:
        need: dict[int, int] = {}
        for g in alternative:
            i = grams.index(g)
            need[i // 62] = need.get(i // 62, 0) | 1 << i % 62
        out = F.lit(True)
        for word, bits in sorted(need.items()):
            out = out & (F.col(f"m{word}").bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long"))
        return out

    kinds = []
    for rule in rules:
        any_of = F.lit(False)
        for alternative in sorted(rule.query, key=sorted):
            any_of = any_of | satisfied(alternative)
        kinds.append(F.when(any_of, F.lit(rule.kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


# verification

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, leftmost and without overlap, as (start, rank, end, kind) in code points."""
    pattern = F.lit(rule.pattern)

    def spans(gaps: Column) -> Column:
        matches = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("own"))
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(gaps[acc["i"]])
            end = start + F.length(m["all"])
            one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            keep = F.length(m["own"]) >= rule.least
            return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(matches, zero, step, lambda acc: acc["found"])

    return F.when(F.rlike(text, pattern), let(F.split(text, rule.pattern, -1), spans)).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, end, kind), by start and then by the rule's place in ``rules``.

    Offsets are code points, the end exclusive.  A null text counts as empty and has no spans; empty texts, repeated
    rows and null ids are rows like others.  Texts are scanned whole.  A column ``spans`` in ``docs`` is replaced.
    """
    indexed = [r for r in rules if r.query != ANY]
    # the row as it is stays in one column, so no other can clash
    row = F.struct(*(text_or_empty().alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "spans"))
    texts = docs.select(row.alias("row"), text_or_empty().alias("text"), F.xxhash64("doc_id", text_or_empty()).alias("key"))
    full = [(i, r) for i, r in enumerate(rules) if r.query == ANY]
    parts = [rule_spans(F.col("text"), r, i) for i, r in full]
    if indexed:
        grams = sorted({g for r in indexed for a in r.query for g in a})
        index = materialise(postings(texts, grams), "postings")
        texts = texts.join(candidates(index, indexed), "key", "left")
        parts += [F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r, i)).otherwise(F.array().cast(_SPANS)) for i, r in enumerate(rules) if r in indexed]
    spans = F.sort_array(F.concat(*parts)) if parts else F.array().cast(_SPANS)
    return texts.select("row", spans.alias("spans")).select("row.*", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]``; of overlapping spans the first is named."""
    found = scan(docs, rules)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, out).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("spans")
