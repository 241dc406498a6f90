"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule says of a text whether it is rejected.  On a sample of the documents each rule's cost (the steps that it takes:
characters scanned, words looked up, values sorted) and its selectivity are estimated, and the rules are ordered by
rejection per cost, each on what the rules before it leave: cheap rules that reject much come first.  The verdict is
one CASE expression in that order, so a document that an early rule rejects never meets a later one.  The order changes
the cost and never the verdict, which is rejection by any rule.

Steps are counted, not timed, and the sample is taken by a hash of the text, so the order is the same on every run and
however the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.columns import let, text_or_empty, words_of

#: Rows that the sample for costs and selectivities holds about.
SAMPLE_ROWS = 1000


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def line_counts(text: Column) -> Column:
    """Struct of lines with a word, and of those that equal an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated")))


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes.  Without an equal pair, which a hash set tells, nothing is sorted.
    """

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def twice(found: Column) -> Column:
        def is_twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.element_at(found, k)["h"] == x["h"]).otherwise(False)
            after = F.when(k < F.size(found) - 1, F.element_at(found, k + 2)["h"] == x["h"]).otherwise(False)
            return before | after

        return F.sort_array(F.transform(F.filter(found, is_twice), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, lambda found: covered(twice(found))))

    return let(windows(words), count).cast("long")


UPPER, LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"


def _only(text: Column, letters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))


@dataclass(frozen=True)
class Facts:
    """What rules look at: expressions that are worked out where a rule asks, or columns that hold them already."""

    text: Column
    words: Column
    word_chars: Column
    n_symbols: Column
    lines: Column
    n_repeat_words: Column

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")


def facts(text: Column, words: Column) -> Facts:
    return Facts(text, words, word_chars(words), n_symbols(text), line_counts(text), n_repeat_words(words))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text is rejected, ``steps`` how many steps that takes."""

    name: str
    rejects: Callable[[Facts], Column]
    steps: Callable[[Facts], Column]


#: Steps for each word of hashing a window, of finding equal ones and of sorting them; for each line and each word of
#: keeping it in a set or joining it; and for each character that a replacement writes or passes over.
WINDOW_STEPS, ITEM_STEPS, REPLACE_STEPS = 40, 4, 3

RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda x: x.n_words < 50, lambda x: F.lit(1)),
    Rule("repeated_windows", lambda x: 100 * x.n_repeat_words > 50 * x.n_words, lambda x: 1 + WINDOW_STEPS * x.n_words),
    Rule("symbols", lambda x: 100 * x.n_symbols > 20 * x.n_words, lambda x: 1 + F.length(x.text)),
    Rule("shouting", lambda x: _only(x.text, UPPER) > _only(x.text, LOWER), lambda x: 1 + 2 * REPLACE_STEPS * F.length(x.text)),
    Rule("repeated_lines", lambda x: let(x.lines, lambda lines: 100 * lines["repeated"] > 50 * lines["n"]), lambda x: 1 + F.length(x.text) + ITEM_STEPS * F.regexp_count(x.text, F.lit("\n"))),
    Rule("word_length", lambda x: let(x.word_chars, lambda n: (n < 2 * x.n_words) | (n > 20 * x.n_words)), lambda x: 1 + ITEM_STEPS * x.n_words),
)
#: The rules that are the contract's base.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Measured:
    """A rule with its figures on the rows of the sample that the rules before it leave."""

    rule: Rule
    rows: int
    steps: int
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(1, self.steps)


def cascade(rules: Sequence[Rule], groups: Iterable[Mapping]) -> list[Measured]:
    """The rules, each time the one of most rejection per cost among the rows that are left; the earlier one on ties.

    :param groups: ``n`` rows of which rule i ``rejects[i]``, and which take it ``steps[i]``.
    """
    left, open_, out = list(groups), list(enumerate(rules)), []
    while open_:
        figures = [Measured(r, sum(g["n"] for g in left), sum(g["steps"][i] for g in left), sum(g["n"] for g in left if g["rejects"][i])) for i, r in open_]
        best = max(range(len(open_)), key=lambda k: (figures[k].worth, -k))
        i, _ = open_.pop(best)
        out.append(figures[best])
        left = [g for g in left if not g["rejects"][i]]
    return out


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """The cascade of rules by their figures on a sample.  An empty sample keeps the order.

    What reaches the driver is a row for each set of rules that rejects some text of the sample.
    """
    every = max(1, docs.count() // max(1, rows))
    sample = docs.select(text_or_empty().alias("text")).filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(every)) == 0)
    seen = facts(F.col("text"), F.col("words"))
    found = sample.withColumn("words", words_of(F.col("text"))).select(F.array(*(r.rejects(seen) for r in rules)).alias("rejects"), *(r.steps(seen).cast("long").alias(f"steps{i}") for i, r in enumerate(rules)))
    sums = found.groupBy("rejects").agg(F.count("*").alias("n"), F.array(*(F.sum(f"steps{i}") for i in range(len(rules)))).alias("steps"))
    return cascade(rules, sums.collect())


def rejected_by(seen: Facts, rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(seen), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``: the name of the first rule that rejects the text, or null.

    A null text counts as empty and has no words, so the rule of few words rejects it.  A text is looked at whole,
    however long.  A column of that name in ``docs`` is replaced.  No other column is read, no row dropped or merged.
    """
    ordered = [m.rule for m in measure(docs, rules, sample_rows)]
    text = text_or_empty()
    return docs.withColumn("rejected_by", let(words_of(text), lambda words: rejected_by(facts(text, words), ordered)))


def statistics(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base_failed and the cascade's verdict for each document.

    :return: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row for each row
        of ``docs``, whatever its id.

    Null and empty texts have counts of 0 and fail the base.  Whole texts are counted, however long.  The counts are
    worked out once, and the rules look at them.
    """
    ordered = [m.rule for m in measure(docs, rules, sample_rows)]
    text, words = F.col("text"), F.col("words")
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("words", words_of(text))
    counted = base.select("*", *(value.alias(name) for name, value in vars(facts(text, words)).items() if name not in ("text", "words")))
    seen = Facts(**{name: F.col(name) for name in vars(facts(text, words))})
    base_failed = F.coalesce(*(F.when(r.rejects(seen), F.lit(True)) for r in rules if r.name in BASE), F.lit(False))
    kept = F.when(F.col("base_failed"), False).otherwise(rejected_by(seen, [r for r in ordered if r.name not in BASE]).isNull())
    return counted.withColumn("base_failed", base_failed).select("doc_id", seen.n_words.alias("n_words"), "word_chars", "n_symbols", F.col("lines.repeated").alias("n_dup_lines"), "n_repeat_words", "base_failed", kept.alias("kept"))
