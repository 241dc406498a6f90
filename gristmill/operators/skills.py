"""Skills that adverts mention, and whether they ask for them, teach them or list them as work.

An advert is exploded into segments (lines, sentences, list items), and a segment into the places of its cues and
skills, all of them.  What governs a mention is the last cue in its segment that begins before it or with it; else the
last cue of the up to twelve segments before, within 1200 characters; else the first cue after it; else it is work.
The strongest context of all places counts.  The windows are over one advert, so they never hold more than one text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import let

# Texts shorter than this are summaries, how far back a heading holds, and how long quotes are.
LEAST_CHARS, BACK_SEGMENTS, BACK_CHARS, QUOTE_CHARS = 700, 12, 1200, 220

def phrases(*words: str) -> str:
    """An expression for any of some words or phrases, longer ones first; one space stands for any white space."""
    listed = sorted(words, key=lambda w: (-len(w), w))
    return "|".join(w.replace("'", "['’]").replace(" ", r"\s+") for w in listed)


#: Cue kinds, in the order in which they claim a cue, and what shows them; ``ignore`` is talk of the company.  A caller
#: with a list of their own gives that.
CUES: dict[str, str] = {
    "ignore": phrases("about us", "who we are", "why join us", "benefits", "perks", "our values", "our mission", "our culture", "diversity"),
    "taught": phrases("you'll learn", "you will learn", "learn", "learning", "taught", "teach you", "trained", "training", "module", "modules", "course covers"),
    "asked": phrases("you'll need", "you will need", "you need", "must", "must have", "essential", "desirable", "required", "requirement", "requirements", "we're looking for", "looking for", "strong", "experience of", "experience in", "experience with", "knowledge of", "good understanding of", "able to", "about you"),
    "job": phrases("what you'll do", "what you will do", "responsibilities", "responsible for", "duties", "day to day", "this role", "your role", "in the role"),
}
QUALIFICATIONS = rf"(?i)\b(?:{phrases('gcse', 'gcses', 'a level', 'a levels', 'a-level', 'a-levels', 'btec', 'btecs', 't level', 't levels', 'highers', 'ucas points')})\b"
_RANK = {"asked": 2, "taught": 1, "job": 0}


def segments(text: Column) -> Column:
    """Lines, sentences and list items, trimmed, without empty ones."""
    items = F.regexp_replace(text, r"[^\S\n]*[•▪●◦*][^\S\n]+", "\n")
    sentences = F.regexp_replace(items, r"([.!?:;])[^\S\n]+([A-Z0-9(])", "$1\n$2")
    return F.filter(F.transform(F.split(sentences, r"\n+", -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def _kind(cue: Column, cues: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(list(cues.items())):
        out = F.when(cue.rlike(rf"(?i)^(?:{pattern})$"), kind).otherwise(out)
    return out


def mentions(adverts: DataFrame, dictionary: Mapping[str, str], key: str = "listing_id", text: str = "text", cues: Mapping[str, str] = CUES) -> DataFrame:
    """``key``, id, ctx (the strongest of asked, taught and job) and quote: a row for each skill that an advert has.

    :param dictionary: skill to its regular expression, which matches no empty text.  A bounded table; it becomes part
        of the plan.

    Texts under 700 characters and null texts give no rows.  Segments with school qualifications are entry
    requirements and are passed over, a mention within a question counts as work.
    """
    any_cue = r"(?i)\b(?:" + "|".join(cues.values()) + r")\b"

    def ends(c: Column) -> Column:
        """The kinds of a segment's first and last cue: its cues are looked for once."""
        kind = lambda at: let(at, lambda cue: _kind(cue, cues))
        return let(F.regexp_extract_all(c, F.lit(any_cue), F.lit(0)), lambda found: F.when(F.size(found) > 0, F.struct(kind(F.get(found, F.lit(0))).alias("first"), kind(F.get(found, F.size(found) - 1)).alias("last"))))

    # equal rows count once, different texts of one key each by itself
    rows = adverts.filter(F.length(text) >= LEAST_CHARS).select(F.col(key), F.xxhash64(key, text).alias("advert"), segments(F.col(text)).alias("parts"))
    parts = rows.distinct().select(key, "advert", F.posexplode("parts").alias("at", "part")).withColumn("cue", ends(F.col("part"))).select("*", F.col("cue.last").alias("last"))
    order = Window.partitionBy(key, "advert").orderBy("at")
    parts = parts.withColumn("chars", F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.when(F.col("last").isNotNull(), F.struct("last", F.col("chars").alias("until")))
    heading = F.last(seen, ignorenulls=True).over(order.rowsBetween(-BACK_SEGMENTS, -1))
    parts = parts.withColumn("heading", heading)
    # the budget counts the segments between the heading's and this one
    held = F.when(F.col("chars") - F.length("part") - F.col("heading.until") < BACK_CHARS, F.col("heading.last"))
    asked_for = parts.filter(~F.col("part").rlike(QUALIFICATIONS) & F.col("part").rlike("|".join(f"(?:{p})" for p in dictionary.values())))

    def places(pattern: str, id_: str | None) -> Column:
        """Each match: what it is of, how long it and the text since the match before it are, and a cue's kind."""
        hits, gaps = F.regexp_extract_all("part", F.lit(pattern), F.lit(0)), F.split("part", pattern, -1)
        kind = (lambda h: _kind(h, cues)) if id_ is None else (lambda h: F.lit(None).cast("string"))
        return F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.lit(id_).cast("string").alias("id"), F.length(h).alias("long"), F.length(g).alias("gap"), kind(h).alias("kind")))

    listed = F.concat(F.when(F.col("cue").isNotNull(), places(any_cue, None)).otherwise(F.array()), *(F.when(F.col("part").rlike(p), places(p, name)).otherwise(F.array()) for name, p in dictionary.items()))
    met = asked_for.select(key, "advert", "at", "part", held.alias("held"), F.col("cue.first").alias("first"), F.posexplode(listed).alias("nth", "m")).select("*", "m.*")
    # a place is the sum of what comes before it
    before = Window.partitionBy(key, "advert", "at", "id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("place", F.sum(F.col("gap") + F.col("long")).over(before) - F.col("long"))
    upto = Window.partitionBy(key, "advert", "at").orderBy("place", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("own", F.last("kind", ignorenulls=True).over(upto)).filter("id IS NOT NULL")
    context = F.when(F.col("part").rlike(r"\?\s*$"), "job").otherwise(F.coalesce("own", "held", "first", F.lit("job")))
    known = met.withColumn("ctx", context).filter("ctx != 'ignore'")
    rank = F.create_map(*(F.lit(x) for k, v in _RANK.items() for x in (k, v)))
    best = known.groupBy(key, "id").agg(F.max_by(F.struct("ctx", "part"), F.struct(F.element_at(rank, F.col("ctx")).alias("r"), (-F.col("at")).alias("a"))).alias("best"))
    quote = F.when(F.length("best.part") > QUOTE_CHARS, F.concat(F.substring("best.part", 1, QUOTE_CHARS - 3), F.lit("…"))).otherwise(F.col("best.part"))
    return best.select(key, "id", F.col("best.ctx").alias("ctx"), quote.alias("quote"))
