"""Listings printed in columns: the text that a page-layout extractor makes of a document.

Two layouts are read.  A *table* has a head line of labels, and a row opens at a token of its own (such as a level) near
the label of its column; the lines below it are wrapped cells.  A *card* has label lines one below the other, two
columns on some.

Lines are rows.  What a line belongs to is told by windows over a document's lines: the last head, the last opening or
breaking line, the next label.  Each entry's lines then meet in one group, and its cells are put together by a fold over
the few runs of text it has.  A document is one row of text, so its windows are bounded by it; documents are spread by
their own key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gristmill.functions.dates import MONTH_NAMES
from gristmill.functions.text import collapse_spaces, filled, let, slugify

_RUN = r"\S+(?: \S+)*"
_WHITE = " \t\n\x0b\f\r"  # what \s is
_YEAR = "(?:19|20)[0-9]{2}"
SEASONS = ("Spring", "Summer", "Autumn", "Winter")
#: Words that stand where a month could.
OPEN_WORDS = ("Open now", "Opens now", "Opening now", "Open soon", "Opens soon", "Opening soon", "Now open", "Coming soon", "Ongoing", "Rolling", "TBC", "TBA", "ASAP", "Immediate", "Immediately", "Flexible", "Closed", "Now")


def _period() -> str:
    """A month or season, perhaps a part of it."""
    months = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "September" else "Sept?(?:ember)?" for m in MONTH_NAMES)
    return rf"(?:(?:Early|Mid|Late|End of|End)[ -])?(?:{months}|{'|'.join(SEASONS)})"


def _when() -> str:
    words = "|".join(w.replace(" ", r"\s+") for w in sorted(OPEN_WORDS, key=len, reverse=True))
    return rf"(?:{words}|{_period()}\b(?:\s+[0-9]{{4}})?)"


#: A web address, one without its scheme, or an address for mail.
LINK = r"(?:(?:https?://|www\.)\S+|[\w.-]+@[\w-]+(?:\.[\w-]+)+|[a-z0-9-]+(?:\.[a-z0-9-]+)+/\S*)"
LEVELS = r"^[2-7](?:\s*(?:/|&|,|-|–|or|and|to)\s*[2-7])*$"


@dataclass(frozen=True)
class Table:
    """How a printed table looks.  Expressions are matched without regard to case unless they say so."""

    #: A line that is a head, and the labels whose columns it gives.
    head: str
    labels: Mapping[str, str]
    #: Labels that stand on a line of their own below the head, and what such a line looks like.
    below: Mapping[str, str] = field(default_factory=dict)
    below_line: str = r"(?!)"
    #: The column of the token that opens a row, and the token.
    opener: str = "level"
    opener_text: str = LEVELS
    #: The two fields left of the opener; the two next ones right of it; the dates that end the line with a link.
    left: tuple[str, str] = ("employer", "role")
    middle: tuple[str, str] = ("location", "salary")
    dates: tuple[str, str, str] = ("opens", "closes", "start")
    #: Where the second of ``middle`` begins, if both run together.
    money: str = r"£|\b(?:Competitive|Negotiable|Up to|DOE|Depend(?:ent|ing)|(?:National|Apprenticeship) minimum|Minimum wage|National (?:living|:))"
    #: Lines that end the table, and lines that are passed over.
    footer: str = r"(?!)"
    skip: str = r"(?!)"

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.left, *self.middle, *self.dates)


@dataclass(frozen=True)
class Cards:
    """How printed cards look: label lines in this order, each within ``reach`` lines of the one before."""

    role: str
    location: str
    opens: str
    closes: str
    start: str
    salary: str
    link: str
    #: Headings of sections, which stand before an entry's employer.
    section: str
    level: str = r"\bLevel\b"
    reach: int = 30


def runs(line: Column) -> Column:
    """Runs of text that two spaces or more divide: array of col (from 0) and text."""
    # each with the white space before it: the line is cut once, and only its end is left out
    cut = F.regexp_extract_all(F.rtrim(line, F.lit(_WHITE)), F.lit(rf"\s*{_RUN}"), F.lit(0))

    def placed(found: Column) -> Column:
        ends = lambda k: F.length(F.array_join(F.slice(found, F.lit(1), k + 1), ""))
        return F.transform(found, lambda x, k: let(F.ltrim(x, F.lit(_WHITE)), lambda text: F.struct((ends(k) - F.length(text)).alias("col"), text.alias("text"))))

    return let(cut, placed)


def join_wrapped(parts: Column) -> Column:
    """Cell lines as one text: a space between them, none after a letter and a hyphen or slash."""
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"(?<=\p{L}[-/])\n", ""), "\n", " ")


def clean_name(c: Column) -> Column:
    """A name without the bullets and dashes before it."""
    return collapse_spaces(F.regexp_replace(c, r"^[^\p{L}\p{N}(]+", ""))


def top_level(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[2-7]"), F.lit(0)), lambda d: d.cast("int")))


def lines_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc (a key of the row), key, i, line: a form feed ends a line too.  Null texts have no lines."""
    keyed = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("key"), F.split(F.translate(text, "\f", "\n"), "\n").alias("all"))
    return keyed.select("doc", "key", F.posexplode("all").alias("i", "line"))


_FIELDS = ("section", "employer", "role", "level", "location", "salary", "opens", "closes", "start", "link")


def _lines() -> WindowSpec:
    """A document's lines in order."""
    return Window.partitionBy("doc").orderBy("i")


def _at(label: str, line: Column) -> Column:
    """Where a label stands, or null."""
    return F.nullif(F.regexp_instr(line, F.lit(f"(?i){label}")), F.lit(0)) - 1


def _nearest(col: Column, places: Column, allowed: Column | None = None) -> Column:
    """The field (a number) whose column is nearest, the first of equal ones; null without any."""
    known = F.filter(places, lambda p: p["c"].isNotNull() & (F.lit(True) if allowed is None else F.array_contains(allowed, p["f"])))
    return F.array_min(F.transform(known, lambda p: F.struct(F.abs(col - p["c"]).alias("far"), p["f"].alias("f"))))["f"]


def _opened(line: Column, cells: Column, head: Column, t: Table) -> Column:
    """A row's first line: level, link and parts (field, text, col); null for other lines."""
    names = t.fields
    number = {name: F.lit(i) for i, name in enumerate(names)}
    part = lambda name, text, col: F.struct(number[name].alias("f"), F.trim(text).alias("text"), col.alias("col"))
    fits = F.transform(cells, lambda s, k: F.when((k > 0) & (s["col"] >= head[t.opener] - 6) & (s["col"] <= head[t.middle[0]] + 1) & s["text"].rlike(f"(?i){t.opener_text}"), k))

    def left_of(at: Column) -> Column:
        """The two fields before the opener; torn at the last space before the second one's column if they ran together."""
        one = F.get(cells, F.lit(0))
        cut = F.length(F.regexp_extract(F.substring(one["text"], F.lit(1), F.greatest(F.lit(0), head[t.left[1]] - one["col"]) + 1), r"^(.*) ", 1))
        torn = let(cut, lambda c: F.when(c > 0, F.array(part(t.left[0], F.substring(one["text"], F.lit(1), c), one["col"]), part(t.left[1], F.substring(one["text"], c + 2, F.length(one["text"])), one["col"] + c + 1))))
        whole = F.transform(F.slice(cells, F.lit(1), at), lambda s, k: F.struct(F.when(k == 0, number[t.left[0]]).otherwise(number[t.left[1]]).alias("f"), s["text"].alias("text"), s["col"].alias("col")))
        return F.when(at >= 2, whole).otherwise(torn)

    when = _when()
    pattern = rf"(?i)^(.*?)(\s*)\b({when})(\s+)({when})(\s+)({when})(\s+)({LINK})\s*$"

    def as_usual(piece: Column, offset: Column) -> Column:
        """Fields of a line that ends in three dates and a link: pieces of the line in order."""
        mid = piece[0]

        def middle(within: Column, money: Column) -> Column:
            first = F.get(within, F.lit(0))
            by_money = F.array(part(t.middle[0], F.substring(mid, F.lit(1), money - 1), offset + F.coalesce(first["col"], F.lit(0))), part(t.middle[1], F.substring(mid, money, F.length(mid)), offset + money - 1))
            by_gap = F.transform(within, lambda s, k: F.struct(F.when((F.size(within) > 1) & (k == F.size(within) - 1), number[t.middle[1]]).otherwise(number[t.middle[0]]).alias("f"), s["text"].alias("text"), (s["col"] + offset).alias("col")))
            return F.when(money > 0, by_money).otherwise(by_gap)

        col, days = offset, []
        for g in range(8):
            if g in (2, 4, 6):
                days.append(part(t.dates[g // 2 - 1], piece[g], col))
            col = col + F.length(piece[g])
        fields = let(runs(mid), lambda w: let(F.regexp_instr(mid, F.lit(f"(?i){t.money}")), lambda m: middle(w, m)))
        return F.struct(piece[8].alias("link"), F.concat(fields, F.array(*days)).alias("parts"))

    def loosely(found: Column, offset: Column) -> Column:
        """Other wording: each run goes to the nearest column of the head."""
        places = F.array(*(F.struct(number[f].alias("f"), head[f].alias("c")) for f in names[2:]))
        is_link = lambda s: s["text"].rlike(f"(?i)^{LINK}$") & (s["col"] + offset >= F.coalesce(head[t.dates[2]], F.lit(-1)))
        guessed = F.transform(F.filter(found, lambda s: ~is_link(s)), lambda s: F.struct(_nearest(s["col"] + offset, places).alias("f"), s["text"].alias("text"), (s["col"] + offset).alias("col")))
        return F.struct(F.get(F.filter(found, is_link), F.lit(0))["text"].alias("link"), guessed.alias("parts"))

    def read(at: Column) -> Column:
        opener = F.get(cells, at)
        offset = opener["col"] + F.length(opener["text"])
        tail = F.substring(line, offset + 1, F.length(line))
        # all groups by one match; a line that doesn't match stays whole
        groups = "\x01".join(f"${g}" for g in range(1, 10))
        pieces = lambda x: let(F.split(F.regexp_replace(x, pattern, groups), "\x01", -1), lambda p: F.when(F.size(p) == 9, p))
        right = let(offset, lambda o: let(tail, lambda x: let(pieces(x), lambda p: F.when(p.isNotNull(), as_usual(p, o)).otherwise(let(runs(x), lambda r: loosely(r, o))))))
        whole = lambda left, r: F.struct(top_level(opener["text"]).alias("level"), r["link"].alias("link"), F.filter(F.concat(left, r["parts"]), lambda p: p["text"] != "").alias("parts"))
        return let(left_of(at), lambda left: F.when(left.isNotNull(), let(right, lambda r: whole(left, r))))

    return let(F.array_min(fits), lambda at: F.when(at.isNotNull(), read(at)))


def _filled(opened: Column, below: Column, head: Column, t: Table) -> Column:
    """All parts of a row: those of its first line, and what the lines below (array of arrays of runs) add."""
    names = t.fields
    days = [names.index(d) for d in t.dates]
    bare_month = rf"(?i)^{_period()}$"

    def own_col(i: int) -> Column:
        return F.coalesce(F.get(F.filter(opened["parts"], lambda p: p["f"] == i), F.lit(0))["col"], head[names[i]])

    places_ = F.array(*(F.struct(F.lit(i).alias("f"), own_col(i).alias("c")) for i in range(len(names))))

    def pieces(s: Column) -> Column:
        """Two cells in one run: pay after a place, years side by side."""
        divided = F.split(s["text"], rf" (?=£)| (?={_YEAR}$)", -1)
        return let(divided, lambda texts: F.transform(texts, lambda x, k: F.struct((s["col"] + F.length(F.array_join(F.slice(texts, F.lit(1), k), " ")) + F.when(k > 0, 1).otherwise(0)).alias("col"), x.alias("text"))))

    more = F.flatten(F.transform(F.flatten(below), pieces))
    given_ = F.transform(opened["parts"], lambda p: F.struct(p["f"].alias("f"), p["text"].alias("text")))

    def begin(given: Column) -> Column:
        def is_bare(i: int) -> Column:
            return let(F.filter(given, lambda p: p["f"] == i), lambda own: (F.size(own) == 1) & F.get(own, F.lit(0))["text"].rlike(bare_month))

        bare = F.array_compact(F.array(*(F.when(is_bare(i), F.lit(i)) for i in days)))
        return F.struct(given.alias("parts"), bare.alias("bare"))

    def add(state: Column, s: Column, places: Column) -> Column:
        year = s["text"].rlike(f"^{_YEAR}$")
        field_ = F.when(year, _nearest(s["col"], places, state["bare"])).when(s["text"].startswith("£"), F.lit(names.index(t.middle[1]))).otherwise(_nearest(s["col"], places))

        def added(f: Column) -> Column:
            parts = F.when(f.isNull(), state["parts"]).otherwise(F.concat(state["parts"], F.array(F.struct(f.alias("f"), s["text"].alias("text")))))
            return F.struct(parts.alias("parts"), F.filter(state["bare"], lambda b: f.isNull() | (b != f)).alias("bare"))

        return let(field_, added)

    return let(places_, lambda places: let(given_, lambda given: F.aggregate(more, begin(given), lambda state, s: add(state, s, places))))["parts"]


def table_entries(lines: DataFrame, t: Table) -> DataFrame:
    """doc, key, i and the fields of each row of printed tables."""
    line, blank = F.col("line"), F.trim("line") == ""
    line_is = lambda p: line.rlike(f"(?i){p}")
    heads = lines.withColumns({
        "is_head": line_is(t.head),
        "sub": F.first(F.when(line_is(t.below_line), line), ignorenulls=True).over(_lines().rowsBetween(1, 3)),
        "above": F.last(F.when(~blank, line), ignorenulls=True).over(_lines().rowsBetween(-3, -1)),
        "heads_next": F.coalesce(F.first(F.when(~blank, line_is(t.head)), ignorenulls=True).over(_lines().rowsBetween(1, 3)), F.lit(False)),
    })
    labels = {**t.labels, **t.below}
    places = F.struct(*(F.coalesce(_at(label, F.col("sub")), _at(label, line)).alias(name) if name in t.below else _at(label, line).alias(name) for name, label in labels.items()))
    event = F.when(F.col("is_head"), F.struct(F.lit(True).alias("within"), places.alias("cols"))).when(line_is(t.footer), F.struct(F.lit(False).alias("within"), places.alias("cols")))
    so_far = _lines().rowsBetween(Window.unboundedPreceding, 0)
    placed = heads.withColumns({"head": F.last(event, ignorenulls=True).over(so_far), "section": F.last(F.when(F.col("is_head"), collapse_spaces(F.col("above"))), ignorenulls=True).over(so_far)})
    inside = F.coalesce(F.col("head.within"), F.lit(False))
    page_number = line.rlike(r"^\s*[0-9]{1,3}\s*$")
    breaks = F.col("is_head") | ~inside | blank | page_number | F.col("heads_next")
    cells = placed.withColumn("cells", F.when(inside & ~breaks & ~line_is(t.skip), runs(line)))
    opened = cells.withColumn("opened", F.when(F.col("cells").isNotNull(), _opened(line, F.col("cells"), F.col("head.cols"), t)))
    marked = opened.withColumn("row", F.last(F.when(F.col("opened").isNotNull(), F.col("i")).when(breaks, F.lit(-1)), ignorenulls=True).over(so_far))
    rows = marked.filter("row >= 0 AND cells IS NOT NULL").groupBy("doc", "key", "row").agg(
        F.first("section").alias("section"),
        F.min_by("opened", "i").alias("opened"),
        F.min_by("head.cols", "i").alias("cols"),
        F.array_sort(F.collect_list(F.when(F.col("i") > F.col("row"), F.struct("i", "cells")))).alias("below"),  # one entry's lines
    )

    def entry(parts: Column) -> Column:
        def cell(name: str) -> Column:
            text = join_wrapped(F.transform(F.filter(parts, lambda p: p["f"] == t.fields.index(name)), lambda p: p["text"]))
            return filled(text)

        days = zip(t.dates, ("opens", "closes", "start"), strict=True)
        return F.struct(clean_name(cell(t.left[0])).alias("employer"), cell(t.left[1]).alias("role"), F.col("opened.level").alias("level"), F.coalesce(cell(t.middle[0]), F.lit("")).alias("location"), cell(t.middle[1]).alias("salary"), *(cell(d).alias(n) for d, n in days), F.col("opened.link").alias("link"))

    # taken out of an array, since a filter on fields would have the optimizer work them out again for each condition
    read = let(_filled(F.col("opened"), F.transform("below", lambda b: b["cells"]), F.col("cols"), t), entry)
    named = F.filter(F.array(read), lambda e: e["employer"].isNotNull() & e["role"].isNotNull())
    return rows.select("doc", "key", F.col("row").alias("i"), "section", F.explode(named).alias("e")).select("doc", "key", "i", "section", "e.*")


def _blanked(line: Column, at: Column, length: Column) -> Column:
    """A line with ``length`` characters from ``at`` on as spaces; a null place blanks nothing."""
    return F.coalesce(F.concat(F.substring(line, F.lit(1), at), F.repeat(F.lit(" "), length), F.substring(line, at + length + 1, F.length(line))), line)


def _label_blanked(line: Column, label: str) -> Column:
    return _blanked(line, _at(label, line), F.length(F.regexp_extract(line, f"(?i){label}", 0)))


def card_entries(lines: DataFrame, c: Cards) -> DataFrame:
    """doc, key, i and the fields of each printed card."""
    line = F.col("line")
    label = lambda p: line.rlike(rf"(?i)^\s{{0,4}}{p}")
    ahead = _lines().rowsBetween(1, c.reach)

    def next_(is_: Column, what: Column) -> Column:
        return F.first(F.when(is_, what), ignorenulls=True).over(ahead)

    link_text = F.trim(F.regexp_replace(line, rf"(?i)^\s{{0,4}}{c.link}", ""))
    later = F.transform(F.array(*(F.lead("line", k).over(_lines()) for k in (1, 2, 3))), lambda x: F.trim(x))
    follow = F.array_min(F.transform(later, lambda x, k: F.when(x != "", F.struct(k.alias("k"), x.alias("x")))))
    ended = F.when(link_text != "", F.struct((F.col("i") + 1).alias("end"), link_text.alias("link"))).otherwise(F.struct((F.col("i") + 1 + F.coalesce(follow["k"] + 1, F.lit(3))).alias("end"), F.coalesce(follow["x"], F.lit("")).alias("link")))
    chained = lines.withColumn("at_link", next_(label(c.link), F.struct(F.col("i").alias("link_at"), ended.alias("e"))))
    chained = chained.withColumn("at_start", next_(label(c.start) & F.col("at_link").isNotNull(), F.struct(F.col("i").alias("start_at"), F.col("at_link").alias("l"))))
    chained = chained.withColumn("at_dates", next_(label(c.opens) & F.col("at_start").isNotNull(), F.struct(F.col("i").alias("dates_at"), F.col("at_start").alias("s"))))
    chained = chained.withColumn("at_place", next_(label(c.location) & F.col("at_dates").isNotNull(), F.struct(F.col("i").alias("place_at"), F.col("at_dates").alias("d"))))
    opens = label(c.role) & line.rlike(c.level) & F.col("at_place").isNotNull()
    card = F.when(opens, F.struct(F.col("i").alias("i"), F.col("at_place").alias("p")))
    so_far = _lines().rowsBetween(Window.unboundedPreceding, 0)
    placed = chained.withColumns({"own": F.last(card, ignorenulls=True).over(so_far), "next": F.first(card, ignorenulls=True).over(_lines().rowsBetween(0, Window.unboundedFollowing))})
    i, end = F.col("i"), F.col("own.p.d.s.l.e.end")
    inside = F.coalesce(i < end, F.lit(False))
    # between two cards: a page number, a heading, the employer of the next
    told = ~inside & (F.trim("line") != "") & ~line.rlike(r"^\s*[0-9]{1,3}\s*$")
    placed = placed.withColumn("card", F.when(inside, F.col("own.i")).when(told, F.col("next.i"))).filter("card IS NOT NULL")
    place, dates, start, link = (F.col(f"own.p.{x}") for x in ("place_at", "d.dates_at", "d.s.start_at", "d.s.l.link_at"))
    kind = F.when(~inside, "before").when(i < place, "role").when(i < dates, "place").when(i < start, "dates").when(i < link, "start")
    last_level = F.length(F.regexp_extract(line, rf"(?i)^(.*){c.level}", 1))
    first_word = F.length(F.regexp_extract(line, r"^\s*", 0))
    role_line = _blanked(_blanked(line, last_level, F.lit(5)), first_word, F.length(F.regexp_extract(F.ltrim("line"), f"(?i)^{c.role}", 0)))
    plain = (
        F.when((kind == "role") & (i == F.col("card")), role_line)
        .when((kind == "place") & (i == place), _label_blanked(line, c.location))
        .when((kind == "dates") & (i == dates), _label_blanked(_label_blanked(line, c.opens), c.closes))
        .when((kind == "start") & (i == start), _label_blanked(_label_blanked(line, c.start), c.salary))
        .otherwise(line)
    )
    right = F.when((kind == "dates") & (i == dates), _at(c.closes, line)).when((kind == "start") & (i == start), _at(c.salary, line))
    split = placed.select("doc", "key", "card", "i", "line", kind.alias("kind"), right.alias("right"), F.when(kind.isNotNull() & (kind != "before"), runs(plain)).alias("cells"), F.when(inside, F.col("own.p.d.s.l.e.link")).alias("link"))
    rows = split.groupBy("doc", "key", "card").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "before", F.struct("i", F.trim("line").alias("line"))))).alias("before"),  # the lines of one card, and those above it
        F.array_sort(F.collect_list(F.when(F.col("cells").isNotNull(), F.struct("i", "kind", "cells")))).alias("held"),
        F.max(F.when(F.col("kind") == "dates", F.col("right"))).alias("right_dates"),
        F.max(F.when(F.col("kind") == "start", F.col("right"))).alias("right_start"),
        F.max("link").alias("link"),
    )

    def texts(kind: str, keep: Column | None = None, side: str | None = None, right: bool = False) -> Column:
        cells = F.flatten(F.transform(F.filter("held", lambda h: h["kind"] == kind), lambda h: h["cells"]))
        if side:
            at = F.coalesce(F.col(side), F.lit(1 << 30)) - 8
            cells = F.filter(cells, lambda s: (s["col"] >= at) if right else (s["col"] < at))
        return F.transform(cells, lambda s: s["text"])

    role = texts("role")
    level = F.get(F.filter(role, lambda x: x.rlike(f"(?i){LEVELS}")), F.lit(0))
    at = F.array_position(role, level)
    role_parts = F.when(level.isNull(), role).otherwise(F.concat(F.slice(role, F.lit(1), at.cast("int") - 1), F.slice(role, at.cast("int") + 1, F.size(role))))
    headings = F.filter(F.slice(F.transform("before", lambda b: b["line"]), F.lit(1), F.greatest(F.size("before") - 1, F.lit(0))), lambda x: x.rlike(f"(?i){c.section}"))
    heading = F.when(F.size(headings) > 0, F.element_at(headings, -1))
    section = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc").orderBy("card").rowsBetween(Window.unboundedPreceding, 0))
    empty = lambda x: F.nullif(x, F.lit(""))
    out = rows.select(
        "doc",
        "key",
        F.col("card").alias("i"),
        section.alias("section"),
        F.when(F.size("before") > 0, clean_name(F.element_at("before", -1)["line"])).alias("employer"),
        empty(join_wrapped(role_parts)).alias("role"),
        top_level(level).alias("level"),
        join_wrapped(texts("place")).alias("location"),
        empty(join_wrapped(texts("start", side="right_start", right=True))).alias("salary"),
        empty(join_wrapped(texts("dates", side="right_dates"))).alias("opens"),
        empty(join_wrapped(texts("dates", side="right_dates", right=True))).alias("closes"),
        empty(join_wrapped(texts("start", side="right_start"))).alias("start"),
        empty(F.regexp_extract("link", r"^\S+", 0)).alias("link"),
    )
    return out.filter("employer IS NOT NULL AND employer <> '' AND role IS NOT NULL")


def entries(docs: DataFrame, text: str, key: str, table: Table | None = None, cards: Cards | None = None) -> DataFrame:
    """key, i (its line) and the fields of every entry printed in a document, each once: by link, or by what it says.

    Null and empty texts, and those of neither layout, have no entries.  Repeated documents are read each for itself.
    """
    lines = lines_of(docs, text, key)
    read = [f for f in (table and table_entries(lines, table), cards and card_entries(lines, cards)) if f is not None]
    found = read[0] if len(read) == 1 else read[0].withColumn("layout", F.lit(0)).unionByName(read[1].withColumn("layout", F.lit(1)))
    found = found if "layout" in found.columns else found.withColumn("layout", F.lit(0))
    same = F.when(F.contains("link", F.lit("/")), F.col("link")).otherwise(F.concat_ws("|", "employer", "role", "location"))
    first = F.row_number().over(Window.partitionBy("doc", same).orderBy("layout", "i"))
    return found.withColumn("nth", first).filter("nth = 1").select("key", "i", *_FIELDS)


# editions


def edition_of(text: Column, url: Column, title: str) -> Column:
    """Struct of year and month: after ``title`` in the text, else in the file's name, else of the upload's folder."""
    month = "|".join(MONTH_NAMES) + "|" + "|".join(m[:3] for m in MONTH_NAMES)
    printed, file = rf"(?i){title}:\s*({month})\s+([0-9]{{4}})", rf"(?i)\b({month})[a-z]*-[\w-]*?([0-9]{{4}})[^/]*$"
    folder = r"/([0-9]{4})/([0-9]{2})/[^/]*$"
    name = F.regexp_extract(url, r"[^/]*$", 0)
    pick = lambda c, p, m, y: F.when(F.rlike(c, F.lit(p)), F.struct(F.regexp_extract(c, p, y).cast("int").alias("year"), month_number(F.regexp_extract(c, p, m)).alias("month")))
    by_folder = F.when(url.rlike(folder), F.struct(F.regexp_extract(url, folder, 1).cast("int").alias("year"), F.regexp_extract(url, folder, 2).cast("int").alias("month")))
    return F.coalesce(pick(text, printed, 1, 2), pick(name, file, 1, 2), by_folder)


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or its first three letters, else null."""
    short = F.array(*(F.lit(m[:3].lower()) for m in MONTH_NAMES))
    return F.nullif(F.array_position(short, F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def month_of(text: Column, edition: Column) -> Column:
    """The first day of the month that a text names; one without a year is that after the edition, or the month before."""
    pattern = r"(?i)\b((?:" + "|".join(m[:3] for m in MONTH_NAMES) + r")[a-z]*)\b(?:\s+([0-9]{4}))?"
    month = month_number(F.regexp_extract(text, pattern, 1))
    year = F.regexp_extract(text, pattern, 2).try_cast("int")
    guessed = F.when(month >= edition["month"] - 1, edition["year"]).otherwise(edition["year"] + 1)
    return F.make_date(F.coalesce(year, guessed), month, F.lit(1))


def newest_first(urls: Column, folder: str = r"/([0-9]{4}/[0-9]{2})/[^/]*$") -> Column:
    """Distinct URLs by the folder they were put in, newest first, in their order within one; those without come last."""
    listed = F.array_distinct(urls)
    keyed = F.transform(listed, lambda u, k: F.struct(F.regexp_extract(u, folder, 1).alias("folder"), (-k).alias("k"), u.alias("u")))
    return F.transform(F.reverse(F.array_sort(keyed)), lambda x: x["u"])


def split_places(text: Column) -> Column:
    """Struct of places and is_national: places that commas, slashes or "and" divide, if each is short; else the text."""
    plain = F.regexp_replace(collapse_spaces(text), r"[,;]\s*$", "")
    national = plain.rlike(r"(?i)^(?:national(?:ly)?|nationwide|uk[- ]?wide|across (?:the )?uk)$")
    parts = F.filter(F.transform(F.split(plain, r"(?i)\s*[,;/]\s*|\s+(?:and|or|&)\s+", -1), lambda p: F.trim(p)), lambda p: p != "")
    several = (F.size(parts) > 1) & F.forall(parts, lambda p: F.size(F.split(p, " ")) <= 4)
    none = F.array().cast("array<string>")
    places = F.when(plain.isNull() | (plain == "") | national | plain.rlike(r"(?i)^(?:multiple|various)(?: locations)?$"), none).when(several, parts).otherwise(F.array(plain))
    return F.struct(places.alias("places"), F.coalesce(national, F.lit(False)).alias("is_national"))


def listings(found: DataFrame, edition: Column, url: Column) -> DataFrame:
    """``found`` with closing_date (the month's last day), start_date, places, is_national, apply_url and source_id."""
    closes, start = month_of(F.col("closes"), edition), month_of(F.col("start"), edition)
    mail = F.col("link").rlike(r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$")
    web = F.when(F.col("link").isNull() | mail, None).when(F.col("link").rlike("(?i)^https?://"), F.col("link")).otherwise(F.concat(F.lit("https://"), F.col("link")))
    named = slugify(F.concat_ws(" ", "employer", "role", "location"))
    spread = split_places(F.col("location"))
    return found.withColumns({
        "closing_date": F.last_day(closes), "start_date": start, "places": spread["places"], "is_national": spread["is_national"],
        "salary": F.regexp_replace("salary", r"([0-9]),\s+([0-9]{3})\b", "$1,$2"),
        "url": F.coalesce(web, url), "apply_url": F.when(mail, F.concat(F.lit("mailto:"), F.col("link"))), "source_id": F.substring(named, 1, 120),
    })


def newest_edition(found: DataFrame, series: Sequence[str], edition: str) -> DataFrame:
    """The rows of each series' newest edition; an older one that comes later counts for nothing.

    Only the editions are grouped and joined back; rows without one are kept where their series has none.
    """
    top = found.groupBy(*series).agg(F.max(edition).alias("newest edition"))
    met = found.join(top, list(series))
    return met.filter(F.col(edition).eqNullSafe(F.col("`newest edition`"))).select(*(f"`{c}`" for c in found.columns))


def re_emitted(stored: DataFrame, fresh: DataFrame, today: Column, every: int = 6) -> tuple[DataFrame, DataFrame]:
    """What each source gives today, and its new state.

    :param stored: source, url, checked (day), entries: what was read last.
    :param fresh: source, url, entries of today's look at sources; url null where nothing was found.
    :return: (source, url, entries, how), (source, url, checked, entries).

    A source that was checked less than ``every`` days ago gives what is stored, as does one whose URL is unchanged or
    not found; the last keeps its day, so it is looked at again tomorrow.  A source that is in neither has no row.
    """
    s = stored.select("source", F.col("url").alias("old_url"), "checked", F.col("entries").alias("old"))
    f = fresh.select("source", F.col("url").alias("new_url"), F.col("entries").alias("new"))
    due = F.col("checked").isNull() | (F.datediff(today, F.col("checked")) >= every)
    how = F.when(~due, "not due").when(F.col("new_url").isNull(), "not found").when(F.col("new_url").eqNullSafe(F.col("old_url")), "unchanged").otherwise("new")
    both = s.join(f, "source", "full_outer").withColumn("how", how)
    is_new = F.col("how") == "new"
    both = both.select("source", F.when(is_new, F.col("new_url")).otherwise(F.col("old_url")).alias("url"), F.when(is_new | (F.col("how") == "unchanged"), today).otherwise(F.col("checked")).alias("checked"), F.when(is_new, F.col("new")).otherwise(F.col("old")).alias("entries"), "how")
    return both.select("source", "url", "entries", "how"), both.select("source", "url", "checked", "entries")
