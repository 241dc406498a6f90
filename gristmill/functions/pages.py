"""Pages of adverts: safe HTML, almost-JSON, hidden parts, gone pages, marked-up fields, headlines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import collapse_spaces, decode_entities, html_to_text
from gristmill.session import ship

# Elements that are kept, headings that become smaller, and schemes of links.
KEPT = frozenset("p br ul ol li strong b em i u a h3 h4 h5 blockquote".split())
SMALLER = {"h1": "h3", "h2": "h3"}
SCHEMES = ("http:", "https:", "mailto:")
_DROPPED = frozenset(("script", "style", "textarea", "option", "noscript"))


class _Safe(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.silent += tag in _DROPPED
        tag = SMALLER.get(tag, tag)
        if tag not in KEPT or self.silent:
            return
        link = next((v or "" for k, v in attrs if k == "href"), "").strip()
        safe = link.lower().startswith(SCHEMES) or link and ":" not in link.split("/")[0]
        extra = f' href="{escape(link)}"' if safe else ""
        self.out.append(f'<a{extra} target="_blank" rel="noopener noreferrer nofollow">' if tag == "a" else f"<{tag}>" if tag != "br" else "<br />")
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.silent = max(0, self.silent - 1)
        tag = SMALLER.get(tag, tag)
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                # a paragraph without text goes
                if last == "p" and self.out and self.out[-1] == "<p>":
                    self.out.pop()
                else:
                    self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(escape(data, quote=False))


def _safe(html: str) -> str:
    parser = _Safe()
    parser.feed(html)
    parser.close()
    parser.out += [f"</{t}>" for t in reversed(parser.open)]
    return "".join(parser.out).strip()


def _mapped(c: Column, one: Callable[[str], str | None]) -> Column:
    """``one`` of each text, in Arrow batches; null stays null."""
    ship(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(c)


def sanitise(html: Column) -> Column:
    """HTML with simple formatting and links only; scripts and styles go with what they hold.  Null stays null."""
    return _mapped(html, _safe)


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def lenient_json(c: Column) -> Column:
    """A variant of JSON, or of what is JSON but for comments and raw control characters; null of anything else.

    Strings are matched first, so what looks like a comment in one stays.
    """
    bare = F.regexp_replace(c, rf"(?s)({_STRING})|//[^\r\n]*+|/\*.*?\*/", "$1")
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_replace(bare, r"[\x00-\x1f]+", " ")))


def object_at(c: Column, begin: Column) -> Column:
    """The object or array that begins at a place of a text (counted from 1), up to the bracket that closes it; or null.

    One pass over strings' quotes, escapes, brackets and what lies between, keeping place, depth and the end.
    """
    rest = F.substring(c, begin, F.length(c))
    tokens = F.regexp_extract_all(rest, F.lit(r"(?s)(\\.|[\"{}\[\]]|[^\"\\{}\[\]]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("end"))

    def step(state: Column, t: Column) -> Column:
        quote = t == '"'
        turn = F.when(state["quoted"], 0).when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        at, depth = state["at"] + F.length(t), state["depth"] + turn
        end = F.when(state["end"] > 0, state["end"]).when((depth == 0) & (turn < 0), at).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(quote, ~state["quoted"]).otherwise(state["quoted"]).alias("quoted"), end.alias("end"))

    end = F.aggregate(tokens, start, step, lambda s: s["end"])
    return F.when(rest.rlike(r"^[{\[]") & (end > 0), F.substring(rest, F.lit(1), end))


def embedded_json(c: Column, marker: str) -> Column:
    """The text of the first object or array after a marker in a page's script, by matching its brackets; null without."""
    at = F.locate(marker, c)
    ahead = F.regexp_instr(F.substring(c, at, F.length(c)), F.lit(r"[{\[]"))
    return F.when((at > 0) & (ahead > 0), object_at(c, at + ahead - 1))


def looks_gone(html: Column, status: Column, phrases: Sequence[str], asked: Column, landed: Column) -> Column:
    """Whether an answer says that a job has gone: its status, one of some phrases, or a landing on a page without its id."""
    says = F.lower(html_to_text(F.coalesce(html, F.lit(""))))
    told = F.lit(False)
    for p in phrases:
        told = told | F.contains(says, F.lit(p.lower()))
    number = F.regexp_extract(asked, r"([0-9]{4,})", 1)
    elsewhere = (number != "") & ~F.contains(F.coalesce(landed, asked), number)
    return status.isin(404, 410) | F.coalesce(told, F.lit(False)) | F.coalesce(elsewhere, F.lit(False))


def marked_field(html: Column, name: str) -> Column:
    """The first value that a page marks with an itemprop: its content attribute, else the element's text."""
    tag = rf"""(?is)<[a-z0-9]+\b[^>]*\bitemprop=["']{name}["'][^>]*>"""
    content = F.regexp_extract(F.regexp_extract(html, f"({tag})", 1), r"""(?is)\bcontent=["']([^"']*)""", 1)
    inner = F.regexp_extract(html, rf"{tag}([^<]*)", 1)
    return F.nullif(collapse_spaces(decode_entities(F.coalesce(F.nullif(content, F.lit("")), inner))), F.lit(""))


def headlines(html: Column, words: str, most: int = 5, chars: int = 120) -> Column:
    """Up to ``most`` different lines of a page that match ``words``, none longer than ``chars``."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    lines = F.split(F.regexp_replace(bare, r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|section|article|tr|td|br)\b)[^>]*>", "\n"), "\n")
    told = F.transform(lines, lambda x: html_to_text(x))
    return F.slice(F.array_distinct(F.filter(told, lambda x: x.rlike(words) & (F.length(x) <= chars))), 1, most)
