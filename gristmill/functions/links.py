"""URL columns: hosts, kinds and ranks of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without www, or null."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def under(host_: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one; an unknown host counts as one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host_ == d) | host_.endswith("." + d)
    return F.coalesce(hit, F.lit(True))


def link_kind(url: Column, own: Sequence[str], boards: Sequence[str]) -> Column:
    """own, board or other; null for what is no URL."""
    h = host(url)
    return F.when(h.isNull(), None).when(under(h, own), "own").when(under(h, boards), "board").otherwise("other")


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "own", 0).when(kind == "other", 1).when(kind == "board", 2).otherwise(3)


def strip_session(url: Column) -> Column:
    """A URL without session tokens in its path or query."""
    url = F.regexp_replace(url, r"(?i);jsessionid=[^?#]*", "")
    url = F.regexp_replace(url, r"(?i)([?&])(?:jsessionid|phpsessid|sid|session|sessionid)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"&{2,}", "&"), r"\?&", "?"), r"[?&](#|$)", "$1")


def redact(url: Column, keys: Sequence[str]) -> Column:
    """A URL with the values of some query keys hidden."""
    return F.regexp_replace(url, r"(?i)([?&](?:" + "|".join(keys) + r")=)[^&#]*", "$1***")


def slug_words(url: Column) -> Column:
    """The words of a URL's last path part, without its extension and numbers of its own."""
    part = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+)/?$", 1)
    plain = F.try_url_decode(F.regexp_replace(part, r"\.[a-zA-Z]{2,5}$", ""))
    return F.filter(F.split(F.lower(F.coalesce(plain, part)), "[^a-z0-9]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


def rank_links(found: Column, order: Sequence[str]) -> Column:
    """Links (url, kind, dead) best first: by kind, then as they came; each URL once, and none that is dead anywhere."""
    dead = F.transform(F.filter(found, lambda x: x["dead"]), lambda x: x["url"])
    alive = F.filter(found, lambda x: x["url"].isNotNull() & ~F.array_contains(dead, x["url"]))
    kinds, urls = F.array(*map(F.lit, order)), F.transform(alive, lambda x: x["url"])
    placed = F.transform(alive, lambda x, i: F.struct(F.coalesce(F.nullif(F.array_position(kinds, x["kind"]), F.lit(0)), F.lit(len(order) + 1)).alias("rank"), i.alias("i"), x["url"].alias("url")))
    once = F.filter(placed, lambda x: F.array_position(urls, x["url"]) == x["i"] + 1)
    return F.transform(F.array_sort(once), lambda x: x["url"])
