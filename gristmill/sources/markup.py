"""Pages as streams of tags: which tag closes which, what is hidden, and microdata with nested scopes.

A page is cut once into texts and tags.  Only tags of the element names that matter in the page (those that carry a mark)
are rows.  A running sum of openings and closings of a name gives each tag its depth, and an opening is closed by the
next tag of its name at its depth: a window over the rows of a page, so the work is that of its tags, however deep they
nest.  The page itself goes along on one row and is put together again in the group of its rows; no key is needed, so
repeated pages are read each for itself.

Scripts, styles and comments are one tag each, so nothing in them counts.  A closing without an opening counts for
nothing.  A hidden element that isn't closed goes to the end of the page; an item that isn't closed, and is in no other,
is around all that follows it, and one within another holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gristmill.functions.text import collapse_spaces, decode_entities, filled, html_to_text, let

_TAG = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[a-z][^>]*>"
#: Elements that hold nothing and are never closed.
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; null without it, empty where it has none."""
    stated = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, stated, g) for g in (1, 2, 3)))
    return F.when(F.rlike(tag, F.lit(stated)), value).when(F.rlike(tag, F.lit(rf"(?is)\s{name}(?=[\s/>])")), F.lit(""))


def _name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def _stream(pages: DataFrame, html: str, marked: Callable[[Column], Column]) -> DataFrame:
    """Rows of tags whose name some marked opening of the page has: page, k, tag, name, closing, is_marked, end.

    ``end`` is the number of the tag that closes an opening.  The row with k = -1 has ``doc`` and ``pieces`` (text, tag,
    text, ...; tag k is piece 2 k + 1).
    """
    cut = pages.select(F.monotonically_increasing_id().alias("page"), F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("doc"), F.col(f"`{html}`").alias("html"))
    tags, texts = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), F.split("html", _TAG, -1)
    cut = cut.select("page", "doc", tags.alias("tags"), texts.alias("texts"))
    listed = F.transform("tags", lambda t, k: F.struct(k.alias("k"), t.alias("tag"), _name(t).alias("name"), t.startswith("</").alias("closing"), (~t.startswith("</") & F.coalesce(marked(t), F.lit(False))).alias("is_marked")))
    cut = cut.withColumn("listed", F.filter(listed, lambda t: (t["name"] != "") & ~t["name"].isin("script", "style")))
    cut = cut.withColumn("names", F.array_distinct(F.transform(F.filter("listed", lambda t: t["is_marked"]), lambda t: t["name"])))
    wanted = F.filter("listed", lambda t: F.array_contains(F.col("names"), t["name"]))
    pieces = F.flatten(F.zip_with("texts", "tags", lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    first = F.array(F.struct(F.lit(-1).alias("k"), F.lit(None).cast("string").alias("tag"), F.lit("").alias("name"), F.lit(False).alias("closing"), F.lit(False).alias("is_marked")))
    rows = cut.select("page", "doc", pieces.alias("pieces"), F.explode(F.concat(first, F.coalesce(wanted, F.array().cast("array<struct<k:int,tag:string,name:string,closing:boolean,is_marked:boolean>>")))).alias("t"))
    head = F.col("t.k") == -1
    rows = rows.select("page", F.when(head, F.col("doc")).alias("doc"), F.when(head, F.col("pieces")).alias("pieces"), "t.*").repartition("page")
    depth = F.sum(F.when(F.col("name").isin(*EMPTY), 0).when(F.col("closing"), -1).otherwise(1)).over(Window.partitionBy("page", "name").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", depth + F.when(F.col("closing"), 1).otherwise(0))
    same = Window.partitionBy("page", "name", "level").orderBy("k")
    holds = ~F.col("closing") & ~F.col("name").isin("", *EMPTY)
    follows = F.lead(F.struct("k", "closing")).over(same)
    return rows.withColumns({"end": F.when(holds & F.coalesce(follows["closing"], F.lit(False)), follows["k"]), "opened": F.when(F.col("closing"), F.lag(F.struct("k", "closing", "is_marked", "tag")).over(same))})


def _in_page() -> WindowSpec:
    return Window.partitionBy("page").orderBy("k")


def without_hidden(pages: DataFrame, html: str, mark: str, names: Sequence[str] = ("div", "section")) -> DataFrame:
    """``pages`` without the elements of some names whose tag has ``mark`` (an expression), and all that they hold.

    A space stands for each.  Elements of the same name within are counted, so the right tag ends it.  Null and empty
    pages stay.  Of hidden elements that cross each other (which sound pages don't have) both go.
    """
    rows = _stream(pages, html, lambda t: _name(t).isin(*names) & F.rlike(t, F.lit(f"(?i){mark}")))
    last = F.when(F.col("is_marked"), F.coalesce("end", F.lit(1 << 28)))
    rows = rows.withColumn("far", F.max(last).over(_in_page().rowsBetween(Window.unboundedPreceding, 0)))
    hidden = rows.groupBy("page").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.first("pieces", ignorenulls=True).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("is_marked"), F.struct("k", "far")))).alias("gone"),  # one page's
    )
    # the parts between: from the furthest end so far to the next hidden opening
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: 2 * g["far"] + 2))
    ends = F.concat(F.transform("gone", lambda g: 2 * g["k"] + 1), F.array(F.size("pieces")))
    kept = F.zip_with(begins, ends, lambda a, b: F.when(b > a, F.array_join(F.slice(F.col("pieces"), a + 1, F.greatest(b - a, F.lit(0))), "")).when(b == F.size(F.col("pieces")), ""))
    text = F.when(F.col("pieces").isNull(), F.lit(None).cast("string")).otherwise(F.array_join(F.array_compact(kept), " "))
    return hidden.select(*(text.alias(c) if c == html else F.col(f"doc.`{c}`") for c in pages.columns))


def microdata(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` with ``items``: its microdata items in order, each once.

    An item has k (its tag's number), parent (that of the item it is a property of, null for top ones), types, and props:
    name, value, html (what its element holds), item (where it is an item itself), in order.  A property belongs to the
    innermost item around it, other than itself.  Its value is its content attribute, else of a link or an image its
    address, else its element's text.  Pages without microdata, null and empty ones have no items.
    """
    is_item = lambda t: attribute(t, "itemscope").isNotNull()
    rows = _stream(pages, html, lambda t: is_item(t) | attribute(t, "itemprop").isNotNull())
    opens_item = F.col("is_marked") & is_item(F.col("tag")) & F.col("end").isNotNull()
    closes_item = F.coalesce(F.col("opened.is_marked") & is_item(F.col("opened.tag")) & ~F.col("opened.closing"), F.lit(False))
    step = F.when(opens_item, 1).when(closes_item, -1).otherwise(0)
    rows = rows.withColumn("opens_item", opens_item).withColumn("within", F.sum(step).over(_in_page().rowsBetween(Window.unboundedPreceding, 0)))
    # an opening item stands at two depths: as a property of the one around it, and as the one around what follows;
    # one that isn't closed is around all that follows outside other items, if it stands in none itself
    sides = F.array(
        F.struct((F.col("within") - F.when(F.col("opens_item"), 1).otherwise(0)).alias("depth"), F.lit(False).alias("around")),
        F.struct(F.when(F.col("opens_item") | (F.col("is_marked") & is_item(F.col("tag")) & (F.col("within") == 0) & ~F.col("name").isin(*EMPTY)), F.col("within")).alias("depth"), F.lit(True).alias("around")),
    )
    rows = rows.withColumn("side", F.explode(F.filter(sides, lambda s: s["depth"].isNotNull()))).select("page", "k", "tag", "doc", "pieces", "end", "is_marked", "side.*")
    around = F.last(F.when(F.col("around"), F.col("k")), ignorenulls=True).over(Window.partitionBy("page", "depth").orderBy("k", "around").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("item", around).filter("NOT around AND (k = -1 OR is_marked)")
    tag = F.col("tag")
    marked = F.struct("k", "end", F.col("item").alias("parent"), attribute(tag, "itemtype").alias("types"), attribute(tag, "itemprop").alias("name"), is_item(tag).alias("is_item"), F.coalesce(attribute(tag, "content"), F.when(_name(tag).isin("a", "link", "area"), attribute(tag, "href")), F.when(_name(tag).isin("img", "source", "embed"), attribute(tag, "src"))).alias("stated"))
    found = rows.groupBy("page").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.first("pieces", ignorenulls=True).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("is_marked"), marked))).alias("marked"),  # one page's
    )
    held = lambda m: F.when(m["end"].isNotNull(), F.array_join(F.slice(F.col("pieces"), 2 * m["k"] + 3, 2 * (m["end"] - m["k"]) - 1), ""))

    def prop(m: Column) -> Column:
        def of(inner: Column) -> Column:
            value = F.when(m["stated"].isNotNull(), collapse_spaces(decode_entities(m["stated"]))).when(~m["is_item"], html_to_text(inner))
            return F.struct(m["name"].alias("name"), filled(value).alias("value"), inner.alias("html"), F.when(m["is_item"], m["k"]).alias("item"), m["parent"].alias("of"))

        return let(held(m), of)

    def listed(props: Column) -> Column:
        own = lambda k: F.transform(F.filter(props, lambda p: p["of"] == k), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), p["html"].alias("html"), p["item"].alias("item")))
        return F.transform(F.filter("marked", lambda m: m["is_item"]), lambda m: F.struct(m["k"].alias("k"), F.when(m["name"].isNotNull(), m["parent"]).alias("parent"), m["types"].alias("types"), own(m["k"]).alias("props")))

    # all properties are read before they are dealt to their items: a column of its own would be put into each item's
    props = F.transform(F.filter("marked", lambda m: m["name"].isNotNull() & m["parent"].isNotNull()), prop)
    items = let(props, listed)
    return found.select(*(F.col(f"doc.`{c}`") for c in pages.columns if c != "items"), items.alias("items"))


def _of(item: Column, name: str) -> Column:
    """An item's first property of a name."""
    # most names are one word, and hold the name or not
    return F.get(F.filter(item["props"], lambda p: F.contains(p["name"], F.lit(name)) & ((p["name"] == name) | F.array_contains(F.split(p["name"], r"\s+"), name))), F.lit(0))


def _item(items: Column, k: Column) -> Column:
    return F.get(F.filter(items, lambda i: i["k"] == k), F.lit(0))


def posting(items: Column) -> Column:
    """The first job posting of a page's items as a struct of title, description, posted, closes, place, city, region,
    postcode, country, employer, identifier, url; null without one.

    The employer's name and the address are looked for in the items that these properties are, else in their texts.
    """
    job = F.get(F.filter(items, lambda i: F.rlike(F.coalesce(i["types"], F.lit("")), F.lit(r"(?i)schema\.org/JobPosting\b"))), F.lit(0))

    def around(j: Column) -> Column:
        """The items that a job's place and employer are."""
        own = F.struct(_of(j, "jobLocation").alias("where"), _of(j, "hiringOrganization").alias("org"), _of(j, "identifier").alias("number"))

        def told(o: Column, place: Column) -> Column:
            return F.struct(o["where"].alias("where"), o["org"].alias("org"), place.alias("place"), F.coalesce(_item(items, _of(place, "address")["item"]), place, j).alias("address"), _item(items, o["org"]["item"]).alias("who"), o["number"].alias("number"), _item(items, o["number"]["item"]).alias("numbered"))

        return let(own, lambda o: let(_item(items, o["where"]["item"]), lambda place: told(o, place)))

    return let(job, lambda j: F.when(j.isNotNull(), let(around(j), lambda k: _fields(j, k))))


def _fields(job: Column, known: Column) -> Column:
    text = lambda name: _of(job, name)["value"]
    org, where, place, address = (known[n] for n in ("org", "where", "place", "address"))
    part = lambda name: _of(address, name)["value"]
    parts = [part(n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    written = filled(F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ", "))
    told = F.coalesce(written, _of(place, "address")["value"], where["value"], F.when(where["item"].isNotNull(), filled(html_to_text(where["html"]))))
    name = F.coalesce(_of(known["who"], "name")["value"], org["value"], filled(html_to_text(org["html"])))
    fields = {
        "title": text("title"), "description": F.coalesce(F.trim(_of(job, "description")["html"]), text("description")), "posted": text("datePosted"), "closes": text("validThrough"),
        "place": told, "city": parts[1], "region": parts[2], "postcode": parts[3], "country": parts[4], "employer": name,
        "identifier": F.coalesce(_of(known["numbered"], "value")["value"], known["number"]["value"]), "url": text("url"),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))
