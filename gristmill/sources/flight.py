"""Page data that a site's server streams into many script tags: put together, cut into rows, references resolved.

A page pushes pieces of one long text, cut anywhere, in order.  Together they are lines ``id:value``; a value is JSON, or
a text with its length before it, and a string ``"$id"`` in it stands for another line's value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.pages import object_at
from gristmill.session import Scratch, materialise

_PUSH = r"(?s)self\.__next_f\.push\((\[.*?\])\)\s*</script>"
_REFERENCE = r'"\$L?([0-9a-f]+)"'


def payload(html: Column) -> Column:
    """The text that a page's scripts push, in order; '' without any.  Pieces that are no JSON count for nothing."""
    pieces = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PUSH), F.lit(1))
    return F.array_join(F.array_compact(F.transform(pieces, lambda p: F.try_variant_get(F.try_parse_json(p), "$[1]", "string"))), "")


def lines(pages: DataFrame, html: str, key: str) -> DataFrame:
    """key, id, value of the lines of each page's payload: the first of an id, the value as JSON.

    A line ends before the next one that begins with an id, so texts may have lines of their own.  Values that are no
    JSON are left out.
    """
    found = pages.select(F.col(f"`{key}`").alias("key"), F.posexplode(F.split(payload(F.col(f"`{html}`")), r"(?m)\n?^(?=[0-9a-f]+:)", -1)).alias("at", "line"))
    value = F.regexp_extract("line", r"(?s)^[0-9a-f]+:(.*)$", 1)
    text = F.when(value.rlike("^T[0-9a-f]+,"), F.to_json(F.struct(F.regexp_extract(value, r"(?s)^T[0-9a-f]+,(.*)$", 1).alias("t"))))
    whole = F.coalesce(F.regexp_extract(text, r"(?s)^\{\"t\":(.*)\}$", 1), F.trim(value))
    rows = found.filter(F.col("line").rlike("^[0-9a-f]+:")).select("key", "at", F.regexp_extract("line", "^([0-9a-f]+):", 1).alias("id"), whole.alias("value"))
    return rows.filter(F.try_parse_json("value").isNotNull()).groupBy("key", "id").agg(F.min_by("value", "at").alias("value"))


def resolved(found: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """key, id, value: lines with the values of others in place of their references.

    :param found: key, id, value.
    :param wanted: ids that are asked for; without it all lines.

    In each round the lines that refer to no other are put in wherever they are asked for, by joins, until none is asked
    for any more: a round for each depth.  References to lines that don't exist stay, as do those in circles and to them.
    """
    with Scratch(found.sparkSession) as keep:
        rows = keep(found.select("key", "id", "value"), "lines")
        step = 0
        while True:
            step += 1
            asked = rows.select("key", "id", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(_REFERENCE), F.lit(1)))).alias("of"))
            asked = keep(asked.join(rows.select("key", F.col("id").alias("of")), ["key", "of"], "left_semi"), f"asked{step}")
            settled = rows.join(asked, ["key", "id"], "left_anti").select("key", F.col("id").alias("of"), F.col("value").alias("given"))
            met = keep(asked.join(settled, ["key", "of"]), f"met{step}")
            keep.drop(asked)
            if met.isEmpty():
                keep.drop(met)
                break
            parts = met.groupBy("key", "id").agg(F.map_from_entries(F.collect_list(F.struct("of", "given"))).alias("parts"))  # one line's references
            texts, names = F.split("value", _REFERENCE, -1), F.regexp_extract_all("value", F.lit(_REFERENCE), F.lit(1))
            marks = F.regexp_extract_all("value", F.lit(_REFERENCE), F.lit(0))
            filled = F.transform(F.arrays_zip(names.alias("n"), marks.alias("m")), lambda x: F.coalesce(F.try_element_at("parts", x["n"]), x["m"]))
            value = F.when(F.col("parts").isNotNull(), F.array_join(F.zip_with(texts, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("value"))
            now = keep(rows.join(parts, ["key", "id"], "left").select("key", "id", value.alias("value")), f"lines{step}")
            keep.drop(rows, met)
            rows = now
        if wanted is not None:
            rows = rows.filter(F.col("id").isin(*wanted))
        return materialise(rows, "resolved")


def record(text: Column, name: str) -> Column:
    """The first object of a name in a payload or a line's value, as a variant; null without one."""
    begin = F.regexp_instr(text, F.lit(rf'"{name}"\s*:\s*\{{'))
    opened = F.length(F.regexp_extract(text, rf'("{name}"\s*:\s*)\{{', 1))
    return F.when(begin > 0, F.try_parse_json(object_at(text, begin + opened)))


def is_complete(found: Column, total: Column, failed: Column) -> Column:
    """Whether a search's first page has all that it says there is; a page that says nothing can't tell."""
    return F.coalesce((found >= total) & ~F.coalesce(failed, F.lit(False)), F.lit(False))


def item_list(html: Column) -> Column:
    """Struct of total and items (url, name) of a page's structured list of items; the total is the number in its name."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))

    def nodes(script: Column) -> Column:
        body = F.try_parse_json(F.trim(script))
        return F.coalesce(F.try_variant_get(body, "$", "array<variant>"), F.try_variant_get(body, "$['@graph']", "array<variant>"), F.array(body))

    listed = F.filter(F.flatten(F.transform(scripts, nodes)), lambda n: F.try_variant_get(n, "$['@type']", "string") == "ItemList")
    one = F.get(listed, F.lit(0))
    number = F.regexp_replace(F.regexp_extract(F.try_variant_get(one, "$.name", "string"), "([0-9][0-9,]*)", 1), ",", "").try_cast("long")
    elements = F.try_variant_get(one, "$.itemListElement", "array<variant>")
    items = F.transform(elements, lambda e: F.struct(F.coalesce(F.try_variant_get(e, "$.url", "string"), F.try_variant_get(e, "$.item.url", "string")).alias("url"), F.coalesce(F.try_variant_get(e, "$.name", "string"), F.try_variant_get(e, "$.item.name", "string")).alias("name")))
    none = F.array().cast("array<struct<url:string,name:string>>")
    return F.struct(number.alias("total"), F.coalesce(F.filter(items, lambda i: i["url"].isNotNull()), none).alias("items"))
