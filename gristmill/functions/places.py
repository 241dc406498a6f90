"""Where an advert is: in the United Kingdom or abroad, and which place of a gazetteer its text names."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import EARTH_MILES, haversine_miles
from gristmill.functions.text import place_key

# Names of the country and its parts, and its codes.
UK_NAMES = ("united kingdom", "great britain", "england", "scotland", "wales", "northern ireland")
UK_CODES = ("GB", "GBR", "UK")


def _named(words: Sequence[str]) -> str:
    return r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def is_uk(country: Column, text: Column, known: Column, abroad: Sequence[str] = ()) -> Column:
    """True for a place in the United Kingdom, false for one abroad, null where nothing tells.

    :param known: whether a gazetteer or a postcode places ``text`` there.
    :param abroad: names of countries and towns elsewhere, matched as whole words; of the caller's own table.
    """
    country, text = F.trim(F.coalesce(country, F.lit(""))), F.coalesce(text, F.lit(""))
    elsewhere = (lambda c: c.rlike(_named(abroad))) if abroad else (lambda c: F.lit(False))
    own = F.when(text.rlike(_named(UK_NAMES)) | text.rlike(r"\b(?:" + "|".join(UK_CODES) + r")\b"), True)
    of_country = F.when(F.lower(country).isin(*UK_NAMES, *(c.lower() for c in UK_CODES)), True).when(country.rlike("^[A-Z]{2,3}$") | elsewhere(country), False)
    return F.coalesce(of_country, own, F.when(elsewhere(text), False), F.when(F.coalesce(known, F.lit(False)) & (text != ""), True))


def all_abroad(places: Column) -> Column:
    """Whether every place is known to be abroad; no places, or an unknown one, are not."""
    return (F.size(places) > 0) & F.forall(places, lambda p: F.coalesce(~p, F.lit(False)))


def gazetteer_keys(gazetteer: DataFrame) -> DataFrame:
    """place, key, lat, lon: a row for each name of a place, one place a key; points beat areas, then the first name.

    :param gazetteer: place, names (array), is_point, lat, lon.
    """
    named = gazetteer.select("place", "is_point", "lat", "lon", F.explode("names").alias("name")).withColumn("key", place_key(F.col("name")))
    best = F.min_by(F.struct("place", "lat", "lon"), F.struct(~F.col("is_point"), F.col("place")))
    return named.filter("key != ''").groupBy("key").agg(best.alias("p")).select("key", "p.*")


def find_places(rows: DataFrame, text: str, gazetteer: DataFrame, most_words: int = 3) -> DataFrame:
    """``rows`` with ``place``, ``lat`` and ``lon``: of the gazetteer's names in a text the longest, the first on a tie.

    Every run of up to ``most_words`` words is exploded and joined by equality, so no text meets the whole gazetteer.  A
    row itself goes along once, with its first run; the others have its number only.  Columns of ``rows`` with these
    names are replaced.
    """
    names = [c for c in rows.columns if c not in ("place", "lat", "lon")]
    words = F.split(place_key(F.col(f"`{text}`")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(words) - i + 1)), lambda n: F.struct(F.array_join(F.slice(words, i, n), " ").alias("key"), n.alias("n"), (-i).alias("i")))))
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), runs.alias("runs"))
    spread = numbered.select("number", "doc", F.posexplode("runs").alias("at", "run")).select("number", F.when(F.col("at") == 0, F.col("doc")).alias("doc"), "run.*")
    met = spread.join(gazetteer_keys(gazetteer), "key", "left")
    best = F.max_by(F.struct("place", "lat", "lon"), F.when(F.col("place").isNotNull(), F.struct("n", "i")))
    found = met.groupBy("number").agg(F.first("doc", ignorenulls=True).alias("doc"), best.alias("p"))
    return found.select(*(F.col(f"doc.`{c}`") for c in names), "p.*")


def _width(band: Column, step: float, lat: Column | None = None) -> Column:
    """Degrees of longitude that ``step`` degrees of latitude take at most in a band, and at a latitude beside it."""
    far = F.greatest(F.abs(band * step), F.abs((band + 1) * step), *([] if lat is None else [F.abs(lat)]))
    return step * 1.01 / F.cos(F.radians(F.least(F.lit(89.0), far)))


def cell_of(lat: Column, lon: Column, miles: float) -> Column:
    """The cell of a grid, about ``miles`` wide, that a point lies in, as a text: band of latitude, cell of the band."""
    step = math.degrees(miles / EARTH_MILES)
    band = F.floor(lat / step)
    return F.concat_ws(":", band.cast("string"), F.floor(lon / _width(band, step)).cast("string"))


def cells_in_reach(lat: Column, lon: Column, miles: float) -> Column:
    """All cells that points within ``miles`` may lie in; the date line isn't crossed."""
    step = math.degrees(miles / EARTH_MILES)

    def of_band(band: Column) -> Column:
        wide, own = _width(band, step, lat), _width(band, step)
        return F.transform(F.sequence(F.floor((lon - wide) / own), F.floor((lon + wide) / own)), lambda cell: F.concat_ws(":", band.cast("string"), cell.cast("string")))

    return F.flatten(F.transform(F.sequence(F.floor((lat - step) / step), F.floor((lat + step) / step)), of_band))


def nearest(rows: DataFrame, gazetteer: DataFrame, miles: float) -> DataFrame:
    """``rows`` (with lat and lon) with ``place`` and ``miles``: the nearest place of a gazetteer within so many miles.

    :param gazetteer: place, place_lat, place_lon.

    Places lie in cells; a row meets those of the cells in its reach, by equality, so neither side is gathered or
    broadcast as a whole.  Nulls, and rows without a place in reach, get null.  The date line isn't crossed.
    """
    cells = gazetteer.filter("place_lat IS NOT NULL AND place_lon IS NOT NULL").withColumn("cell", cell_of(F.col("place_lat"), F.col("place_lon"), miles))
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    reach = keyed.select("row", *rows.columns, F.explode_outer(F.when(known, cells_in_reach(F.col("lat"), F.col("lon"), miles))).alias("cell"))
    met = reach.join(cells, "cell", "left")
    far = haversine_miles(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    best = F.min(F.when(far <= miles, F.struct(far.alias("miles"), F.col("place"))))
    return met.groupBy("row", *rows.columns).agg(best.alias("best")).select(*rows.columns, "best.place", "best.miles")
