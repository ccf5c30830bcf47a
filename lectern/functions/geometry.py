"""Boxes, sizes and resolutions as column expressions. A box is a struct of x0, y0, x1, y1 in points, y down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognition language packs, rendering limits.
LANGUAGE_PACKS = {"ar": "ara+eng", "he": "heb+eng", "fa": "fas+eng", "tr": "tur+eng", "de": "deu+eng", "fr": "fra+eng", "es": "spa+eng", "it": "ita+eng", "ru": "rus+eng", "en": "eng"}
BASE_DPI, MAX_PIXELS, MIN_DPI, SMALL_AREA = 200, 4_000_000, 36, 1.5 * 72 * 72


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def from_normalised(x: Column, y: Column, w: Column, h: Column, page_width: Column, page_height: Column) -> Column:
    """A box given as shares of the page from its bottom left corner, in points from the top left, kept on the page."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return box(inside(x * page_width, page_width), inside((1 - y - h) * page_height, page_height), inside((x + w) * page_width, page_width), inside((1 - y) * page_height, page_height))


def unrotated(b: Column, turn: Column, width: Column, height: Column) -> Column:
    """A box found on an image turned by 0, 90, 180 or 270 degrees clockwise, on the upright page of that width and height."""
    return (
        F.when(turn == 90, box(b["y0"], height - b["x1"], b["y1"], height - b["x0"]))
        .when(turn == 180, box(width - b["x1"], height - b["y1"], width - b["x0"], height - b["y0"]))
        .when(turn == 270, box(width - b["y1"], b["x0"], width - b["y0"], b["x1"]))
        .otherwise(b)
    )


def displayed_size(width: Column, height: Column, turn: Column) -> Column:
    """Width and height of a page as shown."""
    return F.when(turn % 180 == 90, F.struct(height.alias("width"), width.alias("height"))).otherwise(F.struct(width.alias("width"), height.alias("height")))


def effective_dpi(width: Column, height: Column) -> Column:
    """Resolution of a rendered region: small ones sharper, large ones within a number of pixels."""
    base = F.when(F.greatest(width * height, F.lit(1.0)) < SMALL_AREA, F.floor(F.lit(BASE_DPI * 1.75))).otherwise(F.lit(BASE_DPI))
    pixels = (width / 72.0 * base) * (height / 72.0 * base)
    return F.greatest(F.lit(MIN_DPI), F.when(pixels > MAX_PIXELS, F.floor(base * F.sqrt(MAX_PIXELS / pixels))).otherwise(base)).cast("long")


def language_packs(wanted: Column, available: Column) -> Column:
    """Recognition packs: the wanted ones that are there, else English, else the first one there."""
    both = F.array_intersect(F.split(wanted, r"\+"), available)
    return F.when(F.size(both) > 0, F.array_join(both, "+")).when(F.array_contains(available, "eng"), "eng").otherwise(F.get(available, 0))


def packs_of_language(language: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_PACKS.items() for x in kv]), F.lower(language))
