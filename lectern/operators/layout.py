"""Order, gaps, margins, furniture and page kinds from block geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Bands, ratios and page thresholds.
TOP_BAND, BOTTOM_BAND = 0.12, 0.90
REPEAT_PAGES, REPEAT_RATIO, PARITY_PAGES = 3, 0.55, 4
FULL_WIDTH, GUTTER_LOW, GUTTER_HIGH, GUTTER_SIDE = 0.55, 0.35, 0.65, 2
EDGE_CHARS, EDGE_BLOCKS = 90, 3
NATIVE_SHARE, PERVASIVE, MIXED_CHARS, MIXED_COVER, SCAN_COVER = 0.35, 0.70, 60, 0.25, 0.55


def band(y0: Column, y1: Column, height: Column) -> Column:
    return F.when(y1 <= TOP_BAND * height, "top").when(y0 >= BOTTOM_BAND * height, "bottom").otherwise("body")


def upper_median(values: Column) -> Column:
    """The middle value of a list, the higher of two middle ones."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def body_size(blocks: DataFrame) -> DataFrame:
    """Per document: the median type size weighted by text length (1 to 500), and the upper median weighted by 1 to 400."""
    weighted = blocks.withColumn("w", F.least(F.greatest(F.length("text"), F.lit(1)), F.lit(500)).cast("long"))
    exact = weighted.groupBy("doc_id").agg(F.percentile("font_size", 0.5, F.col("w")).alias("body_size"))
    sizes = blocks.withColumn("w", F.least(F.greatest(F.length("text"), F.lit(1)), F.lit(400)).cast("long")).groupBy("doc_id", "font_size").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("doc_id")
    running = sizes.withColumn("upto", F.sum("w").over(w.orderBy("font_size"))).withColumn("all", F.sum("w").over(w))
    upper = running.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("doc_id").agg(F.min("font_size").alias("upper_size"))
    return exact.join(upper, "doc_id")


def single_column_order(blocks: DataFrame) -> DataFrame:
    """Position of each block on its page: rows of four points, then left to right."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y0") / 4), "x0", "i")
    return blocks.withColumn("position", F.row_number().over(w).cast("long"))


def two_column_order(blocks: DataFrame) -> DataFrame:
    """Position on two-column pages: full-width blocks cut the page into segments, left column first in each.

    A page without a gutter (an x between 35 and 65 % that no narrow block crosses, two at least on either side)
    keeps single-column order.
    """
    page = Window.partitionBy("doc_id", "page")
    measured = blocks.withColumn("lo", F.min("x0").over(page)).withColumn("hi", F.max("x1").over(page))
    full = F.col("x1") - F.col("x0") >= FULL_WIDTH * (F.col("hi") - F.col("lo"))
    marked = measured.withColumn("full", full)
    narrow = marked.where(~F.col("full")).select("doc_id", "page", "x0", "x1", "lo", "hi")
    edges = narrow.groupBy("doc_id", "page").agg(F.collect_set("x1").alias("xs"), F.collect_list(F.struct("x0", "x1")).alias("spans"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def fits(x: Column) -> Column:
        share = (x - F.col("lo")) / (F.col("hi") - F.col("lo"))
        crossed = F.exists("spans", lambda s: (s["x0"] < x) & (s["x1"] > x))
        sides = (F.size(F.filter("spans", lambda s: s["x1"] <= x)) >= GUTTER_SIDE) & (F.size(F.filter("spans", lambda s: s["x0"] >= x)) >= GUTTER_SIDE)
        return share.between(GUTTER_LOW, GUTTER_HIGH) & ~crossed & sides

    gutter = edges.select("doc_id", "page", F.array_min(F.filter("xs", fits)).alias("gutter"))
    joined = marked.join(gutter, ["doc_id", "page"], "left")
    above = F.sum(F.when(F.col("full"), 1).otherwise(0)).over(page.orderBy("y0", "i").rowsBetween(Window.unboundedPreceding, -1))
    segmented = joined.withColumn("segment", F.when(F.col("gutter").isNull(), 0).otherwise(F.coalesce(above, F.lit(0))))
    side = F.when(F.col("gutter").isNull(), 0).when(F.col("full"), 2).when(F.col("x0") >= F.col("gutter"), 1).otherwise(0)
    first = F.when(F.col("gutter").isNull(), F.bround(F.col("y0") / 4)).otherwise(F.col("y0"))
    ordered = page.orderBy("segment", side, first, "x0", "i")
    return segmented.withColumn("position", F.row_number().over(ordered).cast("long")).select(*blocks.columns, "gutter", "position")


def gaps(blocks: DataFrame) -> DataFrame:
    """Space above and below each block in its page and column; null at the ends."""
    w = Window.partitionBy("doc_id", "page", "col").orderBy("y0", "i")
    return blocks.withColumn("gap_above", F.col("y0") - F.lag("y1").over(w)).withColumn("gap_below", F.lead("y0").over(w) - F.col("y1"))


def split_at_gaps(rows: DataFrame) -> DataFrame:
    """Parts of each document's text at blank lines: part number, first and last line, characters."""
    w = Window.partitionBy("doc_id").orderBy("i")
    blank = F.col("line").rlike(r"^\s*$")
    marked = rows.withColumn("blank", blank).withColumn("fresh", F.when(~blank & F.coalesce(F.lag(blank).over(w), F.lit(True)), 1).otherwise(0))
    parts = marked.withColumn("part", F.sum("fresh").over(w)).where(~F.col("blank"))
    return parts.groupBy("doc_id", F.col("part").cast("long").alias("part")).agg(F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.sum(F.length("line")).cast("long").alias("chars"))


def repeated_heads(blocks: DataFrame, ratio: float = REPEAT_RATIO, least: int = REPEAT_PAGES) -> DataFrame:
    """Keys that recur in one band of a book: on enough of all pages, or of the left or right ones.

    blocks: book, page, text, y0, y1, page_height.
    """
    keyed = blocks.withColumn("band", band(F.col("y0"), F.col("y1"), F.col("page_height"))).where("band <> 'body'").withColumn("key", T.head_key(F.col("text"))).where("key <> ''")
    pages = blocks.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("pages"), F.sum(F.col("page") % 2).alias("odd"))
    seen = keyed.select("book", "band", "key", "page").distinct().groupBy("book", "band", "key").agg(F.count("*").alias("on"), F.sum(F.col("page") % 2).alias("on_odd"))
    joined = seen.join(pages, "book").withColumn("even", F.col("pages") - F.col("odd")).withColumn("on_even", F.col("on") - F.col("on_odd"))
    share = lambda n: F.floor(ratio * n)
    side = lambda on, n: (n >= PARITY_PAGES) & (on >= F.greatest(F.lit(least), share(n)))
    overall = F.col("on") >= F.greatest(F.lit(1), share(F.col("pages")))
    kept = joined.where((F.col("on") >= least) & (overall | side(F.col("on_odd"), F.col("odd")) | side(F.col("on_even"), F.col("even"))))
    return kept.select("book", "band", "key", "pages", "on", F.when(overall, "all").when(side(F.col("on_odd"), F.col("odd")), "odd").otherwise("even").alias("class"))


def edge_blocks(blocks: DataFrame) -> DataFrame:
    """First and last short block of each page with three or more blocks."""
    page = Window.partitionBy("book", "page")
    marked = blocks.withColumn("n_blocks", F.count("*").over(page)).withColumn("place", F.row_number().over(page.orderBy("y0", "i"))).withColumn("edge", F.when(F.col("place") == 1, "first").when(F.col("place") == F.col("n_blocks"), "last"))
    return marked.where((F.col("n_blocks") >= EDGE_BLOCKS) & F.col("edge").isNotNull() & (F.length("text") <= EDGE_CHARS)).select("book", "page", "edge", "text")


def page_number_profile(blocks: DataFrame, confirmed: int = 5) -> DataFrame:
    """Per book: upper medians of height on the page and type size of its page numbers, where enough are known."""
    numbers = blocks.where(F.col("text").rlike(T.PAGE_NUMBER)).withColumn("y", F.bround(F.col("y0") / F.col("page_height"), 6))
    found = numbers.groupBy("book").agg(F.count("*").alias("numbers"), upper_median(F.collect_list("y")).alias("y_share"), upper_median(F.collect_list("font_size")).alias("size"))
    return found.where(F.col("numbers") >= confirmed)


def page_number_matches(blocks: DataFrame, profile: DataFrame, body: float = 10.0) -> DataFrame:
    """Short blocks where and as large as a book's page numbers: misread ones among them."""
    joined = blocks.join(profile, "book")
    close = (F.abs(F.col("y0") / F.col("page_height") - F.col("y_share")) <= 0.02) & (F.abs(F.col("font_size") - F.col("size")) <= 0.18 * F.col("size"))
    return joined.where(close & (F.length("text") <= 8) & (F.col("font_size") <= 0.85 * body)).select("book", "page", "i", "text")


def page_kinds(pages: DataFrame) -> DataFrame:
    """Kind of each page by native text and image cover: NATIVE, MIXED, SCANNED or EMPTY.

    pages: book, page, native_chars, image_coverage.
    """
    filled = pages.where("native_chars > 0")
    typical = filled.groupBy("book").agg(F.floor(F.median("native_chars")).cast("long").alias("typical"))
    share = filled.join(typical, "book").groupBy("book").agg(F.max("typical").alias("typical"), F.avg(F.when(F.col("native_chars") >= NATIVE_SHARE * F.col("typical"), 1.0).otherwise(0.0)).alias("share"))
    joined = pages.join(share, "book", "left").withColumn("typical", F.coalesce("typical", F.lit(0).cast("long")))
    n, cover = F.col("native_chars"), F.col("image_coverage")
    kind = (
        F.when((F.col("typical") > 0) & (n >= NATIVE_SHARE * F.col("typical")), "NATIVE")
        .when((F.coalesce("share", F.lit(0.0)) >= PERVASIVE) & (n >= 20), "NATIVE")
        .when(n >= MIXED_CHARS, F.when(cover >= MIXED_COVER, "MIXED").otherwise("NATIVE"))
        .when(cover >= SCAN_COVER, "SCANNED").when(n > 0, "NATIVE").otherwise("EMPTY")
    )
    return joined.select("book", "page", n.alias("native_chars"), "typical", kind.alias("kind"))


def classify_books(kinds: DataFrame) -> DataFrame:
    """Class of each book from its page kinds."""
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long")
    sums = kinds.groupBy("book").agg(F.count("*").alias("pages"), count("SCANNED").alias("scanned"), count("MIXED").alias("mixed"), count("NATIVE").alias("native"))
    label = F.when(F.col("scanned") >= 0.95 * F.col("pages"), "SCANNED").when(F.col("scanned") + F.col("mixed") > 0, "MIXED").when(F.col("native") > 0, "NATIVE").otherwise("UNKNOWN")
    return sums.withColumn("class", label)


def text_measure(blocks: DataFrame) -> DataFrame:
    """Per page: median left and right edge, the start that a quarter of the lines lie left of, and the share indented."""
    page = blocks.where(F.length("text") > 0).groupBy("doc_id", "page").agg(
        F.median("x0").alias("left"), F.median("x1").alias("right"), F.collect_list("x0").alias("xs"), F.count("*").alias("lines")
    )
    ordered = F.array_sort("xs")
    quarter = F.element_at(ordered, F.floor(F.size(ordered) / 4).cast("int") + 1)
    indented = F.size(F.filter("xs", lambda x: x > F.col("left") + 4.0))
    return page.where(F.col("lines") >= 3).select("doc_id", "page", "lines", "left", "right", quarter.alias("quarter_start"), F.bround(indented / F.col("lines"), 6).alias("indented_share"))


def overlap_anti(boxes: DataFrame, taken: DataFrame, share: float = 0.35) -> DataFrame:
    """Boxes that no taken box of the same page covers by that share of their own area."""
    t = taken.select("doc_id", "page", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "t_x1") - F.greatest("x0", "t_x0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "t_y1") - F.greatest("y0", "t_y0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = boxes
    cond = (b["doc_id"] == t["doc_id"]) & (b["page"] == t["page"]) & (wide * high >= share * area) & (area > 0)
    return b.join(t, cond, "left_anti")


def centre_inside(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a region of their page, with the region's id."""
    r = regions.select("doc_id", "page", "region", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return blocks.join(r, ["doc_id", "page"]).where(cx.between(F.col("r_x0"), F.col("r_x1")) & cy.between(F.col("r_y0"), F.col("r_y1"))).drop("r_x0", "r_y0", "r_x1", "r_y1")


def nearest_caption(regions: DataFrame, captions: DataFrame, reach: float = 60.0) -> DataFrame:
    """Per region the closest caption within reach, above preferred to below at equal distance, then the first."""
    c = captions.select("doc_id", "page", F.col("i").alias("caption"), F.col("text").alias("caption_text"), F.col("y0").alias("c_y0"), F.col("y1").alias("c_y1"))
    gap = F.when(F.col("c_y1") <= F.col("y0"), F.col("y0") - F.col("c_y1")).when(F.col("c_y0") >= F.col("y1"), F.col("c_y0") - F.col("y1"))
    near = regions.join(c, ["doc_id", "page"]).withColumn("gap", gap).where(F.col("gap") <= reach)
    below = (F.col("c_y0") >= F.col("y1")).cast("int")
    return near.groupBy("doc_id", "page", "region").agg(F.min(F.struct("gap", below.alias("below"), "caption", "caption_text")).alias("n")).select("doc_id", "page", "region", "n.caption", "n.caption_text", F.col("n.gap").alias("gap"))


def background_images(images: DataFrame, blocks: DataFrame, share: float = 0.5, chars: int = 3) -> DataFrame:
    """Images of half a page or more with text centred inside: pictures of the page itself.

    images: doc_id, page, image, x0, y0, x1, y1, page_width, page_height.
    """
    large = images.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= share * F.col("page_width") * F.col("page_height")).withColumn("region", F.col("image"))
    inside = centre_inside(blocks, large)
    return inside.groupBy("doc_id", "page", "region").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") >= chars).select("doc_id", "page", F.col("region").alias("image"), "chars")


def direction(docs: DataFrame) -> DataFrame:
    """Strong characters of either direction and the document's direction: half or more right-to-left decides."""
    rtl = F.regexp_count("text", F.lit(T.RTL)).cast("long")
    letters = F.regexp_count("text", F.lit(r"\p{L}")).cast("long")
    counted = docs.select("doc_id", rtl.alias("rtl"), (letters - rtl).alias("ltr"))
    return counted.withColumn("direction", F.when((F.col("rtl") > 0) & (F.col("rtl") >= F.col("ltr")), "rtl").otherwise("ltr"))
