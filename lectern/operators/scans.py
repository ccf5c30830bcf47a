"""Pages that were scanned: images, recognised words and lines, routing and misread heads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.unicode import udfs
from .layout import band, overlap_anti, upper_median

SIMILAR, KEY_MIN, EDGE_CHARS = 0.8, 6, 90
LINE_GAP, LINE_OVERLAP = 1.75, 0.25
DARK_BELOW_MEDIAN, BLANK_SHARE = 50, 0.001


def misread_heads(blocks: DataFrame, proven: DataFrame) -> DataFrame:
    """Margin lines that read almost like a proven running head of their band. proven: book, band, key.

    A shorter key of less than two thirds of the longer one cannot be that similar, so such pairs are not compared.
    """
    keyed = blocks.withColumn("band", band(F.col("y0"), F.col("y1"), F.col("page_height"))).where("band <> 'body'").withColumn("key", T.head_key(F.col("text")))
    lines = keyed.where((F.length("key") >= KEY_MIN) & (F.length(F.trim("text")) <= EDGE_CHARS)).select("book", "band", "key").distinct()
    heads = proven.where(F.length("key") >= KEY_MIN).select("book", "band", F.col("key").alias("head"))
    near = lines.join(heads, ["book", "band"]).where((F.col("key") != F.col("head")) & (3 * F.least(F.length("key"), F.length("head")) >= 2 * F.greatest(F.length("key"), F.length("head"))))
    return near.withColumn("similarity", F.bround(udfs()["similarity"]("key", "head"), 6)).where(F.col("similarity") >= SIMILAR)


def lines_to_blocks(lines: DataFrame) -> DataFrame:
    """Block number of recognised lines: a line joins the newest group whose last line it is close to and overlaps sideways.

    lines: doc_id, page, line_no, x0, y0, x1, y1.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "line_no"])
        heights = sorted(h for h in pdf["y1"] - pdf["y0"] if h > 0)
        middle = len(heights) // 2
        typical = (heights[middle] if len(heights) % 2 else (heights[middle - 1] + heights[middle]) / 2) if heights else 0.0
        groups: list[list] = []  # [number, last line], newest group last
        numbers = []
        for r in pdf.itertuples(index=False):
            for k in range(len(groups) - 1, -1, -1):
                last = groups[k][1]
                narrow = min(r.x1 - r.x0, last.x1 - last.x0)
                beside = (min(r.x1, last.x1) - max(r.x0, last.x0)) / narrow if narrow > 0 else 0.0
                if (not typical or r.y0 - last.y1 <= LINE_GAP * typical) and beside >= LINE_OVERLAP:
                    groups[k][1] = r
                    numbers.append(groups[k][0])
                    break
            else:
                groups.append([len(groups), r])
                numbers.append(groups[-1][0])
        return pdf.assign(block=numbers)[["doc_id", "page", "line_no", "block"]]

    return lines.select("doc_id", "page", "line_no", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page long, line_no long, block long")


def placed_blocks(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Blocks of grouped lines: text by line, box, upper-median line height as type size, mean confidence."""
    joined = lines.join(numbers, ["doc_id", "page", "line_no"])
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return joined.groupBy("doc_id", "page", "block").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.bround(upper_median(F.collect_list(F.col("y1") - F.col("y0"))), 6).alias("font_size"), F.bround(F.avg("confidence"), 6).alias("confidence"),
    )


def best_orientation(readings: DataFrame, enough: float = 88.0) -> DataFrame:
    """Turn of each page's image: upright if that reads well enough, else the one that reads best. readings: doc_id, page, turn, confidence."""
    rank = F.struct(F.when((F.col("turn") == 0) & (F.col("confidence") >= enough), 1).otherwise(0), "confidence", -F.col("turn"))
    return readings.groupBy("doc_id", "page").agg(F.max_by("turn", rank).alias("turn"), F.max_by("confidence", rank).alias("confidence"))


def routed(native: DataFrame, recognised: DataFrame, kinds: DataFrame) -> DataFrame:
    """Blocks of each page from the source its kind names: native text, recognised text, or both without overlap.

    native, recognised: doc_id, page, i, text, x0, y0, x1, y1; kinds: doc_id, page, kind. A page without a kind is native.
    """
    columns = ["doc_id", "page", "i", "text", "x0", "y0", "x1", "y1"]
    known = lambda df: df.join(kinds, ["doc_id", "page"], "left").withColumn("kind", F.coalesce("kind", F.lit("NATIVE")))
    own = known(native).where("kind in ('NATIVE', 'MIXED')").select(*columns, F.lit("native").alias("source"))
    read = known(recognised)
    scanned = read.where("kind = 'SCANNED'").select(*columns, F.lit("ocr").alias("source"))
    mixed = overlap_anti(read.where("kind = 'MIXED'").select(*columns), native).select(*columns, F.lit("ocr").alias("source"))
    return own.unionByName(scanned).unionByName(mixed)


def with_fallbacks(nodes: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Nodes and whole-page image nodes in page order: a fallback stands before the first node of a later page.

    nodes: doc_id, seq, page, role; fallbacks: doc_id, page.
    """
    both = nodes.select("doc_id", "page", F.col("seq"), "role").unionByName(fallbacks.select("doc_id", "page", F.lit(None).cast("long").alias("seq"), F.lit("IMAGE").alias("role")))
    w = Window.partitionBy("doc_id").orderBy("page", F.col("seq").asc_nulls_last())
    return both.withColumn("position", F.row_number().over(w).cast("long"))


def image_coverage(images: DataFrame) -> DataFrame:
    """Share of each page that images cover, an image of the page's shape counting as all of it.

    images: doc_id, page, width, height, page_width, page_height, pixel_width, pixel_height.
    """
    page_like = (F.abs(F.col("width") / F.col("height") - F.col("page_width") / F.col("page_height")) <= 0.03 * F.col("page_width") / F.col("page_height")) & (F.col("pixel_width") >= F.col("page_width"))
    share = F.when(page_like, 1.0).otherwise(F.col("width") * F.col("height") / (F.col("page_width") * F.col("page_height")))
    return images.groupBy("doc_id", "page").agg(F.bround(F.least(F.sum(share), F.lit(1.0)), 6).alias("coverage"), F.min(page_like).alias("scan"))


def blank_leaves(histograms: DataFrame) -> DataFrame:
    """Whether pages are blank: fewer than a thousandth of the pixels are clearly darker than the median. histograms: doc_id, page, level, pixels."""
    page = Window.partitionBy("doc_id", "page")
    running = histograms.withColumn("upto", F.sum("pixels").over(page.orderBy("level"))).withColumn("all", F.sum("pixels").over(page))
    median = running.withColumn("median", F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("level"))).over(page))
    return median.groupBy("doc_id", "page").agg((F.sum(F.when(F.col("level") < F.col("median") - DARK_BELOW_MEDIAN, F.col("pixels")).otherwise(0)) < BLANK_SHARE * F.max("all")).alias("blank"))


def cover_pages(pages: DataFrame) -> DataFrame:
    """Documents whose first page is a cover: a picture of half the page, and 1 to 400 characters of text. pages: doc_id, page, picture_share, chars."""
    return pages.where("page = 1").select("doc_id", ((F.col("picture_share") >= 0.5) & F.col("chars").between(1, 400)).alias("cover"))


def type_area(blocks: DataFrame, least_chars: int = 300, least_pages: int = 3) -> DataFrame:
    """Area that text fills on a document's full pages: upper medians of the extents. blocks: doc_id, page, text, x0, y0, x1, y1."""
    pages = blocks.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where(F.col("chars") >= least_chars)
    found = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), *[upper_median(F.collect_list(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return found.where(F.col("pages") >= least_pages)


def reading_budget(pages: DataFrame, budget_seconds: float) -> DataFrame:
    """Whether reading the rest of each document fits its budget, judged by its first two pages. pages: doc_id, n, seconds."""
    w = Window.partitionBy("doc_id")
    first = pages.withColumn("place", F.row_number().over(w.orderBy("n"))).withColumn("total", F.count("*").over(w)).where("place <= 2")
    probe = first.groupBy("doc_id").agg(F.avg("seconds").alias("per_page"), F.sum("seconds").alias("spent"), F.max("total").alias("pages"), F.count("*").alias("probed"))
    return probe.select("doc_id", "pages", F.bround("per_page", 6).alias("per_page"), (F.col("per_page") * (F.col("pages") - F.col("probed")) <= budget_seconds - F.col("spent")).alias("fits"))


def ink_regions(cells: DataFrame) -> DataFrame:
    """Connected regions of dark cells, two cells apart at most: region number, box and size. cells: doc_id, page, row, col."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(pdf["row"], pdf["col"], strict=True))
        out = []
        while left:
            todo, region = [min(left)], []
            left.discard(todo[0])
            while todo:
                r, c = todo.pop()
                region.append((r, c))
                near = [(r + a, c + b) for a in range(-2, 3) for b in range(-2, 3) if (r + a, c + b) in left]
                left.difference_update(near)
                todo += near
            rows, cols = [x for x, _ in region], [x for _, x in region]
            out.append((pdf["doc_id"].iloc[0], pdf["page"].iloc[0], len(out), min(rows), min(cols), max(rows), max(cols), len(region)))
        return pd.DataFrame(out, columns=["doc_id", "page", "region", "row0", "col0", "row1", "col1", "cells"])

    return cells.select("doc_id", "page", "row", "col").groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page long, region long, row0 long, col0 long, row1 long, col1 long, cells long")


def figure_extent(drawings: DataFrame, figures: DataFrame, reach: float = 18.0) -> DataFrame:
    """Box of a composite figure: the drawing nearest above its caption and all that lie within reach of one another.

    drawings: doc_id, page, x0, y0, x1, y1; figures: doc_id, page, figure, caption_y0.
    """

    def fold(key: tuple, d: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        boxes = [tuple(b) for b in d[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        out = []
        for r in f.itertuples(index=False):
            above = [b for b in boxes if b[3] <= r.caption_y0 + 1]
            if not above:
                continue
            x0, y0, x1, y1 = max(above, key=lambda b: (b[3], -b[0]))
            grown = True
            while grown:
                grown = False
                for b in above:
                    if b[0] <= x1 + reach and b[2] >= x0 - reach and b[1] <= y1 + reach and b[3] >= y0 - reach:
                        new = (min(x0, b[0]), min(y0, b[1]), max(x1, b[2]), max(y1, b[3]))
                        grown = grown or new != (x0, y0, x1, y1)
                        x0, y0, x1, y1 = new
            out.append((key[0], key[1], r.figure, x0, y0, x1, y1))
        return pd.DataFrame(out, columns=["doc_id", "page", "figure", "x0", "y0", "x1", "y1"])

    a, b = drawings.groupBy("doc_id", "page"), figures.groupBy("doc_id", "page")
    return a.cogroup(b).applyInPandas(fold, "doc_id long, page long, figure long, x0 double, y0 double, x1 double, y1 double")
