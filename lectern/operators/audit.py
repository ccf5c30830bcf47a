"""Defects a reader would see, counted per book, and the comparison of two audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# What each defect costs a reader.
WEIGHTS = {"broken": 3, "hyphen": 1, "junk": 2, "furniture": 3, "ocr": 1, "glued": 1, "split": 1, "chars": 2, "headings": 3, "pictures": 5}
REPEATED_LINE, LINE_MIN, LINE_MAX = 4, 4, 60
PICTURE_PIXELS, PICTURE_ASPECT = 600_000, 0.04


def lone_letters(text: Column) -> Column:
    """Tokens that are one lower-case letter and no word of their own."""
    core = lambda t: F.btrim(t, F.lit(T.EDGE_MARKS))
    return F.size(F.filter(F.split(text, " "), lambda t: core(t).rlike(r"^\p{Ll}$") & ~core(t).isin(*T.LETTER_WORDS))).cast("long")


def page_pictures(images: DataFrame) -> DataFrame:
    """Pictures of whole pages, which should have been text: large ones of the page's shape, the cover aside.

    images: book, width, height (pixels), page_aspect (null: unknown, so none is counted), cover.
    """
    shape = F.col("width") / F.col("height")
    whole = (F.col("width") * F.col("height") > PICTURE_PIXELS) & (F.abs(shape - F.col("page_aspect")) < F.col("page_aspect") * PICTURE_ASPECT) & ~F.coalesce("cover", F.lit(False))
    return images.groupBy("book").agg(F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("pictures"))


def audit(nodes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per book: words, ten defect counts, their weighted sum and its index per thousand words.

    nodes: book, seq, tag (p, li, h1 to h4), text (one line, not empty), in reading order by seq; with a column `before`
    (the paragraph before, null if another tag) no order is taken again. images: as page_pictures takes them.
    """
    order = Window.partitionBy("book").orderBy("seq")
    text, heading = F.col("text"), F.col("tag").startswith("h")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    solid = F.length(F.replace(text, F.lit(" "), F.lit("")))
    lower = text.rlike(r"^\p{Ll}")
    folio = text.rlike(T.FOLIO)
    junk = (letters <= 2) | ((F.length(text) <= 25) & (2 * letters < solid))
    seen = nodes if "before" in nodes.columns else nodes.withColumn("before", F.lag(F.when(F.col("tag") == "p", text)).over(order))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    body = lambda c: F.when(heading, 0).otherwise(c).cast("long")
    marked = seen.select(
        "book", "text", heading.alias("heading"), T.count_of(text, T.WORD).alias("words"),
        body(one(F.col("before").isNotNull() & lower & ~F.col("before").endswith(":"))).alias("broken"),
        body(T.count_of(text, T.HYPHEN_BREAK)).alias("hyphen"), body(one(~folio & junk)).alias("junk"), body(one(folio)).alias("furniture"),
        body(T.count_of(text, T.OCR_WORD)).alias("ocr"), body(T.count_of(text, T.GLUED)).alias("glued"), body(lone_letters(text)).alias("split"),
        body(T.count_of(text, T.BAD_CHARS)).alias("chars"),
        F.when(heading, one(folio | lower | (F.size(F.split(text, " ")) > 20))).otherwise(0).cast("long").alias("headings"),
    )
    sums = marked.groupBy("book").agg(*[F.sum(c).alias(c) for c in ("words", "broken", "hyphen", "junk", "furniture", "ocr", "glued", "split", "chars", "headings")])
    short = marked.where(~F.col("heading") & (F.length("text") <= LINE_MAX)).select("book", F.lower("text").alias("line"))
    repeated = short.groupBy("book", "line").count().where((F.col("count") >= REPEATED_LINE) & (F.length("line") >= LINE_MIN) & ~F.col("line").rlike(T.FOLIO))
    extra = repeated.groupBy("book").agg(F.sum(F.col("count") - 1).alias("extra"))
    joined = sums.join(extra, "book", "left").withColumn("furniture", F.col("furniture") + F.coalesce("extra", F.lit(0))).drop("extra")
    if images is None:
        joined = joined.withColumn("pictures", F.lit(0).cast("long"))
    else:
        joined = joined.join(page_pictures(images), "book", "left").withColumn("pictures", F.coalesce("pictures", F.lit(0)))
    cost = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    return joined.withColumn("cost", cost.cast("long")).withColumn("defect_index", F.bround(F.col("cost") * 1000.0 / F.greatest("words", F.lit(1)), 6))


def ranked(audits: DataFrame) -> DataFrame:
    """Worst first. The rank is counted by index, so that no task holds all books."""
    by_index = audits.groupBy("defect_index").count()
    above = by_index.withColumn("rank", F.sum("count").over(Window.orderBy(F.desc("defect_index")).rowsBetween(Window.unboundedPreceding, -1)))
    return audits.join(above.select("defect_index", (F.coalesce("rank", F.lit(0)) + 1).cast("long").alias("rank")), "defect_index")


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per book and defect: both counts per thousand words, and whether the later one is worse."""
    long_form = lambda df, name: df.select("book", "words", F.explode(F.array(*[F.struct(F.lit(k).alias("defect"), F.col(k).alias("n")) for k in WEIGHTS])).alias("d")).select("book", "d.defect", F.bround(F.col("d.n") * 1000.0 / F.greatest("words", F.lit(1)), 6).alias(name))
    pair = long_form(after, "now").join(long_form(before, "was"), ["book", "defect"], "left")
    return pair.select("book", "defect", "was", "now", (F.col("now") > F.coalesce("was", F.lit(0.0))).alias("worse"))
