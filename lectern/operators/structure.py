"""Heading scores and levels, block roles, contents pages and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Limits and the weight of each heading signal.
ACCEPT, MAX_CHARS, MAX_WORDS, DISPLAY_WORDS, DISPLAY = 0.55, 120, 12, 18, 1.5
SPARSE, CENTRED, ABOVE, BELOW, PROSE_MIN = 900, 0.06, 2.2, 1.6, 40
LEVEL_TOLERANCE, MAX_SCALES = 0.18, 4
VOWEL = "aeıioöuüAEIİOÖUÜàâäéèêëíîïóôöúûüyY"


def heading_score(blocks: DataFrame) -> DataFrame:
    """Adds score, strong, is_heading. Needs text, size_ratio, bold, gap_above, gap_below, line_gap, x0, x1, page_width, page_chars, first_on_page."""
    t = T.squeezed(F.col("text"))
    r = F.col("size_ratio")
    n_words = F.size(F.split(t, " "))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    named = F.exists(F.regexp_extract_all(t, F.lit(f"{T.LETTER}{{3,}}"), F.lit(0)), lambda w: w.rlike(f"[{VOWEL}]"))
    unnumbered = F.regexp_replace(t, r"^\s*(?:[0-9]{1,3}(?:\.[0-9]{1,3})*\.?|[IVXLCDMivxlcdm]{1,7}\.)\s+", "")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    veto = (
        (t == "") | (F.length(t) > MAX_CHARS) | t.rlike(T.URL) | t.rlike(T.OPENS_AS_QUOTE) | t.rlike(r"(?i)\bISBN\b") | (count(")") > count("(")) | ~named
        | ((F.length(t) >= PROSE_MIN) & unnumbered.rlike(r"[.?!]\s+\S")) | (F.size(lines) > F.when(r >= DISPLAY, 4).otherwise(2))
        | ((F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).rlike(r"^\s*([0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,6})[.)]\s+\S")))
    )
    zero = F.lit(0.0)
    add = lambda cond, value: F.when(cond, F.lit(value)).otherwise(zero)
    division, numbered = t.rlike(T.DIVISION_WORD), t.rlike(T.NUMBERED_TITLE)
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 2)
    larger = F.when(r >= 1.8, 0.45).when(r >= 1.35, 0.32).when(r >= 1.12, 0.18).otherwise(0.0)
    bold = F.when(F.col("bold") & (r >= 1.02), 0.24).when(F.col("bold"), 0.18).otherwise(0.0)
    short_bold = F.col("bold") & (F.size(lines) == 1) & (n_words <= 8) & ~t.rlike("[.,;:]$")
    middle, half = (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    centred = (F.abs(middle - half) <= CENTRED * F.col("page_width")) & (F.length(t) < 60)
    above = F.coalesce(F.col("gap_above") > ABOVE * F.col("line_gap"), F.lit(True))
    below = F.coalesce(F.col("gap_below") > BELOW * F.col("line_gap"), F.lit(True))
    space = F.when(above & below, 0.24).when(above, 0.12).when(below, 0.08).otherwise(0.0)
    sparse = (F.col("page_chars") > 0) & (F.col("page_chars") < SPARSE)
    context = F.when(sparse & F.col("first_on_page"), 0.26).when(sparse, 0.16).otherwise(0.0)
    prose = t.rlike("[.!?]$") & ~t.rlike(T.BARE_NUMBER) & ~division
    wordy = (n_words > F.when(r >= DISPLAY, DISPLAY_WORDS).otherwise(MAX_WORDS)) & ~division
    total = larger + bold + add(short_bold, 0.15) + add(division, 0.30) + add(numbered, 0.22) + add(capitals, 0.16) + add(centred, 0.18) + space + context - add(prose, 0.30) - add(wordy, 0.25)
    strong = (r >= 1.12) | F.col("bold") | division | numbered | capitals
    score = F.when(veto | ~strong, 0.0).otherwise(F.greatest(F.bround(total, 6), F.lit(0.0)))
    return blocks.withColumn("score", score).withColumn("is_heading", F.col("score") >= ACCEPT)


def page_context(blocks: DataFrame) -> DataFrame:
    """Adds size_ratio, gaps, page_chars and first_on_page to virtual blocks of one document a book."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("y0", "i")
    return (
        blocks.withColumn("gap_above", F.col("y0") - F.lag("y1").over(order)).withColumn("gap_below", F.lead("y0").over(order) - F.col("y1"))
        .withColumn("page_chars", F.sum(F.length("text")).over(page)).withColumn("first_on_page", F.row_number().over(order) == 1)
        .withColumn("size_ratio", F.col("font_size") / 10.0).withColumn("line_gap", F.lit(4.0)).withColumn("bold", F.lit(False)).withColumn("page_width", F.lit(595.0))
    )


def scale_groups(scales: Column) -> Column:
    """Heads of groups of type sizes, largest first: a size within the tolerance of a head belongs to it; four at most."""
    ordered = F.reverse(F.array_sort(F.array_distinct(F.transform(scales, lambda x: F.bround(x, 2)))))
    empty = F.array().cast("array<double>")
    heads = F.aggregate(ordered, empty, lambda a, x: F.when((F.size(a) == 0) | (x < F.element_at(a, -1) * (1 - LEVEL_TOLERANCE)), F.concat(a, F.array(x))).otherwise(a))
    return F.slice(heads, 1, MAX_SCALES)


def heading_levels(headings: DataFrame) -> DataFrame:
    """Level of each heading: the group of its size, pushed below its number's depth. headings: doc_id, seq, text, heading_scale."""
    heads = headings.groupBy("doc_id").agg(scale_groups(F.collect_list("heading_scale")).alias("heads"))
    joined = headings.join(heads, "doc_id")
    size = F.bround("heading_scale", 2)
    base = F.size(F.filter("heads", lambda h: h > size / (1 - LEVEL_TOLERANCE))) + 1
    group = F.least(F.greatest(base, F.lit(1)), F.lit(MAX_SCALES))
    number = F.regexp_extract(T.squeezed(F.col("text")), T.SECTION_NUMBER, 1)
    depth = F.when(number != "", F.size(F.split(number, r"\."))).otherwise(0)
    return joined.select("doc_id", "seq", "text", "heading_scale", group.cast("long").alias("scale_level"), depth.cast("long").alias("depth"), F.least(F.greatest(group, depth), F.lit(6)).cast("long").alias("level"))


def role(text: Column, tag: Column | None = None) -> Column:
    """Role of a text by the ordered chain of tests that need no geometry."""
    t = T.squeezed(text)
    chain = (
        F.when(t.rlike(T.PAGE_NUMBER), "PAGE_NUMBER").when(t.rlike(T.TOC_TITLE), "TOC_TITLE").when(t.rlike(T.LEADER_LINE), "TOC_ENTRY")
        .when((F.length(t).between(3, 24)) & t.rlike(r"^[*•·∙–—\-~=_.◆❖✦ ]+$"), "THEMATIC_BREAK").when(t.rlike(T.BIBLIOGRAPHY_TITLE), "BIBLIOGRAPHY_TITLE")
        .when(t.rlike(T.CAPTION), "CAPTION").when(t.rlike(T.BULLET) | t.rlike(T.NUMBERED), "LIST_ITEM").otherwise("PARAGRAPH")
    )
    if tag is None:
        return chain
    return F.when(tag.isin("h1", "h2", "h3", "h4"), "HEADING").when(tag == "li", "LIST_ITEM").when(tag.isin("footer", "nav", "div"), "FURNITURE").when(tag == "title", "METADATA").otherwise(chain)


def contents_pages(rows: DataFrame) -> DataFrame:
    """Pages of a printed table of contents: three leader lines, or a title and one; a following page with one carries on.

    rows: book, page, text.
    """
    flagged = rows.groupBy("book", "page").agg(F.sum(F.when(F.col("text").rlike(T.LEADER_LINE), 1).otherwise(0)).alias("leaders"), F.max(T.squeezed(F.col("text")).rlike(T.TOC_TITLE)).alias("titled"))
    some = flagged.where("leaders >= 1").withColumn("sure", (F.col("leaders") >= 3) | F.col("titled"))
    w = Window.partitionBy("book").orderBy("page")
    runs = some.withColumn("run", F.col("page") - F.row_number().over(w))
    upto = Window.partitionBy("book", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("contents", F.max("sure").over(upto)).where("contents").select("book", "page", F.col("leaders").cast("long"))


def contents_links(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """Each contents entry with the first heading of its words. entries: book, seq, text; headings: book, seq, text."""
    key = lambda c: F.lower(T.squeezed(F.regexp_replace(c, T.LEADER_LINE, "")))
    first = headings.select("book", key(F.col("text")).alias("key"), "seq").groupBy("book", "key").agg(F.min("seq").alias("target"))
    return entries.withColumn("key", key(F.col("text"))).join(first, ["book", "key"], "left").select("book", "seq", "key", "target")


def plausible_titles(titles: DataFrame, openings: DataFrame) -> DataFrame:
    """Whether a metadata title is borne out by the opening text: four characters, and 60 % of its words there.

    titles: book, title; openings: book, text.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    text = openings.groupBy("book").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("text"))))).alias("known"))
    joined = titles.join(text, "book", "left").withColumn("w", words(F.col("title")))
    hits = F.size(F.filter("w", lambda x: F.array_contains("known", x)))
    boiler = F.lower("title").rlike(r"^(untitled|document|microsoft word|scan|img_|title)")
    return joined.select("book", "title", F.size("w").cast("long").alias("words"), F.coalesce(hits, F.lit(0)).cast("long").alias("found"), (~boiler & (F.length("title") >= 4) & (F.size("w") > 0) & (F.coalesce(hits, F.lit(0)) * 10 >= F.size("w") * 6)).alias("plausible"))


def caption_merge(rows: DataFrame) -> DataFrame:
    """Captions with the lower-case lines that carry them on. rows: doc_id, i, text."""
    w = Window.partitionBy("doc_id").orderBy("i")
    caption, lower = F.col("text").rlike(T.CAPTION), F.col("text").rlike(r"^\s*\p{Ll}")
    marked = rows.withColumn("stop", F.when(caption | ~lower, 1).otherwise(0)).withColumn("run", F.sum("stop").over(w))
    merged = marked.groupBy("doc_id", "run").agg(F.min("i").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.count("*").alias("lines"))
    return merged.where(F.col("text").rlike(T.CAPTION)).select("doc_id", "i", "text", "lines")


def formula_score(text: Column) -> Column:
    """How much a line looks like a formula: symbols, few words, an equation number."""
    symbols = "=+−×÷±≤≥≠≈∑∏∫√∞∂∇∈∉⊂⊃∪∩∀∃→⇒⇔αβγδεζηθλμπρστφχψωΓΔΘΛΠΣΦΨΩ^½¼¾²³"
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    share = F.when(solid > 0, (F.length(text) - F.length(F.translate(text, symbols, ""))) / solid).otherwise(0.0)
    by_share = F.when(share >= 0.30, 0.55).when(share >= 0.12, 0.35).when(share > 0, 0.15).otherwise(0.0)
    numbered = F.when(text.rlike(r"\([0-9]{1,3}(?:\.[0-9]{1,3})?\)\s*$"), 0.25).otherwise(0.0)
    few = F.when((share > 0) & (F.size(F.split(T.squeezed(text), " ")) <= 12), 0.10).otherwise(0.0)
    prose = (F.size(F.split(T.squeezed(text), " ")) >= 15) & (F.regexp_count(text, F.lit(f"{T.LETTER}{{3,}}")) >= 0.6 * F.size(F.split(T.squeezed(text), " ")))
    return F.when(prose, 0.0).otherwise(F.bround(by_share + numbered + few, 6))
