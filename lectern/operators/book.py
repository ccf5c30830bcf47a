"""Chapters, navigation and links of a book, and what became of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def chapters(nodes: DataFrame) -> DataFrame:
    """Adds chapter (0 is what stands before the first one) and chapter_title to nodes.

    nodes: doc_id, seq, role, level, text. The chapter level is the most frequent level of division headings if there are
    two, else the shallowest level of two headings, else the smallest; ties go to the shallower level.
    """
    heads = nodes.where("role = 'HEADING'").withColumn("division", F.col("text").rlike(T.DIVISION_WORD))
    by_level = heads.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.sum(F.col("division").cast("int")).alias("d"))
    choice = by_level.groupBy("doc_id").agg(
        F.sum("d").alias("divisions"), F.max(F.struct("d", -F.col("level"))).alias("mode"), F.min(F.when(F.col("n") >= 2, F.col("level"))).alias("two"), F.min("level").alias("least")
    ).select("doc_id", F.when(F.col("divisions") >= 2, -F.col("mode.col2")).otherwise(F.coalesce("two", "least")).alias("split"))
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("role") == "HEADING") & (F.col("level") <= F.col("split"))
    marked = nodes.join(choice, "doc_id", "left").withColumn("opens", F.coalesce(opens, F.lit(False)))
    numbered = marked.withColumn("chapter", F.sum(F.col("opens").cast("long")).over(upto))
    title = F.last(F.when(F.col("opens"), F.col("text")), True).over(upto)
    return numbered.withColumn("chapter_title", F.coalesce(title, F.lit("Front Matter"))).drop("opens", "split")


def split_level(headings: DataFrame, pages: DataFrame, per_chapter: int = 60) -> DataFrame:
    """Heading level that cuts each book into chapters of at most so many pages; else the shallowest with two, else the least.

    headings: doc_id, level; pages: doc_id, page_count.
    """
    counts = headings.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("level"))).join(pages, "doc_id")
    fits = (F.col("upto") >= 2) & (F.col("page_count") <= per_chapter * F.col("upto"))
    return running.groupBy("doc_id").agg(F.min(F.when(fits, F.col("level"))).alias("fits"), F.min(F.when(F.col("n") >= 2, F.col("level"))).alias("two"), F.min("level").alias("least")).select("doc_id", F.coalesce("fits", "two", "least").alias("level"))


def slugs(titles: DataFrame) -> DataFrame:
    """A file name for each chapter: its slug, with a number from the second of that slug on. titles: doc_id, seq, text."""
    short = F.regexp_replace(F.left(T.slug(F.col("text")), F.lit(80)), "-+$", "")
    named = titles.withColumn("base", F.when(short == "", F.lit("chapter")).otherwise(short))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("seq"))
    return named.withColumn("n", n).select("doc_id", "seq", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


def navigation(nodes: DataFrame) -> DataFrame:
    """Entries of the contents: headings of a chapter's least level and the next one. nodes: doc_id, seq, role, level, text, chapter."""
    heads = nodes.where("role = 'HEADING'")
    top = F.min("level").over(Window.partitionBy("doc_id", "chapter"))
    kept = heads.withColumn("top", top).where(F.col("level") <= F.col("top") + 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return kept.select("doc_id", place.cast("long").alias("position"), "chapter", (F.col("level") - F.col("top")).cast("long").alias("depth"), "text")


def dangling_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links whose target does not exist. links: doc_id, seq, target; anchors: doc_id, anchor."""
    return links.join(anchors.select("doc_id", F.col("anchor").alias("target")).distinct(), ["doc_id", "target"], "left_anti")


def integrity(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Words of the source and of the output per document, the kept share, and blocks that reached no node.

    blocks: doc_id, block_id, text, furniture; nodes: doc_id, source_block_ids, text. The raw ratio shows duplication.
    """
    words = lambda c: T.count_of(c, T.WORD)
    used = nodes.select("doc_id", F.explode("source_block_ids").alias("block_id")).distinct().withColumn("used", F.lit(True))
    source = blocks.join(used, ["doc_id", "block_id"], "left").withColumn("w", words(F.col("text")))
    lost = ~F.col("furniture") & F.col("used").isNull() & (F.col("w") > 0)
    sums = source.groupBy("doc_id").agg(F.sum("w").alias("source_words"), F.sum(F.when(F.col("furniture"), F.col("w")).otherwise(0)).alias("furniture_words"), F.sum(lost.cast("long")).alias("unaccounted"))
    out = nodes.groupBy("doc_id").agg(F.sum(words(F.col("text"))).alias("output_words"))
    joined = sums.join(out, "doc_id", "left").withColumn("output_words", F.coalesce("output_words", F.lit(0))).withColumn("expected", F.greatest(F.col("source_words") - F.col("furniture_words"), F.lit(0)))
    raw = F.when(F.col("expected") > 0, F.col("output_words") / F.col("expected")).otherwise(1.0)
    return joined.withColumn("raw_ratio", F.bround(raw, 6)).withColumn("ratio", F.bround(F.least(raw, F.lit(1.0)), 6)).withColumn("suspicious", (F.col("unaccounted") > 0) | (F.col("ratio") < 0.90))


def structure_score(parts: DataFrame) -> DataFrame:
    """Mean of four shares as 0 to 100. parts: doc_id, heading_share, paragraph_share, list_share, note_share."""
    mean = (F.col("heading_share") + F.col("paragraph_share") + F.col("list_share") + F.col("note_share")) / 4
    return parts.select("doc_id", F.bround(100 * mean, 1).alias("structure_score"))


def quality_score(reports: DataFrame) -> DataFrame:
    """Score from 0 to 100 of each report, with its penalties and caps.

    reports: doc_id, integrity, valid, note_ratio, pages, headings, ocr_confidence (0 to 1 or null), suspicious,
    unmatched_share, suspicious_share, unlinked_share, needs_review.
    """
    structure = F.when((F.col("pages") > 5) & (F.col("headings") == 0), 0.5).otherwise(1.0)
    valid = F.col("valid").cast("double")
    plain = 0.40 * F.col("integrity") + 0.30 * valid + 0.15 * F.col("note_ratio") + 0.15 * structure
    read = 0.32 * F.col("integrity") + 0.26 * valid + 0.14 * F.col("note_ratio") + 0.13 * structure + 0.15 * F.col("ocr_confidence")
    base = 100 * F.when(F.col("ocr_confidence").isNull(), plain).otherwise(read)
    base = F.when(F.col("suspicious"), F.least(base, F.lit(85.0))).otherwise(base)
    penalty = F.least(F.lit(12.0), 100 * F.col("unmatched_share")) + F.least(F.lit(10.0), 20 * F.col("suspicious_share")) + F.least(F.lit(10.0), 10 * F.col("unlinked_share"))
    scored = F.least(base - penalty, F.when(F.col("needs_review"), 92.0).otherwise(100.0))
    return reports.select("doc_id", F.bround(penalty, 6).alias("penalty"), F.bround(F.least(F.greatest(scored, F.lit(0.0)), F.lit(100.0)), 1).alias("score"))


# Stages of a conversion in order.
STAGES = ("queued", "analyzing", "extracting", "ocr", "structuring", "reviewing", "building", "validating", "completed", "failed")


def percent_complete(stage: Column, page: Column, pages: Column) -> Column:
    """Progress by stage, and by page inside the two stages that go page by page."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    step = 100.0 / (len(STAGES) - 2)
    inside = F.when(stage.isin("extracting", "ocr") & (pages > 0), step * F.least(page / pages, F.lit(1.0))).otherwise(0.0)
    return F.when(stage == "completed", 100.0).when(stage == "failed", 0.0).otherwise(F.bround(step * (place - 1) + inside, 6))


def review_candidates(nodes: DataFrame) -> DataFrame:
    """Nodes of low confidence with 200 characters of context on either side. nodes: doc_id, seq, role, text, confidence."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    around = nodes.withColumn("before", F.right(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(200))).withColumn("after", F.left(F.coalesce(F.lead("text").over(w), F.lit("")), F.lit(200)))
    return around.where((F.col("confidence") < 0.70) & ~F.col("role").isin("IMAGE", "HEADER", "FOOTER", "PAGE_NUMBER"))


def local_opinions(requests: DataFrame) -> DataFrame:
    """Opinions by rule: a heading that reads as a sentence is a paragraph, other headings gain confidence, tiny paragraphs may be headings."""
    t = T.squeezed(F.col("text"))
    sentence = (F.size(F.split(t, " ")) > 12) | (t.rlike(r"[.!?]$") & (F.size(F.split(t, " ")) > 6))
    heading = F.col("role") == "HEADING"
    role = F.when(heading & sentence, "PARAGRAPH").when(heading, "HEADING").when((F.col("role") == "PARAGRAPH") & (F.length(t) <= 20), "HEADING").otherwise(F.col("role"))
    sure = F.when(heading & sentence, 0.60).when(heading, F.least(F.lit(0.8), F.col("confidence") + 0.15)).when((F.col("role") == "PARAGRAPH") & (F.length(t) <= 20), 0.55).otherwise(F.col("confidence"))
    return requests.select("doc_id", "seq", role.alias("new_role"), F.bround(sure, 6).alias("new_confidence"))


def apply_opinions(nodes: DataFrame, opinions: DataFrame) -> DataFrame:
    """Nodes with each opinion that is strictly more confident; opinions carry no text."""
    joined = nodes.join(opinions, ["doc_id", "seq"], "left")
    better = F.coalesce(F.col("new_confidence") > F.col("confidence"), F.lit(False))
    return joined.withColumn("changed", better & (F.col("new_role") != F.col("role"))).withColumn("role", F.when(better, F.col("new_role")).otherwise(F.col("role"))).withColumn("confidence", F.when(better, F.col("new_confidence")).otherwise(F.col("confidence"))).drop("new_role", "new_confidence")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words: text, box, upper-median height as type size, mean confidence."""
    from .layout import upper_median

    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy("doc_id", "page", "line_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.bround(upper_median(F.collect_list(F.col("y1") - F.col("y0"))), 6).alias("font_size"), F.bround(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("words"),
    )


def latest_jobs(events: DataFrame) -> DataFrame:
    """Last state of each job: the later update wins, then the larger event. events: job_id, stage, updated_at, event_id."""
    return events.groupBy("job_id").agg(F.max(F.struct("updated_at", "event_id", "stage")).alias("x")).select("job_id", "x.stage", "x.updated_at", "x.event_id")
