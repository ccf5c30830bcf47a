"""Footnotes, endnotes and bibliographies: where they are and what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def footnote_links(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each reference with the note of its number on its page, else on the next; the last such note of a page wins.

    refs: doc_id, seq, page, marker; bodies: doc_id, seq, page, marker. Markers are compared in their bare form.
    """
    r = refs.withColumn("m", T.marker(F.col("marker"))).where("m is not null")
    b = bodies.withColumn("m", T.marker(F.col("marker"))).where("m is not null").groupBy("doc_id", F.col("page").alias("b_page"), "m").agg(F.max("seq").alias("target"))
    near = r.join(b, ["doc_id", "m"], "left").where(F.col("b_page").isNull() | F.col("b_page").between(F.col("page"), F.col("page") + 1))
    best = near.groupBy("doc_id", "seq", "m").agg(F.min(F.struct("b_page", "target")).alias("x"))
    return r.select("doc_id", "seq", "page", "m").join(best, ["doc_id", "seq", "m"], "left").select("doc_id", "seq", "page", F.col("m").alias("marker"), F.col("x.target").alias("target"))


def endnote_sections(nodes: DataFrame) -> DataFrame:
    """Nodes of collected notes with their entry number and chapter scope. nodes: doc_id, seq, role, level, text.

    A section runs from its heading to the next heading of its level or above that names no chapter scope.
    """
    t = T.squeezed(F.col("text"))
    heading = F.col("role") == "HEADING"
    opens = heading & t.rlike(T.ENDNOTE_HEADING)
    scope_text = F.regexp_extract(t, T.CHAPTER_SCOPE, 1)
    scopes = heading & (scope_text != "")
    w = Window.partitionBy("doc_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = nodes.withColumn("opens", opens).withColumn("scopes", scopes).withColumn("scope_here", F.when(scopes, T.roman(scope_text)))
    marked = marked.withColumn("open_seq", F.last(F.when(F.col("opens"), F.col("seq")), True).over(upto)).withColumn("open_level", F.last(F.when(F.col("opens"), F.col("level")), True).over(upto))
    ends = (F.col("role") == "HEADING") & ~F.col("opens") & ~F.col("scopes") & (F.col("level") <= F.col("open_level"))
    section = Window.partitionBy("doc_id", "open_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.where("open_seq is not null").withColumn("closed", F.max(F.coalesce(ends, F.lit(False))).over(section)).where("not closed")
    scoped = inside.withColumn("scope", F.last("scope_here", True).over(section))
    number = F.regexp_extract(t, T.NOTE_ENTRY, 1)
    return scoped.where((F.col("role") != "HEADING") & (number != "")).select("doc_id", "seq", F.col("open_seq").alias("section"), F.col("scope").cast("long").alias("scope"), number.alias("number"))


def endnote_links(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """Each reference with the entry of its number in its chapter's scope, else with an unscoped one; the first wins.

    refs: doc_id, seq, chapter, marker; entries: doc_id, seq, scope, number.
    """
    r = refs.withColumn("m", T.marker(F.col("marker"))).where("m is not null")
    e = entries.withColumn("m", T.marker(F.col("number"))).where("m is not null")
    scoped = e.where("scope is not null").groupBy("doc_id", "m", F.col("scope").alias("chapter")).agg(F.min("seq").alias("scoped"))
    free = e.where("scope is null").groupBy("doc_id", "m").agg(F.min("seq").alias("free"))
    return r.join(scoped, ["doc_id", "m", "chapter"], "left").join(free, ["doc_id", "m"], "left").select("doc_id", "seq", "chapter", F.col("m").alias("marker"), F.coalesce("scoped", "free").alias("target"))


def bibliography_entries(nodes: DataFrame) -> DataFrame:
    """Entries of bibliographies: their section, number in it, first line and text.

    nodes: doc_id, seq, role, text, x0, font_size. A section runs from its title to the next heading. In a numbered list
    (three numbered lines) a number opens an entry; else a line at the margin of a hanging list does; a link never opens one.
    """
    t = T.squeezed(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("role").isin("HEADING", "THEMATIC_BREAK", "TOC_ENTRY")
    marked = nodes.withColumn("title", t.rlike(T.BIBLIOGRAPHY_TITLE)).withColumn("part", F.sum(F.when(stop | F.col("title"), 1).otherwise(0)).over(upto))
    part = Window.partitionBy("doc_id", "part")
    inside = marked.withColumn("in_list", F.max("title").over(part)).where("in_list").withColumn("section", F.min("seq").over(part)).where(~F.col("title"))
    inside = inside.withColumn("numbered", F.sum(F.when(t.rlike(T.NUMBERED_ENTRY), 1).otherwise(0)).over(part)).withColumn("margin", F.min("x0").over(part))
    hung = F.col("x0") > F.col("margin") + F.greatest(0.6 * F.col("font_size"), F.lit(4.0))
    inside = inside.withColumn("hung", hung).withColumn("hanging", F.avg(F.when(hung, 1.0).otherwise(0.0)).over(part) >= 0.1)
    opens = F.when(t.rlike(T.LINK_LINE), False).when(F.col("numbered") >= 3, t.rlike(T.NUMBERED_ENTRY)).when(F.col("hanging"), ~F.col("hung")).otherwise(True)
    order = part.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    entries = inside.withColumn("entry", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", t.alias("t")))), lambda x: x["t"]), " ")
    return entries.groupBy("doc_id", "section", F.col("entry").cast("long").alias("entry")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("lines"), text.alias("text"))


def note_numbers(blocks: DataFrame) -> DataFrame:
    """Numbers that notes at the foot of a page carry. blocks: doc_id, page, text, y0, page_height, font_size, body_size."""
    number = F.regexp_extract(F.trim("text"), T.NOTE_ENTRY, 1)
    foot = (F.col("font_size") < 0.92 * F.col("body_size")) & (F.col("y0") > 0.66 * F.col("page_height"))
    return blocks.where(foot & (number != "")).groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set(number)), ",").alias("numbers"))


def glued_markers(rows: DataFrame, available: DataFrame) -> DataFrame:
    """Note numbers welded to the end of a word, where a note of that number is on the page or the next.

    rows: doc_id, page, i, text; available: doc_id, page, number.
    """
    found = rows.select("doc_id", "page", "i", F.explode(F.regexp_extract_all("text", F.lit(rf"{T.LETTER}{{3}}[!?.,;:»\"')]?([0-9]{{1,2}})(?=\s|$)"), F.lit(1))).alias("number"))
    a = available.select("doc_id", F.col("page").alias("a_page"), "number").distinct()
    cond = (found["doc_id"] == a["doc_id"]) & (found["number"] == a["number"]) & (F.col("a_page").between(F.col("page"), F.col("page") + 1))
    return found.join(a, cond, "left_semi")
