"""Small invented inputs for rules that the corpus never triggers, usable on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as S

#: name -> (DDL, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "note_refs": ("doc_id long, seq long, page long, chapter long, marker string", [
        (1, 10, 1, 1, "[1]"), (1, 11, 1, 1, "²"), (1, 12, 2, 1, "1."), (1, 13, 2, 2, "*"), (1, 14, 3, 2, "7"), (1, 15, 4, 2, "word"),
        (2, 10, 1, 3, "1"), (2, 11, 1, 4, "(1)"), (2, 12, 2, 4, "2"), (2, 13, 2, 5, "3"),
    ]),
    "note_bodies": ("doc_id long, seq long, page long, marker string", [
        (1, 20, 1, "1"), (1, 21, 1, "2)"), (1, 22, 2, "1"), (1, 23, 2, "1."), (1, 24, 3, "*"), (1, 25, 2, "*"), (2, 20, 2, "1"), (2, 21, 1, "1"),
    ]),
    "end_nodes": ("doc_id long, seq long, role string, level long, text string", [
        (1, 1, "HEADING", 1, "A Beginning"), (1, 2, "PARAGRAPH", None, "Prose without any number."), (1, 3, "HEADING", 1, "Notes"), (1, 4, "HEADING", 2, "Chapter III"),
        (1, 5, "PARAGRAPH", None, "1. First note of the third chapter."), (1, 6, "PARAGRAPH", None, "2 Second note there."), (1, 7, "HEADING", 2, "Notes to Chapter 4"),
        (1, 8, "PARAGRAPH", None, "1. First note of the fourth."), (1, 9, "PARAGRAPH", None, "carried over"), (1, 10, "HEADING", 1, "Index"), (1, 11, "PARAGRAPH", None, "1. no note at all"),
        (2, 1, "HEADING", 2, "Endnotes"), (2, 2, "LIST_ITEM", None, "* starred note"), (2, 3, "LIST_ITEM", None, "3) third note"), (2, 4, "HEADING", 2, "References"), (2, 5, "PARAGRAPH", None, "4. outside"),
    ]),
    "bib_nodes": ("doc_id long, seq long, role string, text string, x0 double, font_size double", [
        (1, 1, "HEADING", "Text", 72.0, 14.0), (1, 2, "PARAGRAPH", "Before the list.", 72.0, 10.0), (1, 3, "HEADING", "References", 72.0, 14.0),
        (1, 4, "PARAGRAPH", "[1] Alder, B. A study of rivers.", 72.0, 10.0), (1, 5, "PARAGRAPH", "Second line of it.", 72.0, 10.0), (1, 6, "PARAGRAPH", "[2] Birch, C. Of hills.", 72.0, 10.0), (1, 7, "PARAGRAPH", "https://rivers.example.org/2", 72.0, 10.0), (1, 8, "PARAGRAPH", "[3] Cedar, D. Of seas.", 72.0, 10.0), (1, 9, "HEADING", "Index", 72.0, 14.0), (1, 10, "PARAGRAPH", "[4] not an entry", 72.0, 10.0),
        (2, 1, "HEADING", "Bibliographie", 72.0, 14.0), (2, 2, "PARAGRAPH", "Doe, E. Hanging entry one,", 72.0, 10.0), (2, 3, "PARAGRAPH", "set in on its second line.", 90.0, 10.0), (2, 4, "PARAGRAPH", "Elm, F. Entry two.", 72.0, 10.0),
    ]),
    "contents": ("book long, page long, seq long, text string", [
        (1, 1, 1, "Contents"), (1, 1, 2, "The River ........ 5"), (1, 2, 3, "The Hill . . . . . . 19"), (1, 3, 4, "Plain prose without leaders."), (1, 4, 5, "A stray ..... 7"),
        (2, 1, 1, "One ...... 1"), (2, 1, 2, "Two ...... 2"), (2, 1, 3, "Three ...... 3"), (2, 2, 4, "Four _____ 4"), (2, 4, 5, "Late ..... 9"),
    ]),
    "contents_heads": ("book long, seq long, text string", [(1, 40, "The  River"), (1, 41, "The Hill"), (1, 90, "the river"), (2, 50, "Three"), (2, 51, "Zero")]),
    "tables": ("doc_id long, table long, page long, y0 double, cols long, captioned boolean", [
        (1, 1, 3, 400.0, 3, True), (1, 2, 4, 72.0, 3, False), (1, 3, 5, 72.0, 3, False), (1, 4, 5, 300.0, 3, False), (1, 5, 6, 72.0, 2, False), (1, 6, 7, 72.0, 2, True), (2, 1, 1, 90.0, 2, False), (2, 2, 3, 90.0, 2, False),
    ]),
    "table_cells": ("doc_id long, table long, row long, col long, text string", [
        (1, t, r, c, f"{'head' if r == 0 and t in (1, 2) else f't{t}r{r}'}{c}") for t in (1, 2, 3) for r in range(3) for c in range(3)
    ]),
    "spans": ("doc_id long, table long, x0 double, x1 double", [(1, 1, 72.0, 110.0), (1, 1, 75.0, 120.0), (1, 1, 140.0, 170.0), (1, 1, 165.0, 180.0), (1, 1, 200.0, 230.0), (1, 2, 72.0, 90.0), (1, 2, 90.0, 95.0), (1, 2, 95.5, 99.0)]),
    "payloads": ("doc_id long, json string", [
        (1, '{"engine":"e","pages":[{"page":1,"lines":[{"confidence":0.9,"words":[{"text":"old","bbox":[0,0,9,9],"confidence":0.5}]}]},{"page":1,"lines":[{"confidence":0.9,"words":[{"text":"Two","bbox":[72,100,90,110],"confidence":0.9},{"text":"words","bbox":[94,100,120,112],"confidence":0.7}]},{"confidence":0.8,"words":[{"text":"bad","bbox":[50,0,40,9],"confidence":0.5},{"text":"over","bbox":[1,1,2,2],"confidence":1.5}]}]},{"page":2,"lines":[]}]}'),
        (2, '{"engine":"e","pages":[{"page":7,"lines":[{"confidence":0.4,"words":[{"text":"lone","bbox":[10,20,30,31.5],"confidence":0.4}]}]}]}'),
    ]),
    "reports": ("doc_id long, integrity double, valid boolean, note_ratio double, pages long, headings long, ocr_confidence double, suspicious boolean, unmatched_share double, suspicious_share double, unlinked_share double, needs_review boolean", [
        (1, 1.0, True, 1.0, 120, 12, None, False, 0.0, 0.0, 0.0, False), (2, 0.97, True, 0.5, 30, 0, None, False, 0.03, 0.1, 0.2, True), (3, 0.8, True, 1.0, 4, 0, 0.81, True, 0.5, 0.9, 2.0, True), (4, 0.1, False, 0.0, 9, 0, 0.3, True, 1.0, 1.0, 1.0, True),
    ]),
    "page_images": ("book long, width long, height long, page_aspect double, cover boolean", [
        (1, 1700, 2200, 0.7727, False), (1, 1700, 2200, 0.7727, True), (1, 400, 518, 0.7727, False), (1, 2200, 1700, 0.7727, False), (2, 1000, 1400, None, False), (3, 1000, 1400, 0.7, False), (3, 1010, 1400, 0.7, None),
    ]),
    "shouted": ("id long, text string", [
        (1, "BÖLÜM 3"), (2, "KISIM IV"), (3, "CAPÍTULO 2"), (4, "İÇİNDEKİLER"), (5, "TABLE DES MATIÈRES"), (6, "KAYNAKÇA"), (7, "ŞEKİL 2. Nehir"), (8, "Fig. 3: Bridge"), (9, "çizelge 12 – yıllar"), (10, "RÉFÉRENCES"),
        (11, "Partition walls"), (12, "CHAPTER 3. The Mill"), (13, "Bölümler"), (14, "المراجع"), (15, "Contents of the box"), (16, "KİTAP İKİ"), (17, "Table of 3 rows"),
    ]),
    "worn_texts": ("doc_id long, text string", [
        (1, "summary " * 8 + "\nA Sumrnary , of it,and more!!\n" + "güzel " * 100 + "özel " * 100 + "\nGuzel GUZEL Ozel summary\n" + "gibi " * 8 + "\ngib i and Gib i\n\nﬁne “ words"),
        (2, "summary sumrnary summary\nplain"), (3, ""), (4, None),
    ]),
    "display_titles": ("doc_id long, seq long, text string", [
        (1, 1, "BİL6İ5AYAR  ÇA6I"), (1, 2, "(6EY)"), (1, 3, "A sh0ck, what sh0ck!"), (1, 4, "2041 AND 6"), (1, 5, "0000X"), (1, 6, "GELD!"), (1, 7, "«AFTA"), (1, 8, ""), (2, 1, "6EY"),
    ]),
    "title_words": ("doc_id long, text string", [(1, "bilgisayar bilgisayar çağı çağı şey şey şey gey gey shock shock hafta hafta geldi"), (2, "şey")]),
    "paragraph_nodes": ("doc_id long, seq long, role string, text string", [
        (1, 1, "PARAGRAPH", "The river rose in the"), (1, 2, "FOOTNOTE", "1 A note."), (1, 3, "PARAGRAPH", "night and mor-"), (1, 4, "PAGE_NUMBER", "12"), (1, 5, "PARAGRAPH", "ning came."), (1, 6, "PARAGRAPH", "A new start,”"), (1, 7, "PARAGRAPH", "he said."), (1, 8, "HEADING", "Two"), (1, 9, "PARAGRAPH", "lower but cut"), (1, 10, "QUOTE", "a quote"), (1, 11, "QUOTE", "goes on"),
    ]),
}


def regions(blocks: DataFrame) -> DataFrame:
    """Two boxes on every page of every document, wider the further its number lies in a cycle of forty."""
    pages = blocks.select("doc_id", "page").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    top = 100.0 + 150.0 * F.col("k")
    return pages.select("doc_id", "page", (10 * F.col("page") + F.col("k")).cast("long").alias("region"), F.lit(60.0).alias("x0"), top.alias("y0"), (300.0 + 40.0 * (F.col("doc_id") % 40)).alias("x1"), (top + 80.0).alias("y1"))


REGIONS = """regions AS (SELECT doc_id, page, (10 * page + k)::BIGINT AS region, 60.0::DOUBLE AS x0, 100.0::DOUBLE + 150 * k AS y0, 300.0::DOUBLE + 40 * (doc_id % 40) AS x1, 180.0::DOUBLE + 150 * k AS y1
  FROM (SELECT DISTINCT doc_id, page FROM blocks), range(2) t(k))"""


def frame(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


def view(name: str) -> str:
    ddl, rows = TABLES[name]
    return S.values(name, ", ".join(c.split()[0] for c in ddl.split(", ")), rows)
