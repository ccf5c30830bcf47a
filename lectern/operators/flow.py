"""Paragraph runs, verse and list structure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MERGEABLE = ("PARAGRAPH", "QUOTE")
TRANSPARENT = ("FOOTNOTE", "CAPTION", "IMAGE", "PAGE_NUMBER", "HEADER", "FOOTER")
CLOSING = "”’\"'»"


def sentence_ends(column):
    """Whether a line ends a sentence; a closing quote does so only if what it closes did."""
    trimmed = F.rtrim(column)
    bare = F.regexp_replace(trimmed, f"[{CLOSING}]+$", "")
    clause = (bare != trimmed) & bare.rlike("[,;:–—-]$")
    return trimmed.rlike(f"[.!?…:;{CLOSING}]$") & ~clause


def paragraph_runs(nodes: DataFrame) -> DataFrame:
    """Runs of nodes that are one paragraph: transparent nodes are passed over, any other role cuts.

    nodes: doc_id, seq, role, text. A node continues the previous mergeable one of its role if that did not end a
    sentence. Decisions look at the previous mergeable node only, so one window gives the exact runs.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    solid = nodes.where(~F.col("role").isin(*TRANSPARENT))
    before = F.lag(F.struct("role", "text")).over(w)
    joined = F.col("role").isin(*MERGEABLE) & (before["role"] == F.col("role")) & (F.trim(before["text"]) != "") & (F.trim("text") != "") & ~sentence_ends(before["text"])
    runs = solid.withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return runs.groupBy("doc_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.first("role").alias("role"), F.count("*").alias("nodes"), T.join_broken_lines(F.transform(ordered, lambda x: x["text"])).alias("text")).drop("run")


def held_order(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Order in which runs and the transparent nodes inside them are emitted: held nodes after their run."""
    held = nodes.where(F.col("role").isin(*TRANSPARENT)).select("doc_id", "seq", "role")
    open_runs = runs.select("doc_id", "first_seq", "last_seq")
    inside = held.join(open_runs, (held["doc_id"] == open_runs["doc_id"]) & (F.col("seq") > F.col("first_seq")) & (F.col("seq") < F.col("last_seq")), "left").select(held["doc_id"], "seq", held["role"], F.coalesce("first_seq", "seq").alias("at"), F.lit(1).alias("held"))
    own = runs.select("doc_id", F.col("first_seq").alias("seq"), "role", F.col("first_seq").alias("at"), F.lit(0).alias("held"))
    w = Window.partitionBy("doc_id").orderBy("at", "held", "seq")
    return own.unionByName(inside).withColumn("position", F.row_number().over(w).cast("long")).select("doc_id", "seq", "role", "position")


def turn_runs(turns: DataFrame) -> DataFrame:
    """Runs of consecutive turns by the same side of a conversation (user, or not)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    side = F.when(F.col("role") == "user", "user").otherwise("other")
    marked = turns.withColumn("side", side).withColumn("fresh", F.when(F.lag(side).over(w) == side, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("conv_id", F.col("run").cast("long").alias("run")).agg(F.first("side").alias("side"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("chars"))


def list_items(rows: DataFrame) -> DataFrame:
    """List items with the number they carry and whether it follows the item before. rows: doc_id, i, text."""
    items = rows.where(F.col("text").rlike(T.BULLET) | F.col("text").rlike(T.NUMBERED)).withColumn("mark", F.regexp_extract("text", T.NUMBERED, 1))
    number = F.when(F.col("mark").rlike("^[0-9]+$"), F.col("mark").try_cast("int"))
    w = Window.partitionBy("doc_id").orderBy("i")
    return items.withColumn("number", number.cast("long")).withColumn("follows", F.coalesce((F.col("number") == F.lag("number").over(w) + 1) & (F.col("i") == F.lag("i").over(w) + 1), F.lit(False))).select("doc_id", "i", "mark", "number", "follows")


# Fixed values of the verse test.
SHORT_SHARE, SHORT_WIDTH, RIGHT_SPREAD, ENJAMBED, LENGTH_SPREAD, VERSE_LINES, GAP = 0.75, 0.72, 0.05, 0.25, 0.55, 3, 1.9


def is_verse(lines: list[tuple[str, float, float]], column: tuple[float, float]) -> bool:
    """Whether lines (text, x0, x1) set in a column (left, right) are verse: short, ragged, running on."""
    n = len(lines)
    left, right = column
    width = right - left
    if n < VERSE_LINES or width <= 0:
        return False
    texts = [t.strip() for t, _, _ in lines]
    if any(not t or len(t.split()) > 14 or t[:1].isdigit() or "|" in t for t in texts):
        return False
    if sum(1 for _, x0, x1 in lines if x1 - x0 < SHORT_WIDTH * width) < SHORT_SHARE * n:
        return False
    ends = [(x1 - left) / width for _, _, x1 in lines]
    mean = sum(ends) / n
    if (sum((e - mean) ** 2 for e in ends) / n) ** 0.5 < RIGHT_SPREAD:
        return False
    if sum(1 for t in texts[:-1] if t[-1] not in ".!?…:;") < ENJAMBED * (n - 1):
        return False
    sizes = [len(t) for t in texts]
    average = sum(sizes) / n
    return (sum((s - average) ** 2 for s in sizes) / n) ** 0.5 <= LENGTH_SPREAD * average


def verse_runs(blocks: DataFrame) -> DataFrame:
    """Verse in the lines of each document: doc_id, first_line, last_line, lines.

    From each line the longest run of lines with small gaps is tested; a run that fails gives up its first line only, so a
    later part may still pass. That depends on earlier decisions, hence one ordered fold per document and page.
    blocks: doc_id, page, i, text, x0, x1, y0, y1, font_size.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["y0", "i"]).itertuples(index=False))
        out, a = [], 0
        left, right = (min(r.x0 for r in rows), max(r.x1 for r in rows)) if rows else (0.0, 0.0)
        while a < len(rows):
            b = a + 1
            while b < len(rows) and rows[b].text.strip() and rows[a].text.strip() and rows[b].y0 - rows[b - 1].y1 <= GAP * rows[b].font_size and abs(rows[b].font_size - rows[b - 1].font_size) <= 1:
                b += 1
            if is_verse([(r.text, r.x0, r.x1) for r in rows[a:b]], (left, right)):
                out.append((rows[a].doc_id, rows[a].page, rows[a].i, rows[b - 1].i, b - a))
                a = b
            else:
                a += 1
        return pd.DataFrame(out, columns=["doc_id", "page", "first_line", "last_line", "lines"])

    # Verse has three short lines at least, none of them empty, long in words, or numbered: other pages stay out of Python.
    rows = blocks.select("doc_id", "page", "i", "text", "x0", "x1", "y0", "y1", "font_size")
    t = F.trim("text")
    fit = (t != "") & (F.size(F.split(t, r"\s+")) <= 14) & ~t.rlike("^[0-9]") & ~F.contains(t, F.lit("|"))
    page = rows.groupBy("doc_id", "page").agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.collect_list(F.when(fit, F.col("x1") - F.col("x0"))).alias("widths"))
    few = page.where(F.size(F.filter("widths", lambda w: w < SHORT_WIDTH * (F.col("r") - F.col("l")) + 1e-6)) >= VERSE_LINES).select("doc_id", "page")
    return rows.join(few, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page long, first_line long, last_line long, lines long")


def visual_lines(fragments: DataFrame) -> DataFrame:
    """Line number of text fragments: by height, a fragment joins the open line if it overlaps its first fragment by 55 %.

    fragments: doc_id, page, i, x0, y0, x1, y1.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "i"])
        number, anchor, numbers = -1, None, []
        for r in pdf.itertuples(index=False):
            if anchor is not None:
                overlap = min(anchor.y1, r.y1) - max(anchor.y0, r.y0)
                shorter = min(anchor.y1 - anchor.y0, r.y1 - r.y0)
            if anchor is None or overlap < 0.55 * shorter:
                number, anchor = number + 1, r
            numbers.append(number)
        return pdf.assign(line=numbers)[["doc_id", "page", "i", "line"]]

    return fragments.select("doc_id", "page", "i", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page long, i long, line long")


def stacked_notes(blocks: DataFrame) -> DataFrame:
    """Blocks of several notes as one row a note: a line opens a note only if it carries the next number.

    blocks: doc_id, block_id, text.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                parts, first = [], None
                for line in (r.text or "").split("\n"):
                    head = line.strip().split(" ", 1)[0].rstrip(".)]")
                    number = int(head) if head.isascii() and head.isdigit() and len(head) <= 4 else None
                    if number is not None and (first is None or number == first + len(parts)):
                        first = number if first is None else first
                        parts.append([line])
                    elif parts:
                        parts[-1].append(line)
                    else:
                        parts.append([line])
                        first = -(10**6) if first is None else first
                out += [(r.doc_id, r.block_id, n, "\n".join(p)) for n, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc_id", "block_id", "part", "text"])

    return blocks.select("doc_id", "block_id", "text").mapInPandas(fold, "doc_id long, block_id string, part long, text string")


def merge_title_lines(nodes: DataFrame) -> DataFrame:
    """Headings with the number above them and the lines they wrap over joined: doc_id, seq, text, lines.

    nodes: doc_id, seq, role, text, heading_scale. A bare division number takes the heading after it; consecutive
    headings of one size (0.51 points) are one title of four lines at most.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import re

        rows = list(pdf.sort_values("seq").itertuples(index=False))
        label = re.compile(T.BARE_NUMBER)
        out, a = [], 0
        while a < len(rows):
            r = rows[a]
            if r.role != "HEADING":
                a += 1
                continue
            b, texts = a + 1, [r.text.strip()]
            numbered = bool(label.match(r.text))
            size = None if numbered else r.heading_scale
            while b < len(rows) and rows[b].role == "HEADING" and len(texts) < 4 + numbered and not label.match(rows[b].text) and (size is None or abs(rows[b].heading_scale - size) <= 0.51) and not (size is not None and texts[-1][-1:] in ".!?:"):
                size = rows[b].heading_scale if size is None else size
                texts.append(rows[b].text.strip())
                b += 1
            out.append((r.doc_id, r.seq, " ".join(texts), len(texts)))
            a = b
        return pd.DataFrame(out, columns=["doc_id", "seq", "text", "lines"])

    return nodes.select("doc_id", "seq", "role", "text", "heading_scale").groupBy("doc_id").applyInPandas(fold, "doc_id long, seq long, text string, lines long")
