"""Spans and blocks: style, lines, roles that need geometry, openings of chapters and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Error codes and what each means; review providers and what each resolves to.
ERRORS = {
    "corrupted_pdf": "the file cannot be read", "encrypted_pdf": "the file needs a password", "too_many_pages": "the file has too many pages", "not_a_pdf": "the file is no PDF", "empty_file": "the file is empty",
    "too_large": "the file is too large", "ocr_unavailable": "no text can be recognised here", "ocr_too_slow": "recognition would take too long", "internal_error": "something failed", "conversion_timeout": "the conversion took too long", "rate_limited": "too many requests",
}
PROVIDERS = {"none": "none", "local": "local", "remote-a": "local", "remote-b": "local"}
FOOT, NOTE_SMALL, NOTE_MARKED, DROP_CAP = 0.66, 0.75, 0.90, 1.8


def style(flags: Column, font: Column) -> Column:
    """Bold and italic by the flags of a span or the name of its font."""
    name = F.lower(font)
    bold = (flags.bitwiseAND(16) != 0) | name.contains("bold")
    italic = (flags.bitwiseAND(2) != 0) | name.contains("italic") | name.contains("oblique")
    return F.struct(bold.alias("bold"), italic.alias("italic"))


def folio_head(text: Column, size: Column, body: Column) -> Column:
    """A page number and a title in one line of body-size type."""
    return text.rlike(T.FOLIO_HEAD) & ~text.contains("\n") & (F.size(F.split(T.squeezed(text), " ")) <= 14) & (size <= 1.05 * body)


def note_body(text: Column) -> Column:
    return text.rlike(r"^\s*([0-9]{1,4}|[*†‡§¶#]{1,3})[.)\]]?\s+\S+") & (F.size(F.split(T.squeezed(text), " ")) >= 3)


def display_type(size: Column, body: Column) -> Column:
    return F.when(size >= 1.5 * body, "chapter-title").when(size >= 1.35 * body, "display").otherwise("text")


def fallback_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.55, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3).otherwise(4)


def reference_candidate(text: Column, superscript: Column, size: Column, body: Column) -> Column:
    """A span that may refer to a note: up to six marker characters, raised or small."""
    return F.trim(text).rlike(r"^[0-9*†‡§¶#⁰¹²³⁴-⁹\[\](){}<>.:]{1,6}$") & (superscript | ((body > 0) & (size <= 0.75 * body)))


def file_name(name: Column) -> Column:
    """A name for a download: safe characters, 100 at most."""
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9._ -]", "_"), F.lit(100))


def match_case(word: Column, like: Column) -> Column:
    """A replacement in the capitals of the word it replaces."""
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).when(F.left(like, F.lit(1)) == F.upper(F.left(like, F.lit(1))), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def caller(forwarded: Column, peer: Column) -> Column:
    """Who a request counts for: the first address it was forwarded for, else the peer."""
    first = F.trim(F.get(F.split(F.coalesce(forwarded, F.lit("")), ","), 0))
    return F.when(first != "", first).otherwise(peer)


def alt_text(pictures: Column, caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) != "", caption).when(pictures == 1, "Picture").otherwise(F.format_string("%d pictures", pictures))


def dominant_span(spans: DataFrame) -> DataFrame:
    """The longest span of each block, the first of equal ones. spans: doc_id, block_id, span_no, text, font, font_size."""
    return spans.groupBy("doc_id", "block_id").agg(F.max_by(F.struct("span_no", "text", "font", "font_size"), F.struct(F.length("text"), -F.col("span_no"))).alias("s")).select("doc_id", "block_id", "s.*")


def line_boxes(spans: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Lines of each block from its spans: a span that ends a line is the last of it. spans: doc_id, block_id, span_no, text, x0, x1, line_break_after."""
    w = Window.partitionBy("doc_id", "block_id").orderBy("span_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = spans.withColumn("line", F.coalesce(F.sum(F.col("line_break_after").cast("long")).over(w), F.lit(0)))
    rows = numbered.where(F.trim("text") != "") if skip_blank else numbered
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id", "block_id", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def spaced_fragments(fragments: DataFrame) -> DataFrame:
    """Text of each line with the spaces its fragments lost: a gap of .12 to 2.5 type sizes, no white space beside it.

    fragments: doc_id, line, pos, text, x0, x1, size.
    """
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    gap = (F.col("x0") - F.lag("x1").over(w)) / F.col("size")
    lost = (gap > 0.12) & (gap <= 2.5) & ~F.lag("text").over(w).rlike(r"\s$") & ~F.col("text").rlike(r"^\s")
    marked = fragments.withColumn("piece", F.concat(F.when(lost, " ").otherwise(""), "text"))
    return marked.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))


def emphasis_runs(spans: DataFrame) -> DataFrame:
    """Runs of one style in blocks that mix styles; a run ends at a line break. spans: doc_id, block_id, span_no, text, bold, italic, line_break_after."""
    block = Window.partitionBy("doc_id", "block_id")
    w = block.orderBy("span_no")
    kind = F.when(F.col("bold") & F.col("italic"), "bold-italic").when(F.col("bold"), "bold").when(F.col("italic"), "italic").otherwise("plain")
    styled = spans.withColumn("kind", kind).withColumn("kinds", F.size(F.collect_set(kind).over(block)))
    fresh = F.when((F.lag("kind").over(w) == F.col("kind")) & ~F.lag("line_break_after").over(w), 0).otherwise(1)
    runs = styled.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).where((F.col("kinds") > 1) & (F.col("kind") != "plain"))
    return runs.groupBy("doc_id", "block_id", "run").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("text"))


def foot_notes(blocks: DataFrame) -> DataFrame:
    """Blocks that are notes at the foot of a page that has body text.

    blocks: doc_id, page, i, text, y0, page_height, font_size, body_size.
    """
    has_body = F.max(F.abs(F.col("font_size") - F.col("body_size")) <= 0.05 * F.col("body_size")).over(Window.partitionBy("doc_id", "page"))
    ratio = F.col("font_size") / F.col("body_size")
    small = (ratio <= NOTE_SMALL) | ((ratio <= NOTE_MARKED) & F.col("text").rlike(T.NOTE_ENTRY))
    return blocks.withColumn("has_body", has_body).where((F.col("y0") > FOOT * F.col("page_height")) & F.col("has_body") & small).drop("has_body")


def block_quotes(blocks: DataFrame) -> DataFrame:
    """Indented blocks in italic or smaller type on pages with body text, machine-read ones never.

    blocks: doc_id, page, i, text, x0, margin, font_size, body_size, italic, machine_read, lines.
    """
    has_body = F.max(F.abs(F.col("font_size") - F.col("body_size")) <= 0.05 * F.col("body_size")).over(Window.partitionBy("doc_id", "page"))
    inset = F.col("x0") > F.col("margin") + F.greatest(1.2 * F.col("body_size"), F.lit(8.0))
    apart = F.col("italic") | (F.col("font_size") <= 0.96 * F.col("body_size"))
    return blocks.withColumn("has_body", has_body).where(inset & apart & F.col("has_body") & ~F.col("machine_read")).drop("has_body")


def stanzas(lines: DataFrame) -> DataFrame:
    """Stanza and indent of verse lines: a gap over 1.35 times the median one begins a stanza, an indent is nine points.

    lines: doc_id, run, i, x0, y0, y1.
    """
    run = Window.partitionBy("doc_id", "run")
    order = run.orderBy("i")
    gapped = lines.withColumn("gap", F.col("y0") - F.lag("y1").over(order))
    marked = gapped.withColumn("usual", F.median("gap").over(run)).withColumn("base", F.min("x0").over(run))
    breaks = F.when(F.col("gap") > 1.35 * F.col("usual"), 1).otherwise(0)
    return marked.withColumn("b", breaks).withColumn("stanza", F.sum("b").over(order).cast("long")).withColumn("indent", F.bround((F.col("x0") - F.col("base")) / 9.0).cast("long")).select("doc_id", "run", "i", "stanza", "indent")


def nearest_body(caps: DataFrame, bodies: DataFrame) -> DataFrame:
    """The body block each drop cap belongs to: within a window beside it, the nearest by sides.

    caps: doc_id, page, i, text, x1, y0, body_size; bodies: doc_id, page, i, x0, y0, font_size.
    """
    b = bodies.select("doc_id", "page", F.col("i").alias("target"), F.col("x0").alias("b_x0"), F.col("y0").alias("b_y0"), F.col("font_size").alias("b_size"))
    s = F.col("body_size")
    near = caps.join(b, ["doc_id", "page"]).where(
        (F.abs(F.col("b_size") - s) <= 0.2 * s) & F.col("b_y0").between(F.col("y0") - s, F.col("y0") + 1.5 * s) & F.col("b_x0").between(F.col("x1") - 0.8 * s, F.col("x1") + 2.5 * s) & (F.col("target") != F.col("i"))
    )
    far = F.abs(F.col("b_y0") - F.col("y0")) + F.abs(F.col("b_x0") - F.col("x1"))
    return near.groupBy("doc_id", "page", "i", "text").agg(F.min(F.struct(far.alias("d"), "target")).alias("n")).select("doc_id", "page", "i", "text", "n.target")


def rejoined_caps(caps: DataFrame, bodies: DataFrame, vocab: DataFrame, attested: int = 2) -> DataFrame:
    """Openings with their drop cap put back: before a lower-case letter only, as a word of its own if the book says so.

    caps: as of nearest_body() with its target; bodies: doc_id, page, i, text; vocab: doc_id, word, freq.
    """
    b = bodies.select("doc_id", "page", F.col("i").alias("target"), F.col("text").alias("rest"))
    joined = caps.join(b, ["doc_id", "page", "target"]).where(F.col("text").rlike(r"^\p{L}{1,2}$") & F.col("rest").rlike(r"^\p{Ll}"))
    first = F.regexp_extract("rest", f"^({T.LETTER}+)", 1)
    asked = joined.withColumn("cap_key", T.fold(F.col("text"))).withColumn("first_key", T.fold(first)).withColumn("whole_key", T.fold(F.concat("text", first)))
    for name in ("cap", "first", "whole"):
        known = vocab.select("doc_id", F.col("word").alias(f"{name}_key"), F.col("freq").alias(f"{name}_freq"))
        asked = asked.join(known, ["doc_id", f"{name}_key"], "left").withColumn(f"{name}_freq", F.coalesce(f"{name}_freq", F.lit(0)))
    apart = (F.col("cap_freq") >= attested) & (F.col("first_freq") >= attested) & (F.col("whole_freq") == 0)
    return asked.select("doc_id", "page", "target", F.when(apart, F.concat_ws(" ", "text", "rest")).otherwise(F.concat("text", "rest")).alias("text"))


def settled_numbers(openings: DataFrame) -> DataFrame:
    """Chapter numbers that their neighbours leave room for, in books that number half their chapters and three at least.

    A settled number helps to settle the next, hence one ordered fold per book. openings: doc_id, seq, number.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        values = [None if pd.isna(v) else int(v) for v in pdf["number"]]
        if sum(v is not None for v in values) >= max(3, len(values) / 2):
            for i in range(1, len(values) - 1):
                before, after = values[i - 1], values[i + 1]
                if before is not None and after == before + 2:
                    values[i] = before + 1
        return pd.DataFrame({"doc_id": pdf["doc_id"], "seq": pdf["seq"], "number": pd.array(values, dtype="Int64")})

    return openings.select("doc_id", "seq", "number").groupBy("doc_id").applyInPandas(fold, "doc_id long, seq long, number long")


def title_candidates(spans: DataFrame) -> DataFrame:
    """Title of each opening page: its largest type where that stands out. spans: doc_id, page, text, x0, y0, font_size."""
    from .layout import upper_median

    lettered = spans.select("doc_id", "page", "text", "x0", "y0", "font_size").where(F.regexp_count("text", F.lit(r"\p{L}")) >= 2)
    stats = lettered.groupBy("doc_id", "page").agg(F.max("font_size").alias("top"), upper_median(F.collect_list("font_size")).alias("usual"), F.count("*").alias("n"))
    large = lettered.join(stats, ["doc_id", "page"]).where(((F.col("top") >= 1.3 * F.col("usual")) | (F.col("n") <= 3)) & (F.col("font_size") >= 0.9 * F.col("top")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return large.groupBy("doc_id", "page").agg(text.alias("title"), F.max("top").alias("size")).where(F.length("title").between(3, 200))


def correction_summary(corrections: DataFrame) -> DataFrame:
    """Per document: corrections by kind, mean confidence, pages to review. corrections: doc_id, page, kind, grade, confidence."""
    by_kind = corrections.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(":", x["kind"], x["n"].cast("string"))), ",").alias("by_kind"))
    rest = corrections.groupBy("doc_id").agg(F.count("*").alias("corrections"), F.bround(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct(F.when(F.col("grade") == "UNCERTAIN", F.col("page"))).alias("pages_to_review"))
    return rest.join(by_kind, "doc_id")


def validation_summary(reports: DataFrame) -> DataFrame:
    """Errors and warnings of validator reports in JSON; a missing report has not passed. reports: doc_id, json."""
    parsed = reports.select("doc_id", F.from_json("json", "struct<messages:array<struct<severity:string,message:string>>>").alias("r"))
    count = lambda *kinds: F.coalesce(F.size(F.filter("r.messages", lambda m: m["severity"].isin(*kinds))), F.lit(0)).cast("long")
    return parsed.select("doc_id", count("ERROR", "FATAL").alias("errors"), count("WARNING").alias("warnings"), (F.col("r.messages").isNotNull() & (count("ERROR", "FATAL") == 0)).alias("passed"))


def equation_fragments(blocks: DataFrame, equations: DataFrame) -> DataFrame:
    """Short blocks on the line of an equation: at least .3 of their height beside it. equations: doc_id, page, i, y0, y1."""
    e = equations.select("doc_id", "page", F.col("i").alias("equation"), F.col("y0").alias("e_y0"), F.col("y1").alias("e_y1"))
    shared = F.least("y1", "e_y1") - F.greatest("y0", "e_y0")
    return blocks.join(e, ["doc_id", "page"]).where((F.col("i") != F.col("equation")) & (F.length(F.trim("text")) <= 8) & (shared >= 0.3 * F.least(F.col("y1") - F.col("y0"), F.col("e_y1") - F.col("e_y0")))).select("doc_id", "page", "equation", "i", "text")


Provider = Callable[[list[dict]], list[dict]]


def reviewed_by(requests: DataFrame, provider: Provider, batch: int = 8) -> DataFrame:
    """Opinions of an outside reviewer, asked in batches; it may answer fewer. A batch that fails gives a row for each of
    its requests with the error instead of an opinion, so failures can be counted.

    requests: doc_id, seq, role, text, confidence. An answer holds doc_id, seq, role and confidence, never text.
    """
    roles = ("HEADING", "PARAGRAPH", "QUOTE", "LIST_ITEM", "CAPTION", "FOOTNOTE", "VERSE")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            rows = pdf.to_dict("records")
            for a in range(0, len(rows), batch):
                try:
                    answers = provider([{**r, "text": (r["text"] or "")[:400]} for r in rows[a : a + batch]])
                    out += [(x["doc_id"], x["seq"], x["role"], float(x["confidence"]), None) for x in answers if x.get("role") in roles and 0 <= float(x.get("confidence", -1)) <= 1]
                except Exception as error:  # whatever an outside program raises or answers
                    out += [(r["doc_id"], r["seq"], None, None, f"{type(error).__name__}: {error}") for r in rows[a : a + batch]]
            yield pd.DataFrame(out, columns=["doc_id", "seq", "new_role", "new_confidence", "error"])

    return requests.select("doc_id", "seq", "role", "text", "confidence").mapInPandas(ask, "doc_id long, seq long, new_role string, new_confidence double, error string")


def resolved_provider(name: Column, has_key: Column) -> Column:
    """Which reviewer a configured name means: unknown ones mean none, a hosted one without a key the local one."""
    known = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    return F.when(F.lower(name) == "hosted", F.when(has_key, F.lit("hosted")).otherwise("local")).otherwise(F.coalesce(F.try_element_at(known, F.lower(name)), F.lit("none")))


def manifest(spark, path: str, most_bytes: int = 25_000_000) -> DataFrame:
    """Books of a corpus manifest in JSON: name, family, url, and whether the stated size may be fetched."""
    rows = spark.read.option("multiLine", True).schema("name string, family string, url string, bytes long").json(path)
    return rows.withColumn("fetch", F.coalesce(F.col("bytes"), F.lit(0)) <= most_bytes)


def spread_sample(pages: DataFrame, k: int = 8) -> DataFrame:
    """Up to k pages of each document, evenly spaced. pages: doc_id, page."""
    w = Window.partitionBy("doc_id")
    placed = pages.withColumn("place", F.row_number().over(w.orderBy("page")) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return placed.where((F.col("place") % step == 0) & (F.col("place") / step < k)).drop("place", "n")
