"""Line, node, turn and block views of the corpus tables; each keeps its explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

BLOCK_TAGS = "h1|h2|h3|h4|p|li|div|title|nav|footer|article|ul|body|head|script|style|table|aside"
LINES_PER_PAGE, PAGE_WIDTH, PAGE_HEIGHT = 40, 595.0, 842.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """One row per line of a text: i from 0, n lines in all."""
    parts = F.split("text", "\n")
    return docs.withColumn("n", F.size(parts).cast("long")).select(*[c for c in docs.columns if c != "text"], "n", F.posexplode(parts).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


def blocks_by_document(docs: DataFrame, two_columns: bool = False) -> DataFrame:
    """Virtual typesetting, one document a book: 40 lines a page, every first line of a page in larger type."""
    rows = lines(docs)
    i, width = F.col("i"), F.length("line")
    y0 = (F.lit(72.0) + 14.0 * (i % LINES_PER_PAGE)).cast("double")
    if two_columns:
        column = i % 2
        x0 = 72.0 + 260.0 * column
        x1 = x0 + F.least(5.0 * width, F.lit(200.0))
    else:
        column = F.lit(0).cast("long")
        x0 = F.lit(72.0)
        x1 = x0 + 5.0 * F.least(width, F.lit(90))
    return rows.select(
        "doc_id", "i", "n", F.col("line").alias("text"), (F.floor(i / LINES_PER_PAGE) + 1).cast("long").alias("page"), column.cast("long").alias("col"),
        x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y0.alias("y0"), (y0 + 10.0).alias("y1"),
        F.when(i % LINES_PER_PAGE == 0, F.lit(18.0)).otherwise(F.lit(10.0)).alias("font_size"),
    )


def blocks_by_source(docs: DataFrame) -> DataFrame:
    """Virtual typesetting, one source a book: each document is a page, its lines share the height."""
    ids = docs.select("source", "doc_id").distinct()
    paged = ids.withColumn("page", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    rows = lines(docs.select("source", "doc_id", "text")).join(paged, ["source", "doc_id"])
    i, n, width = F.col("i"), F.col("n"), F.length("line")
    return rows.select(
        F.col("source").alias("book"), "page", "doc_id", "i", "n", F.col("line").alias("text"),
        F.lit(72.0).alias("x0"), (72.0 + 5.0 * F.least(width, F.lit(90))).cast("double").alias("x1"),
        (PAGE_HEIGHT * i / n).alias("y0"), (PAGE_HEIGHT * (i + 1) / n).alias("y1"),
        F.when(i % F.greatest(n, F.lit(1)) == 0, F.lit(18.0)).otherwise(F.lit(10.0)).alias("font_size"),
    )


def html_nodes(pages: DataFrame) -> DataFrame:
    """Block nodes of web pages in order: tag, text, and whether a nav, aside, table or another list item encloses them.

    A node ends where the next block tag begins, whether or not it was closed.
    """
    marked = F.regexp_replace("html", rf"(?i)<(/?(?:{BLOCK_TAGS})\b[^>]*)>", "\x01$1\x02")
    pieces = pages.select("page_id", F.posexplode(F.split(marked, "\x01")).alias("seq", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^(/?[A-Za-z0-9]+)", 1))
    body = F.regexp_replace(F.regexp_replace("piece", "^[^\x02]*\x02", ""), "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    nodes = pieces.where(F.col("piece").contains("\x02")).select("page_id", F.col("seq").cast("long"), tag.alias("tag"), T.squeezed(body).alias("text"))
    order = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = ("nav", "aside", "table", "li"), ("/nav", "/aside", "/table", "/li")
    depth = F.sum(F.when(F.col("tag").isin(*opens), 1).when(F.col("tag").isin(*closes), -1).otherwise(0)).over(order)
    return nodes.withColumn("enclosed", F.coalesce(depth, F.lit(0)) > 0)


def book_nodes(pages: DataFrame) -> DataFrame:
    """The nodes a reader reads: headings, paragraphs and list items with text, outside navigation."""
    return html_nodes(pages).where(F.col("tag").isin("h1", "h2", "h3", "h4", "p", "li") & ~F.col("enclosed") & (F.col("text") != ""))


def document_nodes(docs: DataFrame, *carry: str) -> DataFrame:
    """Lines with text as paragraphs, with the columns to carry, each with the one before it: a text's lines are in order as they are, so none is moved."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("seq"), T.squeezed(x).alias("text")))
    solid = docs.select(F.col("doc_id").alias("book"), *carry, F.filter(numbered, lambda x: x["text"] != "").alias("rows"))
    paired = solid.select("book", *carry, F.explode(F.transform("rows", lambda x, k: F.struct(x["seq"].alias("seq"), x["text"].alias("text"), F.get(F.col("rows"), k - 1)["text"].alias("before")))).alias("x"))
    return paired.select("book", *carry, "x.seq", F.lit("p").alias("tag"), "x.text", "x.before")


def ocr_payload(payloads: DataFrame) -> DataFrame:
    """Words of nested recognition results: bounds checked, the last page of a number wins, pages without lines dropped.

    payloads: doc_id and json. Confidence is 0 to 1.
    """
    schema = "struct<engine:string,pages:array<struct<page:int,lines:array<struct<confidence:double,words:array<struct<text:string,bbox:array<double>,confidence:double>>>>>>>"
    parsed = payloads.select("doc_id", F.from_json("json", schema).alias("p"))
    pages = parsed.select("doc_id", F.posexplode("p.pages").alias("ordinal", "x")).where(F.size("x.lines") > 0)
    last = pages.groupBy("doc_id", F.col("x.page").alias("page")).agg(F.max_by("x", "ordinal").alias("x"))
    rows = last.select("doc_id", "page", F.posexplode("x.lines").alias("line_no", "l")).select("doc_id", "page", F.col("line_no").cast("long"), F.posexplode("l.words").alias("word_no", "w"))
    box = lambda k: F.get("w.bbox", k)
    ok = (F.size("w.bbox") == 4) & (box(0) <= box(2)) & (box(1) <= box(3)) & F.col("w.confidence").between(0, 1) & (F.length("w.text") <= 200)
    return rows.where(ok).select(
        "doc_id", F.col("page").cast("long"), "line_no", F.col("word_no").cast("long"), F.col("w.text").alias("text"),
        box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), F.col("w.confidence").alias("confidence"),
    )


def ocr_tsv(spark: SparkSession, path: str, least_confidence: float = 40.0) -> DataFrame:
    """Word rows of a recogniser's tab-separated output: level 5, confidence at least 40 of 100, given back as 0 to 1."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(schema).csv(path)
    clean = F.trim(F.regexp_replace("text", r"\p{C}", ""))
    return rows.where((F.col("level") == 5) & (F.col("conf") >= least_confidence)).withColumn("text", clean).where("text <> ''").withColumn("conf", F.col("conf") / 100)


def parquet_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an external extractor, in their contract schema."""
    schema = "doc_id long, page int, block_id string, seq long, page_width double, page_height double, bbox struct<x0:double,y0:double,x1:double,y1:double>, kind string, text string, font string, font_size double, bold boolean, italic boolean, col int, source string, ocr_confidence double"
    return spark.read.schema(schema).parquet(path)


def pdf_guards(files: DataFrame, max_bytes: int = 50_000_000) -> DataFrame:
    """Accepts and refuses uploaded files: path, length, error (null if accepted). files: a binaryFile scan."""
    magic = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    error = F.when(~F.lower("path").endswith(".pdf"), "not_a_pdf").when(F.col("length") == 0, "empty_file").when(F.col("length") > max_bytes, "too_large").when(magic != "%PDF-", "not_a_pdf")
    return files.select("path", "length", error.alias("error"))
