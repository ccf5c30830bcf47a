"""Tables of text cells: scores, headers, alignment and continuation over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def pipe_cells(rows: DataFrame) -> DataFrame:
    """Cells of lines with a bar between them: consecutive such lines are one table. rows: doc_id, i, line."""
    w = Window.partitionBy("doc_id").orderBy("i")
    barred = rows.where(F.col("line").contains(" | "))
    tables = barred.withColumn("table", F.col("i") - F.row_number().over(w)).withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "table").orderBy("i")) - 1)
    cells = tables.select("doc_id", F.min("i").over(Window.partitionBy("doc_id", "table")).alias("table_at"), F.col("row").cast("long").alias("row"), F.posexplode(F.split("line", r" \| ")).alias("col", "cell"))
    return cells.select("doc_id", "table_at", "row", F.col("col").cast("long").alias("col"), T.squeezed(F.col("cell")).alias("text"))


def table_scores(cells: DataFrame) -> DataFrame:
    """Size, evenness, fill and score of each table, and whether its first row is a header. cells: doc_id, table_at, row, col, text."""
    numeric = F.col("text").rlike(r"^[-+]?[0-9][0-9.,%\s]*$")
    rows = cells.groupBy("doc_id", "table_at", "row").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("text") != "", 1).otherwise(0)).alias("filled"), F.sum(F.when(numeric, 1).otherwise(0)).alias("numeric"))
    sums = rows.groupBy("doc_id", "table_at").agg(
        F.count("*").alias("rows"), F.max("cells").alias("cols"), F.sum("cells").alias("cells"), F.sum("filled").alias("filled"),
        F.mode("cells", True).alias("usual"), F.collect_list("cells").alias("sizes"), F.sum(F.when(F.col("filled") >= 2, 1).otherwise(0)).alias("spanning"),
        F.max(F.when(F.col("row") == 0, F.struct("cells", "filled", "numeric"))).alias("head"), F.sum(F.when(F.col("row") > 0, F.col("numeric")).otherwise(0)).alias("body_numeric"), F.sum(F.when(F.col("row") > 0, F.col("cells")).otherwise(0)).alias("body_cells"),
    )
    consistent = F.size(F.filter("sizes", lambda x: x == F.col("cols"))) / F.col("rows")
    fill = F.col("filled") / (F.col("rows") * F.col("cols"))
    raw = 0.55 * consistent + 0.45 * fill + F.when(F.col("rows") >= 3, 0.08).otherwise(0.0) - F.when(fill < 0.45, 0.25).otherwise(0.0)
    valid = (F.col("rows") >= 2) & (F.col("cols") >= 2) & (2 * F.col("spanning") >= F.col("rows"))
    header = (F.col("head.cells") == F.col("head.filled")) & (F.col("head.numeric") < 0.34 * F.col("head.cells")) & (F.col("body_numeric") * F.col("head.cells") > F.col("head.numeric") * F.col("body_cells"))
    score = F.when(valid, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return sums.select("doc_id", "table_at", "rows", "cols", F.bround(consistent, 6).alias("consistent"), F.bround(fill, 6).alias("fill"), F.bround(score, 6).alias("score"), F.coalesce(header, F.lit(False)).alias("has_header"))


def aligned_columns(spans: DataFrame) -> DataFrame:
    """Columns of aligned text: x-intervals of a table's spans merged where they touch. spans: doc_id, table, x0, x1."""
    w = Window.partitionBy("doc_id", "table").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)).withColumn("column", F.sum("fresh").over(w) - 1)
    return islands.groupBy("doc_id", "table", F.col("column").cast("long").alias("column")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("spans"))


def continuations(tables: DataFrame) -> DataFrame:
    """Whether each table carries on the one before it: next page, as many columns, no caption of its own; and the chain's first.

    tables: doc_id, table, page, y0, cols, captioned.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "y0")
    carries = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("cols") == F.lag("cols").over(w)) & ~F.col("captioned")
    marked = tables.withColumn("carries", F.coalesce(carries, F.lit(False))).withColumn("chain", F.sum(F.when(F.col("carries"), 0).otherwise(1)).over(w))
    return marked.withColumn("first_table", F.first("table").over(Window.partitionBy("doc_id", "chain").orderBy("page", "y0"))).select("doc_id", "table", "page", "carries", "first_table")


def stitched(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows of each chain of tables numbered through; a header that a later part repeats is left out.

    cells: doc_id, table, row, col, text; chains: as of continuations().
    """
    rows = cells.groupBy("doc_id", "table", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "\t").alias("cells"))
    joined = rows.join(chains.select("doc_id", "table", "page", "carries", "first_table"), ["doc_id", "table"])
    head = joined.where((F.col("row") == 0) & ~F.col("carries")).select("doc_id", "first_table", F.col("cells").alias("header"))
    kept = joined.join(head, ["doc_id", "first_table"], "left").where(~(F.col("carries") & (F.col("row") == 0) & (F.col("cells") == F.col("header"))))
    w = Window.partitionBy("doc_id", "first_table").orderBy("page", "row")
    return kept.select("doc_id", "first_table", (F.row_number().over(w) - 1).cast("long").alias("row"), "cells")
