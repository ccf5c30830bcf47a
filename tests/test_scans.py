"""Scanned pages, openings, reviewers and Unicode helpers on small rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import unicode as U
from lectern.operators import blocks, layout, scans
from lectern.plans import fixtures, scan_queries  # noqa: F401  (its rows are among the fixtures)


@pytest.mark.parametrize(("shown", "read"), [("םולש", "שלום"), ("plain", "plain"), ("abc םולש", "abc שלום"), ("", "")])
def test_reading_order_of_text(shown, read):
    assert U.reorder(shown) == read


@pytest.mark.parametrize(("text", "found"), [("E = mc2 (3)", "<msup><mi>c</mi><mn>2</mn></msup>"), ("x = 3 + y", "<mo>+</mo><mi>y</mi>"), ("∫ f dx = 3", None), ("a = b / c", None), ("a = b c d e", None), ("plain prose", None)])
def test_simple_relations(text, found):
    got = U.simple_mathml(text)
    assert got is None if found is None else found in got


def test_helpers_as_columns(spark):
    u = U.udfs()
    df = spark.createDataFrame([(0, "É́", "abc"), (1, None, None)], "i long, s string, t string")
    rows = df.select("i", u["nfc"]("s").alias("n"), u["folded_words"]("s").alias("f"), u["similarity"]("t", F.lit("abd")).alias("r")).orderBy("i").collect()
    assert rows[0].f == "e" and abs(rows[0].r - 2 / 3) < 1e-9 and rows[1].n is None and rows[1].r is None


def test_misread_heads(spark):
    rows = [(1, p, 0, "Fredrigk Bockman" if p == 7 else "The Mill" if p == 8 else "Fredrick Bockman", 10.0, 20.0) for p in range(1, 12)]
    df = spark.createDataFrame(rows, "book long, page long, i long, text string, y0 double, y1 double").withColumn("page_height", F.lit(842.0))
    heads = layout.repeated_heads(df).select("book", "band", "key")
    assert [r.key for r in scans.misread_heads(df, heads).collect()] == ["fredrigkbockman"]


def test_lines_of_two_columns_make_two_blocks(spark):
    rows = [(1, 1, i, x, x + 180.0, y, y + 10.0, f"l{i}", 0.9) for i, (x, y) in enumerate([(72.0, 100.0), (320.0, 100.0), (72.0, 114.0), (320.0, 114.0), (72.0, 200.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page long, line_no long, x0 double, x1 double, y0 double, y1 double, text string, confidence double")
    got = scans.placed_blocks(df, scans.lines_to_blocks(df))
    assert [r.text for r in got.orderBy("block").collect()] == ["l0\nl2", "l1\nl3", "l4"]


def test_ink_regions_and_figures(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 2), (1, 1, 2, 3), (1, 1, 9, 9)], "doc_id long, page long, row long, col long")
    assert sorted(r.cells for r in scans.ink_regions(cells).collect()) == [1, 3]
    drawings = spark.createDataFrame([(1, 1, 0.0, 50.0, 10.0, 90.0), (1, 1, 20.0, 40.0, 60.0, 80.0), (1, 1, 300.0, 0.0, 310.0, 10.0)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    figures = spark.createDataFrame([(1, 1, 7, 95.0)], "doc_id long, page long, figure long, caption_y0 double")
    assert [tuple(r)[2:] for r in scans.figure_extent(drawings, figures).collect()] == [(7, 0.0, 40.0, 60.0, 90.0)]


def test_boxes(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.1)], "x double, y double, w double, h double")
    b = df.select(G.from_normalised(*[F.col(c) for c in "xywh"], F.lit(100.0), F.lit(200.0)).alias("b")).first().b
    assert [round(v, 6) for v in b] == [10.0, 140.0, 40.0, 160.0]
    two = df.select(G.overlap(G.box(*map(F.lit, (0, 0, 10, 10))), G.box(*map(F.lit, (5, 5, 20, 20)))).alias("o"), G.area(G.union(G.box(*map(F.lit, (0, 0, 1, 1))), G.box(*map(F.lit, (2, 2, 3, 4))))).alias("u"), G.displayed_size(F.lit(1), F.lit(2), F.lit(90)).alias("d")).first()
    assert (two.o, two.u, tuple(two.d)) == (25.0, 12.0, (2, 1))


def test_turns_round_trip(spark):
    """A box of an upright page, placed on the turned image by hand, comes back."""
    up, w, h = (10.0, 20.0, 30.0, 45.0), 200.0, 300.0
    turned = {90: (h - up[3], up[0], h - up[1], up[2]), 180: (w - up[2], h - up[3], w - up[0], h - up[1]), 270: (up[1], w - up[2], up[3], w - up[0]), 0: up}
    df = spark.createDataFrame([(t, *b) for t, b in turned.items()], "turn long, x0 double, y0 double, x1 double, y1 double")
    got = df.select("turn", G.unrotated(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("turn"), F.lit(w), F.lit(h)).alias("b")).collect()
    assert {r.turn: tuple(r.b) for r in got} == {t: up for t in turned}


def test_small_rules(spark):
    df = spark.createDataFrame([("word", "WORD", "Word", "w")], "a string, b string, c string, d string")
    assert tuple(df.select(*[blocks.match_case(F.lit("river"), F.col(c)) for c in "abcd"]).first()) == ("river", "RIVER", "River", "river")
    assert tuple(df.select(blocks.alt_text(F.lit(1), F.lit(None).cast("string")), blocks.alt_text(F.lit(3), F.lit("")), blocks.alt_text(F.lit(3), F.lit("A mill"))).first()) == ("Picture", "3 pictures", "A mill")


def test_chapter_numbers(spark):
    got = {(r.doc_id, r.seq): r.number for r in blocks.settled_numbers(fixtures.frame(spark, "openings")).collect()}
    assert [got[1, s] for s in range(1, 7)] == [34, 35, 36, 37, 38, 39]
    assert [got[2, s] for s in range(1, 5)] == [None, 5, None, 7]


def test_reviewers_may_fail_or_answer_less(spark):
    df = spark.createDataFrame([(1, s, "PARAGRAPH", f"text {s}", 0.5) for s in range(20)], "doc_id long, seq long, role string, text string, confidence double").coalesce(1)

    def provider(batch):
        if batch[0]["seq"] == 8:
            raise RuntimeError("no answer")
        return [{"doc_id": r["doc_id"], "seq": r["seq"], "role": "HEADING" if r["seq"] % 2 else "NONSENSE", "confidence": 0.9} for r in batch]

    got = blocks.reviewed_by(df, provider).collect()
    assert sorted(r.seq for r in got if r.error is None) == [1, 3, 5, 7, 17, 19]
    assert sorted((r.seq, r.new_role, r.error) for r in got if r.error) == [(s, None, "RuntimeError: no answer") for s in range(8, 16)]


def test_title_candidates(spark):
    df = spark.createDataFrame([(1, 1, "THE RIVER", 72.0, 100.0, 24.0), (1, 1, "ROAD", 72.0, 130.0, 23.0), (1, 1, "by someone", 72.0, 200.0, 12.0), (1, 1, "small", 72.0, 220.0, 12.0), (1, 1, "smaller", 72.0, 240.0, 12.0), (2, 1, "even a", 72.0, 1.0, 10.0), (2, 1, "even b", 72.0, 2.0, 10.0), (2, 1, "even c", 72.0, 3.0, 10.0), (2, 1, "even d", 72.0, 4.0, 10.0)], "doc_id long, page long, text string, x0 double, y0 double, font_size double")
    assert [(r.doc_id, r.title) for r in blocks.title_candidates(df).collect()] == [(1, "THE RIVER ROAD")]
