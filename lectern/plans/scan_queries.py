"""Scanned pages, spans, openings and helper functions on small inputs and virtual pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.unicode import udfs
from ..operators import blocks as K
from ..operators import layout as L
from ..operators import repair, scans
from ..sources import corpus as C
from . import fixtures as fx
from . import sql as S
from .corpus_queries import docs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


fx.TABLES |= {
    "span_rows": ("doc_id long, block_id string, span_no long, text string, font string, flags long, font_size double, x0 double, x1 double, line_break_after boolean", [
        (1, "p1_b1", 0, "The river ", "Serif", 0, 10.0, 72.0, 120.0, False), (1, "p1_b1", 1, "rose", "Serif-Bold", 0, 10.0, 120.0, 140.0, True), (1, "p1_b1", 2, "in the night", "Serif", 16, 10.0, 72.0, 130.0, False), (1, "p1_b1", 3, "1", "Serif", 0, 7.0, 130.0, 133.0, True),
        (1, "p1_b2", 0, "Plain only", "Serif", 0, 10.0, 72.0, 120.0, True), (2, "p1_b1", 0, "oblique", "Sans-Oblique", 2, 12.0, 72.0, 100.0, False), (2, "p1_b1", 1, "  ", "Sans", 0, 12.0, 100.0, 104.0, True),
    ]),
    "fragments": ("doc_id long, line long, pos long, text string, x0 double, x1 double, size double", [
        (1, 1, 0, "The", 72.0, 88.0, 10.0), (1, 1, 1, "river", 91.0, 110.0, 10.0), (1, 1, 2, "rose", 110.5, 125.0, 10.0), (1, 1, 3, " up", 130.0, 140.0, 10.0), (1, 1, 4, "far", 190.0, 200.0, 10.0), (1, 2, 0, "alone", 72.0, 90.0, 10.0),
    ]),
    "caps": ("doc_id long, page long, i long, text string, x1 double, y0 double, body_size double", [(1, 1, 1, "T", 90.0, 100.0, 10.0), (1, 2, 5, "A", 90.0, 100.0, 10.0), (1, 3, 9, "Q", 90.0, 100.0, 10.0)]),
    "cap_bodies": ("doc_id long, page long, i long, text string, x0 double, y0 double, font_size double", [
        (1, 1, 2, "he river rose and the mill stood", 92.0, 101.0, 10.0), (1, 1, 3, "far away", 300.0, 101.0, 10.0), (1, 2, 6, "river in spring", 95.0, 104.0, 10.0), (1, 2, 7, "the second choice", 98.0, 110.0, 10.0), (1, 3, 10, "Capital begins", 92.0, 100.0, 10.0),
    ]),
    "cap_words": ("doc_id long, word string, freq long", [(1, "the", 40), (1, "a", 30), (1, "river", 9), (1, "he", 1)]),
    "openings": ("doc_id long, seq long, number long", [(1, 1, 34), (1, 2, 35), (1, 3, None), (1, 4, 37), (1, 5, 83), (1, 6, 39), (2, 1, None), (2, 2, 5), (2, 3, None), (2, 4, 7)]),
    "corrections": ("doc_id long, page long, kind string, grade string, confidence double", [(1, 1, "unicode", "SAFE", 1.0), (1, 2, "unicode", "SAFE", 1.0), (1, 2, "word_split", "UNCERTAIN", 0.4), (1, 3, "word_split", "UNCERTAIN", 0.4), (2, 1, "control_char", "SAFE", 1.0)]),
    "validations": ("doc_id long, json string", [(1, '{"messages":[{"severity":"ERROR","message":"a"},{"severity":"WARNING","message":"b"},{"severity":"FATAL","message":"c"}]}'), (2, '{"messages":[{"severity":"WARNING","message":"b"}]}'), (3, None)]),
    "turned": ("doc_id long, turn long, x0 double, y0 double, x1 double, y1 double, width double, height double", [(1, 0, 10.0, 20.0, 30.0, 45.0, 200.0, 300.0), (1, 90, 10.0, 20.0, 30.0, 45.0, 200.0, 300.0), (1, 180, 10.0, 20.0, 30.0, 45.0, 200.0, 300.0), (1, 270, 10.0, 20.0, 30.0, 45.0, 200.0, 300.0)]),
    "readings": ("doc_id long, page long, turn long, confidence double", [(1, 1, 0, 90.0), (1, 1, 90, 95.0), (1, 2, 0, 40.0), (1, 2, 90, 70.0), (1, 2, 180, 91.0), (1, 2, 270, 91.0)]),
    "rasters": ("doc_id long, page long, width double, height double, page_width double, page_height double, pixel_width long, pixel_height long", [(1, 1, 590.0, 840.0, 595.0, 842.0, 1200, 1700), (1, 2, 100.0, 100.0, 595.0, 842.0, 400, 400), (1, 2, 500.0, 300.0, 595.0, 842.0, 400, 400), (1, 3, 590.0, 840.0, 595.0, 842.0, 200, 300)]),
    "levels": ("doc_id long, page long, level long, pixels long", [(1, 1, 250, 100000), (1, 1, 190, 50), (1, 2, 240, 90000), (1, 2, 30, 9000), (1, 3, 255, 1000), (1, 3, 204, 900)]),
    "covers": ("doc_id long, page long, picture_share double, chars long", [(1, 1, 0.8, 30), (2, 1, 0.8, 0), (3, 1, 0.3, 30), (4, 1, 0.5, 400), (4, 2, 0.9, 10)]),
    "probes": ("doc_id long, n long, seconds double", [(1, 1, 2.0), (1, 2, 4.0), (1, 3, 1.0), (1, 4, 1.0), (2, 1, 100.0), (2, 2, 100.0), (2, 3, 100.0)]),
    "verse_lines": ("doc_id long, run long, i long, x0 double, y0 double, y1 double", [(1, 1, 0, 72.0, 100.0, 110.0), (1, 1, 1, 90.0, 112.0, 122.0), (1, 1, 2, 72.0, 124.0, 134.0), (1, 1, 3, 72.0, 150.0, 160.0), (1, 1, 4, 81.0, 162.0, 172.0)]),
    "page_blocks": ("doc_id long, page long, i long, text string, x0 double, y0 double, margin double, font_size double, body_size double, page_height double, italic boolean, machine_read boolean", [
        (1, 1, 0, "Body text of the page", 72.0, 100.0, 72.0, 10.0, 10.0, 842.0, False, False), (1, 1, 1, "A quoted passage", 100.0, 200.0, 72.0, 9.0, 10.0, 842.0, False, False), (1, 1, 2, "Scanned quote", 100.0, 230.0, 72.0, 9.0, 10.0, 842.0, False, True), (1, 1, 3, "1. A note below", 72.0, 700.0, 72.0, 8.5, 10.0, 842.0, False, False), (1, 1, 4, "small print", 72.0, 720.0, 72.0, 7.0, 10.0, 842.0, False, False), (1, 2, 5, "1. No body here", 72.0, 700.0, 72.0, 7.0, 10.0, 842.0, False, False), (1, 2, 6, "= 7", 300.0, 705.0, 72.0, 7.0, 10.0, 842.0, False, False),
    ]),
    "requests": ("req long, forwarded string, peer string, name string, provider string, has_key boolean", [(1, "10.0.0.1, 10.0.0.2", "p", "my book: vol/2.epub", "local", False), (2, None, "peer", "İstanbul.epub", "hosted", True), (3, "", "x", "plain.pdf", "Hosted", False), (4, " 1.2.3.4", "y", "a" * 120, "other", True)]),
    "strings": ("i long, s string", [(0, "é ﬁ"), (1, "E = mc2 (3)"), (2, "x ≤ 3 + y"), (3, "∫ f dx = 3"), (4, "םולש abc"), (5, "Çağ İKİ"), (6, "a < b / c")]),
}


@query(f"""WITH {fx.view('span_rows')}, s AS (SELECT *, (flags & 16) <> 0 OR contains(lower(font), 'bold') AS bold, (flags & 2) <> 0 OR contains(lower(font), 'italic') OR contains(lower(font), 'oblique') AS italic FROM span_rows)
SELECT doc_id, block_id, span_no, bold, italic, regexp_matches(trim(text), '^[0-9*†‡§¶#⁰¹²³⁴-⁹\\[\\](){{}}<>.:]{{1,6}}$') AND font_size <= 0.75::DOUBLE * 10 AS may_refer FROM s""")
def span_styles(spark, sf_dir):
    s = fx.frame(spark, "span_rows").withColumn("s", K.style(F.col("flags"), F.col("font")))
    return s.select("doc_id", "block_id", "span_no", "s.bold", "s.italic", K.reference_candidate(F.col("text"), F.lit(False), F.col("font_size"), F.lit(10.0)).alias("may_refer"))


@query(f"WITH {fx.view('span_rows')} SELECT doc_id, block_id, span_no, text, font, font_size FROM span_rows QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY length(text) DESC, span_no) = 1")
def dominant_spans(spark, sf_dir):
    return K.dominant_span(fx.frame(spark, "span_rows"))


@query(f"""WITH {fx.view('span_rows')}, n AS (SELECT *, coalesce(sum(line_break_after::INT) OVER (PARTITION BY doc_id, block_id ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM span_rows)
SELECT doc_id, block_id, line, string_agg(text, '' ORDER BY span_no) AS text, min(x0) AS x0, max(x1) AS x1 FROM n WHERE trim(text) <> '' GROUP BY ALL""")
def line_boxes(spark, sf_dir):
    return K.line_boxes(fx.frame(spark, "span_rows"))


@query(f"""WITH {fx.view('span_rows')}, k AS (SELECT *, CASE WHEN (flags & 16) <> 0 OR contains(lower(font), 'bold') THEN 'bold' WHEN (flags & 2) <> 0 OR contains(lower(font), 'oblique') THEN 'italic' ELSE 'plain' END AS kind FROM span_rows),
m AS (SELECT *, count(DISTINCT kind) OVER (PARTITION BY doc_id, block_id) AS kinds, CASE WHEN lag(kind) OVER w = kind AND NOT lag(line_break_after) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY span_no)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, block_id ORDER BY span_no)::BIGINT AS run FROM m)
SELECT doc_id, block_id, run, any_value(kind) AS kind, string_agg(text, '' ORDER BY span_no) AS text FROM r WHERE kinds > 1 AND kind <> 'plain' GROUP BY ALL""")
def emphasis_runs(spark, sf_dir):
    s = fx.frame(spark, "span_rows").withColumn("s", K.style(F.col("flags"), F.col("font")))
    return K.emphasis_runs(s.select("doc_id", "block_id", "span_no", "text", "s.bold", "s.italic", "line_break_after"))


@query(f"""WITH {fx.view('fragments')}, m AS (SELECT *, (x0 - lag(x1) OVER w) / size AS gap, lag(text) OVER w AS before FROM fragments WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos)),
p AS (SELECT *, CASE WHEN gap > 0.12::DOUBLE AND gap <= 2.5::DOUBLE AND NOT regexp_matches(before, '\\s$') AND NOT regexp_matches(text, '^\\s') THEN ' ' ELSE '' END || text AS piece FROM m)
SELECT doc_id, line, string_agg(piece, '' ORDER BY pos) AS text FROM p GROUP BY ALL""")
def space_restoration(spark, sf_dir):
    return K.spaced_fragments(fx.frame(spark, "fragments"))


_CAPS = f"""{fx.view('caps')}, {fx.view('cap_bodies')}, near AS (SELECT c.doc_id, c.page, c.i, c.text, b.i AS target, abs(b.y0 - c.y0) + abs(b.x0 - c.x1) AS d FROM caps c JOIN cap_bodies b USING (doc_id, page)
  WHERE abs(b.font_size - body_size) <= 0.2::DOUBLE * body_size AND b.y0 BETWEEN c.y0 - body_size AND c.y0 + 1.5::DOUBLE * body_size AND b.x0 BETWEEN c.x1 - 0.8::DOUBLE * body_size AND c.x1 + 2.5::DOUBLE * body_size AND b.i <> c.i),
hit AS (SELECT doc_id, page, i, text, target FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, page, i ORDER BY d, target) = 1)"""


@query(f"WITH {_CAPS} SELECT * FROM hit")
def drop_cap_targets(spark, sf_dir):
    return K.nearest_body(fx.frame(spark, "caps"), fx.frame(spark, "cap_bodies"))


@query(f"""WITH {_CAPS}, {fx.view('cap_words')}, j AS (SELECT h.doc_id, h.page, h.target, h.text AS cap, b.text AS rest, regexp_extract(b.text, {S.q(f'^({S.LETTER}+)')}, 1) AS first FROM hit h JOIN cap_bodies b ON b.doc_id = h.doc_id AND b.page = h.page AND b.i = h.target WHERE regexp_matches(b.text, '^\\p{{Ll}}')),
f AS (SELECT j.*, coalesce(c.freq, 0) AS cf, coalesce(w.freq, 0) AS ff, coalesce(x.freq, 0) AS wf FROM j LEFT JOIN cap_words c ON c.doc_id = j.doc_id AND c.word = {S.fold('j.cap')} LEFT JOIN cap_words w ON w.doc_id = j.doc_id AND w.word = {S.fold('j.first')} LEFT JOIN cap_words x ON x.doc_id = j.doc_id AND x.word = {S.fold('j.cap || j.first')})
SELECT doc_id, page, target, CASE WHEN cf >= 2 AND ff >= 2 AND wf = 0 THEN cap || ' ' || rest ELSE cap || rest END AS text FROM f""")
def drop_caps_rejoined(spark, sf_dir):
    bodies = fx.frame(spark, "cap_bodies")
    return K.rejoined_caps(K.nearest_body(fx.frame(spark, "caps"), bodies), bodies, fx.frame(spark, "cap_words"))


@query()
def chapter_numbers(spark, sf_dir):
    return K.settled_numbers(fx.frame(spark, "openings"))


@query(f"""WITH {fx.view('corrections')}, k AS (SELECT doc_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS by_kind FROM (SELECT doc_id, kind, count(*) AS n FROM corrections GROUP BY ALL) GROUP BY doc_id)
SELECT c.doc_id, count(*)::BIGINT AS corrections, round_even(avg(confidence), 6) AS mean_confidence, count(DISTINCT CASE WHEN grade = 'UNCERTAIN' THEN page END)::BIGINT AS pages_to_review, any_value(by_kind) AS by_kind FROM corrections c JOIN k USING (doc_id) GROUP BY c.doc_id""")
def correction_counts(spark, sf_dir):
    return K.correction_summary(fx.frame(spark, "corrections"))


@query(f"""WITH {fx.view('validations')}, m AS (SELECT doc_id, from_json(json, '{{"messages":[{{"severity":"VARCHAR","message":"VARCHAR"}}]}}').messages AS m FROM validations)
SELECT doc_id, coalesce(len(list_filter(m, lambda x: x.severity IN ('ERROR', 'FATAL'))), 0)::BIGINT AS errors, coalesce(len(list_filter(m, lambda x: x.severity = 'WARNING')), 0)::BIGINT AS warnings, m IS NOT NULL AND coalesce(len(list_filter(m, lambda x: x.severity IN ('ERROR', 'FATAL'))), 0) = 0 AS passed FROM m""")
def validation_results(spark, sf_dir):
    return K.validation_summary(fx.frame(spark, "validations"))


@query(f"""WITH {fx.view('turned')} SELECT doc_id, turn, CASE turn WHEN 90 THEN y0 WHEN 180 THEN width - x1 WHEN 270 THEN width - y1 ELSE x0 END AS x0, CASE turn WHEN 90 THEN height - x1 WHEN 180 THEN height - y1 WHEN 270 THEN x0 ELSE y0 END AS y0,
  CASE turn WHEN 90 THEN y1 WHEN 180 THEN width - x0 WHEN 270 THEN width - y0 ELSE x1 END AS x1, CASE turn WHEN 90 THEN height - x0 WHEN 180 THEN height - y0 WHEN 270 THEN x1 ELSE y1 END AS y1,
  greatest(36, CASE WHEN (width / 72 * b) * (height / 72 * b) > 4000000 THEN floor(b * sqrt(4000000 / ((width / 72 * b) * (height / 72 * b)))) ELSE b END)::BIGINT AS dpi FROM (SELECT *, CASE WHEN width * height < 7776 THEN 350 ELSE 200 END AS b FROM turned)""")
def unrotated_boxes(spark, sf_dir):
    t = fx.frame(spark, "turned")
    b = G.unrotated(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("turn"), F.col("width"), F.col("height"))
    return t.select("doc_id", "turn", b.alias("b"), G.effective_dpi(F.col("width"), F.col("height")).alias("dpi")).select("doc_id", "turn", "b.*", "dpi")


@query(f"""WITH {fx.view('readings')} SELECT doc_id, page, turn, confidence FROM readings QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY (turn = 0 AND confidence >= 88) DESC, confidence DESC, turn) = 1""")
def ocr_orientation(spark, sf_dir):
    return scans.best_orientation(fx.frame(spark, "readings"))


@query(f"""WITH {fx.view('rasters')}, p AS (SELECT *, abs(width / height - page_width / page_height) <= 0.03::DOUBLE * page_width / page_height AND pixel_width >= page_width AS page_like FROM rasters)
SELECT doc_id, page, round_even(least(sum(CASE WHEN page_like THEN 1.0::DOUBLE ELSE width * height / (page_width * page_height) END), 1), 6) AS coverage, min(page_like::INT) = 1 AS scan FROM p GROUP BY ALL""")
def image_coverage(spark, sf_dir):
    return scans.image_coverage(fx.frame(spark, "rasters"))


@query(f"""WITH {fx.view('levels')}, r AS (SELECT *, sum(pixels) OVER (PARTITION BY doc_id, page ORDER BY level) AS upto, sum(pixels) OVER (PARTITION BY doc_id, page) AS total FROM levels),
m AS (SELECT *, min(CASE WHEN 2 * upto >= total THEN level END) OVER (PARTITION BY doc_id, page) AS med FROM r)
SELECT doc_id, page, sum(CASE WHEN level < med - 50 THEN pixels ELSE 0 END) < 0.001::DOUBLE * max(total) AS blank FROM m GROUP BY ALL""")
def blank_leaves(spark, sf_dir):
    return scans.blank_leaves(fx.frame(spark, "levels"))


@query(f"WITH {fx.view('covers')} SELECT doc_id, picture_share >= 0.5::DOUBLE AND chars BETWEEN 1 AND 400 AS cover FROM covers WHERE page = 1")
def cover_pages(spark, sf_dir):
    return scans.cover_pages(fx.frame(spark, "covers"))


@query(f"""WITH {fx.view('probes')}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM probes),
g AS (SELECT doc_id, max(total)::BIGINT AS pages, avg(seconds) AS pp, sum(seconds) AS spent, count(*) AS k FROM m WHERE place <= 2 GROUP BY doc_id) SELECT doc_id, pages, round_even(pp, 6) AS per_page, pp * (pages - k) <= 60 - spent AS fits FROM g""")
def ocr_budget(spark, sf_dir):
    return scans.reading_budget(fx.frame(spark, "probes"), 60.0)


@query(f"""WITH {S.blocks_by_document()}, g AS (SELECT doc_id, page, sum(length(text)) AS chars, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM blocks GROUP BY ALL HAVING sum(length(text)) >= 300),
l AS (SELECT doc_id, count(*)::BIGINT AS pages, list_sort(list(x0)) AS a, list_sort(list(y0)) AS b, list_sort(list(x1)) AS c, list_sort(list(y1)) AS d FROM g GROUP BY doc_id)
SELECT doc_id, pages, a[len(a) // 2 + 1] AS x0, b[len(b) // 2 + 1] AS y0, c[len(c) // 2 + 1] AS x1, d[len(d) // 2 + 1] AS y1 FROM l WHERE pages >= 1""")
def type_area(spark, sf_dir):
    """With one full page instead of three, as the virtual books are short."""
    return scans.type_area(C.blocks_by_document(docs(spark, sf_dir)), least_pages=1)


_V1N = f"""{S.blocks_by_document()}, kinds AS (SELECT DISTINCT doc_id, page, CASE doc_id % 3 WHEN 0 THEN 'NATIVE' WHEN 1 THEN 'SCANNED' ELSE 'MIXED' END AS kind FROM blocks WHERE doc_id % 7 <> 0),
native AS (SELECT * FROM blocks), ocr AS (SELECT doc_id, page, i + 100000 AS i, text, x0 + CASE WHEN i % 4 = 0 THEN 400 ELSE 0 END AS x0, y0, x1 + CASE WHEN i % 4 = 0 THEN 400 ELSE 0 END AS x1, y1 FROM blocks)"""


@query(f"""WITH {_V1N} SELECT n.doc_id, n.page, n.i, 'native' AS source FROM native n LEFT JOIN kinds k USING (doc_id, page) WHERE coalesce(kind, 'NATIVE') IN ('NATIVE', 'MIXED')
UNION ALL SELECT o.doc_id, o.page, o.i, 'ocr' FROM ocr o JOIN kinds k USING (doc_id, page) WHERE kind = 'SCANNED'
UNION ALL SELECT o.doc_id, o.page, o.i, 'ocr' FROM ocr o JOIN kinds k USING (doc_id, page) WHERE kind = 'MIXED' AND NOT EXISTS (SELECT 1 FROM native t WHERE t.doc_id = o.doc_id AND t.page = o.page AND (o.x1 - o.x0) * (o.y1 - o.y0) > 0
  AND greatest(0, least(o.x1, t.x1) - greatest(o.x0, t.x0)) * greatest(0, least(o.y1, t.y1) - greatest(o.y0, t.y0)) >= 0.35::DOUBLE * (o.x1 - o.x0) * (o.y1 - o.y0))""")
def page_routing(spark, sf_dir):
    """Every line as native text and as recognised text, some of it moved aside."""
    b = C.blocks_by_document(docs(spark, sf_dir))
    kinds = b.where("doc_id % 7 <> 0").select("doc_id", "page", F.when(F.col("doc_id") % 3 == 0, "NATIVE").when(F.col("doc_id") % 3 == 1, "SCANNED").otherwise("MIXED").alias("kind")).distinct()
    native = b.select("doc_id", "page", "i", "text", "x0", "y0", "x1", "y1")
    aside = F.when(F.col("i") % 4 == 0, 400.0).otherwise(0.0)
    read = native.withColumn("x0", F.col("x0") + aside).withColumn("x1", F.col("x1") + aside).withColumn("i", F.col("i") + 100000)
    return scans.routed(native, read, kinds).select("doc_id", "page", "i", "source")


@query(f"""WITH {S.blocks_by_document()}, n AS (SELECT doc_id, i AS seq, page, 'PARAGRAPH' AS role FROM blocks WHERE trim(text) <> '' UNION ALL
  SELECT doc_id, NULL, page, 'IMAGE' FROM (SELECT doc_id, unnest(range(1, max(page) + 2)) AS page FROM blocks GROUP BY doc_id) p WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page = p.page AND trim(b.text) <> ''))
SELECT doc_id, page, seq, role, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq NULLS LAST)::BIGINT AS position FROM n""")
def fallback_union(spark, sf_dir):
    """Every line with text, and an image for every page that has none: an empty page, and the back cover after the last."""
    b = C.blocks_by_document(docs(spark, sf_dir))
    nodes = b.where(F.trim("text") != "").select("doc_id", F.col("i").alias("seq"), "page", F.lit("PARAGRAPH").alias("role"))
    pages = b.groupBy("doc_id").agg(F.max("page").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 1)).alias("page"))
    return scans.with_fallbacks(nodes, pages.join(nodes.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))


@query(f"""WITH {fx.view('verse_lines')}, g AS (SELECT *, y0 - lag(y1) OVER w AS gap, min(x0) OVER (PARTITION BY doc_id, run) AS base FROM verse_lines WINDOW w AS (PARTITION BY doc_id, run ORDER BY i)),
u AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, run) AS usual FROM g)
SELECT doc_id, run, i, sum(CASE WHEN gap > 1.35::DOUBLE * usual THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY i)::BIGINT AS stanza, round_even((x0 - base) / 9, 0)::BIGINT AS indent FROM u""")
def stanza_breaks(spark, sf_dir):
    return K.stanzas(fx.frame(spark, "verse_lines"))


_BODY = "max((abs(font_size - body_size) <= 0.05::DOUBLE * body_size)::INT) OVER (PARTITION BY doc_id, page) = 1 AS has_body"


@query(f"""WITH {fx.view('page_blocks')}, b AS (SELECT *, {_BODY} FROM page_blocks)
SELECT doc_id, page, i, 'FOOTNOTE' AS role FROM b WHERE y0 > 0.66::DOUBLE * page_height AND has_body AND (font_size / body_size <= 0.75::DOUBLE OR (font_size / body_size <= 0.90::DOUBLE AND {S.has('text', T.NOTE_ENTRY)}))
UNION ALL SELECT doc_id, page, i, 'QUOTE' FROM b WHERE x0 > margin + greatest(1.2::DOUBLE * body_size, 8) AND (italic OR font_size <= 0.96::DOUBLE * body_size) AND has_body AND NOT machine_read""")
def notes_and_quotes(spark, sf_dir):
    b = fx.frame(spark, "page_blocks")
    return K.foot_notes(b).select("doc_id", "page", "i", F.lit("FOOTNOTE").alias("role")).union(K.block_quotes(b).select("doc_id", "page", "i", F.lit("QUOTE").alias("role")))


@query(f"""WITH {fx.view('page_blocks')}, e AS (SELECT doc_id, page, i AS equation, y0 AS a, y0 + 12 AS b FROM page_blocks WHERE i = 5)
SELECT p.doc_id, p.page, equation, p.i, p.text FROM page_blocks p JOIN e USING (doc_id, page) WHERE p.i <> equation AND length(trim(text)) <= 8 AND least(y0 + 10, b) - greatest(y0, a) >= 0.3::DOUBLE * least(10, b - a)""")
def equation_fragments(spark, sf_dir):
    b = fx.frame(spark, "page_blocks")
    equations = b.where("i = 5").select("doc_id", "page", "i", "y0", (F.col("y0") + 12).alias("y1"))
    return K.equation_fragments(b.withColumn("y1", F.col("y0") + 10), equations)


@query()
def title_candidates(spark, sf_dir):
    return K.title_candidates(C.blocks_by_document(docs(spark, sf_dir)).where("page = 1"))


@query(f"""WITH {fx.view('requests')} SELECT req, CASE WHEN trim(string_split(coalesce(forwarded, ''), ',')[1]) <> '' THEN trim(string_split(coalesce(forwarded, ''), ',')[1]) ELSE peer END AS caller, left(regexp_replace(name, '[^A-Za-z0-9._ -]', '_', 'g'), 100) AS file,
  CASE WHEN lower(provider) = 'hosted' THEN CASE WHEN has_key THEN 'hosted' ELSE 'local' END WHEN lower(provider) IN ('local', 'remote-a', 'remote-b') THEN 'local' ELSE 'none' END AS provider FROM requests""")
def request_fields(spark, sf_dir):
    r = fx.frame(spark, "requests")
    return r.select("req", K.caller(F.col("forwarded"), F.col("peer")).alias("caller"), K.file_name(F.col("name")).alias("file"), K.resolved_provider(F.col("provider"), F.col("has_key")).alias("provider"))


@query(f"""WITH {S.LINES}, d AS (SELECT doc_id, i, {S.squeezed('line')} AS t, CASE WHEN i = 0 THEN 1.6::DOUBLE WHEN i % 3 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS r FROM lines)
SELECT doc_id, i, CASE WHEN r >= 1.55::DOUBLE THEN 1 WHEN r >= 1.3::DOUBLE THEN 2 WHEN r >= 1.15::DOUBLE THEN 3 ELSE 4 END::BIGINT AS level, CASE WHEN r * 10 >= 15 THEN 'chapter-title' WHEN r * 10 >= 13.5::DOUBLE THEN 'display' ELSE 'text' END AS type,
  {S.has('t', r'^\s*([0-9]{1,4}|[*†‡§¶#]{1,3})[.)\]]?\s+\S+')} AND len(string_split(t, ' ')) >= 3 AS note_body, {S.has('t', T.FOLIO_HEAD)} AND len(string_split(t, ' ')) <= 14 AND r <= 1.05::DOUBLE AS folio_head FROM d""")
def line_shapes(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir)).select("doc_id", "i", T.squeezed(F.col("line")).alias("t"), F.when(F.col("i") == 0, 1.6).when(F.col("i") % 3 == 0, 1.2).otherwise(1.0).alias("r"))
    return rows.select("doc_id", "i", K.fallback_level(F.col("r")).cast("long").alias("level"), K.display_type(F.col("r") * 10, F.lit(10.0)).alias("type"), K.note_body(F.col("t")).alias("note_body"), K.folio_head(F.col("t"), F.col("r"), F.lit(1.0)).alias("folio_head"))


@query("SELECT lang, CASE lang WHEN 'de' THEN 'deu+eng' WHEN 'fr' THEN 'fra+eng' WHEN 'es' THEN 'spa+eng' WHEN 'en' THEN 'eng' END AS packs, CASE lang WHEN 'de' THEN 'deu+eng' WHEN 'fr' THEN 'eng' WHEN 'es' THEN 'eng' ELSE 'eng' END AS usable, count(*)::BIGINT AS documents FROM documents GROUP BY ALL")
def language_packs(spark, sf_dir):
    have = F.array(F.lit("eng"), F.lit("deu"))
    packs = G.packs_of_language(F.col("lang"))
    return docs(spark, sf_dir).select("lang", packs.alias("packs"), G.language_packs(packs, have).alias("usable")).groupBy("lang", "packs", "usable").agg(F.count("*").alias("documents"))


@query()
def misread_heads(spark, sf_dir):
    """Margin lines against the repeated lines of their own book, at a ratio that the corpus reaches."""
    books = C.blocks_by_source(docs(spark, sf_dir)).withColumn("page_height", F.lit(C.PAGE_HEIGHT))
    return scans.misread_heads(books, L.repeated_heads(books, ratio=0.05).select("book", "band", "key"))


@query()
def ocr_blocks(spark, sf_dir):
    from ..operators import book as B

    lines = B.ocr_lines(C.ocr_payload(fx.frame(spark, "payloads")))
    return scans.placed_blocks(lines, scans.lines_to_blocks(lines))


@query()
def unicode_helpers(spark, sf_dir):
    u = udfs()
    s = fx.frame(spark, "strings")
    return s.select("i", u["nfc"]("s").alias("nfc"), u["folded_words"]("s").alias("folded"), u["reorder"]("s").alias("reading_order"), u["mathml"]("s").alias("mathml"), F.bround(u["similarity"]("s", F.lower("s")), 6).alias("similarity"))


@query(f"""WITH {S.LINES}, p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM lines),
e AS (SELECT doc_id, i, regexp_extract(line, {S.q(f'({S.LETTER}+)[-\\x{{00AD}}]' + chr(92) + 's*$')}, 1) AS "left", coalesce(regexp_extract(next, {S.q('^' + chr(92) + 's*(' + S.LETTER + '+)')}, 1), '') AS "right" FROM p)
SELECT doc_id, i, "left", "right", "left" || "right" AS joined FROM e WHERE "left" <> '' AND "right" <> ''""")
def hyphen_decisions(spark, sf_dir):
    """No line of the corpus ends in a hyphen; the tests hold positive cases."""
    rows = C.lines(docs(spark, sf_dir))
    return repair.hyphen_decisions(rows, repair.hyphen_evidence(rows))


@query()
def spread_pages(spark, sf_dir):
    pages = C.blocks_by_source(docs(spark, sf_dir)).select(F.col("book").alias("doc_id"), "page").distinct()
    return K.spread_sample(pages)
