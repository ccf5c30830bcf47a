"""Layout, structure, notes and table queries over virtual pages and fixtures, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import flow, notes, tables
from ..operators import layout as L
from ..operators import structure as X
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


def _blocks(spark, sf_dir, two=False):
    return C.blocks_by_document(docs(spark, sf_dir), two)


def _books(spark, sf_dir):
    return C.blocks_by_source(docs(spark, sf_dir)).withColumn("page_height", F.lit(C.PAGE_HEIGHT))


V1, V1C, V2 = S.blocks_by_document(), S.blocks_by_document(True), S.BLOCKS_BY_SOURCE


@query(f"""WITH {V1}, sized AS (SELECT doc_id, font_size, least(greatest(length(text), 1), 500) AS w, least(greatest(length(text), 1), 400) AS v FROM blocks),
flat AS (SELECT doc_id, font_size, unnest(range(w)) FROM sized), med AS (SELECT doc_id, median(font_size) AS body_size FROM flat GROUP BY doc_id),
sums AS (SELECT doc_id, font_size, sum(v) AS w FROM sized GROUP BY ALL), run AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY font_size) AS upto, sum(w) OVER (PARTITION BY doc_id) AS total FROM sums)
SELECT doc_id, any_value(body_size) AS body_size, min(font_size) AS upper_size FROM run JOIN med USING (doc_id) WHERE upto > total // 2 GROUP BY doc_id""")
def body_size_weighted_median(spark, sf_dir):
    return L.body_size(_blocks(spark, sf_dir))


@query(f"WITH {V1} SELECT doc_id, page, i, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 4, 0), x0, i)::BIGINT AS position FROM blocks")
def reading_order_single(spark, sf_dir):
    return L.single_column_order(_blocks(spark, sf_dir)).select("doc_id", "page", "i", "position")


@query(f"""WITH {V1C}, m AS (SELECT *, min(x0) OVER p AS lo, max(x1) OVER p AS hi FROM blocks WINDOW p AS (PARTITION BY doc_id, page)),
f AS (SELECT *, x1 - x0 >= 0.55::DOUBLE * (hi - lo) AS wide FROM m), narrow AS (SELECT * FROM f WHERE NOT wide),
cand AS (SELECT DISTINCT doc_id, page, x1 AS x, min(lo) OVER p AS lo, max(hi) OVER p AS hi FROM narrow WINDOW p AS (PARTITION BY doc_id, page)),
ok AS (SELECT c.doc_id, c.page, c.x FROM cand c JOIN narrow n USING (doc_id, page) GROUP BY c.doc_id, c.page, c.x, c.lo, c.hi
  HAVING (c.x - c.lo) / (c.hi - c.lo) BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE AND sum(CASE WHEN n.x0 < c.x AND n.x1 > c.x THEN 1 ELSE 0 END) = 0
  AND sum(CASE WHEN n.x1 <= c.x THEN 1 ELSE 0 END) >= 2 AND sum(CASE WHEN n.x0 >= c.x THEN 1 ELSE 0 END) >= 2),
gut AS (SELECT doc_id, page, min(x) AS gutter FROM ok GROUP BY ALL), j AS (SELECT f.*, gutter FROM f LEFT JOIN gut USING (doc_id, page)),
seg AS (SELECT *, CASE WHEN gutter IS NULL THEN 0 ELSE coalesce(sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS segment,
  CASE WHEN gutter IS NULL THEN 0 WHEN wide THEN 2 WHEN x0 >= gutter THEN 1 ELSE 0 END AS side, CASE WHEN gutter IS NULL THEN round_even(y0 / 4, 0) ELSE y0 END AS y FROM j)
SELECT doc_id, page, i, gutter, row_number() OVER (PARTITION BY doc_id, page ORDER BY segment, side, y, x0, i)::BIGINT AS position FROM seg""")
def reading_order_two_column(spark, sf_dir):
    return L.two_column_order(_blocks(spark, sf_dir, True)).select("doc_id", "page", "i", "gutter", "position")


@query(f"WITH {V1} SELECT doc_id, page, i, y0 - lag(y1) OVER w AS gap_above, lead(y0) OVER w - y1 AS gap_below FROM blocks WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY y0, i)")
def block_gaps(spark, sf_dir):
    return L.gaps(_blocks(spark, sf_dir)).select("doc_id", "page", "i", "gap_above", "gap_below")


@query(f"""WITH {S.LINES}, m AS (SELECT *, regexp_matches(line, '^\\s*$') AS blank FROM lines),
f AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY i), true) THEN 1 ELSE 0 END AS fresh FROM m),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM f)
SELECT doc_id, part::BIGINT AS part, min(i) AS first_line, max(i) AS last_line, sum(length(line))::BIGINT AS chars FROM p WHERE NOT blank GROUP BY ALL""")
def block_split(spark, sf_dir):
    return L.split_at_gaps(C.lines(docs(spark, sf_dir)))


def _repeats(ratio: float) -> str:
    share = lambda n: f"floor({ratio}::DOUBLE * {n})"
    side = lambda on, n: f"({n} >= 4 AND {on} >= greatest(3, {share(n)}))"
    return f"""WITH {V2}, keyed AS (SELECT *, CASE WHEN y1 <= 0.12::DOUBLE * 842.0 THEN 'top' WHEN y0 >= 0.90::DOUBLE * 842.0 THEN 'bottom' ELSE 'body' END AS band, {S.HEAD_KEY} AS key FROM blocks),
pages AS (SELECT book, count(*)::BIGINT AS pages, sum(page % 2)::BIGINT AS odd FROM (SELECT DISTINCT book, page FROM blocks) GROUP BY book),
seen AS (SELECT book, band, key, count(*)::BIGINT AS "on", sum(page % 2)::BIGINT AS on_odd FROM (SELECT DISTINCT book, band, key, page FROM keyed WHERE band <> 'body' AND key <> '') GROUP BY ALL),
j AS (SELECT *, pages - odd AS even, "on" - on_odd AS on_even FROM seen JOIN pages USING (book))
SELECT book, band, key, pages, "on", CASE WHEN "on" >= greatest(1, {share('pages')}) THEN 'all' WHEN {side('on_odd', 'odd')} THEN 'odd' ELSE 'even' END AS class FROM j
WHERE "on" >= 3 AND ("on" >= greatest(1, {share('pages')}) OR {side('on_odd', 'odd')} OR {side('on_even', 'even')})"""


@query(_repeats(0.05))
def repeated_furniture(spark, sf_dir):
    """With a ratio of 0.05: at the usual 0.55 nothing in the corpus recurs often enough."""
    return L.repeated_heads(_books(spark, sf_dir), ratio=0.05)


@query(_repeats(0.15))
def furniture_parity(spark, sf_dir):
    return L.repeated_heads(_books(spark, sf_dir), ratio=0.15)


@query(f"""WITH {V2}, m AS (SELECT *, count(*) OVER (PARTITION BY book, page) AS nb, row_number() OVER (PARTITION BY book, page ORDER BY y0, i) AS place FROM blocks)
SELECT book, page, CASE WHEN place = 1 THEN 'first' ELSE 'last' END AS edge, text FROM m WHERE nb >= 3 AND (place = 1 OR place = nb) AND length(text) <= 90""")
def edge_blocks(spark, sf_dir):
    return L.edge_blocks(_books(spark, sf_dir))


@query(f"""WITH {V2}, m AS (SELECT book, round_even(y0 / 842.0, 6) AS y, font_size FROM blocks WHERE regexp_matches(text, '[0-9]') AND length(text) <= 60),
g AS (SELECT book, count(*)::BIGINT AS numbers, list_sort(list(y)) AS ys, list_sort(list(font_size)) AS fs FROM m GROUP BY book)
SELECT book, numbers, ys[len(ys) // 2 + 1] AS y_share, fs[len(fs) // 2 + 1] AS size FROM g WHERE numbers >= 1""")
def short_number_lines_profile(spark, sf_dir):
    """The profile of page numbers over short lines with a digit: pure page numbers do not occur in the corpus."""
    rows = _books(spark, sf_dir).where(F.col("text").rlike("[0-9]") & (F.length("text") <= 60)).withColumn("text", F.lit("1"))
    return L.page_number_profile(rows, confirmed=1)


_PAGES = """pages AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS page, length(text)::BIGINT AS native_chars, (doc_id % 10) / 10.0::DOUBLE AS image_coverage FROM documents)"""
_KINDS = f"""{_PAGES}, typ AS (SELECT book, floor(median(native_chars))::BIGINT AS typical FROM pages WHERE native_chars > 0 GROUP BY book),
sh AS (SELECT p.book, any_value(typical) AS typical, avg(CASE WHEN native_chars >= 0.35::DOUBLE * typical THEN 1.0::DOUBLE ELSE 0 END) AS share FROM pages p JOIN typ USING (book) WHERE native_chars > 0 GROUP BY p.book),
kinds AS (SELECT book, page, native_chars, coalesce(typical, 0) AS typical, CASE WHEN typical > 0 AND native_chars >= 0.35::DOUBLE * typical THEN 'NATIVE' WHEN coalesce(share, 0) >= 0.70::DOUBLE AND native_chars >= 20 THEN 'NATIVE'
  WHEN native_chars >= 60 THEN CASE WHEN image_coverage >= 0.25::DOUBLE THEN 'MIXED' ELSE 'NATIVE' END WHEN image_coverage >= 0.55::DOUBLE THEN 'SCANNED' WHEN native_chars > 0 THEN 'NATIVE' ELSE 'EMPTY' END AS kind FROM pages LEFT JOIN sh USING (book))"""


def _kinds(spark, sf_dir):
    w = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    pages = docs(spark, sf_dir).select(F.col("source").alias("book"), w.cast("long").alias("page"), F.length("text").cast("long").alias("native_chars"), ((F.col("doc_id") % 10) / 10.0).alias("image_coverage"))
    return L.page_kinds(pages)


@query(f"WITH {_KINDS} SELECT * FROM kinds")
def page_kinds(spark, sf_dir):
    return _kinds(spark, sf_dir)


@query(f"""WITH {_KINDS}, c AS (SELECT book, count(*)::BIGINT AS pages, count(*) FILTER (kind = 'SCANNED')::BIGINT AS scanned, count(*) FILTER (kind = 'MIXED')::BIGINT AS mixed, count(*) FILTER (kind = 'NATIVE')::BIGINT AS native FROM kinds GROUP BY book)
SELECT *, CASE WHEN scanned >= 0.95::DOUBLE * pages THEN 'SCANNED' WHEN scanned + mixed > 0 THEN 'MIXED' WHEN native > 0 THEN 'NATIVE' ELSE 'UNKNOWN' END AS class FROM c""")
def document_classification(spark, sf_dir):
    return L.classify_books(_kinds(spark, sf_dir))


@query(f"""WITH {V1C}, g AS (SELECT doc_id, page, median(x0) AS "left", median(x1) AS "right", list_sort(list(x0)) AS xs, count(*)::BIGINT AS lines FROM blocks WHERE length(text) > 0 GROUP BY ALL)
SELECT doc_id, page, lines, "left", "right", xs[len(xs) // 4 + 1] AS quarter_start, round_even(len(list_filter(xs, lambda x: x > "left" + 4.0::DOUBLE))::DOUBLE / lines, 6) AS indented_share FROM g WHERE lines >= 3""")
def text_measure(spark, sf_dir):
    return L.text_measure(_blocks(spark, sf_dir, True))


_REGIONS = fx.REGIONS


@query(f"""WITH {V1}, {_REGIONS} SELECT doc_id, page, i FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM regions t WHERE t.doc_id = b.doc_id AND t.page = b.page AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0
  AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) >= 0.35::DOUBLE * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def overlap_anti_join(spark, sf_dir):
    return L.overlap_anti(_blocks(spark, sf_dir), fx.regions(_blocks(spark, sf_dir))).select("doc_id", "page", "i")


@query(f"""WITH {V1}, {_REGIONS} SELECT b.doc_id, b.page, b.i, r.region FROM blocks b JOIN regions r ON r.doc_id = b.doc_id AND r.page = b.page
  WHERE (b.x0 + b.x1) / 2 BETWEEN r.x0 AND r.x1 AND (b.y0 + b.y1) / 2 BETWEEN r.y0 AND r.y1""")
def containment_join(spark, sf_dir):
    return L.centre_inside(_blocks(spark, sf_dir), fx.regions(_blocks(spark, sf_dir))).select("doc_id", "page", "i", "region")


@query(f"""WITH {V1}, {_REGIONS}, near AS (SELECT r.doc_id, r.page, r.region, b.i AS caption, b.text AS caption_text, CASE WHEN b.y1 <= r.y0 THEN r.y0 - b.y1 WHEN b.y0 >= r.y1 THEN b.y0 - r.y1 END AS gap, CASE WHEN b.y0 >= r.y1 THEN 1 ELSE 0 END AS below
  FROM regions r JOIN blocks b USING (doc_id, page)) SELECT doc_id, page, region, caption, caption_text, gap FROM near WHERE gap <= 60 QUALIFY row_number() OVER (PARTITION BY doc_id, page, region ORDER BY gap, below, caption) = 1""")
def nearest_caption(spark, sf_dir):
    return L.nearest_caption(fx.regions(_blocks(spark, sf_dir)), _blocks(spark, sf_dir))


_CONTEXT = f"""{V1}, ctx AS (SELECT doc_id, i, page, text, {S.squeezed('text')} AS t, x0, x1, font_size / 10.0::DOUBLE AS r, y0 - lag(y1) OVER w AS above, lead(y0) OVER w - y1 AS below,
  sum(length(text)) OVER (PARTITION BY doc_id, page) AS chars, row_number() OVER w = 1 AS first FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, i))"""
_HEADING = f"""{_CONTEXT}, sig AS (SELECT *, {S.has('t', T.DIVISION_WORD)} AS division, {S.has('t', T.NUMBERED_TITLE)} AS numbered, (upper(t) = t AND lower(t) <> t AND length(t) > 2) AS caps,
  len(string_split(t, ' ')) AS nw, coalesce(above > 2.2::DOUBLE * 4, true) AS ga, coalesce(below > 1.6::DOUBLE * 4, true) AS gb, chars > 0 AND chars < 900 AS sparse FROM ctx),
veto AS (SELECT *, t = '' OR length(t) > 120 OR {S.has('t', T.URL)} OR {S.has('t', T.OPENS_AS_QUOTE)} OR regexp_matches(t, '(?i)\\bISBN\\b')
  OR length(t) - length(replace(t, ')', '')) > length(t) - length(replace(t, '(', ''))
  OR len(list_filter(regexp_extract_all(t, {S.q(T.LETTER + '{3,}')}), lambda w: regexp_matches(w, '[{X.VOWEL}]'))) = 0
  OR (length(t) >= 40 AND regexp_matches(regexp_replace(t, '^\\s*(?:[0-9]{{1,3}}(?:\\.[0-9]{{1,3}})*\\.?|[IVXLCDMivxlcdm]{{1,7}}\\.)\\s+', ''), '[.?!]\\s+\\S')) AS veto FROM sig),
scored AS (SELECT *, CASE WHEN veto OR NOT (r >= 1.12::DOUBLE OR division OR numbered OR caps) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, round_even(
  CASE WHEN r >= 1.8::DOUBLE THEN 0.45::DOUBLE WHEN r >= 1.35::DOUBLE THEN 0.32::DOUBLE WHEN r >= 1.12::DOUBLE THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN division THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN numbered THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN caps THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN abs((x0 + x1) / 2 - 297.5::DOUBLE) <= 0.06::DOUBLE * 595 AND length(t) < 60 THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN ga AND gb THEN 0.24::DOUBLE WHEN ga THEN 0.12::DOUBLE WHEN gb THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN sparse AND first THEN 0.26::DOUBLE WHEN sparse THEN 0.16::DOUBLE ELSE 0 END
  - CASE WHEN regexp_matches(t, '[.!?]$') AND NOT {S.has('t', T.BARE_NUMBER)} AND NOT division THEN 0.30::DOUBLE ELSE 0 END
  - CASE WHEN nw > CASE WHEN r >= 1.5::DOUBLE THEN 18 ELSE 12 END AND NOT division THEN 0.25::DOUBLE ELSE 0 END, 6)) END AS score FROM veto)"""


@query(f"WITH {_HEADING} SELECT doc_id, i, score, score >= 0.55::DOUBLE AS is_heading FROM scored")
def heading_scores(spark, sf_dir):
    return X.heading_score(X.page_context(_blocks(spark, sf_dir))).select("doc_id", "i", "score", "is_heading")


@query("""WITH recursive_base AS (SELECT doc_id, turn_no AS seq, text, scale FROM (SELECT doc_id, unnest(range(len(parts)))::BIGINT AS turn_no, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([24.0, 20.0, 19.0, 16.0, 13.0, 12.0, 10.0])::DOUBLE AS scale) s ON s.k = turn_no % 7 WHERE turn_no < 14),
heads AS (SELECT doc_id, list_reverse(list_sort(list_distinct(list(round_even(scale, 2))))) AS xs FROM recursive_base GROUP BY doc_id),
picked AS (SELECT doc_id, list_reduce(list_prepend([]::DOUBLE[], list_transform(xs, lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 OR x[1] < a[len(a)] * (1 - 0.18::DOUBLE) THEN list_concat(a, x) ELSE a END)[1:4] AS heads FROM heads),
j AS (SELECT b.*, round_even(scale, 2) AS size, heads, regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\s*([0-9]{1,3}(?:\\.[0-9]{1,3})*)\\.?\\s*[^0-9]', 1) AS num FROM recursive_base b JOIN picked USING (doc_id)),
g AS (SELECT *, least(greatest(len(list_filter(heads, lambda h: h > size / (1 - 0.18::DOUBLE))) + 1, 1), 4)::BIGINT AS scale_level, CASE WHEN num <> '' THEN len(string_split(num, '.')) ELSE 0 END::BIGINT AS depth FROM j)
SELECT doc_id, seq, scale AS heading_scale, scale_level, depth, least(greatest(scale_level, depth), 6)::BIGINT AS level FROM g""")
def heading_levels(spark, sf_dir):
    """The first lines of every document as headings of seven invented sizes."""
    scale = F.element_at(F.array(*[F.lit(x) for x in (24.0, 20.0, 19.0, 16.0, 13.0, 12.0, 10.0)]), (F.col("i") % 7 + 1).cast("int"))
    heads = C.lines(docs(spark, sf_dir)).where("i < 14").select("doc_id", F.col("i").alias("seq"), F.col("line").alias("text"), scale.alias("heading_scale"))
    return X.heading_levels(heads).drop("text")


_PARA = """WITH nodes AS (SELECT doc_id, i AS seq, 'PARAGRAPH' AS role, line AS text FROM lines),
b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM nodes),
e AS (SELECT *, rtrim(before) AS p, regexp_replace(rtrim(before), '[”’"''»]+$', '') AS bare FROM b),
m AS (SELECT *, CASE WHEN before IS NOT NULL AND trim(before) <> '' AND trim(text) <> '' AND NOT (regexp_matches(p, '[.!?…:;”’"''»]$') AND NOT (bare <> p AND regexp_matches(bare, '[,;:–—-]$'))) THEN 0 ELSE 1 END AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM m)
SELECT doc_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*)::BIGINT AS nodes, sum(length(text))::BIGINT AS chars FROM r GROUP BY doc_id, run"""


@query("WITH " + S.LINES + ", " + _PARA.removeprefix("WITH "))
def paragraph_runs(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir)).select("doc_id", F.col("i").alias("seq"), F.lit("PARAGRAPH").alias("role"), F.col("line").alias("text"))
    sizes = rows.select("doc_id", "seq", F.length("text").alias("n"))
    runs = flow.paragraph_runs(rows).select("doc_id", "first_seq", "last_seq", "nodes")
    joined = runs.join(sizes, (runs["doc_id"] == sizes["doc_id"]) & sizes["seq"].between(runs["first_seq"], runs["last_seq"]))
    return joined.groupBy(runs["doc_id"], "first_seq", "last_seq", "nodes").agg(F.sum("n").cast("long").alias("chars"))


@query()
def paragraph_texts(spark, sf_dir):
    nodes = fx.frame(spark, "paragraph_nodes")
    runs = flow.paragraph_runs(nodes)
    return flow.held_order(nodes, runs).join(runs.select("doc_id", F.col("first_seq").alias("seq"), "text"), ["doc_id", "seq"], "left")


@query()
def verse_runs(spark, sf_dir):
    return flow.verse_runs(_blocks(spark, sf_dir))


@query()
def visual_lines(spark, sf_dir):
    return flow.visual_lines(_blocks(spark, sf_dir, True))


@query(f"""WITH {S.LINES}, items AS (SELECT doc_id, i, regexp_extract(line, {S.q(T.NUMBERED)}, 1) AS mark FROM lines WHERE {S.has('line', T.BULLET)} OR {S.has('line', T.NUMBERED)}),
n AS (SELECT *, CASE WHEN regexp_matches(mark, '^[0-9]+$') THEN mark::BIGINT END AS number FROM items)
SELECT doc_id, i, mark, number, coalesce(number = lag(number) OVER w + 1 AND i = lag(i) OVER w + 1, false) AS follows FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def list_items(spark, sf_dir):
    return flow.list_items(C.lines(docs(spark, sf_dir)).withColumnRenamed("line", "text"))


_MARK = lambda c: f"nullif(regexp_extract(translate({S.squeezed(c)}, '{T.SUPERSCRIPTS[0]}', '{T.SUPERSCRIPTS[1]}'), {S.q(T.MARKER)}, 1), '')"


@query(f"""WITH {fx.view('note_refs')}, {fx.view('note_bodies')}, r AS (SELECT *, {_MARK('marker')} AS m FROM note_refs),
b AS (SELECT doc_id, page AS b_page, {_MARK('marker')} AS m, max(seq) AS target FROM note_bodies GROUP BY ALL),
n AS (SELECT r.doc_id, r.seq, b.b_page, b.target FROM r JOIN b ON b.doc_id = r.doc_id AND b.m = r.m AND b.b_page BETWEEN r.page AND r.page + 1 QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.seq ORDER BY b_page) = 1)
SELECT r.doc_id, r.seq, r.page, r.m AS marker, n.target FROM r LEFT JOIN n USING (doc_id, seq) WHERE r.m IS NOT NULL""")
def footnote_links(spark, sf_dir):
    return notes.footnote_links(fx.frame(spark, "note_refs"), fx.frame(spark, "note_bodies"))


_END = f"""{fx.view('end_nodes')}, t AS (SELECT *, {S.squeezed('text')} AS t FROM end_nodes),
f AS (SELECT *, role = 'HEADING' AND {S.has('t', T.ENDNOTE_HEADING)} AS opens, CASE WHEN role = 'HEADING' THEN nullif(regexp_extract(t, {S.q(S.dialect(T.CHAPTER_SCOPE))}, 1), '') END AS sc FROM t),
o AS (SELECT *, last_value(CASE WHEN opens THEN seq END IGNORE NULLS) OVER w AS open_seq, last_value(CASE WHEN opens THEN level END IGNORE NULLS) OVER w AS open_level FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
c AS (SELECT *, max(CASE WHEN role = 'HEADING' AND NOT opens AND sc IS NULL AND level <= open_level THEN 1 ELSE 0 END) OVER w AS closed,
  last_value(CASE sc WHEN 'III' THEN 3 WHEN '4' THEN 4 END IGNORE NULLS) OVER w AS scope FROM o WHERE open_seq IS NOT NULL WINDOW w AS (PARTITION BY doc_id, open_seq ORDER BY seq)),
entries AS (SELECT doc_id, seq, open_seq AS section, scope::BIGINT AS scope, regexp_extract(t, {S.q(T.NOTE_ENTRY)}, 1) AS number FROM c WHERE closed = 0 AND role <> 'HEADING' AND {S.has('t', T.NOTE_ENTRY)})"""


@query(f"WITH {_END} SELECT * FROM entries")
def endnote_scopes(spark, sf_dir):
    return notes.endnote_sections(fx.frame(spark, "end_nodes"))


@query(f"""WITH {_END}, {fx.view('note_refs')}, r AS (SELECT *, {_MARK('marker')} AS m FROM note_refs),
s AS (SELECT doc_id, {_MARK('number')} AS m, scope AS chapter, min(seq) AS scoped FROM entries WHERE scope IS NOT NULL GROUP BY ALL),
u AS (SELECT doc_id, {_MARK('number')} AS m, min(seq) AS free FROM entries WHERE scope IS NULL GROUP BY ALL)
SELECT r.doc_id, r.seq, r.chapter, r.m AS marker, coalesce(scoped, free) AS target FROM r LEFT JOIN s USING (doc_id, m, chapter) LEFT JOIN u USING (doc_id, m) WHERE r.m IS NOT NULL""")
def endnote_links(spark, sf_dir):
    return notes.endnote_links(fx.frame(spark, "note_refs"), notes.endnote_sections(fx.frame(spark, "end_nodes")))


@query(f"""WITH {fx.view('bib_nodes')}, t AS (SELECT *, {S.squeezed('text')} AS t FROM bib_nodes), f AS (SELECT *, {S.has('t', T.BIBLIOGRAPHY_TITLE)} AS title FROM t),
p AS (SELECT *, sum(CASE WHEN title OR role IN ('HEADING', 'THEMATIC_BREAK', 'TOC_ENTRY') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS part FROM f),
i AS (SELECT *, max(title::INT) OVER w AS inside, min(seq) OVER w AS section FROM p WINDOW w AS (PARTITION BY doc_id, part)),
n AS (SELECT *, sum(CASE WHEN {S.has('t', T.NUMBERED_ENTRY)} THEN 1 ELSE 0 END) OVER w AS numbered, x0 > min(x0) OVER w + greatest(0.6::DOUBLE * font_size, 4) AS hung FROM i WHERE inside = 1 AND NOT title WINDOW w AS (PARTITION BY doc_id, part)),
h AS (SELECT *, avg(hung::INT) OVER (PARTITION BY doc_id, part) >= 0.1 AS hanging FROM n),
o AS (SELECT *, CASE WHEN {S.has('t', T.LINK_LINE)} THEN false WHEN numbered >= 3 THEN {S.has('t', T.NUMBERED_ENTRY)} WHEN hanging THEN NOT hung ELSE true END AS opens FROM h),
e AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, part ORDER BY seq)::BIGINT AS entry FROM o)
SELECT doc_id, section, entry, min(seq) AS first_seq, count(*)::BIGINT AS lines, string_agg(t, ' ' ORDER BY seq) AS text FROM e GROUP BY ALL""")
def bibliography_entries(spark, sf_dir):
    return notes.bibliography_entries(fx.frame(spark, "bib_nodes"))


_ENTRY = lambda c: f"lower({S.squeezed(f'regexp_replace({c}, {S.q(T.LEADER_LINE)}, {S.q(str())})')})"


@query(f"""WITH {fx.view('contents')}, f AS (SELECT book, page, sum({S.has('text', T.LEADER_LINE)}::INT)::BIGINT AS leaders, max({S.has(S.squeezed('text'), T.TOC_TITLE)}::INT) = 1 AS titled FROM contents GROUP BY ALL),
r AS (SELECT *, (leaders >= 3 OR titled)::INT AS sure, page - row_number() OVER (PARTITION BY book ORDER BY page) AS run FROM f WHERE leaders >= 1),
c AS (SELECT *, max(sure) OVER (PARTITION BY book, run ORDER BY page) AS inside FROM r) SELECT book, page, leaders FROM c WHERE inside = 1""")
def toc_pages(spark, sf_dir):
    return X.contents_pages(fx.frame(spark, "contents"))


@query(f"""WITH {fx.view('contents')}, {fx.view('contents_heads')}, h AS (SELECT book, {_ENTRY('text')} AS key, min(seq) AS target FROM contents_heads GROUP BY ALL)
SELECT c.book, c.seq, {_ENTRY('c.text')} AS key, h.target FROM contents c LEFT JOIN h ON h.book = c.book AND h.key = {_ENTRY('c.text')}""")
def toc_links(spark, sf_dir):
    return X.contents_links(fx.frame(spark, "contents"), fx.frame(spark, "contents_heads"))


@query(f"""WITH {S.LINES}, b AS (SELECT doc_id, i, line, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS tb FROM lines WHERE contains(line, ' | ')),
r AS (SELECT doc_id, min(i) OVER (PARTITION BY doc_id, tb) AS table_at, row_number() OVER (PARTITION BY doc_id, tb ORDER BY i) - 1 AS "row", string_split(line, ' | ') AS cells FROM b),
c AS (SELECT doc_id, table_at, "row", len(cells) AS cells, len(list_filter(cells, lambda x: {S.squeezed('x')} <> '')) AS filled, len(list_filter(cells, lambda x: regexp_matches({S.squeezed('x')}, '^[-+]?[0-9][0-9.,%\\s]*$'))) AS numeric FROM r),
s AS (SELECT doc_id, table_at, count(*)::BIGINT AS rows, max(cells)::BIGINT AS cols, sum(filled) AS filled, sum((filled >= 2)::INT) AS spanning, list(cells) AS sizes,
  max(CASE WHEN "row" = 0 THEN cells END) AS hc, max(CASE WHEN "row" = 0 THEN filled END) AS hf, max(CASE WHEN "row" = 0 THEN numeric END) AS hn, sum(CASE WHEN "row" > 0 THEN numeric ELSE 0 END) AS bn, sum(CASE WHEN "row" > 0 THEN cells ELSE 0 END) AS bc FROM c GROUP BY ALL),
f AS (SELECT *, len(list_filter(sizes, lambda x: x = cols))::DOUBLE / rows AS consistent, filled::DOUBLE / (rows * cols) AS fill FROM s)
SELECT doc_id, table_at, rows, cols, round_even(consistent, 6) AS consistent, round_even(fill, 6) AS fill,
  round_even(CASE WHEN rows >= 2 AND cols >= 2 AND 2 * spanning >= rows THEN least(1, greatest(0, 0.55::DOUBLE * consistent + 0.45::DOUBLE * fill + CASE WHEN rows >= 3 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN fill < 0.45::DOUBLE THEN 0.25::DOUBLE ELSE 0 END)) ELSE 0 END, 6) AS score,
  coalesce(hc = hf AND hn < 0.34::DOUBLE * hc AND bn * hc > hn * bc, false) AS has_header FROM f""")
def aligned_table_scores(spark, sf_dir):
    return tables.table_scores(tables.pipe_cells(C.lines(docs(spark, sf_dir))))


@query(f"""WITH {fx.view('spans')}, m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, "table" ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT doc_id, "table", x0, x1 FROM spans)),
f AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, "table" ORDER BY x0, x1) - 1 AS c FROM m)
SELECT doc_id, "table", c::BIGINT AS "column", min(x0) AS x0, max(x1) AS x1, count(*)::BIGINT AS spans FROM f GROUP BY ALL""")
def aligned_columns(spark, sf_dir):
    return tables.aligned_columns(fx.frame(spark, "spans"))


_CHAIN = f"""{fx.view('tables')}, m AS (SELECT *, coalesce(page = lag(page) OVER w + 1 AND cols = lag(cols) OVER w AND NOT captioned, false) AS carries FROM tables WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0)),
k AS (SELECT *, sum((NOT carries)::INT) OVER (PARTITION BY doc_id ORDER BY page, y0) AS chain FROM m),
chains AS (SELECT doc_id, "table", page, carries, first_value("table") OVER (PARTITION BY doc_id, chain ORDER BY page, y0) AS first_table FROM k)"""


@query(f"WITH {_CHAIN} SELECT * FROM chains")
def table_continuations(spark, sf_dir):
    return tables.continuations(fx.frame(spark, "tables"))


@query(f"""WITH {_CHAIN}, {fx.view('table_cells')}, r AS (SELECT doc_id, "table", "row", string_agg(text, chr(9) ORDER BY "col") AS cells FROM table_cells GROUP BY ALL),
j AS (SELECT r.*, page, carries, first_table FROM r JOIN chains USING (doc_id, "table")), h AS (SELECT doc_id, first_table, cells AS header FROM j WHERE "row" = 0 AND NOT carries),
kept AS (SELECT j.* FROM j LEFT JOIN h USING (doc_id, first_table) WHERE NOT (carries AND "row" = 0 AND coalesce(cells = header, false)))
SELECT doc_id, first_table, row_number() OVER (PARTITION BY doc_id, first_table ORDER BY page, "row")::BIGINT - 1 AS "row", cells FROM kept""")
def table_stitch(spark, sf_dir):
    return tables.stitched(fx.frame(spark, "table_cells"), tables.continuations(fx.frame(spark, "tables")))
