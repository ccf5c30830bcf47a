"""Chapters, navigation, integrity, review, recognition and job queries, with the SQL they must agree with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import book as B
from ..operators import epub
from ..sources import corpus as C
from ..streaming import jobs as J
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


def _nodes(spark, sf_dir):
    """Web pages as books: h1 is level 1; every paragraph that begins with a capital O opens a second-level heading."""
    n = C.book_nodes(C.table(spark, sf_dir, "pages"))
    second = (F.col("tag") == "p") & F.col("text").startswith("O")
    role = F.when(F.col("tag").startswith("h") | second, "HEADING").when(F.col("tag") == "li", "LIST_ITEM").otherwise("PARAGRAPH")
    level = F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).when(second, 2)
    return n.select(F.col("page_id").alias("doc_id"), "seq", role.alias("role"), level.cast("long").alias("level"), "text")


_NODES = f"""{S.HTML_NODES}, nodes AS (SELECT page_id AS doc_id, seq, CASE WHEN left(tag, 1) = 'h' OR (tag = 'p' AND starts_with(text, 'O')) THEN 'HEADING' WHEN tag = 'li' THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS role,
  CASE WHEN left(tag, 1) = 'h' THEN substr(tag, 2, 1)::BIGINT WHEN tag = 'p' AND starts_with(text, 'O') THEN 2 END::BIGINT AS level, text FROM book_nodes)"""
_CHAPTERS = f"""{_NODES}, lv AS (SELECT doc_id, level, count(*) AS n, sum({S.has('text', T.DIVISION_WORD)}::INT) AS d FROM nodes WHERE role = 'HEADING' GROUP BY ALL),
choice AS (SELECT doc_id, CASE WHEN sum(d) >= 2 THEN arg_min(level, -d * 100 + level) ELSE coalesce(min(level) FILTER (n >= 2), min(level)) END AS split FROM lv GROUP BY doc_id),
op AS (SELECT n.*, coalesce(role = 'HEADING' AND level <= split, false) AS opens FROM nodes n LEFT JOIN choice USING (doc_id)),
chaptered AS (SELECT doc_id, seq, role, level, text, sum(opens::INT) OVER w::BIGINT AS chapter, coalesce(last_value(CASE WHEN opens THEN text END IGNORE NULLS) OVER w, 'Front Matter') AS chapter_title FROM op WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"""


@query(f"WITH {_CHAPTERS} SELECT doc_id, chapter, any_value(chapter_title) AS chapter_title, count(*)::BIGINT AS nodes, min(seq) AS first_seq FROM chaptered GROUP BY doc_id, chapter")
def chapter_partition(spark, sf_dir):
    return B.chapters(_nodes(spark, sf_dir)).groupBy("doc_id", "chapter").agg(F.max("chapter_title").alias("chapter_title"), F.count("*").alias("nodes"), F.min("seq").alias("first_seq"))


@query(f"""WITH {_NODES}, c AS (SELECT doc_id, level, count(*) AS n FROM nodes WHERE role = 'HEADING' GROUP BY ALL), p AS (SELECT doc_id, (max(seq) * 3)::BIGINT AS page_count FROM nodes GROUP BY doc_id),
r AS (SELECT c.*, page_count, sum(n) OVER (PARTITION BY c.doc_id ORDER BY level) AS upto FROM c JOIN p USING (doc_id))
SELECT doc_id, coalesce(min(level) FILTER (upto >= 2 AND page_count <= 60 * upto), min(level) FILTER (n >= 2), min(level)) AS level FROM r GROUP BY doc_id""")
def split_level_choice(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    pages = nodes.groupBy("doc_id").agg((F.max("seq") * 3).cast("long").alias("page_count"))
    return B.split_level(nodes.where("role = 'HEADING'"), pages)


_SLUG = "regexp_replace(regexp_replace(translate(lower(translate(text, 'İI', 'ii')), 'ışğçöüâîûáàäéèêëíïñóòôúùß', 'isgcouaiuaaaeeeeiinooouus'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH {_NODES}, s AS (SELECT doc_id, seq, regexp_replace(left({_SLUG}, 80), '-+$', '') AS short FROM nodes WHERE role = 'HEADING'),
b AS (SELECT doc_id, seq, CASE WHEN short = '' THEN 'chapter' ELSE short END AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY seq) AS n FROM b)
SELECT doc_id, seq, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n""")
def slugs(spark, sf_dir):
    return B.slugs(_nodes(spark, sf_dir).where("role = 'HEADING'"))


@query(f"""WITH {_CHAPTERS}, h AS (SELECT *, min(level) OVER (PARTITION BY doc_id, chapter) AS top FROM chaptered WHERE role = 'HEADING')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS position, chapter, (level - top)::BIGINT AS depth, text FROM h WHERE level <= top + 1""")
def nav_entries(spark, sf_dir):
    return B.navigation(B.chapters(_nodes(spark, sf_dir)))


@query("""WITH l AS (SELECT page_id AS doc_id, unnest(range(len(h)))::BIGINT AS seq, unnest(h) AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
a AS (SELECT DISTINCT page_id AS doc_id, '/' || unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]{1,4})</a>', 1)) AS target FROM pages)
SELECT l.doc_id, l.target, l.seq FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = l.doc_id AND a.target = l.target)""")
def dangling_links(spark, sf_dir):
    """Links of pages against anchors named by their short link texts: the long ones dangle."""
    pages = C.table(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("seq", "target")).withColumn("seq", F.col("seq").cast("long"))
    anchors = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]{1,4})</a>'), F.lit(1))).alias("a")).select("doc_id", F.concat(F.lit("/"), "a").alias("anchor"))
    return B.dangling_links(links, anchors)


_WORDS = S.count("text", S.WORD)


@query(f"""WITH {S.LINES}, b AS (SELECT doc_id, i, line AS text, i % 7 = 3 AS furniture, i % 5 <> 4 AS used FROM lines), w AS (SELECT *, {_WORDS} AS w FROM b),
s AS (SELECT doc_id, sum(w)::BIGINT AS source_words, sum(CASE WHEN furniture THEN w ELSE 0 END)::BIGINT AS furniture_words, sum((NOT furniture AND NOT used AND w > 0)::INT)::BIGINT AS unaccounted,
  sum(CASE WHEN used THEN w ELSE 0 END)::BIGINT AS output_words FROM w GROUP BY doc_id),
r AS (SELECT *, greatest(source_words - furniture_words, 0) AS expected FROM s), q AS (SELECT *, CASE WHEN expected > 0 THEN output_words::DOUBLE / expected ELSE 1.0::DOUBLE END AS raw FROM r)
SELECT doc_id, source_words, furniture_words, unaccounted, output_words, expected, round_even(raw, 6) AS raw_ratio, round_even(least(raw, 1), 6) AS ratio, unaccounted > 0 OR round_even(least(raw, 1), 6) < 0.90::DOUBLE AS suspicious FROM q""")
def integrity_by_document(spark, sf_dir):
    """Lines as blocks: every seventh is furniture, every fifth reaches no node."""
    rows = C.lines(docs(spark, sf_dir))
    blocks = rows.select("doc_id", F.col("i").cast("string").alias("block_id"), F.col("line").alias("text"), (F.col("i") % 7 == 3).alias("furniture"))
    nodes = rows.where("i % 5 <> 4").select("doc_id", F.array(F.col("i").cast("string")).alias("source_block_ids"), F.col("line").alias("text"))
    everywhere = nodes.unionByName(docs(spark, sf_dir).select("doc_id", F.array().cast("array<string>").alias("source_block_ids"), F.lit("").alias("text")))
    return B.integrity(blocks, everywhere)


@query(f"""WITH {fx.view('reports')}, b AS (SELECT *, 100 * CASE WHEN ocr_confidence IS NULL THEN 0.40::DOUBLE * integrity + 0.30::DOUBLE * valid::INT + 0.15::DOUBLE * note_ratio + 0.15::DOUBLE * st
  ELSE 0.32::DOUBLE * integrity + 0.26::DOUBLE * valid::INT + 0.14::DOUBLE * note_ratio + 0.13::DOUBLE * st + 0.15::DOUBLE * ocr_confidence END AS base FROM (SELECT *, CASE WHEN pages > 5 AND headings = 0 THEN 0.5::DOUBLE ELSE 1 END AS st FROM reports)),
p AS (SELECT *, least(12::DOUBLE, 100 * unmatched_share) + least(10::DOUBLE, 20 * suspicious_share) + least(10::DOUBLE, 10 * unlinked_share) AS penalty FROM b)
SELECT doc_id, round_even(penalty, 6) AS penalty, round_even(least(100::DOUBLE, greatest(0::DOUBLE, least(CASE WHEN suspicious THEN least(base, 85) ELSE base END - penalty, CASE WHEN needs_review THEN 92 ELSE 100 END))), 1) AS score FROM p""")
def quality_score(spark, sf_dir):
    return B.quality_score(fx.frame(spark, "reports"))


@query(f"""WITH {_CHAPTERS}, s AS (SELECT doc_id, count(*) FILTER (role = 'HEADING')::DOUBLE / count(*) AS h, count(*) FILTER (role = 'PARAGRAPH')::DOUBLE / count(*) AS p, count(*) FILTER (role = 'LIST_ITEM')::DOUBLE / count(*) AS l FROM chaptered GROUP BY doc_id)
SELECT doc_id, round_even(100 * ((h + p + l + 1) / 4), 1) AS structure_score FROM s""")
def structure_score(spark, sf_dir):
    share = lambda r: (F.sum(F.when(F.col("role") == r, 1).otherwise(0)) / F.count("*"))
    parts = B.chapters(_nodes(spark, sf_dir)).groupBy("doc_id").agg(share("HEADING").alias("heading_share"), share("PARAGRAPH").alias("paragraph_share"), share("LIST_ITEM").alias("list_share"), F.lit(1.0).alias("note_share"))
    return B.structure_score(parts)


@query(f"""WITH {S.LINES}, a AS (SELECT doc_id, sum({S.count('line', S.WORD)})::BIGINT AS words, sum(len(regexp_extract_all(line, {S.q(T.OCR_WORD)})) + (NOT regexp_matches(line, '\\p{{Ll}}'))::INT)::BIGINT AS odd FROM lines GROUP BY doc_id)
SELECT quality, toxic, count(*)::BIGINT AS documents, sum(words)::BIGINT AS words, sum(odd)::BIGINT AS odd, round_even(sum(odd) * 1000.0::DOUBLE / sum(words), 6) AS odd_per_1000 FROM a JOIN labels USING (doc_id) GROUP BY ALL""")
def score_vs_labels(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir))
    odd = T.count_of(F.col("line"), T.OCR_WORD) + (~F.col("line").rlike(r"\p{Ll}")).cast("long")
    per = rows.groupBy("doc_id").agg(F.sum(T.count_of(F.col("line"), T.WORD)).alias("words"), F.sum(odd).alias("odd"))
    return per.join(C.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("odd").alias("odd"), F.bround(F.sum("odd") * 1000.0 / F.sum("words"), 6).alias("odd_per_1000"))


def _confident(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumn("confidence", F.bround((F.col("seq") * 37 % 100) / 100.0, 6))


_CONF = f"{_NODES}, c AS (SELECT *, round_even((seq * 37 % 100) / 100.0::DOUBLE, 6) AS confidence FROM nodes)"
_REQ = f"""{_CONF}, r AS (SELECT doc_id, seq, role, level, text, confidence, right(coalesce(lag(text) OVER w, ''), 200) AS before, left(coalesce(lead(text) OVER w, ''), 200) AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
requests AS (SELECT * FROM r WHERE confidence < 0.70::DOUBLE AND role NOT IN ('IMAGE', 'HEADER', 'FOOTER', 'PAGE_NUMBER'))"""
_SENT = f"(len(string_split({S.squeezed('text')}, ' ')) > 12 OR (regexp_matches({S.squeezed('text')}, '[.!?]$') AND len(string_split({S.squeezed('text')}, ' ')) > 6))"
_OPS = f"""{_REQ}, opinions AS (SELECT doc_id, seq, CASE WHEN role = 'HEADING' AND {_SENT} THEN 'PARAGRAPH' WHEN role = 'HEADING' THEN 'HEADING' WHEN role = 'PARAGRAPH' AND length({S.squeezed('text')}) <= 20 THEN 'HEADING' ELSE role END AS new_role,
  round_even(CASE WHEN role = 'HEADING' AND {_SENT} THEN 0.60::DOUBLE WHEN role = 'HEADING' THEN least(0.8::DOUBLE, confidence + 0.15::DOUBLE) WHEN role = 'PARAGRAPH' AND length({S.squeezed('text')}) <= 20 THEN 0.55::DOUBLE ELSE confidence END, 6) AS new_confidence FROM requests)"""


@query(f"WITH {_REQ} SELECT * FROM requests")
def review_candidates(spark, sf_dir):
    return B.review_candidates(_confident(spark, sf_dir))


@query(f"WITH {_OPS} SELECT * FROM opinions")
def local_review(spark, sf_dir):
    return B.local_opinions(B.review_candidates(_confident(spark, sf_dir)))


@query(f"""WITH {_OPS} SELECT c.doc_id, c.seq, CASE WHEN coalesce(new_confidence > confidence, false) THEN new_role ELSE role END AS role, level, text, greatest(confidence, coalesce(new_confidence, 0)) AS confidence,
  coalesce(new_confidence > confidence, false) AND new_role <> role AS changed FROM c LEFT JOIN opinions USING (doc_id, seq)""")
def apply_opinions(spark, sf_dir):
    nodes = _confident(spark, sf_dir)
    return B.apply_opinions(nodes, B.local_opinions(B.review_candidates(nodes)))


_OCR = f"""{fx.view('payloads')}, pg AS (SELECT doc_id, unnest(range(len(x)))::BIGINT AS ordinal, unnest(x) AS p FROM (SELECT doc_id, from_json(json, '{{"pages":[{{"page":"INTEGER","lines":[{{"confidence":"DOUBLE","words":[{{"text":"VARCHAR","bbox":["DOUBLE"],"confidence":"DOUBLE"}}]}}]}}]}}').pages AS x FROM payloads)),
lastp AS (SELECT doc_id, p.page AS page, arg_max(p.lines, ordinal) AS lines FROM pg WHERE len(p.lines) > 0 GROUP BY ALL),
ln AS (SELECT doc_id, page, unnest(range(len(lines)))::BIGINT AS line_no, unnest(lines) AS l FROM lastp), wd AS (SELECT doc_id, page, line_no, unnest(range(len(l.words)))::BIGINT AS word_no, unnest(l.words) AS w FROM ln),
ocr AS (SELECT doc_id, page::BIGINT AS page, line_no, word_no, w.text AS text, w.bbox[1] AS x0, w.bbox[2] AS y0, w.bbox[3] AS x1, w.bbox[4] AS y1, w.confidence AS confidence FROM wd
  WHERE len(w.bbox) = 4 AND w.bbox[1] <= w.bbox[3] AND w.bbox[2] <= w.bbox[4] AND w.confidence BETWEEN 0 AND 1 AND length(w.text) <= 200)"""


@query(f"WITH {_OCR} SELECT * FROM ocr")
def ocr_json_ingest(spark, sf_dir):
    return C.ocr_payload(fx.frame(spark, "payloads"))


@query(f"""WITH {_OCR}, g AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, list_sort(list(y1 - y0)) AS hs, round_even(avg(confidence), 6) AS confidence, count(*)::BIGINT AS words FROM ocr GROUP BY ALL)
SELECT doc_id, page, line_no, text, x0, y0, x1, y1, round_even(hs[len(hs) // 2 + 1], 6) AS font_size, confidence, words FROM g""")
def ocr_word_grouping(spark, sf_dir):
    return B.ocr_lines(C.ocr_payload(fx.frame(spark, "payloads")))


@query()
def epub_package_stats(spark, sf_dir):
    books = epub.packages(B.chapters(_nodes(spark, sf_dir)))
    back = epub.read_back(books).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).cast("long").alias("chars"))
    return books.select("doc_id", F.length("epub").cast("long").alias("bytes")).join(back, "doc_id", "left")


def _jobs(spark, sf_dir):
    """Events as updates of jobs: a user's events are one job's, five kinds are five stages."""
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in (("view", "queued"), ("click", "extracting"), ("signup", "ocr"), ("purchase", "completed"), ("error", "failed")) for x in kv]), F.col("event_type"))
    return C.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), stage.alias("stage"), F.col("ts").alias("updated_at"), "event_id")


_JOBS = """jobs AS (SELECT user_id::VARCHAR AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'extracting' WHEN 'signup' THEN 'ocr' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS stage, ts AS updated_at, event_id FROM events),
latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) = 1)"""


@query(f"WITH {_JOBS} SELECT job_id, stage, event_id FROM latest")
def job_store_latest(spark, sf_dir):
    return B.latest_jobs(_jobs(spark, sf_dir)).drop("updated_at")


@query(f"""WITH {_JOBS} SELECT job_id, event_id, stage, CASE stage WHEN 'completed' THEN 100 WHEN 'failed' THEN 0 ELSE round_even(12.5::DOUBLE * (CASE stage WHEN 'queued' THEN 0 WHEN 'extracting' THEN 2 ELSE 3 END)
  + CASE WHEN stage IN ('extracting', 'ocr') THEN 12.5::DOUBLE * least((event_id % 50) / 40.0::DOUBLE, 1) ELSE 0 END, 6) END::DOUBLE AS percent FROM jobs""")
def percent_complete(spark, sf_dir):
    return _jobs(spark, sf_dir).select("job_id", "event_id", "stage", B.percent_complete(F.col("stage"), F.col("event_id") % 50, F.lit(40)).alias("percent"))


@query(f"""WITH {_JOBS}, q AS (SELECT job_id::BIGINT % 3 AS queue, job_id, stage, updated_at AS enqueued_at, event_id FROM latest)
SELECT queue, job_id, stage, event_id, CASE WHEN stage = 'queued' THEN row_number() OVER (PARTITION BY queue, stage = 'queued' ORDER BY enqueued_at, job_id) - 1 ELSE -1 END::BIGINT AS position FROM q""")
def queue_positions(spark, sf_dir):
    latest = B.latest_jobs(_jobs(spark, sf_dir)).select((F.col("job_id").cast("long") % 3).alias("queue"), "job_id", "stage", F.col("updated_at").alias("enqueued_at"), "event_id")
    return J.queue_positions(latest).drop("enqueued_at")


@query(f"WITH {_JOBS} SELECT job_id, stage, event_id, date_sub('second', updated_at, TIMESTAMP '2024-01-31 00:00:00')::BIGINT AS age_seconds FROM latest WHERE date_sub('second', updated_at, TIMESTAMP '2024-01-31 00:00:00') > 3600")
def ttl_expired(spark, sf_dir):
    return J.expired(B.latest_jobs(_jobs(spark, sf_dir)), datetime(2024, 1, 31), 3600).drop("updated_at")


@query(f"WITH {_JOBS}, f AS (SELECT DISTINCT job_id FROM jobs WHERE event_id % 5 = 0) SELECT coalesce(f.job_id, l.job_id) AS job_id, CASE WHEN f.job_id IS NULL THEN 'job' ELSE 'folder' END AS only FROM f FULL JOIN (SELECT job_id FROM latest WHERE stage <> 'failed') l ON l.job_id = f.job_id WHERE f.job_id IS NULL OR l.job_id IS NULL")
def storage_orphans(spark, sf_dir):
    """Folders named by some updates against the jobs that did not fail."""
    jobs = _jobs(spark, sf_dir)
    return J.orphans(jobs.where("event_id % 5 = 0").select("job_id").distinct(), B.latest_jobs(jobs).where("stage <> 'failed'"))


@query()
def sliding_window_limiter(spark, sf_dir):
    events = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return J.limiter(events, 2, 86400.0).drop("ts")


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS hour, event_type, count(*)::BIGINT AS events, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_per_hour(spark, sf_dir):
    counted = J.windowed_counts(C.table(spark, sf_dir, "events"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.bround("total", 4).alias("total"))
