"""Audit, vocabulary and repair queries over documents and pages, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import flow, repair
from ..operators import layout as L
from ..operators import structure as X
from ..sources import corpus as C
from . import fixtures as fx
from . import sql as S

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


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


_LONE = f"len(list_filter(string_split(text, ' '), lambda t: regexp_matches(trim(t, {S.q(T.EDGE_MARKS)}), '^\\p{{Ll}}$') AND trim(t, {S.q(T.EDGE_MARKS)}) NOT IN ({', '.join(map(S.q, T.LETTER_WORDS))})))::BIGINT"
_COST = " + ".join(f"{w} * {k}" for k, w in A.WEIGHTS.items())


def _audit_sql(nodes: str, tail: str = "SELECT * FROM audited", key: str = "book") -> str:
    one = lambda c: f"CASE WHEN NOT heading AND ({c}) THEN 1 ELSE 0 END"
    some = lambda p: f"CASE WHEN heading THEN 0 ELSE {S.count('text', p)} END"
    folio, lower = S.has("text", T.FOLIO), S.has("text", r"^\p{Ll}")
    return f"""WITH {nodes},
seen AS (SELECT *, left(tag, 1) = 'h' AS heading, lag(CASE WHEN tag = 'p' THEN text END) OVER (PARTITION BY book, seq // 1000000 ORDER BY seq) AS before,
  length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(replace(text, ' ', '')) AS solid FROM nodes),
marked AS (SELECT book, text, heading, {S.count('text', T.WORD)} AS words,
  {one(f"before IS NOT NULL AND {lower} AND NOT ends_with(before, ':')")} AS broken, {some(T.HYPHEN_BREAK)} AS hyphen,
  {one(f"NOT {folio} AND (letters <= 2 OR (length(text) <= 25 AND 2 * letters < solid))")} AS junk, {one(folio)} AS furniture,
  {some(T.OCR_WORD)} AS ocr, {some(T.GLUED)} AS glued, CASE WHEN heading THEN 0 ELSE {_LONE} END AS split, {some(T.BAD_CHARS)} AS chars,
  CASE WHEN heading AND ({folio} OR {lower} OR len(string_split(text, ' ')) > 20) THEN 1 ELSE 0 END AS headings FROM seen),
repeated AS (SELECT book, lower(text) AS line, count(*) AS n FROM marked WHERE NOT heading AND length(text) <= {A.LINE_MAX} GROUP BY ALL
  HAVING count(*) >= {A.REPEATED_LINE} AND length(lower(text)) >= {A.LINE_MIN} AND NOT {S.has('lower(text)', T.FOLIO)}),
extra AS (SELECT book, sum(n - 1) AS extra FROM repeated GROUP BY book),
sums AS (SELECT book, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('words', 'broken', 'hyphen', 'junk', 'ocr', 'glued', 'split', 'chars', 'headings'))},
  (sum(furniture) + coalesce(any_value(extra), 0))::BIGINT AS furniture, 0::BIGINT AS pictures FROM marked LEFT JOIN extra USING (book) GROUP BY book),
audited AS (SELECT *, ({_COST})::BIGINT AS cost, round_even(({_COST}) * 1000.0::DOUBLE / greatest(words, 1), 6) AS defect_index FROM sums)
{tail}"""


_RANKED = "SELECT *, rank() OVER (ORDER BY defect_index DESC)::BIGINT AS rank FROM audited"


@query(_audit_sql(S.DOCUMENT_NODES, _RANKED))
def audit_documents(spark, sf_dir):
    return A.ranked(A.audit(C.document_nodes(docs(spark, sf_dir))))


@query(_audit_sql(S.PAGE_NODES, _RANKED))
def audit_pages(spark, sf_dir):
    nodes = C.book_nodes(C.table(spark, sf_dir, "pages")).select(F.col("page_id").alias("book"), "seq", "tag", "text")
    return A.ranked(A.audit(nodes))


def _by_source(parity: int) -> str:
    return f"""{S.LINES}, nodes AS (SELECT source AS book, doc_id * 1000000 + i AS seq, 'p' AS tag, {S.squeezed('line')} AS text FROM lines
  WHERE {S.squeezed('line')} <> '' AND doc_id % 2 = {parity})"""


def _half(parity: int) -> str:
    return f"SELECT book, unnest([{', '.join(S.q(k) for k in A.WEIGHTS)}]) AS defect, unnest([{', '.join(A.WEIGHTS)}]) * 1000.0::DOUBLE / greatest(words, 1) AS v FROM ({_audit_sql(_by_source(parity))})"


@query(f"""SELECT n.book, n.defect, round_even(w.v, 6) AS was, round_even(n.v, 6) AS now, round_even(n.v, 6) > coalesce(round_even(w.v, 6), 0) AS worse
FROM ({_half(1)}) n LEFT JOIN ({_half(0)}) w USING (book, defect)""")
def audit_regression(spark, sf_dir):
    """Even documents of a source as the audit before, odd ones as the audit now. A document's first paragraph has none before it."""
    nodes = C.document_nodes(docs(spark, sf_dir), "source").select(F.col("source").alias("book"), "seq", "tag", "text", "before", (F.col("book") % 2).alias("half"))
    return A.regressions(A.audit(nodes.where("half = 0")), A.audit(nodes.where("half = 1")))


@query(f"WITH {S.VOCABULARY} SELECT doc_id, word, freq FROM vocab WHERE freq >= 8")
def vocabulary_canonical(spark, sf_dir):
    return repair.vocabulary(docs(spark, sf_dir)).where(F.col("freq") >= repair.CANONICAL)


@query(f"WITH {S.VOCABULARY} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word)::BIGINT AS rank FROM vocab) WHERE rank <= 5")
def vocabulary_top(spark, sf_dir):
    return repair.most_frequent(repair.vocabulary(docs(spark, sf_dir)), 5)


_KEY = f"lower(translate(word, {S.q(T.DIACRITICS[0])}, {S.q(T.DIACRITICS[1])}))"
_MARKS = lambda c: f"(length({c}) - length(translate({c}, {S.q(T.MARKED)}, '')))"


@query(f"""WITH {S.VOCABULARY}, keyed AS (SELECT *, {_KEY} AS key FROM vocab),
attested AS (SELECT doc_id, key, count(*) AS spellings, max({{'freq': freq, 'word': word}}) AS best FROM keyed WHERE freq >= 8 GROUP BY ALL)
SELECT doc_id, word, freq, best.word AS candidate, best.freq AS candidate_freq,
  CASE WHEN spellings > 1 THEN 'several spellings' WHEN {_MARKS('best.word')} <= {_MARKS('word')} THEN 'would lose a mark' WHEN freq > 1 THEN 'used more than once'
    WHEN best.freq < 100 * freq THEN 'not frequent enough' ELSE 'accepted' END AS decision
FROM keyed JOIN attested USING (doc_id, key) WHERE freq < 8 AND word <> best.word""")
def diacritic_candidates(spark, sf_dir):
    return repair.diacritic_candidates(repair.vocabulary(docs(spark, sf_dir)))


def _variants(seen: str, meant: str) -> str:
    return f"list_transform(list_filter(range(2, length(word) + 1), lambda p: substr(word, p, {len(seen)}) = '{seen}'), lambda p: substr(word, 1, p - 1) || '{meant}' || substr(word, p + {len(seen)}))"


@query(f"""WITH {S.VOCABULARY}, options AS (SELECT doc_id, word, freq, unnest(list_concat({', '.join(_variants(a, b) for a, b in repair.CONFUSIONS)})) AS candidate
  FROM vocab WHERE length(word) >= 6 AND freq <= 1 AND freq < 2)
SELECT o.doc_id, o.word, o.freq, max({{'f': v.freq, 'w': candidate}}).w AS candidate, max(v.freq)::BIGINT AS candidate_freq,
  round_even(least(0.99::DOUBLE, 0.80::DOUBLE + least(max(v.freq), 200) / 1000.0::DOUBLE), 6) AS confidence
FROM options o JOIN vocab v ON v.doc_id = o.doc_id AND v.word = o.candidate AND v.freq >= 2 GROUP BY ALL""")
def glyph_repair_candidates(spark, sf_dir):
    """With less evidence than a repair needs (twice instead of eight times), as the corpus holds no misread glyphs."""
    return repair.glyph_repairs(repair.vocabulary(docs(spark, sf_dir)), least=2, most=1)


_SPLITS = f"""{S.LINES}, {S.VOCABULARY},
near AS (SELECT doc_id, i, unnest(list_filter(list_transform(range(1, len(parts)), lambda k: {{'pos': k - 1, 'l': regexp_extract(parts[k], {S.q(f'({S.LETTER}+)$')}, 1), 'r': regexp_extract(parts[k + 1], {S.q(f'^({S.LETTER}+)')}, 1)}}),
  lambda x: x.l <> '' AND x.r <> '' AND least(length(x.l), length(x.r)) <= 2)) AS x FROM (SELECT doc_id, i, string_split(line, ' ') AS parts FROM lines)),
shaped AS (SELECT doc_id, i, x.pos::BIGINT AS pos, x.l AS left_word, x.r AS right_word, {S.fold('x.l || x.r')} AS joined FROM near),
pairs AS (SELECT * FROM shaped SEMI JOIN (SELECT doc_id, word AS joined FROM vocab WHERE freq >= 8) USING (doc_id, joined)),
judged AS (SELECT p.doc_id, p.i, p.pos, p.left_word, p.right_word, p.joined, j.freq AS joined_freq, coalesce(l.freq, 0) AS lf, coalesce(r.freq, 0) AS rf
  FROM pairs p JOIN vocab j ON j.doc_id = p.doc_id AND j.word = p.joined AND j.freq >= 8
  LEFT JOIN vocab l ON l.doc_id = p.doc_id AND l.word = {S.fold('p.left_word')} LEFT JOIN vocab r ON r.doc_id = p.doc_id AND r.word = {S.fold('p.right_word')}),
decided AS (SELECT doc_id, i, pos, left_word AS "left", right_word AS "right", joined, joined_freq,
  CASE WHEN (length(left_word) = 1 AND lf >= 100) OR (length(right_word) = 1 AND rf >= 100) THEN 'a common one-letter word' WHEN lf > 5 AND rf > 5 THEN 'both are words' ELSE 'accepted' END AS decision FROM judged),
sure AS (SELECT *, round_even(CASE WHEN decision = 'accepted' THEN least(0.97::DOUBLE, 0.78::DOUBLE + least(joined_freq, 200) / 1000.0::DOUBLE) ELSE 0.4::DOUBLE END, 6) AS confidence FROM decided)"""


@query(f"WITH {_SPLITS} SELECT * FROM sure")
def split_rejoin_candidates(spark, sf_dir):
    d = docs(spark, sf_dir)
    return repair.split_candidates(C.lines(d), repair.vocabulary(d))


@query(f"""WITH {_SPLITS}, fresh AS (SELECT *, CASE WHEN pos - lag(pos, 1, -2) OVER (PARTITION BY doc_id, i ORDER BY pos) > 1 THEN 1 ELSE 0 END AS f FROM sure WHERE decision = 'accepted'),
chained AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, i ORDER BY pos) AS chain FROM fresh),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i, chain ORDER BY pos) AS place FROM chained)
SELECT doc_id, i, pos, "left", "right", joined, joined_freq, decision, confidence FROM placed WHERE place % 2 = 1""")
def split_rejoin_applied(spark, sf_dir):
    return repair.split_applied(split_rejoin_candidates(spark, sf_dir))


_COLLAPSED = "line"
for _c in ",;:!?":
    _COLLAPSED = f"regexp_replace({_COLLAPSED}, '{'[?]' if _c == '?' else _c}{{2,}}', '{_c}', 'g')"


@query(f"WITH {S.LINES} SELECT doc_id, i, line AS original, {_COLLAPSED} AS corrected FROM lines WHERE line <> {_COLLAPSED}")
def hygiene_repeated_punct(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir))
    return rows.select("doc_id", "i", F.col("line").alias("original"), F.regexp_replace("line", r"([,;:!?])\1+", "$1").alias("corrected")).where("original <> corrected")


_GAPPED = f"regexp_replace(line, {S.q(f'([,;:])({S.LETTER})')}, '\\1 \\2', 'g')"


@query(f"WITH {S.LINES} SELECT doc_id, i, {_GAPPED} AS corrected FROM lines WHERE line <> {_GAPPED}")
def hygiene_missing_space(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir))
    return rows.select("doc_id", "i", "line", F.regexp_replace("line", rf"([,;:])(?={T.LETTER})", "$1 ").alias("corrected")).where("line <> corrected").drop("line")


_LIGATED = "line"
for _a, _b in T.LIGATURES:
    _LIGATED = f"replace({_LIGATED}, '{_a}', '{_b}')"


@query(f"WITH {S.LINES} SELECT doc_id, count(*)::BIGINT AS lines, sum(CASE WHEN line <> {_LIGATED} THEN 1 ELSE 0 END)::BIGINT AS changed, sum(length({_LIGATED}))::BIGINT AS chars FROM lines GROUP BY doc_id")
def hygiene_ligatures(spark, sf_dir):
    done = T.expand_ligatures(F.col("line"))
    return C.lines(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.when(F.col("line") != done, 1).otherwise(0)).cast("long").alias("changed"), F.sum(F.length(done)).cast("long").alias("chars"))


@query()
def hygiene_log(spark, sf_dir):
    return repair.hygiene_log(C.lines(docs(spark, sf_dir)))


@query()
def repair_log(spark, sf_dir):
    """Every change of hygiene, words and splits over all documents, and every refusal."""
    return repair.repaired(docs(spark, sf_dir))[1]


_MENDED = {(1, 1): "A Summary, of it, and more!", (1, 3): "Guzel GUZEL Özel summary", (1, 5): "gibi and Gibi", (1, 6): "", (1, 7): "fine “words", (2, 0): "summary sumrnary summary", (2, 1): "plain", (3, 0): ""}


@query(f"SELECT v.doc_id::BIGINT AS doc_id, v.i::BIGINT AS i, v.text FROM (VALUES {', '.join(f'({d}, {i}, {S.q(t)})' for (d, i), t in _MENDED.items())}) v(doc_id, i, text)")
def repaired_lines(spark, sf_dir):
    """Worn lines after all repairs; the SQL states the answers. The lines of evidence stay as they are and are left out."""
    return repair.repaired(fx.frame(spark, "worn_texts"))[0].where("length(text) < 40")


_READ = {(1, 1): ("BİL6İ5AYAR ÇA6I", "BİLGİSAYAR ÇAĞI", 2), (1, 2): ("(6EY)", "(ŞEY)", 1), (1, 3): ("A sh0ck, what sh0ck!", "A shock, what sh0ck!", 1), (1, 4): ("2041 AND 6", "2041 AND 6", 0), (1, 5): ("0000X", "0000X", 0), (1, 6): ("GELD!", "GELD!", 0), (1, 7): ("«AFTA", "«AFTA", 0), (1, 8): ("", "", 0), (2, 1): ("6EY", "6EY", 0)}


@query(f"SELECT v.doc_id::BIGINT AS doc_id, v.seq::BIGINT AS seq, v.text, v.corrected, v.words::BIGINT AS words FROM (VALUES {', '.join(f'({d}, {s}, {S.q(t)}, {S.q(c)}, {n})' for (d, s), (t, c, n) in _READ.items())}) v(doc_id, seq, text, corrected, words)")
def titles_reread(spark, sf_dir):
    """Titles in display type read again by the words of their document; the SQL states the answers."""
    return repair.reread_titles(fx.frame(spark, "display_titles"), repair.vocabulary(fx.frame(spark, "title_words")))


_KINDS = (("digit", rf"{S.LETTER}+[0-9]+{S.LETTER}+"), ("case", r"\p{Ll}+\p{Lu}+\p{Ll}*"), ("repeat", "|".join(f"{c * 4}+" for c in "abcdefghijklmnopqrstuvwxyz")))


@query(f"WITH {S.LINES} SELECT doc_id, i, kind, passage, count(*)::BIGINT AS times FROM (" + " UNION ALL ".join(f"SELECT doc_id, i, '{k}' AS kind, unnest(regexp_extract_all(line, {S.q(p)})) AS passage FROM lines" for k, p in _KINDS) + ") GROUP BY ALL")
def suspicious_passages(spark, sf_dir):
    return repair.suspicious(C.lines(docs(spark, sf_dir)))


@query(f"""WITH {S.LINES} SELECT DISTINCT doc_id, kind, {S.fold('w')} AS form FROM (
  SELECT doc_id, 'closed' AS kind, unnest(regexp_extract_all(line, {S.q(S.LETTER + '+')})) AS w FROM lines UNION ALL
  SELECT doc_id, 'hyphenated', unnest(regexp_extract_all(line, {S.q(S.LETTER + '+-' + S.LETTER + '+')})) FROM lines)""")
def hyphen_evidence_sets(spark, sf_dir):
    return repair.hyphen_evidence(C.lines(docs(spark, sf_dir)))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{Hebrew}\\p{Arabic}\\p{Syriac}\\p{Thaana}]'))::BIGINT AS rtl, (len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '[\\p{Hebrew}\\p{Arabic}\\p{Syriac}\\p{Thaana}]')))::BIGINT AS ltr, 'ltr' AS direction FROM documents")
def direction_by_document(spark, sf_dir):
    """All documents of the corpus read from the left; right-to-left ones are in the tests."""
    return L.direction(docs(spark, sf_dir))


@query("""WITH marked AS (SELECT *, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS side FROM conversations),
fresh AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY conv_id ORDER BY turn) = side THEN 0 ELSE 1 END AS f FROM marked),
runs AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM fresh)
SELECT conv_id, run::BIGINT AS run, any_value(side) AS side, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM runs GROUP BY ALL""")
def conversation_runs(spark, sf_dir):
    return flow.turn_runs(C.table(spark, sf_dir, "conversations"))


_ROLE = f"""CASE WHEN {S.has('t', T.PAGE_NUMBER)} THEN 'PAGE_NUMBER' WHEN {S.has('t', T.TOC_TITLE)} THEN 'TOC_TITLE' WHEN {S.has('t', T.LEADER_LINE)} THEN 'TOC_ENTRY'
  WHEN length(t) BETWEEN 3 AND 24 AND {S.has('t', r'^[*•·∙–—\-~=_.◆❖✦ ]+$')} THEN 'THEMATIC_BREAK' WHEN {S.has('t', T.BIBLIOGRAPHY_TITLE)} THEN 'BIBLIOGRAPHY_TITLE'
  WHEN {S.has('t', T.CAPTION)} THEN 'CAPTION' WHEN {S.has('t', T.BULLET)} OR {S.has('t', T.NUMBERED)} THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END"""


@query(f"""WITH {S.HTML_NODES}, roles AS (SELECT page_id, CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4') THEN 'HEADING' WHEN tag = 'li' THEN 'LIST_ITEM' WHEN tag IN ('footer', 'nav', 'div') THEN 'FURNITURE'
  WHEN tag = 'title' THEN 'METADATA' ELSE {_ROLE} END AS role, t FROM (SELECT *, text AS t FROM html_enclosed WHERE text <> '' AND tag IN ('title', 'h1', 'h2', 'h3', 'h4', 'p', 'li', 'div', 'footer')))
SELECT page_id, role, count(*)::BIGINT AS nodes, sum(length(t))::BIGINT AS chars FROM roles GROUP BY ALL""")
def roles_by_page_html(spark, sf_dir):
    nodes = C.html_nodes(C.table(spark, sf_dir, "pages")).where((F.col("text") != "") & F.col("tag").isin("title", "h1", "h2", "h3", "h4", "p", "li", "div", "footer"))
    return nodes.withColumn("role", X.role(F.col("text"), F.col("tag"))).groupBy("page_id", "role").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {S.LINES}, roles AS (SELECT doc_id, t, {_ROLE} AS role FROM (SELECT doc_id, {S.squeezed('line')} AS t FROM lines) WHERE t <> '')
SELECT doc_id, role, count(*)::BIGINT AS lines, sum(length(t))::BIGINT AS chars FROM roles GROUP BY ALL""")
def roles_by_document(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir)).withColumn("t", T.squeezed(F.col("line"))).where("t <> ''")
    return rows.withColumn("role", X.role(F.col("t"))).groupBy("doc_id", "role").agg(F.count("*").alias("lines"), F.sum(F.length("t")).cast("long").alias("chars"))


@query(f"""WITH {S.HTML_NODES}, titles AS (SELECT page_id AS book, min(text) AS title FROM html_enclosed WHERE tag = 'title' GROUP BY 1),
known AS (SELECT page_id AS book, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')))) AS known FROM book_nodes GROUP BY 1),
w AS (SELECT *, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS w FROM titles LEFT JOIN known USING (book)),
f AS (SELECT *, len(list_filter(w, lambda x: list_contains(known, x)))::BIGINT AS found FROM w)
SELECT book, title, len(w)::BIGINT AS words, coalesce(found, 0) AS found, (NOT regexp_matches(lower(title), '^(untitled|document|microsoft word|scan|img_|title)') AND length(title) >= 4 AND len(w) > 0 AND coalesce(found, 0) * 10 >= len(w) * 6) AS plausible FROM f""")
def title_plausibility(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    titles = C.html_nodes(pages).where("tag = 'title'").groupBy(F.col("page_id").alias("book")).agg(F.min("text").alias("title"))
    return X.plausible_titles(titles, C.book_nodes(pages).select(F.col("page_id").alias("book"), "text"))


_MINUTES = "(CASE WHEN strpos(url, '?') > 0 THEN left(url, strpos(url, '?') - 1) ELSE url END)"


@query(f"WITH {S.LINES} SELECT doc_id, i, round_even(score, 6) AS score FROM (SELECT doc_id, i, (CASE WHEN solid = 0 THEN 0 WHEN share >= 0.30 THEN 0.55 WHEN share >= 0.12 THEN 0.35 WHEN share > 0 THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(line, '\\([0-9]{{1,3}}(?:\\.[0-9]{{1,3}})?\\)\\s*$') THEN 0.25 ELSE 0 END + CASE WHEN share > 0 AND nw <= 12 THEN 0.10 ELSE 0 END)::DOUBLE AS score, nw, w3 FROM (SELECT *, CASE WHEN solid > 0 THEN marks / solid ELSE 0.0::DOUBLE END AS share FROM (SELECT doc_id, i, line, length(regexp_replace(line, '\\s', '', 'g'))::DOUBLE AS solid, (length(line) - length(translate(line, '=+−×÷±≤≥≠≈∑∏∫√∞∂∇∈∉⊂⊃∪∩∀∃→⇒⇔αβγδεζηθλμπρστφχψωΓΔΘΛΠΣΦΨΩ^½¼¾²³', ''))) AS marks, len(string_split({S.squeezed('line')}, ' ')) AS nw, len(regexp_extract_all(line, {S.q(S.LETTER + '{3,}')})) AS w3 FROM lines))) WHERE NOT (nw >= 15 AND w3 >= 0.6 * nw) AND score > 0")
def formula_scores(spark, sf_dir):
    rows = C.lines(docs(spark, sf_dir)).select("doc_id", "i", X.formula_score(F.col("line")).alias("score"))
    return rows.where("score > 0")


_TOLD = {1: "division", 2: "division", 3: "division", 4: "contents", 5: "contents", 6: "bibliography", 7: "caption", 8: "caption", 9: "caption", 10: "bibliography", 12: "division,numbered", 14: "bibliography", 16: "division"}


@query(f"SELECT v.id::BIGINT AS id, v.told FROM (VALUES {', '.join(f'({i}, {S.q(_TOLD.get(i, str()))})' for i in range(1, 18))}) v(id, told)")
def titles_in_capitals(spark, sf_dir):
    """What divisions, contents, lists of sources and captions look like in capitals of several languages; the SQL states the answers."""
    tests = {"division": T.DIVISION_WORD, "contents": T.TOC_TITLE, "bibliography": T.BIBLIOGRAPHY_TITLE, "caption": T.CAPTION, "numbered": T.NUMBERED_TITLE}
    told = F.array_compact(F.array(*[F.when(T.squeezed(F.col("text")).rlike(p) & (F.lit(k != "numbered") | F.col("text").rlike(T.DIVISION_WORD)), F.lit(k)) for k, p in tests.items()]))
    return fx.frame(spark, "shouted").select("id", F.array_join(told, ",").alias("told"))


@query(f"""WITH {fx.view('page_images')} SELECT book, sum(coalesce(width * height > 600000 AND abs(width / height - page_aspect) < page_aspect * 0.04::DOUBLE AND NOT coalesce(cover, false), false)::INT)::BIGINT AS pictures FROM
  (SELECT book, width::DOUBLE AS width, height::DOUBLE AS height, page_aspect, cover FROM page_images) GROUP BY book""")
def page_pictures(spark, sf_dir):
    return A.page_pictures(fx.frame(spark, "page_images")).select("book", F.coalesce("pictures", F.lit(0)).alias("pictures"))
