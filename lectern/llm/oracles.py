"""SQL of the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import license_scan, ngram_join, quality_rules, sharding


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_R = quality_rules
_BUCKET = "(greatest(length(bin(v)) - 4, 0) * 8 + (v >> greatest(length(bin(v)) - 4, 0)))"
_FLOOR = "((b - greatest(b // 8 - 1, 0) * 8) << greatest(b // 8 - 1, 0))"
_EVENT = " ".join(f"WHEN {_q(k)} THEN ceil({e} / greatest({size}, 1))::BIGINT" for k, (e, size, _) in _R.RATIOS.items())
_TWO_SIDED = ", ".join(_q(k) for k, (*_, both) in _R.RATIOS.items() if both)

OP3 = f"""WITH w AS (SELECT doc_id, coalesce(lang, '{_R.NONE}') AS lang, coalesce(source, '{_R.NONE}') AS source, coalesce(text, '') AS body,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
pos AS (SELECT doc_id, i, ws[i + 1] AS a, ws[i + 2] AS b, ws[i + 3] AS c FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM pos) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(body, {_q(_R.SYMBOLS)}))::BIGINT AS n_symbols,
  len(regexp_extract_all(body, {_q(_R.MARKS)}))::BIGINT AS n_marks, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN 1000 * n_marks // n_words ELSE 0 END AS marks,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length FROM base),
long AS (SELECT doc_id, lang, source, base_failed, ratio, v, CASE ratio {_EVENT} END AS own FROM (SELECT *, unnest(['symbols', 'marks', 'dup_lines', 'word_length']) AS ratio, unnest([symbols, marks, dup_lines, word_length])::BIGINT AS v FROM judged)),
sk AS (SELECT lang, source, ratio, {_BUCKET} AS b, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
levels AS (SELECT lang, source, ratio, b, n FROM sk UNION ALL SELECT lang, '{_R.ALL}', ratio, b, sum(n) FROM sk GROUP BY ALL UNION ALL SELECT '{_R.ALL}', '{_R.ALL}', ratio, b, sum(n) FROM sk GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total FROM levels),
quart AS (SELECT lang, source, ratio, max(total) AS docs, {", ".join(f"min(CASE WHEN 20 * upto >= {k} * total THEN b END) AS b{k}" for k in (4, 5, 15, 16))} FROM run GROUP BY ALL),
q AS (SELECT *, b15 + 1 AS b99, {_FLOOR.replace('b ', 'b4 ')} AS p20, {_FLOOR.replace('b ', 'b5 ')} AS q1, {_FLOOR.replace('b ', 'b15 ')} AS q3, {_FLOOR.replace('b ', 'b16 ')} AS p80 FROM quart),
bounds AS (SELECT lang, source, ratio, docs, q1, q3, greatest(q3 - q1, (p80 - p20) * {_R.FIFTHS} // 1000, {_FLOOR.replace('b ', 'b99 ')} - q3)::BIGINT AS spread FROM q),
picked AS (SELECT o.lang, o.source, o.ratio, CASE WHEN o.docs >= {_R.GROUP_MIN} THEN o WHEN l.docs >= {_R.GROUP_MIN} THEN l ELSE g END AS f
  FROM bounds o LEFT JOIN bounds l ON l.lang = o.lang AND l.source = '{_R.ALL}' AND l.ratio = o.ratio LEFT JOIN bounds g ON g.lang = '{_R.ALL}' AND g.ratio = o.ratio WHERE o.source <> '{_R.ALL}'),
bad AS (SELECT DISTINCT doc_id FROM long JOIN picked USING (lang, source, ratio) WHERE v > f.q3 + {_R.FENCE} * greatest(f.spread, own) OR (ratio IN ({_TWO_SIDED}) AND v < f.q1 - {_R.FENCE} * greatest(f.spread, own)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM judged"""

_UP, _LOW = license_scan.UPPER, license_scan.LOWER
_RULES = ", ".join(f"({n}, {_q(' ' + k + ' ')}, {_q(label)}, {p}, {_q(r)})" for n, k, label, p, r in license_scan.signatures())
_SPACES = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
_BASES = " UNION ALL ".join(f"SELECT doc_id, {_q(label)} AS label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i : i + {len(phrase.split()) - 1}] = {phrase.split()!r})) - 1 AS start FROM w" for phrase, label in license_scan.BASE)
_WEIGHTS = " ".join(f"WHEN {p} THEN {x}::DOUBLE" for p, x in license_scan.WEIGHT.items())

OP6 = f"""WITH t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS flat FROM documents),
w AS (SELECT doc_id, CASE WHEN flat = '' THEN []::VARCHAR[] ELSE string_split(flat, ' ') END AS ws, ' ' || replace(flat, ' ', '  ') || ' ' AS wide FROM t),
base AS ({_BASES}), b AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word, list(DISTINCT label) AS bl FROM base GROUP BY doc_id),
rules(n, k, label, p, r) AS (VALUES {_RULES}),
hits AS (SELECT doc_id, n, label, p, regexp_extract_all(wide, r) AS h, string_split_regex(wide, r) AS g FROM w JOIN rules ON contains(wide, k)),
det AS (SELECT doc_id, n, label, p, list_sum(list_transform(g[1:j], lambda x: {_SPACES('x')})) + coalesce(list_sum(list_transform(h[1:j - 1], lambda x: {_SPACES('x')})), 0) AS s, {_SPACES('h[j]')} AS len FROM (SELECT *, unnest(range(1, len(h) + 1)) AS j FROM hits WHERE len(h) > 0)),
kept AS (SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM det e WHERE e.doc_id = d.doc_id AND e.s <= d.s AND e.s + e.len >= d.s + d.len AND e.p >= d.p AND (e.s <> d.s OR e.len <> d.len OR e.p > d.p OR e.n < d.n))),
k AS (SELECT doc_id, count(*)::BIGINT AS nd, max(p) AS top, list(DISTINCT label) AS kl FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(kl, [])))), ','), '') AS labels,
  CASE WHEN top IS NOT NULL THEN CASE top {_WEIGHTS} END WHEN bl IS NOT NULL THEN {license_scan.WEIGHT[1]}::DOUBLE ELSE 0.0::DOUBLE END AS score, coalesce(nd, 0) AS n_detections
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

_N = ngram_join.WORDS
OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {_N} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i + 1 : i + {_N}], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - {_N - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {ngram_join.WHOLE} * c >= {ngram_join.PART} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id))::BIGINT AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n"""

OP9 = f"""WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
s AS (SELECT doc_id, coalesce(text, '') AS body, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, md5(coalesce(text, '')) AS h FROM documents),
sums AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM s, crc),
g AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS whole, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM s),
w AS (SELECT *, min(start) OVER (PARTITION BY h) AS first FROM g),
cut AS (SELECT j, max(CASE WHEN 8 * first < j * total AND j * total < 8 * (first + whole) AND 2 * least(j * total - 8 * first, 8 * (first + whole) - j * total) <= {sharding.TOLERANCE} * total THEN CASE WHEN 8 * (first + whole) - j * total >= j * total - 8 * first THEN first ELSE first + whole END END) AS moved FROM w, range(1, 8) t(j) GROUP BY j),
k AS (SELECT w.doc_id, w.h, w.size, sum(CASE WHEN moved IS NOT NULL THEN start >= moved ELSE 8 * start >= j * total OR (8 * (start + size) > j * total AND 8 * (start + size) - j * total >= j * total - 8 * start) END::INT)::INT AS shard FROM w, cut GROUP BY w.doc_id, w.h, w.size)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id)::BIGINT - 1 AS slot, NULL::INT AS grown_shard FROM k JOIN sums USING (doc_id)"""

assert sharding.TEXT_DIGITS == 32
ORACLE_SQL = {"op3_quality_rules": OP3, "op6_license_scan": OP6, "op7_ngram_join": OP7, "op9_sharding": OP9}
