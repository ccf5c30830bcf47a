"""Pieces of the SQL that results are compared with: views of the tables, in the other engine's dialect."""

from __future__ import annotations

from ..functions import text as T
from ..sources.corpus import BLOCK_TAGS

LETTER, WORD = T.LETTER, T.WORD


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def dialect(pattern: str) -> str:
    """A pattern in the other engine's words: its case folding is Unicode's by itself, and it has no look-ahead."""
    return pattern.replace("(?iu)", "(?i)").replace(r"(?![\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)")


def count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {q(dialect(pattern))}))::BIGINT"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(dialect(pattern))})"


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def fold(column: str) -> str:
    return f"lower(translate({column}, 'İI', 'iı'))"


LINES = """lines AS (
  SELECT doc_id, source, lang, len(parts)::BIGINT AS n, unnest(range(len(parts)))::BIGINT AS i, unnest(parts) AS line
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents))"""

DOCUMENT_NODES = f"""{LINES}, nodes AS (
  SELECT doc_id AS book, i AS seq, 'p' AS tag, {squeezed('line')} AS text FROM lines WHERE {squeezed('line')} <> '')"""


def _unescaped(column: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        column = f"replace({column}, {q(entity)}, {q(char)})"
    return column


HTML_NODES = f"""html_pieces AS (
  SELECT page_id, unnest(range(len(parts)))::BIGINT AS seq, unnest(parts) AS piece
  FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)<(/?(?:{BLOCK_TAGS})\\b[^>]*)>', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM pages)),
html_nodes AS (
  SELECT page_id, seq, lower(regexp_extract(piece, '^(/?[A-Za-z0-9]+)', 1)) AS tag,
    {squeezed(_unescaped("regexp_replace(substr(piece, strpos(piece, chr(2)) + 1), '<[^>]*>', ' ', 'g')"))} AS text
  FROM html_pieces WHERE contains(piece, chr(2))),
html_enclosed AS (
  SELECT *, coalesce(sum(CASE WHEN tag IN ('nav', 'aside', 'table', 'li') THEN 1 WHEN tag IN ('/nav', '/aside', '/table', '/li') THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS enclosed FROM html_nodes),
book_nodes AS (
  SELECT page_id, seq, tag, text FROM html_enclosed WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'p', 'li') AND NOT enclosed AND text <> '')"""

PAGE_NODES = f"{HTML_NODES}, nodes AS (SELECT page_id AS book, seq, tag, text FROM book_nodes)"


def blocks_by_document(two_columns: bool = False) -> str:
    if two_columns:
        x0, x1, col = "72.0::DOUBLE + 260.0::DOUBLE * (i % 2)", "72.0::DOUBLE + 260.0::DOUBLE * (i % 2) + least(5.0::DOUBLE * length(line), 200.0::DOUBLE)", "(i % 2)::BIGINT"
    else:
        x0, x1, col = "72.0::DOUBLE", "72.0::DOUBLE + 5.0::DOUBLE * least(length(line), 90)", "0::BIGINT"
    return f"""{LINES}, blocks AS (
  SELECT doc_id, i, n, line AS text, (i // 40 + 1)::BIGINT AS page, {col} AS col, {x0} AS x0, {x1} AS x1,
    72.0::DOUBLE + 14.0::DOUBLE * (i % 40) AS y0, 82.0::DOUBLE + 14.0::DOUBLE * (i % 40) AS y1,
    CASE WHEN i % 40 = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size FROM lines)"""


BLOCKS_BY_SOURCE = f"""{LINES}, paged AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS page FROM (SELECT DISTINCT source, doc_id FROM documents)),
blocks AS (
  SELECT source AS book, page, doc_id, i, n, line AS text, 72.0::DOUBLE AS x0, 72.0::DOUBLE + 5.0::DOUBLE * least(length(line), 90) AS x1,
    842.0::DOUBLE * i / n AS y0, 842.0::DOUBLE * (i + 1) / n AS y1,
    CASE WHEN i = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size FROM lines JOIN paged USING (source, doc_id))"""

VOCABULARY = f"""vocab AS (
  SELECT doc_id, {fold('w')} AS word, count(*)::BIGINT AS freq
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(LETTER + '+')})) AS w FROM documents) GROUP BY ALL)"""

HEAD_KEY = f"""CASE WHEN length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) >= 4 THEN regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')
  ELSE lower(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[0-9]+', '#', 'g')) END"""


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A view of literal rows."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return q(v) if isinstance(v, str) else f"{v}::{'DOUBLE' if isinstance(v, float) else 'BIGINT'}"

    quoted = ", ".join(f'"{c}"' for c in columns.split(", "))
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({quoted}))"
