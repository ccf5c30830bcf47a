"""Benchmark passages in documents, found with a budget of edits.

Items and texts are lower-cased and every run of characters other than letters and digits becomes one space. An
item of m characters may be matched with k edits (`edits`). Cut into k + 1 pieces, one piece at least must
occur unchanged (pigeonhole), so an automaton finds the exact hits of all pieces and only the windows around
them are compared, by the bit-parallel recurrence of Myers for the smallest distance of the item to any substring.
An item shorter than SHORT has no edits to spend: it must stand in the text as it is, between word borders.

Items are taken in blocks of bounded size: one block's pieces go to every worker, which keeps the automaton for its
next tasks, and all documents are scanned against it. Windows of one item that touch are joined, so a text costs at
most its own length for each item hit.

Defined cases: null and empty texts never match; null items and items without a letter or digit match nothing;
repeated items and documents, and items with a null id, are reported each; of equally near places the first ends the
span, and its longest start is taken; an empty table on either side gives an empty result; other columns are ignored
by `matches` and kept by `drop_leaky`. A text is normalised whole: about 10 bytes of memory a character.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy

#: Edits allowed, as a share of an item's characters.
BUDGET = 0.05
#: The fewest edits an item may have (one word changed for another), as long as its pieces keep so many characters.
LEAST_EDITS, LEAST_PIECE = 8, 10
#: Items of fewer normal characters are matched as they are.
SHORT = 20
#: Normal characters of the items that are matched in one pass over the documents.
BLOCK_CHARS = 4_000_000
_RUN = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, distance int, start long, stop long"


def normal(text: str | None) -> str:
    return _RUN.sub(" ", text.lower()).strip() if text else ""


def edits(m: int, budget: float = BUDGET) -> int:
    """Edits allowed for an item of m normal characters."""
    return 0 if m < SHORT else max(int(m * budget), min(LEAST_EDITS, m // LEAST_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of pattern to any substring of text (anchored: to any prefix), and the end of the first such."""
    m = len(pattern)
    mask, last = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up) & mask
        minus = up & horizontal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1 | anchored) & mask
        minus = minus << 1 & mask
        up = minus | ~(vertical | plus) & mask
        down = plus & vertical
        if score < best:
            best, end = score, j
    return best, end


_held: dict[str, object] = {}


def _scanner(name: str, items: list[tuple[int | None, str]], budget: float):
    """The scanner of a block of items; a worker keeps that of the last block it met."""
    if name not in _held:
        _held.clear()
        _held[name] = _built(items, budget)
    return _held[name]


def _built(items: list[tuple[int | None, str]], budget: float):
    import ahocorasick

    wanted = [(i, t, edits(len(t), budget)) for i, t in items]
    places: dict[str, list[tuple[int, int]]] = {}
    for n, (_, t, k) in enumerate(wanted):
        for offset, piece in pieces(t, k):
            places.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, at in places.items():
        automaton.add_word(piece, (len(piece), at))
    if places:
        automaton.make_automaton()

    def scan(text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, stop) of the best match of each item within budget, in normal characters."""
        windows: dict[int, list[list[int]]] = {}
        out = []
        for end, (length, at) in automaton.iter(text) if places and text else ():
            begin = end + 1 - length
            for n, offset in at:
                item, t, k = wanted[n]
                if len(t) < SHORT:
                    bordered = (begin == 0 or text[begin - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " ")
                    if bordered and n not in windows:
                        windows[n] = []
                        out.append((item, 0, begin, end + 1))
                    continue
                a, b = max(0, begin - offset - k), min(len(text), begin - offset + len(t) + k)
                mine = windows.setdefault(n, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(a, mine[-1][0]), max(b, mine[-1][1])
                else:
                    mine.append([a, b])
        for n, mine in windows.items():
            item, t, k = wanted[n]
            best = min(((*myers(t, text[a:b]), a) for a, b in mine), key=lambda x: x[0], default=None)
            if best and best[0] <= k:
                stop = best[2] + best[1]
                back = text[max(0, stop - len(t) - k) : stop][::-1]
                out.append((item, best[0], stop - myers(t[::-1], back, True)[1], stop))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))

    return scan


def blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[str, list[tuple[int | None, str]]]]:
    """Normal items in named lists of at most block_chars characters (or one item)."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if held and size + len(text) > block_chars:
            yield uuid.uuid4().hex, held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    if held:
        yield uuid.uuid4().hex, held


def matches(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and span (in normal characters) of every item found within budget in a document."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for name, block in blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], name=name, block=block) -> Iterator[pa.RecordBatch]:
            scan = _scanner(name, block, budget)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in scan(normal(t.as_py()))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "start", "stop"])

        found = found.unionByName(narrow.mapInArrow(tidy(run), SCHEMA))
    return found


def drop_leaky(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any item, with their columns; judged in place, so no text is shuffled."""
    out = docs
    for name, block in blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], name=name, block=block) -> Iterator[pa.RecordBatch]:
            scan = _scanner(name, block, budget)
            for batch in batches:
                clean = [not (t.as_py() and scan(normal(t.as_py()))) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out
