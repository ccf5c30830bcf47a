"""Exact self-join of documents by the Jaccard similarity of their word shingles, and the groups it links.

1.  Every text becomes a sorted array of 64-bit shingle hashes. Equal sets are one class, named by 64 bits of the set's
    hash. The same pass makes the class's bitmap and fills hashed counters of all shingles: a sketch of document
    frequency of a fixed size that only orders them.
2.  Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each, in any common order;
    rare shingles come first. These prefixes are dealt out by shingle; a shingle of one class alone is dropped.
3.  Tiles are a shingle and a size band. First every class is paired with the most central class of its tiles alone,
    which settles groups of near copies with one pair for each member; then pairs are formed within a tile and with the
    tile of the next band (sets that link never lie further apart), less those in one group already and those whose
    sizes or prefix places rule a link out. A tile with many rows is a grid of cells of at most CELL_ROWS by CELL_ROWS.
4.  Pairs are tested by hashed bitmaps of a width that suits their size: common bits plus the fewer collisions bound
    the overlap from above. What passes is decided by the intersection of the sorted arrays.
5.  Linked classes are joined to groups by alternating star contractions.

Texts never move: each pass hashes them where they are, and what is shuffled are sizes, prefixes, bitmaps and the arrays of
those classes that passed the bitmaps (picked by a Bloom filter of bounded size before the exact join).

Defined cases: null texts and texts without words have empty sets and link with nothing; texts of fewer than five words
have one shingle; repeated rows are copies, also those without a doc_id, which count for no component_id; rows that share
a doc_id but not their set are documents of their own; ties in frequency go by hash; an empty table gives an empty result;
other columns are ignored. A text's arrays take about 60 bytes of memory a byte while it is hashed. Two different sets
share a name with probability 2**-64 a pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, keep, spare, tidy

WORDS = 5
#: Jaccard threshold as a fraction.
PART, WHOLE = 75, 100
#: Hashed frequency counters, a power of two, and the parts they are summed in.
COUNTERS, COUNTER_PARTS = 1 << 20, 64
#: Rows of prefixes in one task; a shingle with more rows above the mean is dealt to several tasks.
TASK_ROWS = 500_000
EMITTED_ROWS = 200_000
HOT_ROWS = 50_000
#: Rows of a tile that meet in one task on each side.
CELL_ROWS = 2_000
#: Classes of copies that one task remembers, so that a group of copies sends its prefix once a task.
REMEMBERED = 100_000
#: Bits of the Bloom filter that picks candidates: 16 a candidate, up to this many.
BLOOM_BITS = 1 << 27
#: Removed rows that are sent to all tasks; more are joined by shuffle, behind the Bloom filter.
SENT_ROWS = 2_000_000
#: Bytes of text that are hashed together.
GROUP_BYTES = 1_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A random 64-bit value for each byte (upper case as lower case), and the base of the polynomial over a word's bytes.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _FACTORS[0])[_LOWER]
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; the table of longer texts is not kept."""
    return _table(n) if n <= 1 << 22 else _table.__wrapped__(n)


@functools.lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes of several texts, and where each text's words begin. rows: byte offsets."""
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    borders = rows[(rows > 0) & (rows < len(data))]
    begin[borders] = solid[borders]
    end[borders - 1] = solid[borders - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    upto = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=upto[1:])
    return _mixed((upto[e + 1] - upto[s]) * down[s]), np.searchsorted(s, rows)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column; empty for nulls."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    group = (offsets[:-1] - offsets[0]) // GROUP_BYTES
    cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)] if len(group) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = offsets[a : b + 1] - offsets[a]
        h, words = _word_hashes(data[offsets[a] : offsets[b]], rows)
        n = max(0, len(h) - WORDS + 1)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(WORDS):
            total += h[i : i + n] * _FACTORS[i]
        total = _mixed(total)
        for lo, hi in zip(words[:-1], words[1:], strict=True):
            if hi - lo >= WORDS:
                yield np.unique(total[lo : hi - WORDS + 1])
            elif hi > lo:
                yield _mixed((h[lo:hi] * _FACTORS[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
            else:
                yield total[:0]


def prefix_size(n: int) -> int:
    return n - -(-n * PART // WHOLE) + 1


def band(n):
    """Size band: sets that link lie in the same or in neighbouring bands."""
    return np.floor(np.log(n) / math.log(WHOLE / PART)).astype(np.int64)


def _batches(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def class_of(s: np.ndarray) -> int | None:
    """The name of a set's class."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def bitmap(s: np.ndarray) -> bytes:
    """A bitmap with two bits a shingle at least."""
    width = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def summaries(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, t, n, cid, x) and, with a part number, of summed frequency counters.

    t is a hash of the text itself, n the size of its set, cid its class, x the bitmap, which one row a class and task has.
    """
    kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()], ["doc_id", "t", "n", "cid", "x", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int32)
        seen, known = False, set()
        for batch in batches:
            sizes, classes, maps = [], [], []
            for s in shingle_sets(batch.column("text")):
                c = class_of(s)
                sizes.append(len(s))
                classes.append(c)
                maps.append(bitmap(s) if c is not None and c not in known else None)
                if c is not None and len(known) < REMEMBERED:
                    known.add(c)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                seen = seen or len(s) > 0
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *(pa.array(c, k) for c, k in zip((sizes, classes, maps, none, none), kinds[2:], strict=True))], names)
        if seen:
            pieces = [x.tobytes() for x in np.split(counts, COUNTER_PARTS)]
            none = [None] * COUNTER_PARTS
            yield _batches([none, none, none, none, none, list(range(COUNTER_PARTS)), pieces], kinds, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(tidy(run), "doc_id long, t long, n long, cid long, x binary, part int, counts binary")


def frequencies(summary: DataFrame) -> np.ndarray:
    """The hashed counters summed over all tasks: a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.int32).astype(np.int64)
                held[part] = held[part] + x if part in held else x
        yield _batches([list(held), [x.tobytes() for x in held.values()]], [pa.int32(), pa.binary()], ["part", "counts"])

    total = np.zeros(COUNTERS, dtype=np.int64).reshape(COUNTER_PARTS, -1)
    parts = summary.where("part is not null").select("part", "counts").repartition(COUNTER_PARTS, "part")
    for r in parts.mapInArrow(tidy(run), "part int, counts binary").collect():
        total[r["part"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return total.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, salt, parts, id, n, pos) for the prefix of each class's set, rare shingles first; once a class and task."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    mean = float(counts.mean())
    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()], ["token", "salt", "parts", "id", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, known = sent.value, set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            rows = 0
            for s in shingle_sets(batch.column("text")):
                c = class_of(s)
                if c is None or c in known:
                    continue
                if len(known) < REMEMBERED:
                    known.add(c)
                rarity = df[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort(rarity, kind="stable")[: prefix_size(len(s))]  # ties in order of the hash
                parts = np.maximum(1, np.ceil((rarity[order] - mean) / HOT_ROWS)).astype(np.int32)
                k = len(order)
                for column, x in zip(out, (s[order].view(np.int64), (np.int64(c) % parts).astype(np.int32), parts, np.full(k, c), np.full(k, len(s), dtype=np.int32), np.arange(k, dtype=np.int32)), strict=True):
                    column.append(x)
                rows += k
                if rows >= EMITTED_ROWS:
                    yield _batches([np.concatenate(c) for c in out], kinds, names)
                    out, rows = [[] for _ in names], 0
            if rows:
                yield _batches([np.concatenate(c) for c in out], kinds, names)

    return docs.select("text").mapInArrow(tidy(run), "token long, salt int, parts int, id long, n int, pos int")


def shared(rows: DataFrame, tasks: int) -> DataFrame:
    """The prefix rows whose shingle another class has too, with their size band (split shingles: all rows)."""
    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], ["token", "salt", "parts", "id", "n", "pos", "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        columns = [t.column(c).to_numpy() for c in names[:-1]]
        token, ids = columns[0], columns[3]
        order = np.lexsort((ids, token))
        token, ids = token[order], ids[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])]
        columns = [x[order][fresh] for x in columns]
        token = columns[0]
        same = token[1:] == token[:-1]
        several = np.r_[same, False] | np.r_[False, same] | (columns[2] > 1)
        columns = [x[several] for x in columns]
        for a in range(0, len(columns[0]), 100_000):
            part = [x[a : a + 100_000] for x in columns]
            yield _batches([*part, band(part[4])], kinds, names)

    return rows.repartition(tasks, "token", "salt").mapInArrow(tidy(run), "token long, salt int, parts int, id long, n int, pos int, band long")


def _salted(tokens: DataFrame) -> DataFrame:
    """One row for each part that a shingle's rows were dealt to, to meet them part by part."""
    return tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def central_pairs(tiles: DataFrame) -> DataFrame:
    """Each class with the class that is central in most of its tiles: the one with the fewest rarer shingles."""
    centre = tiles.groupBy("token", "band").agg(F.min(F.struct("pos", "id")).alias("c"), F.count("*").alias("m"), F.max("parts").alias("parts")).where("m > 1")
    centre = _salted(centre.select("token", "band", "parts", F.col("c.id").alias("centre")))
    votes = tiles.join(centre, ["token", "band", "salt"]).where("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "centre")).alias("b"))
    pair = best.select("id", F.col("b.centre").alias("centre"))
    return pair.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def open_pairs(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of a tile, or of it and the next band's, that may reach the threshold by size and place and are in
    different groups. Each row goes to one line and each partner to one column of its tile's grid of cells."""
    known = tiles.join(groups.withColumnRenamed("node", "id"), "id", "left").select("token", "salt", "parts", "band", "id", "n", "pos", F.coalesce("root", "id").alias("g"))
    mixed = known.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("m"), F.max("parts").alias("parts")).where("lo <> hi")
    mixed = _salted(mixed.select("token", "parts", F.ceil(F.col("m") / CELL_ROWS).cast("int").alias("cells")))
    rows = keep(known.join(mixed, ["token", "salt"]).select("token", "band", "id", "n", "pos", "g", "cells", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("own")), "tiles")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    x = rows.select("token", F.col("band").alias("tile"), F.col("own").alias("line"), every.alias("place"), *[F.col(c).alias(f"x{c}") for c in ("id", "n", "pos", "g")])
    y = rows.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("tile"), F.col("own").alias("place"), "cells", "band", "id", "n", "pos", "g")
    y = y.select("token", "tile", every.alias("line"), "place", F.col("band").alias("yband"), *[F.col(c).alias(f"y{c}") for c in ("id", "n", "pos", "g")])
    both = x.join(y, ["token", "tile", "line", "place"])
    need = F.ceil((F.col("xn") + F.col("yn")) * PART / (PART + WHOLE))
    most = 1 + F.least(F.col("xn") - F.col("xpos") - 1, F.col("yn") - F.col("ypos") - 1)
    once = (F.col("yband") < F.col("tile")) | (F.col("xid") < F.col("yid"))
    sized = (F.least("xn", "yn") * WHOLE >= F.greatest("xn", "yn") * PART) & (most >= need)
    return both.where(once & (F.col("xg") != F.col("yg")) & sized).select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).distinct()


class Bloom:
    """A Bloom filter of 64-bit numbers with four probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
        for f in _FACTORS[:4]:
            yield (_mixed(x.view(np.uint64) * f + f) & np.uint64(size - 1)).astype(np.int64)

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for at in self.probes(x, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom(ids: DataFrame) -> Bloom:
    """A filter of a written table of one column of numbers: tasks fill one each, which are joined by or."""
    name = ids.columns[0]
    size = 1 << min(BLOOM_BITS.bit_length() - 1, max(16, (16 * ids.count()).bit_length()))
    pieces = 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for at in Bloom.probes(x, size):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little")
        if packed.any():
            yield _batches([list(range(pieces)), [p.tobytes() for p in np.split(packed, pieces)]], [pa.int32(), pa.binary()], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                held[part] = held[part] | x if part in held else x.copy()
        yield _batches([list(held), [x.tobytes() for x in held.values()]], [pa.int32(), pa.binary()], ["part", "bits"])

    filled = ids.select(F.col(name).cast("long")).where(f"`{name}` is not null").mapInArrow(tidy(fill), "part int, bits binary")
    total = np.zeros((pieces, size // 8 // pieces), dtype=np.uint8)
    for r in filled.repartition(pieces, "part").mapInArrow(tidy(merge), "part int, bits binary").collect():
        total[r["part"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return Bloom(total.reshape(-1))


def arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, x): the sorted array of each class of a written table of ids, and of a few others; once a class and task."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids).bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = Bloom(sent.value), set()
        for batch in batches:
            names, sets = [], []
            for s in shingle_sets(batch.column("text")):
                c = class_of(s)
                if c is not None and c not in known and wanted.may_hold(np.array([c]))[0]:
                    names.append(c)
                    sets.append(s.tobytes())
                    if len(known) < REMEMBERED:
                        known.add(c)
            yield _batches([names, sets], [pa.int64(), pa.binary()], ["id", "x"])

    return docs.select("text").mapInArrow(tidy(run), "id long, x binary").join(ids, "id", "left_semi").groupBy("id").agg(F.first("x").alias("x"))


def overlap_bound(na: int, bits_a: bytes, nb: int, bits_b: bytes) -> int:
    """An upper bound of the number of common shingles."""
    x, y, wx, wy = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little"), 8 * len(bits_a), 8 * len(bits_b)
    while wx > wy:
        wx //= 2
        x = x >> wx | x & (1 << wx) - 1
    while wy > wx:
        wy //= 2
        y = y >> wy | y & (1 << wy) - 1
    return (x & y).bit_count() + min(na - x.bit_count(), nb - y.bit_count())


def links(pairs: DataFrame, maps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold; only the sets of pairs that pass the bitmaps are made again."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            ok = [(WHOLE + PART) * overlap_bound(n, x.as_py(), m, y.as_py()) >= PART * (n + m) for n, x, m, y in zip(na, batch.column("xa"), nb, batch.column("xb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(WHOLE * common >= PART * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(some: DataFrame, held: DataFrame) -> DataFrame:
        a, b = (held.select(*[F.col(c).alias(side if c == "id" else f"{c}{side}") for c in held.columns]) for side in "ab")
        return some.join(a, "a").join(b, "b")

    passed = keep(beside(pairs, maps).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidy(possible), "a long, b long"), "pairs")
    ids = keep(passed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    sets = keep(arrays(docs, ids), "sets")
    found = keep(beside(passed, sets).select("a", "b", "xa", "xb").mapInArrow(tidy(certain), "a long, b long"), "links")
    forget(passed, ids, sets)
    return found


def _contracted(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v. The least neighbours of nodes with many edges
    are sent to all tasks."""

    def lowered(rows: DataFrame, least: DataFrame) -> DataFrame:
        hubs = least.where(F.col("d") > HOT_ROWS)  # at most 2 / HOT_ROWS of the edges
        if hubs.isEmpty():
            return rows.join(least, "u")
        hubs = F.broadcast(keep(hubs, "hubs"))
        return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least, "u"))

    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
    large = lowered(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    moved = lowered(large, lows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: the smallest node of its component, by large and small stars until
    nothing moves (about the logarithm of the longest path in rounds)."""
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark = None
    while before is None or before != mark:
        before, now = mark, keep(_contracted(edges), "edges")
        forget(edges)
        edges = now
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """A kept table of every row's doc_id, t, n, cid, its group (a class of the group), and component_id."""
    spark = docs.sparkSession
    summary = keep(summaries(docs), "shingle-summaries")
    rows = summary.where("part is null").select("doc_id", "t", "n", "cid")
    total = rows.where("n > 0").agg(F.sum(F.floor(F.col("n") * (WHOLE - PART) / WHOLE) + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_ROWS))
    texts = docs.where("text is not null").select("text")
    tiles = keep(shared(prefixes(texts, frequencies(summary)), tasks), "tiles")
    maps = keep(summary.where("x is not null").groupBy(F.col("cid").alias("id")).agg(F.first("n").alias("n"), F.first("x").alias("x")), "bitmaps")
    first = links(central_pairs(tiles), maps, texts)
    groups = components(first)
    second = links(open_pairs(tiles, groups), maps, texts)
    groups = components(first.union(second))
    forget(tiles, maps, first, second)
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    named = keep(classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("g"), "least"), "classes")
    # Only classes of an edge share a group; a root has no row of its own in groups.
    roots = groups.select(F.col("root").alias("g")).distinct()
    least = named.join(roots, "g", "left_semi").groupBy("g").agg(F.min("least").alias("first"))
    classes = named.join(least, "g", "left").select("cid", "g", F.coalesce("first", "least").alias("component_id"))
    done = keep(rows.join(classes, "cid", "left").select("doc_id", "t", "n", "cid", "g", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "components")
    forget(summary, named, groups)
    return done


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the group) of every row."""
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns: that with the smallest doc_id (null last), then the smallest text hash;
    of rows equal in both the one whose other columns hash lowest. Rows without words all stay, as they link with nothing."""
    rows = grouped(docs)
    keys = keep(rows.where("n > 0").groupBy("g", "doc_id", "t").agg(F.count("*").alias("times")), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    groups = keys.groupBy("g").agg(first, F.sum("times").alias("members")).where("members > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    i, t, row = spare(docs, "i", "t", "row")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none"))
    # Groups of over a thousandth of all rows, at most a thousand, are sent to all tasks; the others meet by shuffle.
    groups = keep(groups, "groups")
    total = keys.agg(F.sum("times")).first()[0] or 0
    large = F.broadcast(groups.where(F.col("members") * 1000 > total))
    met = keys.join(large, "g").unionByName(keys.join(large, "g", "left_anti").join(groups.where(F.col("members") * 1000 <= total), "g"))
    gone = keep(met.select(name.alias(i), F.col("t").alias(t), "times", stays.alias("stays")).where("not stays or times > 1"), "copies")
    forget(rows, keys, groups)
    keyed = docs.withColumn(i, name).withColumn(t, F.xxhash64("text"))
    out = _without(keyed, gone.select(i, t)).select(*docs.columns)
    several = gone.where("stays").select(i, t)
    if not several.isEmpty():  # equal rows were all left out above: one of each comes back
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        one = keyed.join(several, [i, t], "left_semi").groupBy(i, t).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.lit(0), *others)).alias(row))
        out = out.unionByName(one.select(f"{row}.*"))
    return out


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key, the columns of gone, is not in gone. Many keys are not sent to all tasks: rows that miss
    their Bloom filter stay where they are, and only the others meet the keys by shuffle."""
    if gone.count() <= SENT_ROWS:
        return keyed.join(F.broadcast(gone), gone.columns, "left_anti")
    (h,) = spare(keyed, "hash")
    hashed = F.xxhash64(*gone.columns)
    bits = keyed.sparkSession.sparkContext.broadcast(bloom(keep(gone.select(hashed.alias("id")), "keys")).bits)

    def held(x):
        import pandas as pd  # workers of the other passes do without it

        return pd.Series(Bloom(bits.value).may_hold(x.to_numpy()))

    may = F.pandas_udf(held, "boolean", F.PandasUDFType.SCALAR)
    told = keyed.withColumn(h, may(hashed))
    return told.where(~F.col(h)).drop(h).unionByName(told.where(h).drop(h).join(gone, gone.columns, "left_anti"))
