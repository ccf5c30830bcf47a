"""A fixed public piece vocabulary and the lattice of all segmentations of text chunks into its pieces.

Text is cut into chunks at word borders that no piece crosses, so a segmentation of a text is a free choice of one
segmentation for each chunk; parts are cut at every place that no piece crosses, and the same holds. A lattice holds many distinct chunks at once: its nodes are the positions of one
joined string, its edges the pieces found by walking a trie from all of them, and sums run over all chunks
together, one distance from the chunk's end (or start) at a time.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np

SPACE = "▁"
#: Stand-ins that no valid text holds, for a real U+2581 and for a line feed.
OWN_SPACE, OWN_BREAK = "\udc81", "\udc0a"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}{OWN_BREAK}]+|{SPACE}+|{OWN_BREAK}")
STOOD_FOR = {OWN_SPACE: SPACE, OWN_BREAK: "\n"}
#: Columns of the trie's dense table: the most frequent characters, and one for those in no piece; COMMON marks the rest.
COMMON = 128
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Pieces of a model file, their trie, and a Zipf log probability for each by its rank.

    A character without a piece of its own is one edge, spelled in byte pieces; its id in a lattice is `size` plus
    its code point.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        crossing = [self.pieces[i] for i in normal if SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i]]
        if crossing:
            raise ValueError(f"pieces cross chunk borders: {crossing[:5]}")
        weight = np.zeros(self.size)
        weight[normal] = 1.0 / (np.arange(len(normal)) + 2.7)
        weight[list(self.byte_of)] = weight[normal].min()
        with np.errstate(divide="ignore"):
            self.log_p = np.log(weight / weight.sum())
        self.byte_log_p = float(self.log_p[self.bytes[0]])
        self.line_break, self.spelled_break = self.size + ord(OWN_BREAK), self.bytes[ord("\n")]
        # A trie as sorted arrays: (node, code point) -> child, and the piece that ends in each node.
        nodes: dict[str, int] = {"": 0}
        for i in normal:
            for n in range(1, len(self.pieces[i]) + 1):
                nodes.setdefault(self.pieces[i][:n], len(nodes))
        inner = {p[:-1] for p in nodes if p}
        nodes = {p: k for k, p in enumerate(sorted(nodes, key=lambda p: p not in inner))}  # leaves last: they need no row
        keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p], dtype=np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_child = keys[order], (order + 1).astype(np.int64)
        self.trie_piece = np.full(len(nodes), -1, dtype=np.int64)
        self.trie_piece[[nodes[self.pieces[i]] for i in normal]] = normal
        # The most frequent characters step through a dense table; 0, the root, stands for no child.
        codes, times = np.unique(self.trie_keys & (1 << 21) - 1, return_counts=True)
        common = codes[np.argsort(-times, kind="stable")[: COMMON - 1]]
        self.column = np.full(0x110000, COMMON - 1, dtype=np.int16)
        self.column[codes] = COMMON
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((max(1, len(inner)), COMMON), dtype=np.int32)
        own = self.column[self.trie_keys & (1 << 21) - 1]
        self.dense[self.trie_keys[own < COMMON] >> 21, own[own < COMMON]] = self.trie_child[own < COMMON]
        # Neighbours within a piece: between any other two characters no piece crosses.
        pairs = sorted({ord(a) << 21 | ord(b) for i in normal for a, b in itertools.pairwise(self.pieces[i])})
        self.pair_keys = np.array(pairs or [-1], dtype=np.int64)
        self.joins = np.zeros((COMMON + 1, COMMON + 1), dtype=bool)
        self.joins[self.column[self.pair_keys >> 21], self.column[self.pair_keys & (1 << 21) - 1]] = True
        # The bytes of every piece, one after the other.
        spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_length = np.fromiter(map(len, spelled), dtype=np.int64, count=self.size)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.byte_pool = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def occurrences(self, code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece) of every piece at some places of code points, longer ones first: the trie walked from all of them together."""
        node = np.zeros(len(place), dtype=np.int64)
        columns, dense = self.column[code], self.dense.ravel()
        starts, stops, pieces = [], [], []
        depth = 0
        while len(place):
            inside = place + depth < len(code)
            place, node = place[inside], node[inside]
            column = columns[place + depth]
            rare = np.flatnonzero(column == COMMON)
            child = dense[node * COMMON + np.minimum(column, COMMON - 1)]
            if len(rare):
                key = node[rare] << 21 | code[place[rare] + depth]
                at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
                child[rare] = np.where(self.trie_keys[at] == key, self.trie_child[at], 0)
            found = np.flatnonzero(child)
            place, node, depth = place[found], child[found].astype(np.int64), depth + 1
            piece = self.trie_piece[node]
            ends = piece >= 0
            starts.append(place[ends])
            stops.append(place[ends] + depth)
            pieces.append(piece[ends])
            on = np.flatnonzero(node < len(self.dense))
            place, node = place[on], node[on]
        return tuple(np.concatenate(x[::-1]).astype(np.int32) for x in (starts, stops, pieces))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, with its spaces as U+2581 and a leading one. No text: none."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return CHUNK.findall(SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE).replace("\n", OWN_BREAK))
        # Single spaces only: the same chunks by plain splits.
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ") if i else ("", *line.split(" "))
            if i:
                out.append(OWN_BREAK)
            if first:
                out.append(first)
            out += [SPACE + w for w in rest]
        return out

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All texts cut, each with a leading space, wherever no piece crosses, and how many parts each has. No text: none.

        Finer than chunks(), so far fewer differ; parts hold plain spaces, and OWN_BREAK for a line feed.
        """
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        lengths += lengths > 0
        code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
        if not len(code):
            return [], lengths
        code[code == ord("\n")] = ord(OWN_BREAK)
        known = code.copy()
        known[code == ord(SPACE)] = ord(OWN_SPACE)
        known[code == ord(" ")] = ord(SPACE)
        column = self.column[known]
        cut = np.ones(len(code) + 1, dtype=bool)
        cut[1:-1] = ~self.joins.ravel()[column[:-1] * np.int16(COMMON + 1) + column[1:]]
        unsure = np.flatnonzero(~cut[1:-1] & ((column[:-1] == COMMON) | (column[1:] == COMMON)))
        if len(unsure):
            pair = known[unsure].astype(np.int64) << 21 | known[unsure + 1]
            at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            cut[unsure + 1] = self.pair_keys[at] != pair
        begin = np.cumsum(lengths) - lengths
        cut[begin] = True
        before = np.cumsum(cut[:-1])
        marked = np.full(len(code) + int(before[-1]) - 1, ord("\n"), dtype=np.int32)
        marked[np.arange(-1, len(code) - 1) + before] = code
        until = np.r_[0, before][begin + lengths]
        return marked.tobytes().decode("utf-32-le", "surrogatepass").split("\n"), np.diff(until, prepend=0)

    def spell(self, ids) -> list[int]:
        """Lattice ids as piece ids: characters without a piece become byte pieces."""
        out: list[int] = []
        for i in ids:
            if i < self.size:
                out.append(int(i))
            else:
                c = chr(i - self.size)
                out.extend(self.bytes[b] for b in STOOD_FOR.get(c, c).encode())
        return out

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of piece ids, all at once."""
        n = self.byte_length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.byte_pool[np.repeat(self.byte_start[ids] - (ends - n), n) + np.arange(total)]

    def decode(self, ids) -> str:
        """The text of piece ids; inverse of any segmentation of chunks(text)."""
        raw = bytearray()
        for i in ids:
            raw += bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(SPACE, " ").encode()
        text = raw.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Edges:
    """The pieces that begin at some places of a text, longer ones first; arrays start, stop, piece."""

    def __init__(self, vocab: Vocabulary, joined: str, places: np.ndarray):
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start, stop, piece = vocab.occurrences(code, places)
        alone = np.zeros(len(joined), dtype=bool)
        alone[places] = True
        alone[start[stop == start + 1]] = False
        extra = np.flatnonzero(alone)
        width = np.fromiter((len(STOOD_FOR.get(joined[i], joined[i]).encode()) for i in extra), dtype=np.int64, count=len(extra))
        self.start = np.concatenate([start, extra.astype(np.int32)])
        self.stop = np.concatenate([stop, extra.astype(np.int32) + 1])
        self.piece = np.concatenate([piece, (code[extra] + vocab.size).astype(np.int32)])
        self.spelled = np.concatenate([np.zeros(len(start), dtype=np.int8), width.astype(np.int8)])  # byte pieces of an edge
        self.vocab = vocab

    def weights(self, log_p: np.ndarray, byte_log_p) -> np.ndarray:
        """Log weight of every edge under log_p, by piece (and language in a second axis)."""
        known = self.piece < self.vocab.size
        out = log_p[np.where(known, self.piece, 0)]
        out[~known] = self.spelled[~known, None] * byte_log_p if log_p.ndim > 1 else self.spelled[~known] * byte_log_p
        return out


def add_up(total: np.ndarray, weight: np.ndarray, into: np.ndarray, out_of: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set the log sum of each node in `into` over its edges, from the nodes in `out_of`, whose sums come first by level.

    Also the order of edges in which those that meet in a node stand together, and where each such run begins.
    """
    bits = max(1, len(into).bit_length(), len(total).bit_length())
    if 2 * bits + (int(level.max()).bit_length() if len(level) else 0) <= 63:  # all three in one number: a plain sort
        order = (level.astype(np.int64) << 2 * bits) | (into.astype(np.int64) << bits) | np.arange(len(level))
        order.sort()
        order &= (1 << bits) - 1
    else:
        order = np.lexsort((into, level))
    node = into[order]
    runs = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=np.int64)
    at = level[order[runs]] if len(node) else runs
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else runs
    ends = np.r_[runs[1:], len(node)]
    for a, b in zip(cuts, np.r_[cuts[1:], len(runs)], strict=True):
        lo, hi = runs[a], ends[b - 1]
        e = order[lo:hi]
        value = weight[e] + total[out_of[e]]
        seg = runs[a:b] - lo
        top = np.maximum.reduceat(value, seg, axis=0)
        top = np.where(np.isfinite(top), top, 0.0)
        lifted = np.exp(value - np.repeat(top, np.diff(np.r_[seg, hi - lo]), axis=0))
        with np.errstate(divide="ignore"):
            total[node[runs[a:b]]] = top + np.log(np.add.reduceat(lifted, seg, axis=0))
    return order, runs


class Lattice(Edges):
    """All segmentations of distinct chunks: their edges, and arrays of chunks: first, last node."""

    def __init__(self, vocab: Vocabulary, chunks: list[str]):
        joined = "\n".join(chunks) + "\n"
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.last = np.cumsum(lengths + 1) - 1
        self.first = self.last - lengths
        super().__init__(vocab, joined, np.delete(np.arange(len(joined)), self.last))
        self.nodes = len(joined)
        self.chunk = np.repeat(np.arange(len(chunks), dtype=np.int32), lengths + 1)

    def sums(self, weight: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all paths from the chunk's start to each node (forward) or from each node to its end; order and runs of edges."""
        into, out_of = (self.stop, self.start) if forward else (self.start, self.stop)
        level = np.arange(self.nodes) - self.first[self.chunk] if forward else self.last[self.chunk] - np.arange(self.nodes)
        total = np.full((self.nodes, *weight.shape[1:]), -np.inf)
        total[self.first if forward else self.last] = 0.0
        return total, *add_up(total, weight, into, out_of, level[into])


def log_sum(values) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))
