"""Distinct sampled segmentations of texts into SentencePiece pieces, and decoding.

A text's segmentations are the leaves of a tree whose levels are lattice steps. The k leaves with the largest
Gumbel-perturbed log probability are a sample without replacement. A best-first (A-star) search finds them: the
backward sums of the lattice give each subtree's total probability, so the perturbed maximum of a whole subtree can be
drawn before it is opened and is an exact bound for it. Opening the best subtree draws its best leaf step by step; what
hangs off that path beside it are the new subtrees, their maxima drawn below the leaf's value.

All texts of a batch are searched together in arrays; parts that a worker has met keep their lattice. Random numbers are
hashes of (seed, row key, sample, place), so a row's samples depend on nothing but its key, its text and the seed.

Each sample has its log probability under the model and its log inclusion score log(1 - exp(-exp(log_p - t))), where t
is the perturbed value of the first leaf left out.

Defined cases: null and empty texts give no samples; a text with fewer than k segmentations gives all of them, with
inclusion 1; a null key seeds as 0; repeated rows give equal samples; other columns are ignored. Characters without a
piece are spelled in byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from .pieces import DEFAULT_MODEL, OWN_SPACE, SPACE, Edges, Vocabulary, add_up, vocabulary

#: Characters of text searched together; a longer text is searched alone, at about 200 bytes of memory a character.
BATCH_CHARS = 250_000
#: Lattice edges that a worker remembers, at about 35 bytes each and the names of their nodes.
REMEMBERED = 500_000
#: Ends of parts have names at every so many characters, up to NAMED, a multiple: names of longer ones would grow with the square.
APART = 4
NAMED = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter-based generator."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(seed: np.ndarray, *places) -> np.ndarray:
    """Numbers in (0, 1) from seeds and counters."""
    for p in places:
        seed = _mix(seed ^ np.asarray(p).astype(np.uint64))
    u = (seed >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


class _Nodes(dict):
    """Numbers of lattice nodes, named by the text from there to the part's end; 0 is every end.

    What follows a node depends on that text alone, so parts with a common end share its nodes.
    """

    size = 1

    def grow(self, parts: Iterable[str]) -> tuple[list[str], list[int], list[int]]:
        """Number parts and those of their ends that are new: parts, how many of their nodes are new, the node after these.

        Ends have names where their length is a multiple of APART and NAMED at most; all have numbers.
        """
        new, many, after, put, size = [], [], [], self.setdefault, self.size
        for part in parts:
            if put(part, size) != size:  # the end of one before it
                continue
            length = at = len(part)
            known = 0
            for at in range(length - NAMED if length > NAMED else length % APART or APART, length, APART):
                known = put(part[at:], size + at)
                if known != size + at:
                    break
            else:
                at, known = length, 0
            size += at
            new.append(part)
            many.append(at)
            after.append(known)
        self.size = size
        return new, many, after


class _Steps:
    """The lattices of all parts met so far as one table of conditional step probabilities, added to batch by batch.

    A node's edges hold only its own numbers, so they are the same whatever stands before them.
    """

    def __init__(self, vocab: Vocabulary, alpha: float):
        self.vocab, self.alpha = vocab, alpha
        self.index = _Nodes()
        self.n_edges, self.n_nodes = 0, 1
        for name, kind in (("stop", np.int32), ("piece", np.int32), ("upto", float), ("p", float), ("runs", np.int32), ("sizes", np.int32), ("after", np.int32), ("beta", float), ("batches", np.int32)):
            setattr(self, name, np.zeros(REMEMBERED + 1024, dtype=kind))  # pages that nothing is written to take no memory

    def _append(self, name: str, n: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if n + len(values) > len(held):
            held = np.concatenate([held[:n], np.zeros(max(len(held), len(values)), dtype=held.dtype)])
            setattr(self, name, held)
        held[n : n + len(values)] = values

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The first node of each part, edges added for nodes that are new."""
        found = np.fromiter(map(self.index.get, parts, repeat(0)), dtype=np.int32, count=len(parts))
        unknown = np.flatnonzero(found == 0).tolist()
        if unknown:
            names = [parts[i] for i in unknown]
            self._add(*self.index.grow(dict.fromkeys(names)))
            found[unknown] = [self.index[x] for x in names]
        self.batches[found] = self.batches[found] + 1
        return found

    def _add(self, new: list[str], many: list[int], after: list[int]) -> None:
        many, after, base = np.array(many), np.array(after), self.n_nodes
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        begin, last = np.cumsum(lengths + 1) - lengths - 1, np.cumsum(many) - 1
        nodes = int(last[-1]) + 1
        within = np.arange(nodes) - np.repeat(last + 1 - many, many)
        places, left = np.repeat(begin, many) + within, np.repeat(lengths, many) - within
        follows = np.arange(base + 1, base + nodes + 1)
        follows[last] = after
        for name, values in (("after", follows), ("beta", np.zeros(nodes)), ("batches", np.zeros(nodes, dtype=np.int32))):
            self._append(name, base, values)
        joined = ("\n".join(new) + "\n").replace(SPACE, OWN_SPACE).replace(" ", SPACE)
        node = np.zeros(len(joined), dtype=np.int64)
        node[places] = np.arange(base, base + nodes)
        at = begin + many
        while len(at):  # the known rest of each part
            at, after = at[after > 0], after[after > 0]
            node[at] = after
            at, after = at + 1, self.after[after]
        edges = Edges(self.vocab, joined, places)
        weight = self.alpha * edges.weights(self.vocab.log_p, self.vocab.byte_log_p)
        start, stop = node[edges.start], node[edges.stop]
        add_up(self.beta, weight, start, stop, left[start - base])
        order = np.argsort(start, kind="stable")
        start, stop = start[order], stop[order]
        p = np.exp(weight[order] + self.beta[stop] - self.beta[start])
        sizes = np.bincount(start - base, minlength=nodes)
        runs = np.cumsum(sizes) - sizes
        p /= np.repeat(np.add.reduceat(p, runs), sizes)
        upto = p.copy()
        j, longer = 1, np.flatnonzero(sizes > 1)
        while len(longer):  # sums within each run, free of what stands before it
            at = runs[longer] + j
            upto[at] += upto[at - 1]
            j += 1
            longer = longer[sizes[longer] > j]
        upto = np.minimum(upto, 1.0)
        upto[runs + sizes - 1] = 1.0
        for name, values in (("stop", stop), ("piece", edges.piece[order]), ("upto", upto), ("p", p)):
            self._append(name, self.n_edges, values)
        for name, values in (("runs", runs + self.n_edges), ("sizes", sizes)):
            self._append(name, base, values)
        self.n_edges, self.n_nodes = self.n_edges + len(p), base + nodes

    def shrunk(self) -> _Steps:
        """A new table of the parts that several batches had, the most used first, of at most half the size."""
        out = _Steps(self.vocab, self.alpha)
        order = np.argsort(-self.batches[: self.n_nodes], kind="stable")
        order = order[self.batches[order] > 1]
        while True:
            stays = np.zeros(self.n_nodes, dtype=bool)
            reached = order
            while len(reached):
                stays[reached] = True
                reached = self.after[reached]
                reached = reached[(reached > 0) & ~stays[reached]]
            old = np.flatnonzero(stays)
            sizes = self.sizes[old]
            if sizes.sum() <= REMEMBERED // 2:
                break
            order = order[: len(order) * 3 // 4]
        if not len(old):
            return out
        moved = np.cumsum(stays) * stays  # new numbers from 1; an end stays 0
        runs = np.cumsum(sizes) - sizes
        edges = np.arange(int(sizes.sum())) + np.repeat(self.runs[old] - runs, sizes)
        for name, values in (("stop", moved[self.stop[edges]]), ("piece", self.piece[edges]), ("upto", self.upto[edges]), ("p", self.p[edges])):
            out._append(name, 0, values)
        for name, values in (("runs", runs), ("sizes", sizes), ("after", moved[self.after[old]]), ("beta", self.beta[old]), ("batches", self.batches[old] // 2)):
            out._append(name, 1, values)
        out.n_edges, out.n_nodes = len(edges), len(old) + 1
        moved = moved.tolist()
        out.index.update((name, moved[i]) for name, i in self.index.items() if moved[i])
        out.index.size = out.n_nodes
        return out

    def run_of(self, e: np.ndarray) -> np.ndarray:
        """The node that each edge leaves."""
        return np.searchsorted(self.runs[1 : self.n_nodes], np.asarray(e, dtype=np.int32), side="right")

    def logs(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of edges, and of all other edges of their runs together."""
        p = self.p[edges]
        rest = 1.0 - p
        for i in np.flatnonzero((p > 1 - 1e-9) & (p < 1)):  # too near 1 for a difference
            r = int(self.run_of(edges[i]))
            rest[i] = sum(self.p[j] for j in range(self.runs[r], self.runs[r] + self.sizes[r]) if j != edges[i])
        with np.errstate(divide="ignore"):
            return np.log(p), np.log(rest)

    def walk(self, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sampled edges from each node to its part's end, and which start each belongs to, step by step."""
        who = np.flatnonzero(node).astype(np.int32)
        node = node[who]
        walks, edges, step = [], [], 0
        base = _mix(seed ^ place.astype(np.uint64))
        while len(who):
            e, u = self.runs[node], _uniform(base[who], step)
            left = np.flatnonzero(u >= self.upto[e])
            while len(left):  # longer pieces come first and are mostly likelier
                e[left] += 1
                left = left[u[left] >= self.upto[e[left]]]
            walks.append(who)
            edges.append(e)
            node = self.stop[e]
            on = np.flatnonzero(node)
            who, node, step = who[on], node[on], step + 1
        return walks, edges


_tables: dict[tuple[Vocabulary, float], _Steps] = {}


def _table(vocab: Vocabulary, alpha: float) -> _Steps:
    """The table of this worker; a smaller one when it has grown to REMEMBERED edges."""
    held = _tables.get((vocab, alpha))
    broken = held is not None and held.index.size != held.n_nodes  # an error left nodes without edges
    if held is None or broken or held.n_edges > REMEMBERED:
        _tables.clear()
        _tables[vocab, alpha] = _Steps(vocab, alpha) if held is None or broken else held.shrunk()
    return _tables[vocab, alpha]


class _Path:
    """One sample of every text: edges in text order, the occurrence and the text of each."""

    def __init__(self, edges: np.ndarray, occurrence: np.ndarray, text: np.ndarray, texts: int):
        self.edges, self.occurrence, self.text = edges, occurrence, text
        self.begin = np.searchsorted(text, np.arange(texts + 1))


def search(vocab: Vocabulary, texts: list[str], keys: np.ndarray, k: int, seed: int, alpha: float):
    """For each sample rank: (text index, path, log p, perturbed value); and the first value left out of each text."""
    parts, per_text = vocab.parts(texts)
    steps = _table(vocab, alpha)
    occ_first = steps.numbers(parts)
    n = len(texts)
    occ_text = np.repeat(np.arange(n, dtype=np.int32), per_text)
    occ_begin = np.cumsum(per_text) - per_text
    occ_place = np.arange(len(occ_text)) - occ_begin[occ_text]
    root = _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(np.full(n, seed % 2**64, dtype=np.uint64)))

    def gumbel_below(where: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            return np.where(np.isfinite(where), where - np.log(np.exp(where - top) - np.log(u)), -np.inf)

    def complete(walks, edges, base_edges, base_occ) -> _Path:
        occ = np.concatenate([base_occ, *walks]).astype(np.int32)
        order = np.argsort(occ, kind="stable")
        occ = occ[order]
        return _Path(np.concatenate([base_edges, *edges]).astype(np.int32)[order], occ, occ_text[occ], n)

    none = np.zeros(0, dtype=np.int64)
    paths: list[_Path] = []
    results = []
    value = -np.log(-np.log(_uniform(root, 1)))  # the perturbed maximum of all segmentations: total probability 1
    alive = np.ones(n, dtype=bool)
    queue_value = np.full((n, 0), -np.inf)
    queue_path = np.zeros((n, 0), dtype=np.int64)
    queue_level = np.zeros((n, 0), dtype=np.int64)
    forbidden: list[dict[int, tuple[int, list[int]]]] = []  # by path: text -> (level, edges tried there)
    for sample in range(k):
        closed: dict[int, tuple[int, list[int], float]] = {}
        if sample == 0:
            walks, edges = steps.walk(occ_first, _mix(root)[occ_text], occ_place)
            path = complete(walks, edges, none, none)
            from_level = np.zeros(n, dtype=np.int64)
        else:
            best = queue_value.argmax(axis=1)
            rows = np.arange(n)
            value = queue_value[rows, best]
            alive = np.isfinite(value)
            parent, level = queue_path[rows, best], queue_level[rows, best]
            queue_value[rows, best] = -np.inf
            keep_e, keep_o, alt_e, alt_o = [], [], [], []
            node = np.zeros(len(occ_first), dtype=np.int32)
            draw = _uniform(root, 2, sample)
            for q in np.unique(parent[alive]):
                mine = alive & (parent == q)
                p = paths[q]
                rank = np.arange(len(p.edges)) - p.begin[p.text]
                cut = mine[p.text] & (rank < level[p.text])
                keep_e.append(p.edges[cut])
                keep_o.append(p.occurrence[cut])
                for t in np.flatnonzero(mine):
                    at = p.begin[t] + level[t]
                    e = int(p.edges[at])
                    known = forbidden[q].get(t)
                    tried = [*known[1], e] if known and known[0] == level[t] else [e]
                    r = int(steps.run_of(e))
                    a = steps.runs[r]
                    open_ = [i for i in range(a, a + steps.sizes[r]) if i not in tried]
                    left = sum(steps.p[i] for i in open_)
                    u, pick = draw[t] * left, open_[-1]
                    for i in open_:
                        u -= steps.p[i]
                        if u < 0:
                            pick = i
                            break
                    alt_e.append(pick)
                    o = p.occurrence[at]
                    alt_o.append(o)
                    node[o] = steps.stop[pick]
                    still = sum(steps.p[i] for i in open_ if i != pick)
                    closed[t] = (int(level[t]), tried, float(np.log(still)) if still > 0 else -np.inf)
            branch = np.full(n, np.iinfo(np.int64).max)
            if alt_o:
                branch[occ_text[np.array(alt_o)]] = alt_o
            later = np.arange(len(occ_first)) > branch[occ_text]
            node[later] = occ_first[later]
            walks, edges = steps.walk(node, _mix(root ^ np.uint64(sample))[occ_text], occ_place)
            path = complete(walks, edges, np.concatenate([*keep_e, np.array(alt_e, dtype=np.int64)]), np.concatenate([*keep_o, np.array(alt_o, dtype=np.int64)]))
            from_level = level
        paths.append(path)
        forbidden.append({t: (lv, tried) for t, (lv, tried, _) in closed.items()})
        step_log, rest_log = steps.logs(path.edges)
        upto = np.cumsum(step_log)
        before = upto - step_log
        base = np.zeros(n)
        has = path.begin[:-1] < path.begin[1:]
        base[has] = before[path.begin[:-1][has]]
        total = np.zeros(n)
        total[has] = upto[path.begin[1:][has] - 1] - base[has]
        results.append((np.flatnonzero(alive & has), path, total, value.copy()))
        rank = np.arange(len(path.edges)) - path.begin[path.text]
        off = rest_log
        for t, (lv, _, rest) in closed.items():
            off[path.begin[t] + lv] = rest
        where = before - base[path.text] + off
        where[rank < from_level[path.text]] = -np.inf
        seeded = _mix(_mix(root ^ np.uint64(3 + sample)) ^ np.uint64(1 << 40))
        u = _uniform(seeded[path.text], rank)
        bound = gumbel_below(where, value[path.text], u)
        # The best few subtrees beside this path are all that later samples can need.
        for _ in range(k - sample):
            top = np.full(n, -np.inf)
            place = np.zeros(n, dtype=np.int64)
            if len(bound):
                top[has] = np.maximum.reduceat(bound, path.begin[:-1][has])
                hit = np.flatnonzero((bound == top[path.text]) & np.isfinite(bound))
                texts_hit, first = np.unique(path.text[hit], return_index=True)
                place[texts_hit] = rank[hit[first]]
                bound[hit[first]] = -np.inf
            queue_value = np.column_stack([queue_value, top])
            queue_path = np.column_stack([queue_path, np.full(n, sample)])
            queue_level = np.column_stack([queue_level, place])
    left_out = queue_value.max(axis=1, initial=-np.inf)
    return steps, results, left_out


def _spelled(vocab: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lattice ids of all texts as piece ids, and where each text's begin: a character without a piece becomes its bytes."""
    other = np.flatnonzero(ids >= vocab.size)
    breaks = ids[other] == vocab.line_break
    ids[other[breaks]] = vocab.spelled_break
    other = other[~breaks]
    if not len(other):
        return ids, begin
    many = [vocab.spell([i]) for i in ids[other].tolist()]
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[other] = [len(x) for x in many]
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.repeat(ids, sizes)
    for at, x in zip(starts[other], many, strict=True):
        out[at : at + len(x)] = x
    return out, starts[begin]


def samples(vocab: Vocabulary, texts: list[str], keys: list[int], k: int, seed: int = 0, alpha: float = 1.0):
    """For each rank: texts that have that sample, piece ids of all texts, where each text's begin, log p, log inclusion."""
    steps, results, left_out = search(vocab, texts, np.array(keys, dtype=np.int64), k, seed, alpha)
    for who, path, total, _ in results:
        ids, begin = _spelled(vocab, steps.piece[path.edges], path.begin)
        with np.errstate(over="ignore", divide="ignore"):
            x = np.exp(np.minimum(total - left_out, 700.0))
            inclusion = np.where(np.isneginf(left_out), 0.0, np.where(x < 1e-12, total - left_out, np.log(-np.expm1(-x))))
        yield who, ids.astype(np.int32), begin, total, inclusion


def segment(vocab: Vocabulary, texts: list[str], keys: list[int], k: int, seed: int = 0, alpha: float = 1.0) -> Iterator[tuple[int, int, list[int], float, float]]:
    """(text index, rank, piece ids, log p, log inclusion) of every sample; texts must not be empty."""
    for rank, (who, ids, begin, total, inclusion) in enumerate(samples(vocab, texts, keys, k, seed, alpha)):
        for t in who:
            yield int(t), rank, ids[begin[t] : begin[t + 1]].tolist(), float(total[t]), float(inclusion[t])


def gives_back(vocab: Vocabulary, ids: np.ndarray, begin: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the pieces of each text spell it: its bytes after a leading space."""
    raw = vocab.raw(ids)
    ends = np.r_[0, np.cumsum(vocab.byte_length[ids])][begin]
    whole = raw.tobytes()
    if ends[0] == 0 and (np.diff(ends) == np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))).all() and whole == b"".join(texts):
        return np.ones(len(texts), dtype=bool)
    return np.array([whole[a:b] == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)], dtype=bool)


def sample(docs: DataFrame, k: int = 2, seed: int = 0, alpha: float = 1.0, model_file: str = DEFAULT_MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, sample, ids, n_pieces, log_p, log_inclusion, decoded.

    decoded tells that the ids give back the text.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), *carry, "text").where("text <> ''")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in narrow.schema if f.name in carry)
    names = ["doc_id", *carry, "sample", "ids", "n_pieces", "log_p", "log_inclusion", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file)
        for batch in batches:
            column = batch.column("text")
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1])
            group = np.cumsum(sizes) // BATCH_CHARS
            for a, b in zip(cuts := np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), np.r_[cuts[1:], len(group)], strict=True):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                spelled = [b" " + t.encode() for t in texts]
                keys = [x or 0 for x in part.column("doc_id").to_pylist()]
                for rank, (who, ids, begin, log_p, inclusion) in enumerate(samples(vocab, texts, keys, k, seed, alpha)):
                    decoded = gives_back(vocab, ids, begin, spelled)
                    rows, lengths = part.select(["doc_id", *carry]).take(pa.array(who, pa.int64())), np.diff(begin)[who]
                    chosen = ids if len(who) == len(texts) else np.concatenate([ids[:0], *[ids[begin[t] : begin[t + 1]] for t in who]])
                    shown = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(chosen))
                    columns = [rows.column("doc_id"), *(rows.column(c) for c in carry), pa.array(np.full(len(who), rank), pa.int32()), shown, pa.array(lengths, pa.int32()), pa.array(log_p[who], pa.float64()), pa.array(inclusion[who], pa.float64()), pa.array(decoded[who], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(tidy(run), f"doc_id long, {kept}sample int, ids array<int>, n_pieces int, log_p double, log_inclusion double, decoded boolean")


def texts_of(vocab: Vocabulary, lists: pa.ListArray) -> list[str | None]:
    """The text of each list of piece ids; null for a null list and one that holds a null or an id that is no piece."""
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(lengths)]
    known = (ids >= 0) & (ids < vocab.size)
    bad = np.r_[0, np.cumsum(~known)]
    ids = np.where(known, ids, 0)
    whole, at = vocab.raw(ids).tobytes(), np.r_[0, np.cumsum(vocab.byte_length[ids])][ends]
    out: list[str | None] = []
    for i, (a, b, none) in enumerate(zip(at[:-1], at[1:], lists.is_null().to_pylist(), strict=True)):
        text = whole[a:b].decode("utf-8", errors="replace")
        out.append(None if none or bad[ends[i + 1]] > bad[ends[i]] else text[1:] if text.startswith(" ") else text)
    return out


def decode(encoded: DataFrame, ids: str = "ids", into: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """encoded with the texts of its lists of piece ids in a column of their own; all other columns stay.

    Null lists, and lists with a null or an id that is no piece, give null; an empty list gives the empty text; an
    existing column of that name is replaced.
    """

    def texts(lists):
        import pandas as pd  # sampling does without it

        return pd.Series(texts_of(vocabulary(model_file), pa.array(lists, pa.list_(pa.int32()), from_pandas=True)), dtype=object)

    return encoded.withColumn(into, F.pandas_udf(texts, "string", F.PandasUDFType.SCALAR)(F.col(ids).cast("array<int>")))
