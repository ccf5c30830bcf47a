"""A quality score learned from positive and unlabelled texts.

Trusted positives, unlabelled texts and an estimated share of positives among them (the class prior) are enough: the
risk of the negatives is estimated as the unlabelled risk less the prior times that of the positives, and kept from
going below zero (the non-negative estimator). Labelled negatives are never learned from. The model is a small network
over surface statistics of the whole text: shares of characters, sizes and repetition of words and lines.

The positives are a bounded sample; every unlabelled text takes part. Statistics are made once where the texts are, and
in each round every task descends on its own rows from the common weights, which are then averaged by rows. The prior is
the best-bin estimate: a network that tells half of the positives from half of the unlabelled texts ranks the other
halves, and the share of unlabelled texts above a score over the share of held-out positives above it is an upper bound of the prior, least where only
positives lie; the score is chosen where the bound plus its sampling error is least.

Defined cases: null and empty texts are scored as texts without characters; without positives, or without any text to
learn from, every score is the prior; if every text has a label, all of them stand for the unlabelled ones; a document
with several labels counts as positive if one is; repeated rows are learned from and scored each; equal scores stay
equal; an empty table gives an empty result; other columns are ignored. A text's statistics take about 100 bytes of
memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, keep, tidy

#: Labelled positives that the model is trained on.
SAMPLE_TEXTS = 4000
HIDDEN, HALF, RATE, DECAY = 16, 128, 5e-3, 1e-4
#: Rounds of averaging, the fewest steps of a task in each, and the rows it may hold to take them from again.
ROUNDS, LEAST_STEPS, HELD_ROWS = 5, 400, 20_000
#: Score bins of the prior's estimate.
BINS = 1000
#: Used when no estimate can be made.
DEFAULT_PRIOR = 0.5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
MARKS = ".,;:!?'\"()-_/\\#*$%&|<>@=+~^"


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    nw = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:])) if nw > 1 else 0
    repeated = 0.0
    if nw > 2:
        index: dict[bytes, int] = {}
        w = np.fromiter((index.setdefault(x, len(index)) for x in words), dtype=np.uint64, count=nw)
        triples = (w[:-2] * _MIX[0] + w[1:-1]) * _MIX[1] + w[2:]
        repeated = 1 - len(np.unique(triples)) / len(triples)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=nw)
    share = counts / max(1, n)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return [
        np.log1p(n), np.log1p(nw), np.log1p(len(lines)),
        share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(), share[32], share[10],
        counts[65:91].sum() / max(1, letters),
        lengths.mean() if nw else 0.0, lengths.std() if nw else 0.0,
        distinct / max(1, nw), np.log1p(distinct) / np.log1p(max(1, nw)), same / max(1, nw), repeated,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        *(np.sqrt(share[[ord(c) for c in MARKS]])),
    ]


WIDTH = len(features(""))


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.parts = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.rest()

    def rest(self) -> None:
        """Forget the momentum."""
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts]
        self.steps = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, p in enumerate(self.parts):
            self.parts[i] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.rest()

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1])

    def standard(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.parts[2] + self.parts[3][0]

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(raw)), -30, 30)))

    def learn(self, x: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """One Adam step, given the derivative of the risk by each logit."""
        h = self.hidden(x)
        back = np.outer(slope, self.parts[2]) * (1 - h**2)
        grads = [x.T @ back + DECAY * self.parts[0], back.sum(0), h.T @ slope + DECAY * self.parts[2], np.array([slope.sum()])]
        self.steps += 1
        for i, g in enumerate(grads):
            m, v = self.moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.parts[i] = self.parts[i] - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _sigma(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _step(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float | None, rate: float) -> None:
    """One step on the non-negative risk with the logistic loss; without a prior, positives against unlabelled."""
    zp, zu = net.logits(xp), net.logits(xu)
    if prior is None:
        slope = np.r_[-_sigma(-zp) / len(zp), _sigma(zu) / len(zu)]
    elif np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():  # the risk of the unseen negatives
        slope = np.r_[(-prior * _sigma(-zp) - prior * _sigma(zp)) / len(zp), _sigma(zu) / len(zu)]
    else:  # below zero: step back along that part alone
        slope = np.r_[prior * _sigma(zp) / len(zp), -_sigma(zu) / len(zu)]
    net.learn(np.concatenate([xp, xu]), slope, rate)


def descend(net: Network, positive: np.ndarray, blocks: Iterator[np.ndarray], prior: float | None, seed: int, rate: float) -> int:
    """Steps over all rows of the blocks, in order; few rows are gone over again. Gives the number of rows."""
    rng = np.random.default_rng(seed)
    p, n, held = net.standard(positive), 0, []
    for raw in blocks:
        u = net.standard(raw)
        n += len(u)
        if n <= HELD_ROWS:
            held.append(u)
        for a in range(0, len(u), HALF):
            _step(net, p[rng.integers(0, len(p), HALF)], u[a : a + HALF], prior, rate)
    if 0 < n <= HELD_ROWS:
        again = np.concatenate(held)
        while net.steps < LEAST_STEPS:
            _step(net, p[rng.integers(0, len(p), HALF)], again[rng.integers(0, len(again), HALF)], prior, rate)
    return n


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """The training of `train` over one task's rows."""
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6, seed)
    for r in range(ROUNDS):
        net.rest()
        descend(net, positive, iter([unlabelled]), prior, seed + r, RATE / (1 + r))
    return net


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from counts of held-out positives and of unlabelled texts in rising score bins."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if n_p < 10 or n_u < 10:
        return DEFAULT_PRIOR
    q_p, q_u = (np.cumsum(x[::-1]) / x.sum() for x in (positive, unlabelled))
    error = np.sqrt(np.log(40) / 2) * (n_u**-0.5 + n_p**-0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(q_p > 0, (q_u + error) / q_p, np.inf)
    best = int(bound.argmin())
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.95))


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(np.int64), BINS - 1), minlength=BINS).astype(np.float64)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimate of `train` over one task's rows: every second row is held out of the ranking."""
    net = fit(positive[::2], unlabelled[::2], None)
    return best_bin(_bins(net.scores(positive[1::2])), _bins(net.scores(unlabelled[1::2])))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(v) for v in features(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, x array<float>")


def _added(rows: DataFrame, of_task) -> np.ndarray:
    """The sum over tasks of an array that of_task makes of a task's blocks of statistics: a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of_task(_matrix(b.column("x")) for b in batches if len(b))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.select("x").mapInArrow(tidy(run), "v array<double>").select(F.posexplode("v").alias("i", "y"))
    found = {r["i"]: r["y"] for r in parts.groupBy("i").agg(F.sum("y").alias("y")).collect()}
    return np.array([found[i] for i in sorted(found)])


def _fit_over(rows: DataFrame, positive: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Rounds of descent in every task, weights averaged by rows after each."""
    net = Network(mean, scale, seed)
    sent = rows.sparkSession.sparkContext.broadcast(positive)
    for r in range(ROUNDS):
        start = net.flat()

        def of_task(blocks: Iterator[np.ndarray], start=start, r=r) -> np.ndarray | None:
            own = Network(mean, scale, seed)
            own.load(start)
            n = descend(own, sent.value, blocks, prior, seed + r, RATE / (1 + r))
            return np.r_[n, n * own.flat()] if n else None

        total = _added(rows, of_task)
        net.load(total[1:] / total[0])
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE_TEXTS) -> tuple[Network | None, float]:
    """The network and the class prior, from labels of rows where `learn` holds (quality 1: trusted positives)."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    rows = keep(statistics(docs.where(learn)).join(marks, "doc_id", "left").select("doc_id", "x", "quality"), "statistics")
    trusted, unlabelled = rows.where("quality = 1"), rows.where("quality is null")
    n = trusted.count()
    drawn = trusted.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(min(1.0, limit / max(1, n)) * (1 << 30)))
    positive = np.array(sorted(r.x for r in drawn.select("x").collect()), dtype=np.float64).reshape(-1, WIDTH)
    if unlabelled.isEmpty():
        unlabelled = rows
    if not len(positive):
        return None, DEFAULT_PRIOR

    def moments(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in blocks:
            part = np.r_[len(x), x.sum(0), (x * x).sum(0)]
            total = part if total is None else total + part
        return total

    sums = _added(unlabelled, moments) + moments(iter([positive]))
    mean = sums[1 : WIDTH + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[WIDTH + 1 :] / sums[0] - mean**2, 0)) + 1e-6

    def tally(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in blocks:
            total = _bins(ranking.scores(x)) + (0 if total is None else total)
        return total

    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)) == 0
    if unlabelled.where(half).isEmpty() or unlabelled.where(~half).isEmpty() or len(positive) < 20:
        prior = DEFAULT_PRIOR
    else:
        ranking = _fit_over(unlabelled.where(half), positive[::2], mean, scale, None)
        prior = best_bin(_bins(ranking.scores(positive[1::2])), _added(unlabelled.where(~half), tally))
    net = _fit_over(unlabelled, positive, mean, scale, prior)
    forget(rows)
    return net, prior


def score(docs: DataFrame, net: Network | None, prior: float) -> DataFrame:
    """doc_id and score of every text."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([features(t.as_py()) for t in batch.column("text")], dtype=np.float64).reshape(-1, WIDTH)
            values = net.scores(raw) if net else np.full(len(raw), prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return narrow.mapInArrow(tidy(run), "doc_id long, score double")
