"""Language identification by segmentation-marginalised unigrams.

Each language has one probability for each piece of a fixed public vocabulary. A chunk's probability is the sum over
all its segmentations of the product of its pieces' probabilities (a forward algorithm over the chunk's lattice), a
text's log probability the sum over its chunks. The piece probabilities are trained by expectation-maximisation on
the distinct chunks of a bounded sample of labelled texts.

Defined cases: a null text, and one without a letter, is `und` with score 0; a null language is never learned from;
ties go to the language that sorts first; repeated rows are scored each; without any labelled text every text is
`und`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from .pieces import DEFAULT_MODEL, Lattice, Vocabulary, vocabulary

UNKNOWN = "und"
#: Texts of each language that the model is trained on, and the rounds of training.
SAMPLE_TEXTS = 300
ROUNDS = 4
#: Weight of the vocabulary's own distribution, in pieces.
PRIOR = 300.0
#: Longer chunks are scored but not remembered; of the others the most used, so many at most.
LONG, REMEMBERED = 64, 200_000
#: Characters of text scored together.
BATCH_CHARS = 500_000


def train(counts: dict[str, dict[str, int]], model_file: str = DEFAULT_MODEL, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece log probabilities (pieces x languages) from counts of chunks in each."""
    vocab = vocabulary(model_file)
    prior = np.exp(vocab.log_p) * PRIOR
    languages = sorted(counts)
    learned = []
    for language in languages:
        chunks = sorted(counts[language])
        times = np.array([counts[language][c] for c in chunks], dtype=np.float64)
        lattice = Lattice(vocab, chunks)
        known = lattice.piece < vocab.size
        log_p = vocab.log_p
        for _ in range(rounds):
            weight = lattice.weights(log_p, vocab.byte_log_p)
            alpha, *_ = lattice.sums(weight, forward=True)
            beta, *_ = lattice.sums(weight, forward=False)
            chunk = lattice.chunk[lattice.start]
            expected = times[chunk] * np.exp(alpha[lattice.start] + weight + beta[lattice.stop] - beta[lattice.first][chunk])
            mass = np.bincount(lattice.piece[known], weights=expected[known], minlength=vocab.size) + prior
            with np.errstate(divide="ignore"):
                log_p = np.log(mass / mass.sum())
        learned.append(log_p)
    return languages, np.stack(learned, axis=1) if learned else np.zeros((vocab.size, 0))


def chunk_scores(vocab: Vocabulary, log_p: np.ndarray, chunks: list[str]) -> np.ndarray:
    """Log probability of each chunk in each language, summed over all its segmentations."""
    lattice = Lattice(vocab, chunks)
    alpha, *_ = lattice.sums(lattice.weights(log_p, vocab.byte_log_p), forward=True)
    return alpha[lattice.last]


class Scorer:
    """Log probabilities of texts; remembers those of the chunks it has met most."""

    def __init__(self, log_p: np.ndarray, model_file: str):
        self.vocab, self.log_p = vocabulary(model_file), log_p
        self.index: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, log_p.shape[1]))
        self.uses = np.zeros(REMEMBERED, dtype=np.int64)

    def _room(self, n: int) -> None:
        """Forget the less used half if n more chunks do not fit."""
        if len(self.index) + n > REMEMBERED:
            names = list(self.index)
            stay = np.argsort(-self.uses[: len(names)], kind="stable")[: REMEMBERED // 2]
            self.index = {names[i]: k for k, i in enumerate(stay)}
            self.table[: len(stay)] = self.table[stay]
            self.uses[: len(stay)] = self.uses[stay] // 2
            self.uses[len(stay) :] = 0

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [self.vocab.chunks(t) for t in texts]
        local: dict[str, int] = defaultdict(count().__next__)
        places = np.fromiter(map(local.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        names = list(local)
        at = np.fromiter((self.index.get(c, -1) for c in names), dtype=np.int64, count=len(names))
        rows = self.table[at]
        new = np.flatnonzero(at < 0)
        times = np.bincount(places, minlength=len(names))
        self.uses[at[at >= 0]] += times[at >= 0]
        if len(new):
            rows[new] = chunk_scores(self.vocab, self.log_p, [names[i] for i in new])
            short = [i for i in new if len(names[i]) <= LONG]
            self._room(len(short))
            for i in short[: REMEMBERED - len(self.index)]:
                k = self.index[names[i]] = len(self.index)
                self.table[k], self.uses[k] = rows[i], times[i]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        out = np.zeros((len(texts), self.log_p.shape[1]))
        has = np.flatnonzero(lengths)
        if len(has):
            out[has] = np.add.reduceat(rows[places], (np.cumsum(lengths) - lengths)[has], axis=0)
        return out


def sample_counts(docs: DataFrame, learn: Column, model_file: str = DEFAULT_MODEL, texts: int = SAMPLE_TEXTS) -> dict[str, dict[str, int]]:
    """Counts of the chunks of about `texts` texts of each language, the ones whose hashed id is smallest."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.2 * texts / n))])
    drawn = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                chunks = vocab.chunks(text.as_py())
                # Stand-ins for characters are lone surrogates, which Arrow refuses; they start no useful chunk.
                good = [c for c in chunks if not any("\udc00" <= x <= "\udcff" for x in c)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(good), pa.string()), pa.array(good, pa.string())], ["lang", "chunk"])

    counted = drawn.select("lang", "text").mapInArrow(tidy(run), "lang string, chunk string").groupBy("lang", "chunk").count().collect()
    out: dict[str, dict[str, int]] = {}
    for r in counted:
        out.setdefault(r["lang"], {})[r["chunk"]] = r["count"]
    return out


def identify(docs: DataFrame, languages: list[str], log_p: np.ndarray, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language under equal priors) of every text."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    model = docs.sparkSession.sparkContext.broadcast(log_p.astype(np.float64))  # pieces x languages: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, model_file)

        def judged(ids: list, texts: list) -> pa.RecordBatch:
            letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if languages and any(letters):
                who = np.flatnonzero(letters)
                logs = scorer.scores([texts[i] for i in who])
                best = logs.argmax(axis=1)
                scores[who] = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, j in zip(who, best, strict=True):
                    names[i] = languages[j]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > BATCH_CHARS:
                    yield judged(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield judged(ids, texts)

    return narrow.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
