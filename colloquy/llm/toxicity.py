"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed terms: words and the first letters of words. The machine has a weight for each term and
vectors whose inner products weigh pairs of terms that occur together. No term is left out for what it says alone: penalties
in standard errors let weights of terms without a message be zero, and vectors start where the whole corpus of training
rows shows that pairs explain what weights leave over, more than they would explain the same residuals in random order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from colloquy.llm.common import discard, in_batches, written
from colloquy.llm.token_counts import byte_lengths, portions

BITS = 20
EDGE = ".,;:!?\"'()[]{}<>|*#$%&@/\\-_=+~`^"
#: Words a worker remembers; this bounds memory only.
REMEMBERED = 200_000


def terms_of(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-case word: itself, and its first 4 and 5 letters if it is longer."""
    w = word.strip(EDGE)
    if not w:
        return ()
    out = [crc32(b"w" + w.encode())]
    for n in (4, 5):
        if len(w) > n:
            out.append(crc32(b"p%d" % n + w[:n].encode()))
    return tuple(h >> (32 - BITS) for h in out)


def hashed(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((h for w in set((text or "").lower().split()) for h in terms_of(w)), np.int32))


@dataclass
class FactorizationMachine:
    """Sigmoid of bias + sum of weights + sum over pairs of terms of the inner product of their vectors."""

    terms: np.ndarray  # hashed terms it knows, ascending
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(rows, self.weights[cols], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[cols, f]
            z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse rows of terms, each 1, by row and by column, in 4-byte numbers: 8 bytes an entry. No column is empty."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, k: int):
        """rows ascending; cols ascending within a row."""
        self.n, self.k, self.cols = n, k, cols
        self.each, self.seen = np.bincount(rows, minlength=n), np.bincount(cols, minlength=k)
        self.by_cols = rows[np.argsort(cols, kind="stable")]
        self.some = np.flatnonzero(self.each)
        self.row_starts = (np.cumsum(self.each) - self.each)[self.some]
        self.col_starts = np.cumsum(self.seen) - self.seen

    def of(self, keep: np.ndarray) -> _Rows:
        """With the columns that keep names alone, numbered anew."""
        place = np.full(self.k, -1, np.int32)
        place[keep] = np.arange(len(keep), dtype=np.int32)
        new = place[self.cols]
        ok = new >= 0
        return _Rows(np.repeat(np.arange(self.n, dtype=np.int32), self.each)[ok], new[ok], self.n, len(keep))

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's number of terms against the mean, and each column's share of rows: their product is how often a term
        is expected in a document of that length."""
        return self.each / max(self.each.mean(), 1), self.seen / self.n

    def by_row(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.some):
            out[self.some] = np.add.reduceat(weights.astype(np.float32)[self.cols], self.row_starts, dtype=np.float64)
        return out

    def by_col(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights.astype(np.float32)[self.by_cols], self.col_starts, dtype=np.float64) if self.k else np.zeros(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _weights(x: _Rows, y: np.ndarray, c: np.ndarray, z: float, rate: float = 0.1, steps: int = 100) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression by thresholded steps: in each, every term whose residuals are still more
    than z standard errors from 0 moves by rate at most, until none is. Terms that say the same share its weight, which is
    steadier than the choice of one; terms that say nothing beyond how long a document is never move. Terms that can't
    move yet are looked at every ten steps."""
    p = (c * y).sum() / c.sum()
    bias, w = float(np.log(p / (1 - p))), np.zeros(x.k)
    error = np.sqrt(x.seen * ((c * (y - p)) ** 2).mean()) + 1e-12
    long, share = x.lengths()
    active, part, sums = np.zeros(0, np.int64), x.of(np.zeros(0, np.int64)), np.zeros(x.n)
    for step in range(steps):
        g = c * (_sigmoid(bias + sums) - y)
        if step % 10 == 0:
            active = np.flatnonzero((np.abs(x.by_col(g) - share * (long @ g)) > 0.8 * z * error) | (w != 0))
            part = x.of(active)
        far = (part.by_col(g) - share[active] * (long @ g)) / error[active]
        move = np.sign(far) * np.clip(np.abs(far) - z, 0, 1)
        if not move.any() and step % 10 == 0:
            break
        # Many terms that move at once must not overshoot: the mean document goes by half at most.
        change = part.by_row(rate * move)
        damped = min(1.0, 0.5 / max(float((c * np.abs(change)).sum()), 1e-12))
        w[active] -= damped * rate * move
        sums -= damped * change
        for _ in range(2):
            q = _sigmoid(bias + sums)
            bias -= float((c * (q - y)).sum() / max((c * q * (1 - q)).sum(), 0.01 * c.sum()))
    return bias, w


def _directions(x: _Rows, g: np.ndarray, factors: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The strongest directions of the co-occurrence of terms weighted by residuals, their strengths descending.

    Terms count by their deviation from how often they occur in documents of that many terms, so words of every text have
    no say; rare ones are shrunk, and long documents weigh as much as short ones. A term's occurrence with itself is no pair."""
    long, share = x.lengths()
    h = g / np.maximum(x.each, 1)
    d = share / (share + 0.01)
    own = x.by_col(h) - 2 * share * x.by_col(h * long) + (h * long**2).sum() * share**2

    def times(v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for f in range(v.shape[1]):
            u = d * v[:, f]
            s = h * (x.by_row(u) - long * (share @ u))
            out[:, f] = d * (x.by_col(s) - share * (long @ s) - own * u)
        return out

    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.k, min(factors, x.k))))[0]
    size = 0.0
    for _ in range(rounds):
        new = times(v)
        size = max(size, float(np.abs(np.linalg.norm(new, axis=0)).max()))
        # Shifted, so that the most positive directions win: an inner product of a vector with itself is positive.
        v = np.linalg.qr(new + size * v)[0]
    strength, turn = np.linalg.eigh(v.T @ times(v))
    return (v @ turn)[:, ::-1], strength[::-1]


def _margin(x: _Rows, bias: float, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    z = bias + x.by_row(weights)
    for f in np.flatnonzero(vectors.any(0)):
        z += 0.5 * (x.by_row(vectors[:, f]) ** 2 - x.by_row(vectors[:, f] ** 2))
    return z


def _refined(x: _Rows, y: np.ndarray, c: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray, steps: int, shrink: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors after so many steps of Adam over all rows; entries of vectors that are 0 stay so."""
    moves = vectors != 0
    params = [np.array([bias]), weights.copy(), vectors.copy()]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        _, w, v = params
        g = c * (_sigmoid(_margin(x, float(params[0][0]), w, v)) - y)
        one = x.by_col(g)
        gv = np.zeros_like(v)
        for f in np.flatnonzero(moves.any(0)):
            gv[:, f] = x.by_col(g * x.by_row(v[:, f])) - one * v[:, f]
        for j, grad in enumerate((np.array([g.sum()]), one + shrink / 10 * w, np.where(moves, gv + shrink * v, 0.0))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            s[j] = 0.999 * s[j] + 0.001 * grad**2
            params[j] -= 0.05 * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-9)
    return float(params[0][0]), params[1], params[2]


def fit(docs: list[np.ndarray], toxic: np.ndarray, least: int = 3, z: float = 3.0, tiny: float = 0.02, factors: int = 4, margin: float = 1.5, epochs: int = 30, shrink: float = 2e-3, balance: float = 1.0, seed: int = 0) -> FactorizationMachine:
    """Learns from documents as arrays of hashed terms. Equal documents count once.

    1. Weights over all terms of at least `least` documents, by thresholds of z standard errors; those below `tiny`, a
       fifth of a step, are zero.
    2. Up to `factors` directions in which pairs of terms explain the residuals, those `margin` times as strong as the
       strongest one of residuals in random order. Loads below a twentieth of a direction's largest are zero.
    3. Weights and vectors of terms that have any, fitted together in `epochs` steps, four times as many where there are
       vectors; squares shrink both. Vectors stay if they lower the loss by a tenth on a quarter of the rows that is left
       out for that: where words say all alone, the machine is a linear one.

    balance is the power to which classes are weighed alike (0: every document counts the same). Without documents of both
    classes every score is the share of toxic ones (0.5 without any).
    """
    first: dict[bytes, int] = {}
    for i, d in enumerate(docs):
        first.setdefault(d.tobytes() + bytes([int(toxic[i])]), i)
    docs, y = [docs[i] for i in first.values()], np.array([toxic[i] for i in first.values()], float)
    n, n1 = len(y), y.sum()
    if not 0 < n1 < n:
        share = (n1 + 0.5) / (n + 1)
        return FactorizationMachine(np.zeros(0, np.int32), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    flat, of = np.concatenate(docs), np.repeat(np.arange(n, dtype=np.int32), [len(d) for d in docs])
    del docs
    terms = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= least).astype(np.int32)
    place = np.full(1 << BITS, -1, np.int32)
    place[terms] = np.arange(len(terms), dtype=np.int32)
    flat = place[flat]
    x = _Rows(of[flat >= 0], flat[flat >= 0], n, len(terms))
    del flat, of
    c = np.where(y == 1, (n / n1) ** balance, (n / (n - n1)) ** balance)
    c /= c.sum()
    bias, w = _weights(x, y, c, z)
    w[np.abs(w) < tiny] = 0
    g = c * (y - _sigmoid(bias + x.by_row(w)))
    found, strength = _directions(x, g, factors, 16, seed)
    order = np.random.default_rng(seed).permutation(n)
    chance = _directions(x, g[order], 1, 10, seed)[1][:1].max(initial=0.0)
    ok = strength > max(margin * chance, 0)
    v = found[:, ok] * np.sign(found[np.abs(found[:, ok]).argmax(0), np.arange(ok.sum())]) if ok.any() else np.zeros((x.k, 0))
    most = np.abs(v).max(0, initial=1e-12)
    v = np.where(np.abs(v) >= 0.05 * most, v / most, 0.0) * 0.3
    vectors = np.zeros((x.k, factors))
    vectors[:, : v.shape[1]] = v
    if v.any():  # every fourth row is left out for a moment
        kept, steps = np.arange(n) % 4 > 0, 4 * epochs
        losses = []
        for start in (vectors, np.zeros_like(vectors)):
            keep = np.flatnonzero((w != 0) | start.any(1))
            part = x.of(keep)
            tried = _refined(part, y, np.where(kept, c, 0.0), bias, w[keep], start[keep], steps, shrink)
            q = _sigmoid(_margin(part, *tried))
            losses.append(-(c * ~kept * np.log(np.clip(np.where(y == 1, q, 1 - q), 1e-9, 1))).sum())
        if losses[0] < 0.9 * losses[1]:
            epochs = steps
        else:
            vectors[:] = 0
    keep = np.flatnonzero((w != 0) | vectors.any(1))
    return FactorizationMachine(terms[keep], *_refined(x.of(keep), y, c, bias, w[keep], vectors[keep], epochs, shrink))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_toxic: int = 5000, sample_clean: int = 9000, sample_terms: int = 6_000_000, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fits the machine on labelled rows that are not held out: at most sample_toxic and sample_clean of either class,
    those first in a seeded order of hashes, and of these, in that order, as many as have sample_terms terms together. So
    the broadcast of their ids is bounded, and what the driver gets: 4 bytes a term.

    Labels that are null or not 0 or 1, or that contradict another label of their id, and ids without a document count
    for nothing. Null texts are documents without terms. Rows that repeat an id are documents of their own; equal ones of
    one label count once, whatever their order.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("__y"), F.max("toxic").alias("__z"))
    known = known.where((F.col("__y") == F.col("__z")) & ~held_out(F.col("doc_id"))).select("doc_id", "__y")
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    sample = known.where("__y = 1").orderBy(*order).limit(sample_toxic).unionByName(known.where("__y = 0").orderBy(*order).limit(sample_clean))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(byte_lengths(b.column(1))):
                terms = [hashed(t).tobytes() for t in b.column(1)[part].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[part].cast(pa.int64()), pa.array(terms, pa.binary()), pa.array([len(t) // 4 for t in terms], pa.int64()), b.column(2)[part].cast(pa.int32())], ["doc_id", "terms", "n", "y"])

    found = written(in_batches(rows).mapInArrow(run, "doc_id long, terms binary, n long, y int"), "terms")
    before = Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample
    upto = found.groupBy("doc_id").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(before))
    got = found.join(F.broadcast(upto.where(F.col("upto") <= sample_terms).select("doc_id")), "doc_id").select("doc_id", "terms", "y").toArrow()
    discard(found)
    terms, ids, y = got.column("terms").to_pylist(), got.column("doc_id").to_pylist(), got.column("y").to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], terms[i]))  # the same machine whatever order tasks end in
    return fit([np.frombuffer(terms[i], np.int32) for i in order], y[order], seed=seed)


class Scorer:
    def __init__(self, fm: FactorizationMachine):
        self.fm = fm
        self.place = dict(zip(fm.terms.tolist(), range(len(fm.terms)), strict=True))
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows, cols, get, place = [], [], self.words.get, self.place
        for i, t in enumerate(texts):
            found: set[int] = set()
            for w in set(t.lower().split()) if t else ():
                got = get(w)
                if got is None:
                    got = self.words[w] = tuple(place[h] for h in terms_of(w) if h in place)
                if got:
                    found.update(got)
            rows += [i] * len(found)
            cols += sorted(found)
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return self.fm.score(np.array(rows, np.int64), np.array(cols, np.int64), len(texts))


def score_toxicity(docs: DataFrame, fm: FactorizationMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score and predicted, from text alone; whole texts, no shuffle.

    Null and empty texts get the score of a document without terms. Repeated rows score alike; a score that equals the
    threshold is predicted toxic. An empty table gives an empty result; columns of docs stay, but score and predicted are
    replaced.
    """
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    at = next(i for i, f in enumerate(keep) if f.name.lower() == text_col.lower())
    names = [f"c{i}" for i in range(len(keep))]  # Spark takes no name with a dot here
    model = docs.sparkSession.sparkContext.broadcast(fm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            texts = b.column(at)
            score = np.concatenate([np.zeros(0), *(scorer(texts[p].to_pylist()) for p in portions(byte_lengths(texts)))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, keep, strict=True)]).add("score", DoubleType()).add("predicted", IntegerType())
    rows = docs.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, keep, strict=True)])
    return in_batches(rows).mapInArrow(run, schema).toDF(*[f.name for f in keep], "score", "predicted")
