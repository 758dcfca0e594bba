"""Quality: positive-unlabelled learning with the non-negative risk.

Positives are trusted labelled rows (at most ``MAX_POSITIVE``, those whose hashed id is
smallest); every document that may be trained on is unlabelled text. With class prior p the
risk is ``p R_P(+) + max(0, R_U(-) - p R_P(-))``; where the second part falls below zero,
steps go against it instead. The model is a linear one over about a hundred dense
features of writing (shares of byte classes and of token shapes, repetition, length). Features
are computed once and written; each step of the fit is one pass over them that returns a
hundred sums, and scoring reads them too.

The prior is estimated from positives and unlabelled text alone, by the best bin: a linear
positive-against-unlabelled model is fitted with every second positive, and the prior is the
least ratio, over score thresholds, of the share of unlabelled rows above it to the share
of the other positives above it (plus a bound for chance). A stretch of scores that holds
positives only gives the prior exactly; labelled negatives are never looked at.

Steps are Newton steps whose gradient is summed over all rows; only the curvature comes from
a sample (``CURVATURE`` unlabelled rows), which sets how fast they converge but not where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K
from lodegraph.llm.runtime import Scratch, remainder, ship, table

MAX_POSITIVE, CURVATURE, STEPS, DECAY, CLIP = 8_000, 4_000, 16, 1e-3, 8.0
THRESHOLD = 0.3
_PUNCT = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
#: Byte classes: each ASCII punctuation mark, capital, small letter, digit, space, line feed, other control, non-ASCII.
_CLASS = np.full(256, len(_PUNCT) + 5, dtype=np.int64)
_CLASS[_PUNCT] = np.arange(len(_PUNCT))
for _k, _r in enumerate((range(65, 91), range(97, 123), range(48, 58), (32,), (10,))):
    _CLASS[list(_r)] = len(_PUNCT) + _k
_CLASS[128:] = len(_PUNCT) + 6
N_CLASS, N_SHAPE = len(_PUNCT) + 7, 64
WIDTH = N_CLASS + N_SHAPE + 4
_CASED = K.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)


_FLAGS = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), _PUNCT)]


def _inside(flag: np.ndarray, w: K.Words) -> np.ndarray:
    """How many flagged bytes each word has."""
    total = np.zeros(len(flag) + 1, dtype=np.int32)
    np.cumsum(flag, dtype=np.int32, out=total[1:])
    return total[w.end] - total[w.start]


def features(col: pa.Array) -> np.ndarray:
    """(rows, WIDTH) features; a null or empty text is a row of zeros."""
    out = np.zeros((len(col), WIDTH), dtype=np.float32)
    for lo, hi, buf, offs in K.chunks(*K.text_buffers(col)):
        n, size = hi - lo, np.diff(offs)
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * N_CLASS + _CLASS[buf], minlength=n * N_CLASS).reshape(n, N_CLASS)
        w = K.Words(buf, offs, _CASED)
        count = np.maximum(np.diff(w.first), 1)
        own = w.rows()
        caps, digits, marks = (_inside(flag[buf], w) for flag in _FLAGS)
        length = w.end - w.start
        opens = (buf[w.start] >= 65) & (buf[w.start] <= 90) if len(w) else np.zeros(0, bool)
        shape = opens + 2 * (caps * 2 > length) + 4 * (digits > 0) + 8 * np.minimum(marks, 1) + 16 * np.searchsorted([3, 8, 14], length)
        shapes = np.bincount(own * N_SHAPE + shape, minlength=n * N_SHAPE).reshape(n, N_SHAPE)
        pairs = np.sort((own.astype(K.U64) << K.U64(40)) | (w.hash >> K.U64(24)))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        distinct = np.bincount((pairs >> K.U64(40)).astype(np.int64), minlength=n)
        same = np.bincount(own[1:][(w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])], minlength=n)
        out[lo:hi, :N_CLASS] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
        out[lo:hi, N_CLASS : N_CLASS + N_SHAPE] = np.sqrt(shapes / count[:, None])
        out[lo:hi, -4:] = np.stack([np.log1p(np.diff(w.first)) / 10, distinct / count, np.sqrt(same / count), np.bincount(own, length, minlength=n) / count / 10], axis=1)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class PuModel:
    """Standardisation, weights (the last is the bias) and the prior they were fitted with."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(standard(x, self.mean, self.scale) @ self.weights)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features at unit scale, clipped, and a column of ones."""
    return np.concatenate([np.clip((x - mean) / scale, -CLIP, CLIP), np.ones((len(x), 1))], axis=1)


def matrix(col: pa.Array) -> np.ndarray:
    """Stored features of some rows."""
    return np.frombuffer(b"".join(v.as_buffer() for v in col), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def vectors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, x`` of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            x = features(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(own.mapInArrow(run, "doc_id long, x binary"), "features")


def sums(rows: DataFrame, of) -> np.ndarray:
    """The sum over all rows of ``of(features)``, a vector: one row a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + of(matrix(b["x"]))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["place", "v"])

    found = rows.select("x").mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()
    return np.array([r["v"] for r in found])


def risk_parts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of some standardised rows: how many, the sum of losses when called negative, and that sum's gradient."""
    z = x @ w
    return np.concatenate([[len(x), np.logaddexp(0, z).sum()], sigmoid(z) @ x])


def pu_gradient(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """Non-negative risk, the gradient to follow, and whether the negative part is at or above zero; ``unlabelled`` are `risk_parts`."""
    z = positive @ w
    n_u, s = unlabelled[0], sigmoid(z)
    negative = unlabelled[1] / n_u - prior * np.logaddexp(0, z).mean()
    plus, minus = prior * (s - 1) @ positive / len(z), unlabelled[2:] / n_u - prior * s @ positive / len(z)
    value = prior * np.logaddexp(0, -z).mean() + max(0.0, negative) + DECAY / 2 * float(w[:-1] @ w[:-1])
    decay = DECAY * np.append(w[:-1], 0)
    return value, (plus + minus + decay if negative >= 0 else -minus), negative >= 0


def naive_gradient(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, _: float) -> tuple[float, np.ndarray, bool]:
    """Plain logistic risk of positives against unlabelled rows."""
    z = positive @ w
    value = np.logaddexp(0, -z).mean() + unlabelled[1] / unlabelled[0] + DECAY / 2 * float(w[:-1] @ w[:-1])
    return value, (sigmoid(z) - 1) @ positive / len(z) + unlabelled[2:] / unlabelled[0] + DECAY * np.append(w[:-1], 0), True


def minimise(gradient, positive: np.ndarray, sample: np.ndarray, passes, prior: float, weight: float, start: np.ndarray) -> np.ndarray:
    """Newton steps: ``passes(w)`` sums `risk_parts` over all unlabelled rows; ``weight`` is that of the positives' curvature."""
    w, best, step = start, np.inf, 1.0
    kept, move = w, np.zeros_like(w)
    for _ in range(STEPS):
        value, g, whole = gradient(positive, passes(w), w, prior)
        if (value > best + 1e-9 or not whole) and best < np.inf and step > 1 / 16:  # too far: half the way
            step /= 2
            w = kept - step * move
            continue
        best, kept = value, w
        s, p = sigmoid(sample @ w), sigmoid(positive @ w)
        h = (sample * (s * (1 - s))[:, None]).T @ sample / len(sample) + weight * (positive * (p * (1 - p))[:, None]).T @ positive / len(positive)
        move = np.linalg.solve(h + (DECAY + 1e-2) * np.eye(len(w)), g)
        step = 1.0 if whole else 1 / 16
        w = kept - step * move
        if np.abs(move).max() < 1e-3:
            break
    return kept


def best_bin(unlabelled: np.ndarray, positive: np.ndarray, delta: float = 0.1) -> float:
    """Prior from the numbers of rows above each score threshold, each array from the highest threshold down to all rows."""
    n_u, n_p = max(unlabelled[-1], 1), max(positive[-1], 1)
    chance = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    share = positive / n_p
    use = np.flatnonzero(share > chance)
    at = use[np.argmin((unlabelled[use] / n_u + chance) / share[use])]
    return float(np.clip(unlabelled[at] / n_u / share[at], 0.01, 0.99))


def fit_pu(positive: np.ndarray, rows: DataFrame, sample: np.ndarray, prior: float | None = None) -> PuModel | None:
    """Non-negative PU fit with logistic loss over all ``rows`` (``x``); None without positives or unlabelled rows.

    ``sample`` are features of some of the rows. Without a ``prior`` it is estimated.
    """
    if not len(positive) or not len(sample):
        return None
    total = sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = total[0]
    mean = total[1 : 1 + WIDTH] / n
    scale = np.sqrt(np.maximum(total[1 + WIDTH :] / n - mean * mean, 0)) + 1e-3
    p, u = standard(positive, mean, scale), standard(sample, mean, scale)
    passes = lambda w: sums(rows, lambda x: risk_parts(standard(x, mean, scale), w))
    if prior is None:
        half, other = p[::2], p[1::2] if len(p) > 1 else p
        w = minimise(naive_gradient, half, u, passes, 0.0, 1.0, np.zeros(WIDTH + 1))
        edges = np.linspace(0, 1, 1001)
        above = lambda x: np.cumsum(np.histogram(sigmoid(x @ w), edges)[0][::-1]).astype(np.float64)
        prior = best_bin(sums(rows, lambda x: above(standard(x, mean, scale))), above(other))
    start = np.zeros(WIDTH + 1)
    start[-1] = np.log(prior / (1 - prior))
    # The positives' share of the risk is linear in the score: all curvature is the unlabelled rows'.
    return PuModel(mean, scale, minimise(pu_gradient, p, u, passes, prior, 0.0, start), prior)


def _sample(rows: DataFrame, ids: DataFrame, limit: int) -> np.ndarray:
    """Features of at most ``limit`` documents, those whose hashed id is smallest."""
    own = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = rows.join(F.broadcast(own), "doc_id").select("x").toArrow()
    x = matrix(found["x"].combine_chunks()) if found.num_rows else np.zeros((0, WIDTH))
    return x[np.lexsort(x.T[::-1])]


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", held: int = 0, modulus: int = 5, prior: float | None = None) -> PuModel | None:
    """A model from features ``doc_id, x``; labels, and texts, of held-out ids (crc32(id) mod ``modulus`` is ``held``) are not used.

    Positives are ids that have label 1 and no other; a repeated row counts as often as it stands.
    """
    ship(rows.sparkSession)
    rows = rows.where("doc_id is not null").where(remainder("doc_id", modulus) != held)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(remainder("doc_id", modulus) != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    positive = _sample(rows, own.where("y = 1").select("doc_id"), MAX_POSITIVE)
    return fit_pu(positive, rows, _sample(rows, rows.select("doc_id").distinct(), CURVATURE), prior)


def score(rows: DataFrame, model: PuModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of features; without a model every score is 0.5.

    Null and empty texts have features of zero and score like any others; a null id stays null, a repeated
    row is scored again, a score of exactly ``threshold`` is predicted 1, an empty table gives no rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.score(matrix(b["x"])) if held.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document scored, a fifth of the ids held out of training."""
    rows = vectors(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    out = score(rows, fit(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
