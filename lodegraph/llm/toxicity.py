"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word beginnings, word pairs and pairs over one gap of a
text, hashed to 2**20 places. Training is FTRL-proximal: each weight has its own learning rate and L1
keeps it at zero until its evidence exceeds a bound, so what remains is a short list of
(place, weight) that every scoring task can hold.

The model is fitted on at most ``MAX_ROWS`` labelled rows (those whose hashed id is
smallest), streamed once through one task that keeps only feature numbers. Scoring reads
every whole text, in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K
from lodegraph.llm.runtime import remainder, ship, table

BITS, MAX_ROWS, EPOCHS = 20, 12_000, 4
#: Word beginnings of these byte lengths are features too: inflected forms share a stem.
STEMS = (6, 7, 8, 9)
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.5
THRESHOLD = 0.7


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: the row and the place of each word, pair and skip-pair."""
    for lo, hi, buf, offs in K.chunks(*K.text_buffers(col)):
        w = K.Words(buf, offs, K.ALNUM_WORDS)
        row = w.rows()
        rows, places = [row], [w.hash]
        for n in STEMS:
            long = np.flatnonzero(w.end - w.start > n)
            rows.append(row[long])
            places.append(w.prefixes(long, n))
        gap = K.mix(w.hash[:-2] * K.U64(0xE7037ED1A0B428DB) + w.hash[2:]) if len(w) > 2 else w.hash[:0]
        pair = K.shingles(w.hash, 2)
        same1, same2 = row[1:] == row[:-1], row[2:] == row[:-2]
        place = np.concatenate([*places, pair[same1], gap[same2[: len(gap)]]]) >> K.U64(64 - BITS)
        yield lo, hi, np.concatenate([*rows, row[:-1][same1], row[:-2][same2]]), place.astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss with 0/1 features."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bz = self.bn = 0.0

    def _weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    @property
    def bias(self) -> float:
        return -self.bz / ((self.beta + self.bn**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self._weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        sigma = ((self.bn + g * g) ** 0.5 - self.bn**0.5) / self.alpha
        self.bz += g - sigma * self.bias
        self.bn += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self._weights(slice(None))
        at = np.flatnonzero(w)
        return at, w[at]


def fit_rows(texts: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> Ftrl:
    model, order = Ftrl(1 << BITS), np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(texts)):
            model.learn(texts[i], labels[i])
    return model


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    rows = []
    for b in batches:
        ids, labels = b["doc_id"].to_pylist(), b["label"].to_pylist()
        for lo, hi, row, place in features(b["text"]):
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
            row, place = row[new], place[new].astype(np.int32)
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            rows += [(ids[lo + r], labels[lo + r], place[edge[r] : edge[r + 1]].copy()) for r in range(hi - lo)]
    rows.sort(key=lambda x: (x[0], x[1], len(x[2])))
    if rows:
        model = fit_rows([x[2] for x in rows], [x[1] for x in rows])
        at, w = model.sparse()
        at, w = np.append(at, -1), np.append(w, model.bias)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["place", "weight"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, held: int, modulus: int, limit: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``limit`` labelled rows that are not held out (crc32(id) mod ``modulus`` is not ``held``).

    The limit is taken on ids, before any text is read, and the ids are then few enough to broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(f"doc_id is not null and label is not null")
    own = own.where(remainder("doc_id", modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text")


class Weights:
    """What training leaves: the places that have a weight, and the bias (None where there was nothing to learn from)."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float | None):
        self.places, self.weights, self.bias = places.astype(np.int32), weights.astype(np.float32), bias

    def table(self) -> np.ndarray:
        """All 2**20 places, 4 MB, for one task."""
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.places] = self.weights
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: int = 1, modulus: int = 3, limit: int = MAX_ROWS) -> Weights:
    """Weights from at most ``limit`` labelled rows; of several labels of an id the largest counts."""
    ship(docs.sparkSession)
    # A shuffle of at most ``limit`` rows: coalescing instead would read all documents in one task.
    found = labelled(docs, labels, label, held, modulus, limit).repartition(1).mapInArrow(_train, "place long, weight double").toArrow()
    place, weight = found["place"].to_numpy(), found["weight"].to_numpy()
    bias = weight[place < 0]
    return Weights(place[place >= 0], weight[place >= 0], float(bias[0]) if len(bias) else None)


def scores(col: pa.Array, weights: np.ndarray, bias: float | None) -> np.ndarray:
    """Score of each row; without a model every score is 0.5."""
    out = np.full(len(col), 0.0 if bias is None else bias)
    for lo, _, row, place in features(col):
        w = weights[place]
        hit = np.flatnonzero(w)
        if len(hit):
            pairs = np.unique((row[hit] << BITS) | place[hit])
            np.add.at(out, lo + (pairs >> BITS), weights[pairs & ((1 << BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row; whole texts of any length.

    Null and empty texts score as texts without features. A null id stays null, a repeated row is scored again, a score of exactly
    ``threshold`` is predicted 1, an empty table gives no rows. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        weights = held.value.table()
        for b in batches:
            s = scores(b["text"], weights, held.value.bias)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document scored, a third of the ids held out of training."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go; all columns of the others stay, without a shuffle.

    Rows are judged one by one, so repeated rows stay or go together, and rows without an id, or with a null or empty
    text, are judged like any others; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        weights = held.value.table()
        for b in batches:
            yield b.filter(pa.array(scores(b["text"], weights, held.value.bias) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
