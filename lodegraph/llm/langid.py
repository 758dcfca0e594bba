"""Language identification by mixtures: expectation-maximisation over words, sets by penalised likelihood.

Each language has a distribution over hashed byte trigrams of lower-cased words with their
edges, counted over all training documents. A word's likelihood in a language is the
product over its trigrams. A document is a mixture: EM estimates the share of each
language from its words. Nested sets (the likeliest language, the likeliest two, ... up to all) are
refitted and the set with the lowest penalised likelihood (BIC) is chosen; its largest
share is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K
from lodegraph.llm.runtime import remainder, ship, table

BITS, SMOOTH, FULL_ROUNDS, SET_ROUNDS = 18, 0.5, 6, 3
_WORD_LIMIT = 12.0  # natural-log span between languages that a single word may decide


def _grams(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte of each word and one for its end; 0 marks an edge. Also the word's start among them."""
    c = w.codes.astype(np.uint32)
    c1 = np.empty_like(c)
    c1[1:] = c[:-1]
    c1[w.start] = 0
    c0 = np.empty_like(c)
    c0[1:] = c1[:-1]
    c0[w.start] = 0
    inside = c != 0
    gram = ((c0 << np.uint32(16) | c1 << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    last = w.end - 1
    end = ((c1[last] << np.uint32(16) | c[last] << np.uint32(8)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at = np.cumsum(inside)[last]
    return np.insert(gram[inside], at, end).astype(np.int64), np.concatenate([[0], at[:-1] + np.arange(1, len(at))]) if len(at) else at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b["lang"].to_pylist(), dtype=object)
        for lo, hi, buf, offs in K.chunks(*K.text_buffers(b["text"])):
            w = K.Words(buf, offs, K.ALNUM_WORDS)
            if not len(w):
                continue
            gram, first = _grams(w)
            edge = np.append(first, len(gram))[w.first]
            for r in range(hi - lo):
                t = totals.setdefault(langs[lo + r], np.zeros(1 << BITS, dtype=np.int64))
                own = gram[edge[r] : edge[r + 1]]
                np.add.at(t, own, 1)
    for lang, t in totals.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], names=["lang", "gram", "n"])


class Model:
    """Log-probabilities by language, float32 ``(languages, 2**18)``."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * counts.shape[1])).astype(np.float32)

    def words(self, w: K.Words) -> np.ndarray:
        """(languages, words): likelihood of each word, the best language at 1, none below the limit."""
        gram, first = _grams(w)
        s = np.stack([np.add.reduceat(p[gram], first) for p in self.logp])
        s -= s.max(axis=0)
        return np.exp(np.maximum(s, -_WORD_LIMIT))

    @staticmethod
    def _em(like: np.ndarray, first: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares (languages, rows) and log-likelihood of each row after some rounds of EM; every row has words."""
        r = np.empty_like(like)
        for i in range(rounds + 1):
            for k in range(len(like)):
                np.multiply(like[k], np.repeat(share[k], count), out=r[k])
            total = r.sum(axis=0)
            if i == rounds:
                return share, np.add.reduceat(np.log(total + np.float32(1e-30)), first)
            np.divide(1, total, out=total)
            share = np.stack([np.add.reduceat(np.multiply(x, total, out=x), first) / count for x in r]).astype(np.float32)

    def infer(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages): shares within each row's chosen set; rows without words have zeros. And which rows have words."""
        k, n_rows = len(self.langs), len(w.first) - 1
        out, some = np.zeros((n_rows, k)), np.diff(w.first) > 0
        if not some.any() or not k:
            return out, some
        first = w.first[:-1][some]
        count = np.diff(np.append(first, len(w)))
        like = self.words(w)
        full, _ = self._em(like, first, count, np.full((k, len(first)), 1 / k, dtype=np.float32), FULL_ROUNDS)
        order = np.argsort(-full, axis=0, kind="stable")
        best, chosen = np.full(len(first), np.inf), np.zeros((k, len(first)))
        for m in range(1, k + 1):
            start = np.zeros_like(full)
            np.put_along_axis(start, order[:m], np.take_along_axis(full, order[:m], axis=0) + np.float32(1e-3), axis=0)
            start /= start.sum(axis=0)
            share, ll = self._em(like, first, count, start, SET_ROUNDS if m > 1 else 0)
            cost = -2 * ll + (2 * m - 1) * np.log(count + 1)
            take = cost < best
            best[take], chosen[:, take] = cost[take], share[:, take]
        out[some] = chosen.T
        return out, some


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 1, modulus: int = 3) -> Model:
    """Trigram counts of every training document (crc32(id) mod ``modulus`` is not ``held``, language not null).

    Counts are summed in each task and then by (language, trigram): what reaches the driver is
    bounded by languages times 2**18, whatever the corpus.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where("lang is not null and i is not null").where(remainder("i", modulus) != held).select("text", "lang")
    found = own.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    own = names.dictionary.to_pylist()
    langs = sorted(own)
    counts = np.zeros((len(langs), 1 << BITS))
    code = np.array([langs.index(x) for x in own], dtype=np.int64)
    counts[code[np.asarray(names.indices)], found["gram"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, langs, shares`` for every row.

    ``score`` is the predicted language's share; ``langs`` the chosen set, largest share first.
    Texts that are null, or without a letter, and all texts if no language was learned: ``und``, 0. Texts of any length
    are read whole; equal shares go by the languages' names; a repeated row is judged again, a null id stays null, an
    empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore", under="ignore")
        m = held.value
        for b in batches:
            for lo, hi, buf, offs in K.chunks(*K.text_buffers(b["text"])):
                shares, some = m.infer(K.Words(buf, offs, K.ALNUM_WORDS))
                ascii_letter = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122) & (buf < 128))])[offs]
                for r in np.flatnonzero(some & (np.diff(ascii_letter) == 0)):
                    some[r] = any(ch.isalpha() for ch in b["text"][lo + int(r)].as_py())
                pred, score, langs, weights = [], [], [], []
                for r in range(hi - lo):
                    at = np.argsort(-shares[r], kind="stable") if some[r] and len(m.langs) else []
                    at = [i for i in at if shares[r][i] > 0]
                    pred.append(m.langs[at[0]] if at else "und")
                    score.append(min(1.0, float(shares[r][at[0]])) if at else 0.0)
                    langs.append([m.langs[i] for i in at])
                    weights.append([float(shares[r][i]) for i in at])
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every document, a third of the ids held out of training."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))
