"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming blocks, exact check.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. An item and
a window of a document are compared by their distinct five-word shingles, weighted by
rarity among the items: contaminated if the shingles of the item that the window holds
carry at least 0.8 of the item's weight. An item of fewer words is one shingle, its whole sequence.

That bound means a window worth looking at shares a shingle with the item, so windows of
the item's size are laid where a shingle of the benchmark stands, aligned by its place in
the item. Each such window gets a 128-bit SimHash over its weighted words. Item
fingerprints are indexed by 16 blocks of eight bits; as 39 < 16 * 3, every item within
Hamming distance 39 has a block within distance 2, so probing each block's neighbourhood
finds all of them. What is within that radius is then compared exactly.

The radius has to be wide: a window that holds 0.8 of an item may have a fifth of foreign
words, 35 degrees or about 25 of 128 bits on average. At 39 bits most items share some
block's neighbourhood, so the blocks guarantee completeness here and thin little; it is the
placing of windows that keeps the work small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K
from lodegraph.llm.runtime import Scratch, table

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 39, 16
#: Items, and their words, held by one pass over the documents; a larger benchmark takes several passes, one after the other.
ITEMS_PER_PASS, WORDS_PER_PASS = 20_000, 1_000_000
_FILTER_BITS = 22


class ItemIndex:
    """Items of one pass: shingles with weights, anchors, fingerprints and their block index."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int = SHINGLE, radius: int = RADIUS, spread: Spread | None = None):
        with np.errstate(over="ignore"):
            self._build(ids, texts, shingle, radius, spread)

    def _build(self, ids: list[int], texts: list[str], shingle: int, radius: int, spread: Spread | None) -> None:
        self.shingle, self.radius = shingle, radius
        words = K.Words(*K.text_buffers(pa.array(texts, pa.string())), K.ALNUM_WORDS)
        lists = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        kept = [i for i, w in enumerate(lists) if len(w)]
        self.ids = [ids[i] for i in kept]
        self.words = [lists[i] for i in kept]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        #: Words of each item's shingles: five, or all of a shorter item.
        span = np.minimum(self.size, shingle)
        self.spans = sorted(set(span.tolist()))
        runs = [K.shingles(w, int(k)) ^ K.U64(int(k)) for w, k in zip(self.words, span, strict=True)]  # a shingle's length is part of its name
        sets = [np.unique(r) for r in runs]
        every, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, K.U64), np.zeros(0, int))
        n = len(sets)
        if spread:
            n, df = spread.items, spread.of(0, every)
        self.vocab, self.weight = every, np.log1p(n / np.maximum(df, 1))
        self.sets = [np.searchsorted(every, s) for s in sets]
        self.total = np.array([self.weight[s].sum() for s in self.sets])
        item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        offset = np.concatenate([np.arange(len(r)) for r in runs]) if runs else np.zeros(0, int)
        code = np.searchsorted(every, np.concatenate(runs)) if runs else np.zeros(0, int)
        self.span = np.full(len(every), shingle)
        self.span[code] = span[item] if len(item) else 0
        order = np.argsort(code, kind="stable")
        self.anchor_item, self.anchor_offset = item[order], offset[order]
        self.anchor_first = np.searchsorted(code[order], np.arange(len(every) + 1))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(every >> K.U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        known, wdf = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True) if self.words else (np.zeros(0, K.U64), np.zeros(0, int))
        if spread:
            wdf = spread.of(1, known)
        self.known, self.word_weight = known, np.log1p(n / np.maximum(wdf, 1))
        self.rare = float(np.log1p(max(n, 1)))
        self.prints = np.array([self.fingerprint(w) for w in self.words], dtype=np.uint8).reshape(-1, BLOCKS)
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        #: Values within reach of each value of a block, and each block's items in order of their value.
        self.near = [np.flatnonzero(apart[v] <= radius // BLOCKS) for v in range(256)]
        self.order = np.argsort(self.prints, axis=0, kind="stable").astype(np.int32)
        self.first = np.stack([np.searchsorted(self.prints[self.order[:, j], j], np.arange(257)) for j in range(BLOCKS)])

    def fingerprint(self, words: np.ndarray) -> np.ndarray:
        """128-bit SimHash of weighted words, as 16 bytes."""
        at = np.searchsorted(self.known, words)
        at[at == len(self.known)] = 0
        found = self.known[at] == words if len(self.known) else np.zeros(len(words), bool)
        weight = np.where(found, self.word_weight[at] if len(self.known) else 0.0, self.rare)
        halves = np.stack([words, K.mix(words + K.U64(0x2545F4914F6CDD1D))], axis=1)
        bits = np.unpackbits(halves.view(np.uint8).reshape(len(words), 16), axis=1).astype(np.float64)
        return np.packbits(weight @ (2 * bits - 1) > 0)

    def probe(self, window: np.ndarray) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        hit = np.zeros(len(self.prints), dtype=bool)
        for j in range(BLOCKS):
            near = self.near[window[j]]
            lo, n = self.first[j][near], self.first[j][near + 1] - self.first[j][near]
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            hit[self.order[at, j]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.prints[found] ^ window).sum(axis=1) <= self.radius]

    def matches(self, words: np.ndarray, codes: np.ndarray, places: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """For one document: item to (best similarity, first word of the first such window, windows).

        ``places`` are the positions of benchmark shingles, ascending, ``codes`` which ones.
        """
        n = self.anchor_first[codes + 1] - self.anchor_first[codes]
        anchor = np.arange(n.sum()) + np.repeat(self.anchor_first[codes] - np.cumsum(n) + n, n)
        size = self.size[self.anchor_item[anchor]]
        start = np.clip(np.repeat(places, n) - self.anchor_offset[anchor], 0, np.maximum(len(words) - size, 0))
        ends = places + self.span[codes]
        out: dict[int, tuple[float, int, int]] = {}
        for start, size in np.unique(np.stack([start, size], axis=1), axis=0).tolist():
            lo, hi = np.searchsorted(places, [start, start + size])
            held = np.unique(codes[lo:hi][ends[lo:hi] <= start + size])
            if not len(held):
                continue
            for i in self.probe(self.fingerprint(words[start : start + size])).tolist():
                share = self.sets[i][np.isin(self.sets[i], held, assume_unique=True)]
                score = float(self.weight[share].sum() / self.total[i])
                if score >= threshold - 1e-12:
                    best, first, n = out.get(i, (0.0, start, 0))
                    out[i] = (max(best, score), first, n + 1)
        return out

    def scan(self, col: pa.Array, threshold: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
        """(row, matches) of every row that has any."""
        if not len(self.vocab):
            return
        for lo, _, buf, offs in K.chunks(*K.text_buffers(col)):
            w = K.Words(buf, offs, K.ALNUM_WORDS)
            found = [self._places(w, k) for k in self.spans]
            place, code = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(place):
                continue
            order = np.lexsort((code, place))
            place, code = place[order], code[order]
            row = np.searchsorted(w.first, place, "right") - 1
            edge = np.searchsorted(row, np.arange(len(w.first)))
            for r in np.unique(row).tolist():
                own = slice(edge[r], edge[r + 1])
                if found := self.matches(w.hash[w.first[r] : w.first[r + 1]], code[own], place[own] - w.first[r], threshold):
                    yield lo + r, found

    def _places(self, w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the benchmark's shingles of ``k`` words, and which ones."""
        runs = K.shingles(w.hash, k) ^ K.U64(k)
        hit = np.flatnonzero(self.filter[(runs >> K.U64(64 - _FILTER_BITS)).astype(np.int64)])
        code = np.searchsorted(self.vocab, runs[hit])
        code[code == len(self.vocab)] = 0
        row = np.searchsorted(w.first, hit, "right") - 1
        sure = (self.vocab[code] == runs[hit]) & (hit + k <= w.first[row + 1])
        return hit[sure], code[sure]


class Spread:
    """Over the whole benchmark: how many items there are, and how many hold each shingle (kind 0) and word (kind 1)."""

    def __init__(self, items: DataFrame, shingle: int, scratch: Scratch):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for b in batches:
                w = K.Words(*K.text_buffers(b["t"]), K.ALNUM_WORDS)
                for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
                    if lo < hi:
                        own, k = w.hash[lo:hi], min(int(hi - lo), shingle)
                        for kind, h in ((0, np.unique(K.shingles(own, k) ^ K.U64(k))), (1, np.unique(own)), (2, np.zeros(1, K.U64))):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(h.view(np.int64))], names=["kind", "h"])

        counted = items.mapInArrow(run, "kind int, h long").groupBy("kind", "h").agg(F.count("*").alias("n"))
        self.counts = scratch.write(counted.where("n > 1 or kind = 2"), "spread")
        self.items = (self.counts.where("kind = 2").first() or {"n": 0})["n"]

    def of(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Of some hashes, those of one pass."""
        own = self.counts.sparkSession.createDataFrame(pa.table({"h": pa.array(hashes.view(np.int64))}))
        found = self.counts.where(F.col("kind") == kind).join(own, "h").select("h", "n").toArrow()
        out = np.ones(len(hashes), dtype=np.int64)
        out[np.searchsorted(hashes, found["h"].to_numpy().view(K.U64))] = found["n"].to_numpy()
        return out


def _batches(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, words = [], [], 0
    for r in items.orderBy("i", "t").toLocalIterator():
        n = len(r["t"]) // 2 + 1  # no text has more words
        if ids and (len(ids) == ITEMS_PER_PASS or words + n > WORDS_PER_PASS):
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        words += n
    yield ids, texts


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> Iterator[ItemIndex]:
    """The benchmark in passes of bounded size, in order of id; null texts are left out, repeated rows count once.

    Weights are those of the whole benchmark, whichever pass an item is in.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    passes = _batches(items)
    first, second = next(passes), next(passes, None)
    spread = Spread(items, shingle, Scratch(benchmark.sparkSession, "spread")) if second else None
    for ids, texts in chain([first, *([second] if second else [])], passes):
        yield ItemIndex(ids, texts, shingle, radius, spread)


def _passes(docs: DataFrame, benchmark: DataFrame, shingle: int, radius: int, run, scratch: Scratch) -> Iterator[DataFrame]:
    """``run(docs, index)`` for each pass; only the last is left to the caller's plan, so one index is held at a time."""
    before = None
    for index in indexes(benchmark, shingle=shingle, radius=radius):
        if before is not None:
            found, held = before
            yield scratch.write(found, "pass")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(index)
        before = run(docs, held), held
    yield before[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words, n_windows``, a row for each document and item that meet the threshold.

    Texts of any length are searched whole. Repeated rows of documents give repeated results; of equal
    benchmark rows one counts. A null or empty text matches nothing, a null id stays null; a similarity of
    exactly ``threshold`` counts; an empty table on either side gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(docs: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            x = held.value
            for b in batches:
                rows = [(b["doc_id"][r].as_py(), x.ids[i], s, first, int(x.size[i]), n) for r, found in x.scan(b["text"], threshold) for i, (s, first, n) in sorted(found.items())]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words", "n_windows"])

        return docs.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long, n_windows long")

    return reduce(DataFrame.union, _passes(docs, benchmark, shingle, radius, search, scratch))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns kept; no shuffle.

    Rows with a null or empty text stay, as do repeated rows; without items nothing goes.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    held = None
    for index in indexes(benchmark):
        if held is not None:  # one index at a time
            docs = scratch.write(docs, "pass")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[r for r, _ in held.value.scan(b.column(text_col), threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document that holds a benchmark item, with the item and the place."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; all columns of the others stay.

    Null and empty texts stay, as do repeated rows; an empty table stays empty.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))
