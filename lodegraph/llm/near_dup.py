"""MinHash near-duplicate documents with sequential Bayesian verification.

Candidates share one of 32 bands of five minima (a pair at 0.8 is missed with chance
3e-6). Their signatures are then compared 32 positions at a time; a pair is dropped as
soon as the posterior probability of reaching the threshold falls below ``miss``. The
survivors are confirmed on their full shingle sets. Documents with equal sets are one
class from the start, so copies are never paired off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import buckets as B
from lodegraph.llm import textkernel as K
from lodegraph.llm.bloom import build
from lodegraph.llm.components import components
from lodegraph.llm.minhash import MinHasher, posterior_floor
from lodegraph.llm.runtime import Scratch, table, tasks
from lodegraph.llm.setlinks import SetLinks

BANDS, ROWS, STEP = 32, 5, 32


def _shingle_rows(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges: shingle hashes, each row's first one, and the words' own hashes and firsts."""
    for lo, hi, buf, offs in K.chunks(*K.text_buffers(col)):
        w = K.Words(buf, offs, K.SPACE_WORDS)
        n = np.diff(w.first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        runs = K.shingles(w.hash, k)
        out = np.empty(int(count.sum()), dtype=K.U64)
        first = np.concatenate([[0], np.cumsum(count)])
        long = n >= k
        if long.any():
            src = np.repeat(w.first[:-1][long] - first[:-1][long], count[long]) + np.flatnonzero(np.repeat(long, count))
            out[np.repeat(long, count)] = runs[src]
        for r in np.flatnonzero(~long & (n > 0)):  # fewer words than a shingle: the whole sequence
            h = K.U64(0x51ED270B)
            for x in w.hash[w.first[r] : w.first[r + 1]]:
                h = K.mix(np.array([h * K.U64(0xA0761D6478BD642F) + x], dtype=K.U64))[0]
            out[first[r]] = h
        yield lo, hi, out, first


def _sketch(k: int, hasher: MinHasher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            for lo, hi, hashes, first in _shingle_rows(b["text"], k):
                sigs = hasher.signatures(hashes, first)
                keys = hasher.band_keys(sigs).view(np.int32)
                sigs = (sigs >> np.uint32(16)).astype(np.uint16)
                sizes, digests, i = [], [], 0
                out_sig, out_keys = [], []
                for r in range(hi - lo):
                    s = np.unique(hashes[first[r] : first[r + 1]])
                    sizes.append(len(s))
                    if len(s):
                        digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                        out_sig.append(sigs[i].tobytes())
                        out_keys.append(keys[i])
                        i += 1
                    else:
                        digests.append(None)
                        out_sig.append(None)
                        out_keys.append(None)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(out_sig, pa.binary()), pa.array(out_keys, pa.list_(pa.int32()))], names=["doc_id", "n", "digest", "sig", "keys"])

    return run


def _deal(slots: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = B.Dealer(BANDS, slots, num, den)
        for b in batches:
            keys = np.asarray(b["keys"].flatten()).view(np.uint32).reshape(-1, BANDS)
            dealer.add(keys, np.asarray(b["id"]), np.asarray(b["n"]))
            if dealer.full():
                yield from map(pa.RecordBatch.from_pydict, dealer.flush())
        yield from map(pa.RecordBatch.from_pydict, dealer.flush())

    return run


def _full_sets(k: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            b = b.filter(b["doc_id"].is_valid())
            b = b.filter(pa.array(wanted.value.has(np.asarray(b["doc_id"]))))
            for lo, hi, hashes, first in _shingle_rows(b["text"], k):
                sets = [np.unique(hashes[first[r] : first[r + 1]]).tobytes() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "items"])

    return run


def _bayes(threshold: float, miss: float):
    floors = posterior_floor(BANDS * ROWS, STEP, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BANDS * ROWS
        for b in batches:
            if not b.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(z.as_buffer() for z in b[c]), dtype=np.uint16).reshape(-1, width) for c in ("p", "q"))
            alive, agreed, at = np.arange(len(p)), np.zeros(len(p), dtype=np.int32), 0
            for n, floor in floors:
                agreed[alive] += (p[alive, at:n] == q[alive, at:n]).sum(axis=1, dtype=np.int32)
                alive, at = alive[agreed[alive] >= floor], n
            yield pa.RecordBatch.from_arrays([b["x"], b["y"]], names=["x", "y"]).take(pa.array(alive))

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without ASCII white space after lower-casing A-Z; a set holds the
    distinct ``shingle``-word runs, or the whole sequence of a shorter text. Null, empty
    and blank texts have an empty set and stay alone. Linked: ``den * |A & B| >= num *
    |A | B|``; texts of any length are compared whole. The smallest id of a class is kept, so
    ties do not arise. Rows that share an id are one document: each counts its own shingles, whatever any of their
    texts is linked with is in their class. A null id is never linked and is kept; an empty table gives no rows. Other
    columns are not read.

    Sets are known by their digest (and candidates by 64 bits of it), never by an id, so the result does not depend on which of
    several rows with one id a task meets first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hasher = MinHasher(BANDS, ROWS)
    sketch = scratch.write(docs.mapInArrow(_sketch(shingle, hasher), "doc_id long, n long, digest binary, sig binary, keys array<int>"), "sketch")
    known = sketch.where("doc_id is not null and digest is not null")
    same = scratch.write(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "same")
    first = (known["digest"] == same["digest"]) & (F.col("doc_id") == F.col("rep"))
    reps = known.join(same, first, "left_semi").dropDuplicates(["digest"])
    reps = scratch.write(reps.select(F.xxhash64("digest").alias("id"), F.col("digest").alias("node"), "doc_id", F.col("n").cast("int").alias("n"), "sig", "keys"), "reps")
    slots = B.n_slots(docs, BANDS, tasks(docs.sparkSession))
    multi = scratch.write(B.collisions(reps.select("id", "n", "keys").mapInArrow(_deal(slots, num, den), B.SCHEMA), BANDS, slots, num, den), "multi")

    def sets_of(by: str, keys: DataFrame) -> DataFrame:
        wanted = scratch.write(keys.select(by).join(reps.select("id", "node", "doc_id"), by), "wanted")
        held = docs.sparkSession.sparkContext.broadcast(build(wanted, "doc_id"))
        found = docs.mapInArrow(_full_sets(shingle, held), "node binary, items binary")
        return scratch.write(found.join(wanted.select("id", "node"), "node").dropDuplicates(["node"]).select("id", "node", "items"), "sets")

    def prune(pairs: DataFrame, by: str) -> DataFrame:
        sig = reps.select(F.col(by).alias("x"), F.col("sig").alias("p"), "n")
        other = sig.select(F.col("x").alias("y"), F.col("p").alias("q"), F.col("n").alias("m"))
        both = pairs.join(sig, "x").join(other, "y").where(f"{den}L * least(n, m) >= {num}L * greatest(n, m)")
        return both.select("x", "y", "p", "q").mapInArrow(_bayes(num / den, miss), "x long, y long" if by == "id" else "x binary, y binary")

    scratch.free()
    label = SetLinks(scratch, "binary", num, den, sets_of, prune, nodes=reps.select("id", "node")).classes(B.pairs(multi), B.members(multi))
    scratch.drop(multi)
    classes = scratch.write(same.join(label, F.col("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", "digest").alias("c")), "classes")
    scratch.drop(reps)
    # An id that names several texts holds their classes together.
    several = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    of_id = scratch.write(known.join(several, "doc_id").select("doc_id", "digest").join(classes, "digest").select("doc_id", "c").distinct(), "several")
    if not of_id.isEmpty():
        lowest = of_id.groupBy("doc_id").agg(F.min("c").alias("v"))
        joined = components(of_id.join(lowest, "doc_id").select(F.col("c").alias("u"), "v"), scratch)
        classes = scratch.write(classes.join(joined, F.col("c") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", "c").alias("c")), "classes")
    smallest = classes.groupBy("c").agg(F.min("rep").alias("component"))
    found = scratch.write(classes.join(smallest, "c").select("digest", "component"), "found")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: two-word shingles, similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), shingle=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates (five-word shingles, 0.8); all columns stay.

    Of rows with the same id and text one stays. Documents without words, and rows without an id, stay; an
    empty table stays empty.
    """
    found = near_duplicates(docs, Scratch(spark, "stage-near"), shingle=5)
    found = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("doc_id is not null")
    odd = found.where("not kept or n > 1").select(F.col("doc_id").alias("_odd"), F.col("kept").alias("_odd_kept"))
    once = docs.join(odd, docs["doc_id"] == odd["_odd"], "left_anti")
    again = odd.where(odd["_odd_kept"])
    twice = docs.join(again, docs["doc_id"] == again["_odd"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)
