"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors of any length are put on the unit sphere by the usual extra coordinate
(so the nearest in angle is the largest inner product), centred, and turned by two
rotations learned by iterative quantisation on a bounded sample; the signs are 128 bits.
Codes are split into eight 16-bit substrings, each indexed by value. If a code lies within
Hamming radius ``r`` of a query's, one of its substrings lies within ``r // 8``
(pigeonhole), so probing each substring's values within that distance retrieves every such
code. What is retrieved is reranked by the inner product of the original vectors in double
precision. The radius is the one that holds ``TARGET`` of the true neighbours of sample
queries in the sample; neighbours in the full table are nearer still.

Codes are computed once. Queries are written once, as a table in the shared folder; each task
indexes its rows, reads the queries block by block and answers them; only its best ``k`` a
query leave the task. No pair is shuffled, and no query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.runtime import Scratch, table

SAMPLE, SAMPLE_QUERIES, ROTATIONS, ITERATIONS, TARGET = 10_000, 400, 2, 30, 0.985
SUBSTRINGS = 8
QUERY_BLOCK, INDEX_BLOCK = 4_096, 65_536
_POP16 = np.bitwise_count(np.arange(65536, dtype=np.uint16))


class Codes:
    """The learned code: scale, centre and rotations, 64 bits a rotation (as many as 64 leading directions, repeated if there are fewer)."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 3):
        self.longest = max(longest, 1e-300)
        x = self._lift(sample)
        self.centre = x.mean(axis=0)
        x = x - self.centre
        dim = x.shape[1]
        vt = np.linalg.eigh(x.T @ x)[1].T[::-1]
        rng, parts = np.random.default_rng(seed), []
        width = min(64, dim)
        for _ in range(ROTATIONS):
            v = x @ vt[:width].T
            r = np.linalg.qr(rng.standard_normal((width, width)))[0]
            for _ in range(ITERATIONS):
                b = np.sign(v @ r)
                u, _, wt = np.linalg.svd(b.T @ v)
                r = (u @ wt).T
            parts.append(vt[:width].T @ r)
        self.turn = np.concatenate(parts, axis=1)
        self.turn = np.tile(self.turn, (1, -(-64 * ROTATIONS // self.turn.shape[1])))[:, : 64 * ROTATIONS]

    def _lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def _sign(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1).view(np.uint16)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._sign(self._lift(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        """A query's length has no say in the order of its neighbours."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._sign(np.concatenate([x, np.zeros((len(x), 1))], axis=1))


def radius(codes: Codes, sample: np.ndarray, k: int) -> int:
    """Hamming radius that holds ``TARGET`` of the sample queries' true neighbours in the sample."""
    n = min(SAMPLE_QUERIES, len(sample))
    s = sample[:n] @ sample.T
    s[np.arange(n), np.arange(n)] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 64 * ROTATIONS
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    q, r = codes.queries(sample[:n]), codes.rows(sample)
    far = np.bitwise_count(q[:, None, :] ^ r[near]).sum(axis=2)
    return int(np.quantile(far, TARGET, method="higher"))


class MultiIndex:
    """Codes of some rows, with rows by value for each 16-bit substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.append(first, len(codes)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the Hamming radius: every one, by the pigeonhole bound on its substrings."""
        near, found = radius // self.codes.shape[1], np.zeros(len(self.codes), dtype=bool)
        for (values, first, order), part in zip(self.tables, code, strict=True):
            hit = np.flatnonzero(_POP16[values ^ part] <= near)
            if len(hit) == len(values):
                found[:] = True
                break
            size = first[hit + 1] - first[hit]
            at = np.arange(size.sum()) + np.repeat(first[hit] - np.cumsum(size) + size, size)
            found[order[at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _usable(vec: str) -> str:
    return f"size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vec}, x -> x <> 0) and aggregate({vec}, 0D, (s, x) -> s + x * x) between 1e-300D and 1e300D"


def search(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target_radius: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found, ties to the smaller id.

    An id is one query however many rows it has: that of its smallest vector, component by component. A query never finds a row of
    its own id; other repeated rows are each found. Rows whose id or
    vector is null, zero, empty, of another length than most (of equally frequent lengths the
    smaller counts), or holds a null or non-finite component take no part, and neither do vectors
    whose length overflows a double. Vectors may have any number of components; an empty table gives
    no rows; other columns are not read. A task that finds fewer than ``k`` within the radius
    widens it, up to all of its rows, so no query goes short.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "ann")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null").where(_usable("v"))
    base, queries = pick(base), pick(queries)
    empty = "query_id long, rank int, vec_id long, score double"
    shape = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")).alias("longest")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], empty)
    dim, longest = shape["d"], shape["longest"]
    base = base.where(F.size("v") == dim)
    queries = queries.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = np.asarray(picked.flatten(), dtype=np.float64).reshape(-1, dim)
    codes = Codes(sample, longest)
    reach = target_radius if target_radius is not None else radius(codes, sample, k)
    model = spark.sparkContext.broadcast((codes, reach))

    def encode(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learned = model.value[0]
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.asarray(b["v"].flatten()).reshape(-1, dim)
                code = learned.rows(x) if kind == "rows" else learned.queries(x)
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary())], names=["vec_id", "v", "code"])

        return run

    coded = "vec_id long, v binary, code binary"
    asked = scratch.write(queries.mapInArrow(encode("queries"), coded), "queries")
    place = asked._lodegraph_path

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model.value[1]
        for own, x, code in _rows(batches, dim, INDEX_BLOCK):
            index, out = MultiIndex(code), []
            for qid, qv, qc in _rows(_stored(place), dim, QUERY_BLOCK):
                for i in range(len(qid)):
                    r = reach
                    while True:
                        found = index.within(qc[i], r)
                        found = found[own[found] != qid[i]]
                        if len(found) >= k or r >= 64 * ROTATIONS:
                            break
                        r += SUBSTRINGS
                    score = x[found] @ qv[i]
                    if len(found) > k:
                        bar = np.partition(score, len(score) - k)[len(score) - k]
                        found, score = found[score >= bar], score[score >= bar]
                    order = np.lexsort((own[found], -score))[:k]
                    out.append((np.full(len(order), qid[i]), own[found[order]], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])
                    out = []

    out = base.mapInArrow(encode("rows"), coded).mapInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stored(place: str) -> Iterator[pa.RecordBatch]:
    """Rows of a written table, file by file; Spark's marker files begin with an underscore."""
    store, root = fs.FileSystem.from_uri(place)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".parquet"))
    for f in files:
        with store.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(QUERY_BLOCK)


def _rows(batches: Iterator[pa.RecordBatch], dim: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and codes, about ``block`` rows at a time."""
    held, n = [], 0

    def whole():
        ids, v, code = (pa.chunked_array([b[c] for b in held]).combine_chunks() for c in ("vec_id", "v", "code"))
        raw = lambda col, t: np.frombuffer(b"".join(x.as_buffer() for x in col), dtype=t)
        return np.asarray(ids), raw(v, np.float64).reshape(-1, dim), raw(code, np.uint16).reshape(-1, SUBSTRINGS)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= block:
            yield whole()
            held, n = [], 0
    if n:
        yield whole()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: 20 nearest of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
