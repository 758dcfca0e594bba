"""Distributed connected components: unions inside tasks, star steps between them.

Edges ``(u, v)`` are longs or binaries. Each round first joins up what meets in one task (every
node then has one edge, to the smallest node of its part), with tasks of a bounded number of
edges. Only if several tasks are needed do large-star and small-star steps follow: grouped
minima (pre-aggregated before their shuffle, so a hub with millions of neighbours is one row a
task) and equi-joins back, which adaptive execution splits when a hub is hot. Nothing is
gathered to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.runtime import Scratch

#: Edges that one task joins up.
EDGES_PER_TASK = 1_000_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
    return up


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for b in batches:
        u.append(b["u"])
        v.append(b["v"])
    if not u:
        return
    n = sum(map(len, u))
    both = pa.chunked_array([*u, *v]).combine_chunks().dictionary_encode()
    names, code = both.dictionary, np.asarray(both.indices)
    order = np.asarray(pc.sort_indices(names))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]
    top = roots(code[:n], code[n:], len(names))
    low = np.flatnonzero(top != np.arange(len(top)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order[low])), names.take(pa.array(order[top[low]]))], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Every node has one parent or is one, never both: one pre-aggregated shuffle."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``(node, component)`` for every node of an edge but the smallest of each component; component is the smallest node reachable.

    Loops and repeated edges are allowed; nulls are dropped; no edges give an empty table.
    """
    kind = dict(edges.dtypes)["u"].replace("bigint", "long")
    cur = scratch.write(edges.where("u is not null and v is not null and u <> v").select("u", "v"), "edges")
    while True:
        tasks = max(1, -(-cur.count() // per_task))
        nxt = scratch.write(cur.coalesce(tasks).mapInArrow(_join_up, f"u {kind}, v {kind}"), "joined")
        scratch.drop(cur)
        cur = nxt
        if tasks == 1 or _is_star(cur):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        nxt = scratch.write(_small_star(_large_star(cur)), "star")
        scratch.drop(cur)
        cur = nxt
