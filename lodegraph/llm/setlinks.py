"""Links between sets of Jaccard similarity at or above a threshold, found from MinHash buckets.

Members of a bucket are never paired off with each other wholesale. Since only the connected
classes matter, work goes in two steps (see `buckets`):

1. the pairs of each bucket's pivots are compared on their full sets;
2. members of large buckets that still hold several classes go through an exact set-similarity
   join among themselves: elements ordered from rare to frequent, only the first
   ``n - ceil(t n) + 1`` of each set can carry a first match, with size and position bounds.
   The order is that of a counting sketch of bounded size. Any order that all sets share makes
   the filter exact; a coarser one only makes it less selective. Elements whose holders all
   belong to one class are left out, as a link there changes nothing. Sets and classes go under
   numbers, and each carries a mask: parities of its elements at 128 places. Two masks differ at
   no more places than their sets do, so a pair that differs at too many is no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.components import components
from lodegraph.llm.runtime import Scratch

#: Longs of a mask.
MASKS = 2
#: Places of the counting sketch (4 MB) that orders elements.
COUNT_BITS = 20
_U = np.uint64
#: Sets as one flat array of 64-bit hashes and each set's first place; hashes may repeat within a set.
Sets = tuple[np.ndarray, np.ndarray]


def stored(items: pa.Array) -> Sets:
    """Sets kept as their distinct 64-bit hashes."""
    size = np.asarray(pc.binary_length(items)).astype(np.int64) >> 3
    flat = np.frombuffer(b"".join(x.as_buffer() for x in items), dtype=_U)
    return flat, np.concatenate([[0], np.cumsum(size)])


def bites(batch: pa.RecordBatch, *columns: str, limit: int = 1 << 18, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows whose columns hold at most ``limit`` bytes, or one longer row."""
    size = sum(np.asarray(pc.binary_length(batch[c])).astype(np.int64) for c in columns)
    edge, lo = np.concatenate([[0], np.cumsum(size)]), 0
    while lo < batch.num_rows:
        hi = min(max(int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1, lo + 1), batch.num_rows, lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def distinct(sets: Sets) -> np.ndarray:
    """Sorted distinct elements of up to 256 sets: the set's number in the top byte, 56 bits of the hash below."""
    flat, first = sets
    row = np.repeat(np.arange(len(first) - 1, dtype=_U), np.diff(first))
    out = np.sort(row << _U(56) | flat >> _U(8))
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def overlaps(p: Sets, q: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sets: size of the intersection and of both sets."""
    n = len(p[1]) - 1
    a, b = distinct(p), distinct(q)
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs: one merge
    shared = both[1:][both[1:] == both[:-1]]
    count = lambda x: np.bincount((x >> _U(56)).astype(np.int64), minlength=n)
    return count(shared), count(a), count(b)


def masks(items: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Parities of each set's elements by their lowest bits, from `distinct` and the sets' sizes."""
    end, place = np.cumsum(n), items % _U(64 * MASKS)
    out = []
    for k in range(MASKS):
        bit = np.where(place >> _U(6) == k, _U(1) << (place & _U(63)), _U(0))
        upto = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(bit)])
        out.append((upto[end] ^ upto[end - n]).view(np.int64))
    return out


class SetLinks:
    """``num / den`` is the threshold: linked when ``den * |A & B| >= num * |A | B|``.

    Candidates come by a 64-bit id, sets are named by nodes (``kind``: their type); two nodes may share an id. ``sets_of(column, keys)``
    returns at least the sets whose ``column`` (id or node) is in the one-column table ``keys``, as ``id, node, items binary``, from which
    ``expand`` makes 64-bit hashes. ``prune(pairs, column)`` may drop pairs that are below the threshold beyond reasonable doubt.
    """

    def __init__(self, scratch: Scratch, kind: str, num: int, den: int, sets_of: Callable[[str, DataFrame], DataFrame], prune: Callable[[DataFrame, str], DataFrame] | None = None, expand: Callable[[pa.Array], Sets] = stored, nodes: DataFrame | None = None):
        self.scratch, self.kind, self.num, self.den, self.sets_of, self.prune, self.expand, self.nodes = scratch, kind, num, den, sets_of, prune, expand, nodes

    def classes(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """``node, component`` of linked nodes (the smallest of a class has no row), from candidate pairs ``x, y`` and members of large buckets ``key, id``."""
        scratch = self.scratch
        links = self._verify(pairs, "id")
        label = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), scratch)
        if members.isEmpty():
            return label
        own = members.join(self.nodes, "id") if self.nodes is not None else members.withColumn("node", F.col("id"))
        named = own.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        named = scratch.write(named, "named")
        mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        rest = scratch.write(named.join(mixed, "key").select("node", "c").distinct().withColumn("id", F.monotonically_increasing_id()), "rest")
        scratch.drop(links, named)
        scratch.free()
        if not rest.isEmpty():
            lead = rest.groupBy("c").agg(F.min("id").alias("lead"))
            own = rest.join(lead, "c").select("node", "id", F.col("lead").alias("c"))
            held = scratch.write(self.sets_of("node", rest.select("node")).select("node", "items").join(own, "node"), "rest-sets")
            met, name = self._prefix_pairs(held), lambda end, key: rest.select(F.col("id").alias(key), F.col("node").alias(end))
            last = self._verify(met.join(name("x", "a"), "a").join(name("y", "b"), "b").select("x", "y"), "node", held)
            known = label.select(F.col("node").alias("u"), F.col("component").alias("v"))
            label = components(known.union(last.select("x", "y")), scratch)
            scratch.drop(last, held)
        scratch.drop(rest)
        return label

    def _prefix_pairs(self, held: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of ids whose classes differ, from ``id, c, items``, that pass the prefix, size, position and mask filters."""
        num, den, expand, scratch = self.num, self.den, self.expand, self.scratch

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
            for b in (x for batch in batches for x in bites(batch, "items")):
                total += np.bincount(((distinct(expand(b["items"])) << _U(8)) >> _U(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["place", "n"])

        found = held.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        spread = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        spread[found["place"].to_numpy()] = found["n"].to_numpy()
        known = held.sparkSession.sparkContext.broadcast(spread)

        def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            spread = known.value
            for b in (x for batch in batches for x in bites(batch, "items")):
                items = distinct(expand(b["items"]))
                row = (items >> _U(56)).astype(np.int64)
                often = spread[((items << _U(8)) >> _U(64 - COUNT_BITS)).astype(np.int64)]
                order = np.lexsort((items, often, row))
                n = np.bincount(row, minlength=b.num_rows)
                mask = masks(items, n)
                items, often = items[order], often[order]
                i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                # An element of one set alone pairs with nothing: it only takes up a place.
                at = np.flatnonzero((i < (n - (num * n + den - 1) // den + 1)[row]) & (often > 1))
                own = row[at]
                cols = [pa.array((items[at] << _U(8)).view(np.int64)), pa.array(n[own], pa.int32()), pa.array(i[at], pa.int32())]
                cols += [b[c].take(pa.array(own)) for c in ("id", "c")] + [pa.array(m[own]) for m in mask]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "n", "i", "id", "c", *bits])

        bits = [f"m{k}" for k in range(MASKS)]
        rows = scratch.write(held.mapInArrow(prefix, "item long, n int, i int, id long, c long" + "".join(f", {m} long" for m in bits)), "prefix")
        split = rows.groupBy("item").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("item")
        kept = scratch.write(rows.join(split, "item"), "split")
        scratch.drop(rows)
        # Both sides are one exchange. Shared items still possible from here must reach num/(num+den) of both sizes together.
        on = F.expr("q.item = p.item and (p.n < q.n or (p.n = q.n and p.id < q.id)) and q.c <> p.c") & F.expr(f"{den}L * p.n >= {num}L * q.n")
        on &= F.expr(f"least(q.n - q.i, p.n - p.i) * ({num}L + {den}) >= {num}L * (q.n + p.n)")
        on &= F.expr(f"({' + '.join(f'bit_count(q.{m} ^ p.{m})' for m in bits)}) * ({num}L + {den}) <= ({den}L - {num}) * (q.n + p.n)")
        both = kept.alias("q").join(kept.alias("p"), on).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))
        met = scratch.write(both.distinct(), "met")
        scratch.drop(kept)
        return met

    def _verify(self, pairs: DataFrame, by: str, sets: DataFrame | None = None) -> DataFrame:
        """Pairs of nodes whose full sets meet the threshold, from pairs ``x, y`` of their column ``by``; ``sets``: at least theirs, if they are at hand."""
        num, den, expand = self.num, self.den, self.expand
        pairs = self.scratch.write(self.prune(pairs, by) if self.prune else pairs, "pairs")
        if pairs.isEmpty():
            return self.scratch.spark.createDataFrame([], f"x {self.kind}, y {self.kind}")
        sets = self.sets_of(by, pairs.select(F.col("x").alias(by)).union(pairs.select("y")).distinct()) if sets is None else sets

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for b in (x for batch in batches for x in bites(batch, "p", "q")):
                shared, n, m = overlaps(expand(b["p"]), expand(b["q"]))
                yield pa.RecordBatch.from_arrays([b["x"], b["y"]], names=["x", "y"]).filter(pa.array(den * shared >= num * (n + m - shared)))

        side = lambda end, node, items: sets.select(F.col(by).alias(end), F.col("node").alias(node), F.col("items").alias(items))
        both = pairs.join(side("x", "u", "p"), "x").join(side("y", "v", "q"), "y").where("u <> v").select(F.col("u").alias("x"), F.col("v").alias("y"), "p", "q")
        links = self.scratch.write(both.mapInArrow(exact, f"x {self.kind}, y {self.kind}"), "links")
        self.scratch.drop(pairs)
        self.scratch.free()
        return links
