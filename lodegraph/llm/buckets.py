"""Buckets of MinHash bands, found in packed arrays and never expanded into all pairs.

Every task keeps (band, key, id) entries of its rows and sends them off as one binary blob a
slot (a slot is a range of keys of one band). The task that gets a slot sorts its entries and
yields pairs of the ids of each bucket: every pair in buckets of up to ``SMALL`` ids, in larger
ones the pairs of the first ``PIVOTS`` ids with all others. Pairs whose sets' sizes differ too much are left out. The ids of larger buckets are listed
too, for the exact join of `setlinks`. A bucket of more than ``HOT`` ids in one task is paired
off there in the same way, and only its first ids travel, so no task ever gathers a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL, PIVOTS, HOT, FLUSH = 8, 4, 64, 2_000_000
#: Input bytes for which one slot of each band is enough (about 70 MB of entries a slot).
BYTES_PER_SLOT = 1 << 30


#: An entry: a band's key, the id, and the size of its set on a scale of ``STEPS`` to a factor of 5/4.
ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("size", "<u2")])
STEPS = 16


def scaled(size: np.ndarray) -> np.ndarray:
    """Sizes on a log scale. Sets of similarity t differ by at most ``-log t`` on it (plus one step for rounding), so others are no candidates."""
    return (np.log(np.maximum(size, 1)) * (STEPS / np.log(1.25))).astype(np.uint16)


def n_slots(df: DataFrame, bands: int, least: int) -> int:
    """Slots a band: by the estimated size of the input, and enough for ``least`` tasks over all bands."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(-(-size // BYTES_PER_SLOT), -(-least // bands), 1) if size < 1 << 56 else -(-least // bands)


#: Dealt rows: entries of a slot, or (with no entries, under any slot) a pair ``x, y`` or a member ``x`` of the large bucket ``key``.
SCHEMA = "slot int, entries binary, key long, x long, y long"
FOUND = "key long, x long, y long"


def _rows(n: int, **cols) -> dict[str, pa.Array]:
    kinds = {"slot": pa.int32(), "entries": pa.binary(), "key": pa.int64(), "x": pa.int64(), "y": pa.int64()}
    return {c: pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in kinds.items()}


def _paired(ids: np.ndarray, size: np.ndarray, head: np.ndarray, count: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the ids of each bucket whose sizes are within ``reach`` steps; buckets lie one after the other."""
    start = np.repeat(head, count)
    pos = np.arange(len(start)) - start
    until = np.minimum(pos, np.repeat(np.where(count <= SMALL, SMALL, PIVOTS), count))
    for r in range(SMALL):
        at = np.flatnonzero(until > r)
        if not len(at):
            return
        first = start[at] + r
        near = np.abs(size[at].astype(np.int32) - size[first]) <= reach
        yield ids[first[near]], ids[at[near]]


class Dealer:
    """Entries of one task. ``num / den`` is the similarity that pairs must reach."""

    def __init__(self, bands: int, slots: int, num: int, den: int):
        self.bands, self.slots, self.held, self.n = bands, slots, [], 0
        self.reach = size_reach(num, den)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``keys``: a row an id, a column a band."""
        self.held.append((keys, ids, scaled(sizes)))
        self.n += keys.size

    def full(self) -> bool:
        return self.n > FLUSH

    def flush(self) -> Iterator[dict[str, pa.Array]]:
        if not self.n:
            return
        keys, ids, size = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        ids, at = np.unique(ids, return_index=True)
        keys, size = keys[at], size[at]
        for band in range(self.bands):
            order = np.argsort(keys[:, band], kind="stable")
            k, own, s = keys[order, band], ids[order], size[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(head, len(k)))
            if (count > HOT).any():
                inside = np.repeat(count > HOT, count)
                hot, many = own[inside], count[count > HOT]
                first = np.cumsum(many) - many
                pos = np.arange(len(hot)) - np.repeat(first, many)
                # Under slots in turn, as no task need see them together.
                turn = lambda n: np.arange(n) % (self.bands * self.slots)
                yield _rows(len(hot), slot=turn(len(hot)), key=(band << 32) | k[inside].astype(np.int64), x=hot)
                for x, y in _paired(hot, s[inside], first, many, self.reach):
                    yield _rows(len(x), slot=turn(len(x)), x=x, y=y)
                keep = ~inside
                keep[inside] = pos <= SMALL  # so many that the bucket counts as a large one wherever it goes
                k, own, s = k[keep], own[keep], s[keep]
            entries = np.empty(len(k), dtype=ENTRY)
            entries["key"], entries["id"], entries["size"] = k, own, s
            slot = (k % np.uint32(self.slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            edge = np.searchsorted(slot[order], np.arange(self.slots + 1))
            used = np.flatnonzero(np.diff(edge))
            yield _rows(len(used), slot=band * self.slots + used, entries=[entries[order[edge[i] : edge[i + 1]]].tobytes() for i in used])


def size_reach(num: int, den: int) -> int:
    return int(np.ceil(np.log(den / num) * STEPS / np.log(1.25))) + 1


def _gather(slots: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            done = b.filter(b["entries"].is_null())
            if done.num_rows:
                yield done.select(["key", "x", "y"])
            b = b.filter(b["entries"].is_valid())
            for slot, blob in zip(b["slot"].to_pylist(), b["entries"].to_pylist(), strict=True):
                held.setdefault(slot, []).append(blob)
        for slot in sorted(held):
            entries = np.frombuffer(b"".join(held.pop(slot)), dtype=ENTRY)
            entries = entries[np.lexsort([entries["id"], entries["key"]])]
            k, ids = entries["key"], entries["id"]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (ids[1:] != ids[:-1])])
            k, ids, size = k[new], ids[new], entries["size"][new]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(head, len(k)))
            out, large = [], np.repeat(count > SMALL, count)
            if large.any():
                out.append(_rows(int(large.sum()), key=((slot // slots) << 32) | k[large].astype(np.int64), x=ids[large]))
            out += [_rows(len(x), x=x, y=y) for x, y in _paired(ids, size, head, count, reach)]
            yield from (pa.RecordBatch.from_pydict({c: rows[c] for c in ("key", "x", "y")}) for rows in out)

    return run


def collisions(dealt: DataFrame, bands: int, slots: int, num: int, den: int) -> DataFrame:
    """From dealt rows: ``key, x, y``, a pair where ``y`` is set, a member of a large bucket where it is not."""
    return dealt.repartitionById(bands * slots, F.col("slot")).mapInArrow(_gather(slots, size_reach(num, den)), FOUND)


def pairs(multi: DataFrame) -> DataFrame:
    return multi.where("y is not null").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def members(multi: DataFrame) -> DataFrame:
    return multi.where("y is null").select("key", F.col("x").alias("id")).distinct()
