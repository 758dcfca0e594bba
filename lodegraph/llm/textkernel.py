"""Vectorised text primitives shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column: a 256-entry byte
table maps separators to 0 and folds case, word boundaries fall out of one comparison,
and every word gets a 64-bit hash from a prefix sum of ``table[byte] * P**position``.
No Python string is created per word. Texts are never cut: a long text forms a chunk
of its own, and hashing walks it in segments so that tables stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers (the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, 4 * CHUNK_BYTES)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, dtype=U64)
            out[0], done, step = 1, 1, base
            while done < size:
                m = min(done, size - done)
                out[done : done + m] = out[:m] * U64(step)
                done += m
                step = step * step & _M64
            _tables[key] = out
    return _tables["p"], _tables["q"]


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte map: separators to 0, A-Z to a-z, NUL (if it is no separator) to the code of a separator byte."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if 0 not in separators:
        t[0] = separators[0]
    t[list(separators)] = 0
    return t


#: Words as runs without ASCII white space.
SPACE_WORDS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words as runs of ASCII letters, digits and any non-ASCII byte.
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one longer row): first row, end row, bytes, offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of some rows: byte ``start`` and ``end``, 64-bit ``hash``, and ``first``: each row's first word, with the total at the end."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        codes = table[buf]
        inside = codes != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        opens[heads] = inside[heads]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offs)
        self.codes = codes
        self.hash = self._hash()

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self) -> np.ndarray:
        if "t" not in _tables:
            _tables["t"] = splitmix(256, 7)
        values, out, i, n = _tables["t"], np.empty(len(self.start), dtype=U64), 0, len(self.start)
        while i < n:
            lo = int(self.start[i])
            j = max(int(np.searchsorted(self.start, lo + CHUNK_BYTES)), i + 1)
            hi = int(self.end[j - 1])
            p, q = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(values[self.codes[lo:hi]] * p[: hi - lo], out=sums[1:])
            s = self.start[i:j] - lo
            out[i:j] = mix((sums[self.end[i:j] - lo] - sums[s]) * q[s])
            i = j
        return out

    def prefixes(self, which: np.ndarray, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word given by number; the words are longer than that."""
        p, _ = _powers(n + 1)
        h = np.full(len(which), n, dtype=U64)
        for j in range(n):
            h += _tables["t"][self.codes[self.start[which] + j]] * p[j + 1]
        return mix(h)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours, wherever it starts; runs over a row's end are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U64(0xA0761D6478BD642F)
        out += hashes[j : j + n]
    return mix(out)


def word_hash(word: str, table: np.ndarray = ALNUM_WORDS) -> list[int]:
    """Hashes of the words in a short phrase, equal to those in texts."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return [int(x) for x in Words(raw, np.array([0, len(raw)]), table).hash]
