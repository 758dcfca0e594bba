"""CRC-32C of many byte ranges at once, and the masked form used in record files.

Each range is cut into 64-byte blocks (zero bytes in front of a range leave an unseeded
CRC unchanged), block CRCs are table lookups over a matrix, and "append n zero bytes"
is a linear map on 32 bits, tabulated for every power of two.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64
_POLY = 0x82F63B78  # fixed value: the reflected Castagnoli polynomial
_U = np.uint32


@lru_cache(1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=_U)
    for _ in range(8):
        t = np.where(t & 1, (t >> _U(1)) ^ _U(_POLY), t >> _U(1))
    return t


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    return _byte_table()[crc & _U(255)] ^ (crc >> _U(8))


@lru_cache(64)
def _shift(power: int) -> np.ndarray:
    """(4, 256): what appending ``2**power`` zero bytes does to each byte of a CRC."""
    if power == 0:
        basis = np.arange(256, dtype=_U)
        return np.stack([_zero_byte(basis << _U(8 * i)) for i in range(4)])
    half = _shift(power - 1)
    return np.stack([_apply(half, half[i]) for i in range(4)])


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & _U(255)] ^ t[1][(crc >> _U(8)) & _U(255)] ^ t[2][(crc >> _U(16)) & _U(255)] ^ t[3][crc >> _U(24)]


@lru_cache(1)
def _block_tables() -> np.ndarray:
    out = np.empty((BLOCK, 256), dtype=_U)
    out[-1] = _byte_table()
    for i in range(BLOCK - 2, -1, -1):
        out[i] = _zero_byte(out[i + 1])
    return out


def _advance(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    crc, power = crc.copy(), 0
    while len(zeros) and (zeros >> power).any():
        on = np.flatnonzero((zeros >> power) & 1)
        crc[on] = _apply(_shift(power), crc[on])
        power += 1
    return crc


def crc32c(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32C of ``data[first[i]:first[i+1]]`` for every i; ``data`` is uint8."""
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    raw = np.zeros(int(begin[-1]) * BLOCK, dtype=np.uint8)
    raw[np.repeat(begin[1:] * BLOCK - first[1:], size) + np.arange(first[0], first[-1])] = data[first[0] : first[-1]]
    rows, tables = raw.reshape(-1, BLOCK), _block_tables()
    crc = np.zeros(len(rows), dtype=_U)
    for j in range(BLOCK):
        crc ^= tables[j][rows[:, j]]
    crc = _advance(crc, (np.repeat(begin[1:], blocks) - 1 - np.arange(len(rows))) * BLOCK)
    out = _advance(np.full(len(size), 0xFFFFFFFF, dtype=_U), size)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(crc, begin[:-1][some])
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    """The public masking of record files: rotate right by 15 and add a constant."""
    return ((crc >> _U(15)) | (crc << _U(17))) + _U(0xA282EAD8)
