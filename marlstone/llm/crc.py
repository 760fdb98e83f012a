"""CRC-32 of joined byte strings from the CRCs of their parts.

Appending k zero bytes to a message maps its CRC by a linear function over GF(2), the k-th power of the map of one byte; a
CRC of two parts is the first one's, so shifted by the length of the second, xor the second one's. Every map here is four
tables of 256 values, one for each byte of the CRC, so arrays of CRCs are shifted by look-ups.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

BLANK = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k, crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


@functools.cache
def shift_tables(power: int) -> np.ndarray:
    """The map of 2 ** power zero bytes: uint32 of shape (4, 256)."""
    if power:
        half = shift_tables(power - 1)
        return np.stack([_apply(half, half[k]) for k in range(4)])
    # one zero byte: the raw register moves by eight bits, which zlib gives with its own conditioning undone
    zero = zlib.crc32(b"\0")
    units = np.array([zlib.crc32(b"\0", 1 << k) ^ zero for k in range(32)], np.uint32)
    values = np.arange(256, dtype=np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(32):
        has = (values >> np.uint32(k % 8) & np.uint32(1)).astype(bool)
        tables[k // 8, has] ^= units[k]
    return tables


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs moved by n bytes each, for combination with a message of that length."""
    out, n = crc.astype(np.uint32, copy=True), np.asarray(n, np.int64)
    for power in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> power & 1)
        out[at] = _apply(shift_tables(power), out[at])
    return out


def joined(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of two messages one after the other; n is the length of the second in bytes."""
    return shifted(first, n) ^ second
