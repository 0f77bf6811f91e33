"""CRC-32C over many values at once, with numpy.

A register that starts at zero ignores leading zero bytes, so values are padded
on the left to a common width and stepped through together, two bytes a step.
Long values are cut into lanes, and the lanes of all values are stepped through
as one matrix. Lanes and prefixes are combined with the operator that advances
a register over 2^k zero bytes, kept as four byte-indexed tables.
"""

from __future__ import annotations

import numpy as np

from .constants import CRC_MASK_DELTA, CRC_POLYNOMIAL

ONES = 0xFFFFFFFF
LANE = 256
#: Lanes that are stepped through at a time: their bytes stay in the cache.
TOGETHER = 4096

# Made when first asked for. Plain objects, so that these functions can be sent
# by value to workers that cannot import the package.
_TABLES: dict[int, np.ndarray] = {}


def _step_table() -> np.ndarray:
    """The register after two zero bytes, from each 16-bit low half."""
    if -1 not in _TABLES:
        t = np.arange(65536, dtype=np.uint32)
        for _ in range(16):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1).astype(np.uint32)
        _TABLES[-1] = t
    return _TABLES[-1]


def _advance(tables: np.ndarray, crc):
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _zeros(k: int) -> np.ndarray:
    """Tables of the operator over 2^k zero bytes."""
    if k not in _TABLES:
        bytes_ = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        if k == 0:
            for _ in range(8):
                bytes_ = np.where(bytes_ & 1, (bytes_ >> 1) ^ np.uint32(CRC_POLYNOMIAL), bytes_ >> 1).astype(np.uint32)
        else:
            bytes_ = _advance(_zeros(k - 1), _advance(_zeros(k - 1), bytes_))
        _TABLES[k] = bytes_
    return _TABLES[k]


def shifted(crc, length, unit: int = 0):
    """Registers advanced over length * 2^unit zero bytes each."""
    crc, length = np.atleast_1d(np.asarray(crc, np.uint32)).copy(), np.atleast_1d(np.asarray(length, np.int64))
    k = 0
    while (rest := length >> k).any():
        odd = (rest & 1).astype(bool)
        crc[odd] = _advance(_zeros(unit + k), crc[odd])
        k += 1
    return crc


def _registers(rows: np.ndarray) -> np.ndarray:
    """From zero over each row of an even number of bytes."""
    table, out = _step_table(), np.zeros(len(rows), np.uint32)
    for at in range(0, len(rows), TOGETHER):
        words = np.ascontiguousarray(rows[at : at + TOGETHER].view("<u2").T)
        crc = np.zeros(words.shape[1], np.uint32)
        for w in words:
            crc = table[(crc ^ w) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
        out[at : at + TOGETHER] = crc
    return out


def _padded(values, widths) -> np.ndarray:
    """The values one after the other, each with zeros before it up to its width."""
    out = bytearray(int(sum(widths)))
    end = 0
    for value, width in zip(values, widths):
        end += width
        out[end - len(value) : end] = value
    return np.frombuffer(out, np.uint8)


def crc32c_many(values, initial=None) -> np.ndarray:
    """The CRC-32C of each value (None: 0), going on from `initial` CRCs."""
    n = len(values)
    size = np.array([0 if v is None else len(v) for v in values], np.int64)
    crc = np.zeros(n, np.uint32)
    width = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 2))).astype(int), LANE)
    for w in np.unique(width[size > 0]):
        own = np.nonzero((width == w) & (size > 0))[0]
        lanes = -(-size[own] // w)
        # As much at a time as memory should hold twice.
        groups = np.cumsum(lanes * w) >> 25
        for g in np.unique(groups):
            some = groups == g
            mine, count = own[some], lanes[some]
            rows = _padded([values[i] for i in mine], (count * w).tolist()).reshape(-1, w)
            found, ends = _registers(rows), np.cumsum(count)
            if w == LANE:
                behind = np.repeat(ends, count) - 1 - np.arange(int(ends[-1]))
                found = np.bitwise_xor.reduceat(shifted(found, behind, LANE.bit_length() - 1), ends - count)
            crc[mine] = found
    start = np.full(n, ONES, np.uint32) if initial is None else np.asarray(initial, np.uint32) ^ np.uint32(ONES)
    return crc ^ shifted(start, size) ^ np.uint32(ONES)


def crc32c(value: bytes) -> int:
    return int(crc32c_many([value])[0])


def combine(first, second, second_length):
    """The CRC of A then B, from those of A and B and the length of B."""
    return shifted(first, second_length) ^ np.atleast_1d(np.asarray(second, np.uint32))


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17) & ONES) + CRC_MASK_DELTA) & ONES
