"""Words of many texts at once: numpy finds and hashes them in the texts' UTF-8 bytes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that belong to words: anything but ASCII whitespace; or digits, letters (after lower-casing) and all of non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2**64; kept, as most batches are of about one size."""
    found = _powers.get(hex(base))
    if found is None or len(found) < n:
        found = np.full(max(n, 1), base, np.uint64)
        found[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(found, out=found)
        if n < 20_000_000:
            _powers[hex(base)] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased (A-Z only) bytes of all texts of a column, and the n+1 offsets of the texts in them; a null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].copy() if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # a null may span bytes
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].copy()
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWER[raw], offsets - offsets[0]


def hashed_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, in order, and for each of the n+1 text offsets the number of words before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=prefix[1:])
        hashes = (prefix[ends] - prefix[starts]) * _power(_INVERSE, n)[starts]
        hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets, side="left")
