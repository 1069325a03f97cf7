"""PartEnum signatures of shingle sets: sets whose Jaccard similarity is at least 0.8 share at least one.

Sizes fall in bands; a pair is found in the band of its larger set. Sets u and v of similarity 0.8 differ in at most
(|u| + |v|) / 9 elements. In a band, the domain of shingles is divided by hashing into n1 blocks of n2 parts each; a signature is a
block's number with the content of n2 - k2 of its parts. Small sets have one block, with k2 the number of differences they may
have. Others have n2 = 3 and k2 = 1: of any d // 2 + 1 blocks, one has at most one difference, and so two equal parts.

A set signs a prefix of the blocks: until d // 2 + 1 of them, with d the most that its partners may differ, are such that no choice of parts is
empty; empty choices are left out. For a pair, in the shorter prefix, the blocks with at most one difference are too many to be
all among those with an empty choice, so one shares a choice that isn't empty. A set without enough such blocks signs all blocks, and empty choices too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from rankweave.llm.tokens import SPACED, hashed_words, mix, text_bytes

SHINGLE = 5
#: Similarity in percent; the band ratio and the bound on differences follow from it.
SIMILARITY = 80
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column) -> list[np.ndarray]:
    """The ordered distinct hashes of each text's runs of SHINGLE words; a shorter text's words are one run; none, none."""
    words, bounds = hashed_words(*text_bytes(column), SPACED)
    with np.errstate(over="ignore"):
        runs = words[: max(len(words) - SHINGLE + 1, 0)].copy()
        for k in range(1, SHINGLE):
            runs = runs * _STEP + words[k : k + len(runs)]
        runs = mix(runs)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = short * _STEP + w
                sets.append(mix(np.array([short], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def set_name(shingles: np.ndarray) -> bytes:
    """A name of 16 bytes of a set: equal sets have equal names. Its first 8 bytes serve where a rare clash does no harm."""
    h = mix(shingles ^ _STEP)
    return mix(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h)), mix(h + _STEP).sum(dtype=np.uint64)], np.uint64)).tobytes()


def band(size: int) -> tuple[int, int, int]:
    """The number, least and largest size of the band of a size. A partner of at most 5/4 the size is in this band or the next."""
    number, low = 0, 1
    while True:
        high = max(low, low * 25 // 16)
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


class Scheme:
    """The division of the domain in one band."""

    def __init__(self, number: int, high: int):
        self.number = number
        most = 2 * high // 9
        if most <= 3:
            self.n1, self.k2 = 1, most
            self.n2 = 1 if not most else most + 3
        else:
            self.n1, self.n2, self.k2 = -(-115 * (most // 2 + 1) // 100), 3, 1
        self.choices = [np.array(c) for c in combinations(range(self.n2), self.n2 - self.k2)]
        self.seed = np.uint64(((number + 1) * 0xD1342543DE82EF95) % 2**64)

    def sign(self, shingles: np.ndarray, differ: int) -> np.ndarray:
        """Signatures for partners that differ in at most so many elements."""
        with np.errstate(over="ignore"):
            h = mix(shingles ^ self.seed)
            part = (((h >> np.uint64(32)) * np.uint64(self.n1 * self.n2)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ordered = part[order]
            first = np.searchsorted(ordered, np.arange(self.n1 * self.n2 + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _STEP)[order], dtype=np.uint64)])
            content = (sums[first[1:]] - sums[first[:-1]]).reshape(self.n1, self.n2)
            filled = (first[1:] > first[:-1]).reshape(self.n1, self.n2)
            good = filled.sum(axis=1) > self.k2
            need = differ // (self.k2 + 1) + 1
            reach = np.cumsum(good)
            enough = reach[-1] >= need
            upto = int(np.searchsorted(reach, need)) + 1 if enough else self.n1
            block = np.arange(upto, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + self.seed
            found = []
            for i, choice in enumerate(self.choices):
                x = block + np.uint64(i + 1)
                for j in choice:
                    x = mix(x * _STEP + content[:upto, j])
                found.append(x[filled[:upto][:, choice].any(axis=1)] if enough else x)
        return np.concatenate(found)


_schemes: dict[int, Scheme] = {}


def signatures(shingles: np.ndarray) -> np.ndarray:
    """All signatures of a set that isn't empty: of its own band, and of the next where larger partners may be."""
    size = len(shingles)
    number, _, high = band(size)
    largest = size * 5 // 4
    found = []
    for i in (number, number + 1):
        if i > number:
            if largest <= high:
                break
            high = max(high + 1, (high + 1) * 25 // 16)
        scheme = _schemes.get(i) or _schemes.setdefault(i, Scheme(i, high))
        found.append(scheme.sign(shingles, (size + min(high, largest)) // 9))
    return np.concatenate(found)


#: Bits of the least and of the longest sketch.
LEAST_SKETCH, MOST_SKETCH = 64, 32_768


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of hash slots, a power of two of them and two or more a shingle up to MOST_SKETCH.

    Sets that differ in d elements have sketches of the same length that differ in at most d bits. folded() makes a sketch of half the length.
    """
    slots = min(max(LEAST_SKETCH, 1 << (2 * len(shingles) - 1).bit_length()), MOST_SKETCH)
    at = (mix(shingles + _STEP) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches (64-bit words), folded to a length of so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)
