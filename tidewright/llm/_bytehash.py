"""Vectorised polynomial hashing of byte strings, words and shingles (numpy, modulo 2**64)."""

from __future__ import annotations

import hashlib

import numpy as np

from tidewright.llm._common import worker_cache

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Tables of base**i and base**-i, grown by doubling and kept per worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


def powers(base: int = BASE) -> Powers:
    cache = worker_cache("powers")
    if base not in cache:
        cache[base] = Powers(base)
    return cache[base]


def prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """S with S[i] = sum over j < i of (data[j] + 1) * base**j."""
    up, _ = powers(base).upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the byte strings [start, end); equal strings get equal hashes wherever they stand."""
    _, down = powers(base).upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


#: Bytes of a word from which its hash is a digest.
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and for each text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A text may end without white space: cut words at the borders of texts.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text, ascending, and their offsets; fewer than k words make one shingle."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], U64)
    if len(starts):
        h = spans(prefix(data), starts, ends)
        view = memoryview(data)
        # Polynomials modulo 2**64 are weak on long structured strings only: long words are hashed by BLAKE2b instead.
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8).digest(), "little")
        factors = [U64(pow(BASE2, i + 1, 1 << 64)) for i in range(k)]
        n = len(h)
        rolled = np.zeros(max(0, n - k + 1), U64)
        for i in range(k):
            rolled += h[i : n - k + 1 + i] * factors[i]
        rolled = mix(rolled)
        long = counts >= k
        if long.all():
            index = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], per)
            out = rolled[index]
        else:
            for d in np.flatnonzero(counts):
                a, b = first[d], first[d + 1]
                if counts[d] >= k:
                    out[bounds[d] : bounds[d + 1]] = rolled[a : b - k + 1]
                else:
                    short = h[a:b] * np.array(factors[: b - a], U64)
                    out[bounds[d]] = mix(np.array([short.sum(dtype=U64) + U64(int(b - a))], U64))[0]
    sizes = np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        part = out[bounds[d] : bounds[d + 1]]
        if len(part) > 1:
            part.sort()
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            distinct = part[keep]
            out[bounds[d] : bounds[d] + len(distinct)] = distinct
            sizes[d] = len(distinct)
        else:
            sizes[d] = len(part)
    total = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(total[-1]) + np.repeat(bounds[:-1] - total[:-1], sizes)
    return out[index], total


def set_digest(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each set of hashes, whatever their order: two sums of mixed members."""
    out = np.zeros((len(bounds) - 1, 2), U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j, salt in enumerate((0x51_7C_C1_B7_27_22_0A_95, 0x2545F4914F6CDD1D)):
            out[full, j] = np.add.reduceat(mix(values ^ U64(salt)), bounds[full])
    return out
