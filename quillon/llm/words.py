"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: ASCII letters and digits and
everything beyond ASCII. All words of a batch are hashed together, eight bytes of each at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        p = np.full(max(n, 1 << 16), base % 2**64, np.uint64)
        p[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(p)
    return known[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[i] the sum of the first i bytes' values times BASE**position; for statistics, as such sums can be made to collide."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand; never 0."""
    inverse = powers(pow(BASE, -1, 2**64), len(c))
    h = mix((c[end] - c[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return np.where(h == 0, U(1), h)


#: Longer words are hashed by BLAKE2b, one at a time.
LONG = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start and end of every word, index of each text's first word with the total at the end)."""
    low = LOWER[data]
    flag = IS_WORD[low]
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1]
    end[:-1] &= ~flag[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = flag[inner]
    end[inner - 1] = flag[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, s, e, np.searchsorted(s, offsets)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], never 0: every 8 bytes are mixed into the state, so no polynomial identity collides.

    Different seeds give independent families of hashes.
    """
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * U(BASE) + U(seed * 0xA24BAED4963EE407 % 2**64 + 1))
    h = mix(h ^ (eight[start] & _MASKS[np.minimum(size, 8)]))
    left = np.flatnonzero(size > 8)
    at = 8
    while len(left) and at < LONG:
        chunk = eight[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
        h[left] = mix((h[left] + U(BASE)) ^ chunk)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return np.where(h == 0, U(1), h)


def words(offsets: np.ndarray, data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word with the total at the end)."""
    low, s, e, first = spans(offsets, data)
    return digests(low, s, e, seed), first


#: Multipliers by position in a shingle.
PLACE = mix(np.arange(101, 201, dtype=np.uint64)) | U(1)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, index of each text's first); a text of 1 to size-1 words is one shingle."""
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(per)), per)
    start = np.arange(at[-1]) - at[text] + first[text]
    length = np.minimum(counts, size)[text]
    out = length.astype(np.uint64) * U(0xA0761D6478BD642F)
    for k in range(size):
        take = length > k
        if take.all():
            out += hashes[start + k] * PLACE[k]
        else:
            out[take] += hashes[start[take] + k] * PLACE[k]
    return mix(out), at
