"""Words of many texts at once: where they are, and 64-bit hashes of words and word windows.

A word is a polynomial over its chunks of seven bytes, modulo the prime 2^61 - 1, at a secret place. For any
two different words of up to n chunks the chance that they agree is at most (n + 1) / 2^61, whatever the words are, as long as the place
was drawn after them: operators whose results hang on hashes draw it anew for each run.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np

_PRIME = (1 << 61) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Where the polynomial is taken when nothing hangs on collisions.
FIXED = 0x0E3779B97F4A7C15 % _PRIME
_CHUNK = 7
#: Words of more chunks are hashed one by one.
_LONG = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(_CHUNK + 1)], np.uint64)

#: Bytes between words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def draw() -> int:
    """A place for one run."""
    return secrets.randbelow(_PRIME - (1 << 32)) + (1 << 32)


def _times(a: np.ndarray, place: int) -> np.ndarray:
    """a * place modulo 2^61 - 1, not fully reduced: below 2^61 + 8. a below 2^62."""
    low, top = np.uint64(place & 0x7FFFFFFF), np.uint64(place >> 31)
    m, n, half = np.uint64(0x7FFFFFFF), np.uint64(31), np.uint64(30)
    a1, a0 = a >> n, a & m
    mid = a1 * low + a0 * top
    out = ((a1 * top) << np.uint64(1)) + a0 * low
    out = (out & np.uint64(_PRIME)) + (out >> np.uint64(61))
    out += (mid >> half) + ((mid & np.uint64(0x3FFFFFFF)) << n)
    return (out & np.uint64(_PRIME)) + (out >> np.uint64(61))


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: int) -> np.ndarray:
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))
    h = size.astype(np.uint64)  # the leading coefficient
    h = _times(h, place) + (eight[starts] & _MASKS[np.minimum(size, _CHUNK)])
    live = np.flatnonzero(size > _CHUNK)
    k = 1
    while len(live):
        far = size[live] > _LONG * _CHUNK
        if k == 1 and far.any():
            key = place.to_bytes(8, "little")
            for w in live[far].tolist():
                h[w] = int.from_bytes(hashlib.blake2b(raw[starts[w] : ends[w]].tobytes(), digest_size=8, key=key).digest(), "little") % _PRIME
            live = live[~far]
            continue
        left = size[live] - k * _CHUNK
        h[live] = _times(h[live], place) + (eight[starts[live] + k * _CHUNK] & _MASKS[np.minimum(left, _CHUNK)])
        live = live[left > _CHUNK]
        k += 1
    h = _times(h, place)
    h[h >= np.uint64(_PRIME)] -= np.uint64(_PRIME)
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """starts, ends: byte ranges of words; hash: of each word; at: the first word of each text, and the end."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, between: np.ndarray, place: int | None = FIXED):
        """place: that of the hashes; None for none."""
        n = len(raw)
        # a byte of no word before and after all, and between texts
        inside = np.zeros(n + 2, bool)
        np.logical_not(between[raw], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        cuts = np.unique(at[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # inside a run of word bytes
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        if place is not None:
            self.hash = _hashed(raw, starts, ends, place)
        self.at = np.searchsorted(self.starts, at)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by its first word; runs over the ends of texts are among them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def windows_at(hashes: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the runs of k words that begin there."""
    out = hashes[begin]
    for j in range(1, k):
        out *= _STEP
        out += hashes[begin + j]
    return mix(out)


def within(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows of k words that lie in one text, and the text of each."""
    n = np.maximum(np.diff(at) - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    return np.arange(n.sum()) - before[owner] + at[:-1][owner], owner
