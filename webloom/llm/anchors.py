"""Anchors of byte strings: a lossless filter for repeated windows.

Every window of ``length`` bytes has an anchor, the k-gram of least hash in it, of equals the rightmost. Windows of equal
bytes have equal anchors at equal places, so a window whose anchor hash occurs once in the corpus is not repeated, and
neither is any longer string that begins with it. One anchor serves a run of consecutive windows.
"""

from __future__ import annotations

import numpy as np

GRAM = 128
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xC2B2AE3D27D4EB4F | 1
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(hashes: np.ndarray, at: np.ndarray, key: int) -> np.ndarray:
    """Hashes with a place and a key of 64 bits mixed in, as signed numbers."""
    seed = _mix(np.array([key], dtype=np.int64).view(np.uint64)) + at.astype(np.int64).view(np.uint64) * np.uint64(_MULTIPLIER)
    return _mix(hashes ^ seed).view(np.int64)


_OCTETS = [_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (_MULTIPLIER, _SECOND)]
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept for the longest text so far."""
    if (found := _powers.get((base, 0))) is None or len(found) < n:
        size = max(n, 1 << 12, 2 * len(found) if found is not None else 0)
        found = np.ones(size, dtype=np.uint64)
        found[1:] = np.uint64(base)
        _powers[(base, 0)] = found = np.multiply.accumulate(found)
    return found[:n]


class Prefixes:
    """Hashes of any stretch of a byte string, from sums of its octets' values times powers of an odd base."""

    def __init__(self, data: np.ndarray, which: int):
        base = (_MULTIPLIER, _SECOND)[which]
        self.inverse = _power(pow(base, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_OCTETS[which][data] * _power(base, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys in a row, by doubling."""
    out, done = keys, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(text: bytes, length: int, reach: int, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, end, context hashes 1 and 2) of each anchor: it serves the windows of ``length`` bytes
    that start at first to last. Its context is all bytes from first to end, ``reach`` bytes after last if the text has
    them. Long texts go chunk by chunk, and a run that a chunk border cuts becomes two."""
    windows = len(text) - length + 1
    if windows <= _CHUNK:
        return _anchors(text, max(0, windows), length, reach, k)
    parts = []
    for at in range(0, windows, _CHUNK):
        h, place, first, last, end, c1, c2 = _anchors(text[at : at + _CHUNK + reach - 1], min(_CHUNK, windows - at), length, reach, k)
        parts.append((h, place + at, first + at, last + at, end + at, c1, c2))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(text: bytes, windows: int, length: int, reach: int, k: int) -> tuple[np.ndarray, ...]:
    if not windows:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    data = np.frombuffer(text, dtype=np.uint8)
    one, two = Prefixes(data, 0), Prefixes(data, 1)
    grams = one.grams(k)[: windows + length - k]
    # Hash above, complement of the place below: the least key is the rightmost of least hash. Places fit in 24 bits.
    keys = (grams & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - np.arange(len(grams), dtype=np.uint64))
    place = ((1 << 24) - 1) - (_least(keys, length - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(place)]]) - 1
    end = np.minimum(last + reach, len(text))
    at = place[first]
    return grams[at].view(np.int64), at, first, last, end, one(first, end).view(np.int64), two(first, end).view(np.int64)
