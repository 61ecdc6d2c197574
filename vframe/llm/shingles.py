"""Sets of word shingles, hashed over whole texts in numpy.

Words are maximal runs without ASCII white space, A-Z in lower case. A set
holds the 64-bit hashes of a text's distinct runs of ``k`` words; a text with
fewer words has one shingle, the whole sequence; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed together.
SLICE_BYTES = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_ODD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_STEP)
    return x ^ (x >> np.uint64(32))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values for a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed * 0x1000193 + 7))


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
BYTE_VALUES = stream(1, 256)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
_PLACE = stream(2, 64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and the byte where it starts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buffer], [True]))))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(len(buffer))
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * power[: len(buffer)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64)), starts


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    words, starts = word_hashes(buffer)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(starts, bounds)
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        runs += words[i : i + n] * _PLACE[i]
    runs = mix(runs)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= k:
            yield np.unique(runs[low : high - k + 1])
        elif high > low:
            whole = (words[low:high] * _PLACE[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            yield mix(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sets(texts: Iterable[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles; k is 64 at most."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield from _sets(held, k)
            held, size = [], 0
    if held:
        yield from _sets(held, k)


class MinHash:
    """Signatures of 16-bit values, one for each of ``bands * rows`` functions."""

    def __init__(self, bands: int, rows: int, seed: int = 3):
        self.bands, self.rows = bands, rows
        n = bands * rows
        self.a = (stream(seed, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (stream(seed + 1, n) >> np.uint64(32)).astype(np.uint32)
        self.place = stream(seed + 2, rows) | np.uint64(1)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (self.a[:, None] * x[None, i : i + 1024] + self.b[:, None]).min(axis=1), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        """The bucket of each band, of a matrix of signatures."""
        s = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        return mix((s * self.place).sum(axis=2, dtype=np.uint64)).view(np.int64)
