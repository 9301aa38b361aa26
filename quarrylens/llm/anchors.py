"""Content-defined anchors of byte strings: equal long strings have equal anchors.

Each window of ``length`` bytes has as its anchor the place of its smallest k-byte
fingerprint (the leftmost on ties).  Windows with one anchor stand side by side, so an
anchor comes with the range of windows it answers for, and their union is its context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEED = 77_003
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
LETTERS = np.random.default_rng(SEED).integers(1, 2**64 - 1, 256, dtype=np.uint64)
#: Bits of an order key that hold a place.
PLACE_BITS = 26


class Powers:
    """Powers of a step and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            ups, downs = np.full(size, STEP), np.full(size, BACK)
            ups[0] = downs[0] = 1
            self.up, self.down = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prints:
    """Fingerprints of all substrings of some bytes, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = POWERS.to(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LETTERS[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """The fingerprint at each place where ``size`` bytes begin."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values: running minima of blocks from both ends."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Anchors:
    """Places, fingerprints, and first and last window of each anchor of a text."""

    place: np.ndarray
    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, length: int, k: int, segment: int = 1 << PLACE_BITS - 1) -> Anchors:
        """A very long text is taken in segments of windows; where two meet, an anchor's
        windows may come in two parts, each with its own context."""
        parts = [cls._segment(data[at : at + segment + length - 1], length, k, at) for at in range(0, max(len(data) - length + 1, 0), segment)]
        if not parts:
            return cls(*(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64)))
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("place", "key", "first", "last", "context")))

    @classmethod
    def _segment(cls, data: np.ndarray, length: int, k: int, at: int) -> Anchors:
        prints = Prints(data)
        grams = prints.every(k)
        low = np.uint64((1 << PLACE_BITS) - 1)
        places = np.arange(len(grams), dtype=np.uint64)
        owner = (sliding_min((grams & ~low) | places, length - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        place = owner[first]
        # the offset of the anchor in its context is part of what makes contexts equal
        context = mixed(prints.of(first, last - first + length) ^ (place - first).astype(np.uint64))
        return cls(place + at, grams[place], first + at, last + at, context)
