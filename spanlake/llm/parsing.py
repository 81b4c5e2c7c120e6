"""Content-defined parsing of byte texts, vectorised over chunks of documents.

A rolling hash runs over every ``TRIGGER``-byte string. The trigger of a ``LENGTH``-byte string is the
place of the smallest hash among its first ``SPAN`` places (the leftmost on ties), so equal strings
have their trigger at the same place wherever they stand, whatever surrounds them. Neighbouring
strings mostly share a trigger; a *run* is the interval of starts that share one, and the bytes
from a run's first start to the end of its last string are its *phrase*.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH = 200
TRIGGER = 12
SPAN = 128
#: Bytes behind a trigger that every string with this trigger holds.
CORE = LENGTH - SPAN + 1
#: Bytes of documents that are parsed at a time; a longer document is a chunk of its own.
CHUNK = 1 << 19

_RNG = np.random.default_rng(97)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 40, 1 << 60)) * 8 + 5  # odd, of large order
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        base, size = _BASE % 2**64, max(n, CHUNK + 1024)
        _powers.clear()
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Intervals of consecutive documents of about ``CHUNK`` bytes."""
    first = held = 0
    for k, size in enumerate(sizes):
        if k > first and held + size > CHUNK:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


class Chunk:
    """The runs of some documents: arrays doc, ord (number within the document), anchor, lo, hi (buffer places)."""

    def __init__(self, docs: list[bytes]) -> None:
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.buffer = np.frombuffer(b"".join(docs), np.uint8)
        self.prefix: np.ndarray | None = None
        counts = np.maximum(self.sizes - LENGTH + 1, 0)  # starts of whole strings, by document
        total = int(counts.sum())
        if total == 0:
            self.doc = self.ord = self.anchor = self.lo = self.hi = np.empty(0, np.int64)
            return
        before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        places = np.arange(total) + np.repeat(self.begin[:-1] - before, counts)
        ends = len(self.buffer) - TRIGGER + 1
        at = np.arange(ends, dtype=np.uint64)
        least = self.hash(np.arange(ends), np.arange(ends) + TRIGGER)
        least ^= least >> np.uint64(29)
        least *= np.uint64(0xBF58476D1CE4E5B9)
        least &= _HIGH
        least |= at
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        owner = (least[places] & _LOW).astype(np.int64)
        new = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        self.anchor, self.lo = owner[new], places[new]
        self.hi = places[np.concatenate([new[1:] - 1, [total - 1]])]
        self.doc = np.searchsorted(self.begin, self.lo, side="right") - 1
        self.ord = np.arange(len(new)) - np.searchsorted(self.doc, self.doc, side="left")

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit rolling hashes of the strings [start, end) of the buffer. Equal strings have equal ones; others that do only cost work, as what is removed is told by digests or bytes."""
        power, inverse = _power(len(self.buffer) + 1)
        if self.prefix is None:
            self.prefix = np.zeros(len(self.buffer) + 1, np.uint64)
            np.cumsum(_BYTES[self.buffer] * power[: len(self.buffer)], out=self.prefix[1:])
        return (self.prefix[end] - self.prefix[start]) * inverse[start]

    def cores(self) -> np.ndarray:
        return self.hash(self.anchor, self.anchor + CORE)

    def starts(self, pick: np.ndarray) -> np.ndarray:
        """Every start of some runs."""
        sizes = self.hi[pick] - self.lo[pick] + 1
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.arange(int(sizes.sum())) + np.repeat(self.lo[pick] - before, sizes)
