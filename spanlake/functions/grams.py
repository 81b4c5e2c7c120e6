"""n-grams of hashed words in numpy, packed by buckets of their hashes: a shuffled gram takes few bytes and no row of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words and documents of a chunk: what a task works on at once. A document is never cut, and its number fits into 13 bits.
CHUNK, DOCS = 2_000_000, 8192
#: Buckets take the highest bits of a hash.
BITS = 10
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finish of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Words of each document, and the columns' hashes end to end; every column is a list of longs of the same lengths."""
    sizes, parts, words, docs = [], [], 0, 0
    joined = lambda: (np.concatenate(sizes), [np.concatenate(p).view(np.uint64) for p in zip(*parts)])
    for batch in batches:
        for k in range(0, len(batch), 64):
            rows = batch.slice(k, 64)
            n = np.diff(rows.column(0).offsets.to_numpy())
            if docs and (words + n.sum() > CHUNK or docs + len(n) > DOCS):
                yield joined()
                sizes, parts, words, docs = [], [], 0, 0
            sizes.append(n)
            parts.append([c.flatten().to_numpy() for c in rows.columns])
            words, docs = words + int(n.sum()), docs + len(n)
    if docs:
        yield joined()


def runs(words: np.ndarray, owner: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, documents and hashes of the n-grams up to ``most`` words, each hash from that of the gram that is a word shorter."""
    at, g = np.arange(len(words)), mixed(words)
    for n in range(1, most + 1):
        if n > 1:
            ok = at + n - 1 < len(words)
            ok[ok] = owner[at[ok]] == owner[at[ok] + n - 1]
            at, g = at[ok], g[ok]
            g = mixed(g * U(0x9E3779B97F4A7C15) + words[at + n - 1])
        yield n, owner[at], g


def edges(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each run of sorted buckets."""
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    yield from zip(buckets[first].tolist(), first.tolist(), np.append(first[1:], len(buckets)).tolist())


def low_bytes(g: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes that follow the bucket's bits, one row for each hash."""
    return ((g << U(BITS)) >> U(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width]


def from_low_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def gaps(values: np.ndarray) -> bytes:
    """Ascending numbers in unary: a one for each of them, after a zero for each step."""
    bits = np.zeros(int(values[-1]) + len(values), dtype=np.uint8)
    bits[values + np.arange(len(values))] = 1
    return np.packbits(bits).tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))
    return ones - np.arange(len(ones))


def counted(sizes: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """Bucket, n, 60-bit hashes but for the bucket's, documents and running counts of a chunk's distinct grams of each document."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for n, doc, g in runs(words, owner, most):
        order = np.argsort((g >> U(64 - BITS) << U(64 - BITS)) | (doc.astype(np.uint64) << U(41)) | (g << U(BITS) >> U(23)))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        more = np.diff(np.append(first, len(g))) - 1
        g, doc = g[first], doc[first]
        low = low_bytes(g, 6)
        for bucket, i, j in edges((g >> U(64 - BITS)).astype(np.int64)):
            yield bucket, n, low[i:j].tobytes(), gaps(doc[i:j]), gaps(np.cumsum(more[i:j]))


def clipped(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that several documents have, and of each the least of its count and the most that any other document has."""
    order = np.argsort(g)
    first = np.flatnonzero(np.diff(g[order], prepend=~g[order[:1]]))
    sizes = np.diff(np.append(first, len(g)))
    order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(order):
        return order, order
    c, first = c[order], np.cumsum(sizes) - sizes
    top = np.repeat(np.maximum.reduceat(c, first), sizes)
    alone = np.repeat(np.add.reduceat((c == top).astype(np.int64), first) == 1, sizes)
    following = np.repeat(np.maximum.reduceat(np.where(c == top, 0, c), first), sizes)
    return order, np.minimum(c, np.where((c == top) & alone, following, top))


def distinct(words: np.ndarray, others: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, n and 80 more bits of the hashes of a chunk's distinct grams, of two hashes of each word."""
    for (n, _, a), (_, _, b) in zip(runs(words, owner, max(sizes)), runs(others, owner, max(sizes))):
        if n in sizes and len(a):
            order = np.argsort(a)
            a, b = a[order], b[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            packed = np.concatenate([low_bytes(a, 6), b.view(np.uint8).reshape(-1, 8)[:, :4]], axis=1)
            for bucket, i, j in edges((a >> U(64 - BITS)).astype(np.int64)):
                yield bucket, n, packed[i:j].tobytes()


def n_distinct(data: bytes) -> int:
    """How many of the packed grams of a bucket differ."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 10)
    high, low = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel(), np.ascontiguousarray(raw[:, 8:]).view(np.uint16).ravel()
    order = np.argsort(high)
    high, low = high[order], low[order]
    same = high[1:] == high[:-1]
    if (same & (low[1:] != low[:-1])).any():  # hardly ever: equal in 74 bits, not in 90
        return len(np.unique(raw, axis=0))
    return len(high) - int(same.sum())
