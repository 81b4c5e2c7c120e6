"""n-grams are shuffled packed by buckets, not as rows of their own."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from spanlake.functions import grams as G
from spanlake.operators import similarity


def grams(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def batches(docs):
    yield from (pa.RecordBatch.from_arrays([pa.array(docs[k : k + 7], pa.list_(pa.int64()))], names=["w"]) for k in range(0, len(docs), 7))


def corpus(seed):
    draw = random.Random(seed)
    code = {w: draw.getrandbits(64) - (1 << 63) for w in range(40)}
    return [[code[w] for w in draw.choices(range(draw.choice((2, 40))), k=draw.choice((0, 1, 3, 30, 200)))] for _ in range(150)]


def test_packed_counts(monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 1500)
    docs, base, held = corpus(1), 0, {}
    for sizes, (words,) in G.chunks(batches(docs)):
        for bucket, n, g, doc, more in G.counted(sizes, words, 3):
            held.setdefault((bucket, n), []).append((G.from_low_bytes(g, 6), base + G.from_gaps(doc), np.diff(G.from_gaps(more), prepend=0) + 1))
        base += len(sizes)
    assert base == len(docs) and max(len(x) for x in held.values()) > 2
    got, hits = Counter(), Counter()
    for (_, n), parts in held.items():
        g, doc, c = (np.concatenate(x) for x in zip(*parts))
        assert len(set(zip(g.tolist(), doc.tolist()))) == len(g)
        got.update({(n, d): k for d, k in Counter(np.repeat(doc, c).tolist()).items()})
        at, hit = G.clipped(g, c)
        for d, h in zip(doc[at].tolist(), hit.tolist()):
            hits[n, d] += h
    for n in (1, 2, 3):
        counts = [Counter(grams(d, n)) for d in docs]
        most = {}
        for d, own in enumerate(counts):
            for g, c in own.items():
                most.setdefault(g, []).append((c, d))
        for d, own in enumerate(counts):
            assert got[n, d] == sum(own.values())
            assert hits[n, d] == sum(min(c, max([x for x, e in most[g] if e != d], default=0)) for g, c in own.items())


def test_few_bytes_a_gram():
    draw = np.random.default_rng(2)
    sizes, words = np.full(4000, 250), draw.integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    packed = sum(len(g) + len(doc) + len(c) for _, _, g, doc, c in G.counted(sizes, words, 2))
    assert packed < 7.2 * 1_996_000


def test_no_row_for_each_gram(spark):
    frame = spark.createDataFrame([(1, "a b a"), (2, "b a")], "doc_id long, text string")
    assert "Generate" not in similarity.self_bleu(frame)._jdf.queryExecution().optimizedPlan().toString()
