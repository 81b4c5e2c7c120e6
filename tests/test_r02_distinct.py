"""F8: distinct n-grams are shuffled packed by buckets, ten bytes each, and counted by one sort of a bucket."""

import random

import numpy as np

from spanlake.functions import grams as G
from spanlake.operators import measures


def grams(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def test_ten_bytes_a_gram():
    draw = np.random.default_rng(2)
    owner, words = np.repeat(np.arange(4000), 250), draw.integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    assert sum(len(g) for _, _, g in G.distinct(words, words ^ np.uint64(5), owner, (2, 3))) == 10 * (4000 * 249 + 4000 * 248)


def test_equal_but_for_the_last_bits():
    rows = np.array([[*range(8), 1, 0], [*range(8), 2, 0], [*range(8), 1, 0], [9] * 10], dtype=np.uint8)
    assert G.n_distinct(rows.tobytes()) == 3


def test_no_row_for_each_gram(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghijklmn", k=draw.choice((0, 1, 2, 5, 80)))) for _ in range(120)] + [None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    words = [(t or "").split() for t in texts]
    for sizes in ((1, 2, 3), (3,), (2, 90)):
        found = measures.distinct_n(frame, sizes)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {n: (len(set(every)), len(every)) for n in sizes if (every := [g for w in words for g in grams(w, n)])}
        assert {r.n: (r.distinct_grams, r.total_grams) for r in found.collect()} == want
