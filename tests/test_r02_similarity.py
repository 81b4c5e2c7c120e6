"""the texts of all candidate pairs are never joined at once, and blocks are multiplied without row objects."""

import random

import numpy as np

from spanlake.operators import similarity


def test_later_records_in_rounds(spark, monkeypatch):
    draw = random.Random(5)
    docs = [(i, " ".join(draw.choices("abcdefghij", k=draw.choice((0, 1, 4, 12, 60))))) for i in range(40)]
    pairs = [(i, j) for j in range(40) for i in range(j) if draw.random() < 0.8]
    records = spark.createDataFrame(docs, "doc_id long, text string")
    candidates = spark.createDataFrame(pairs, "i long, j long")
    joined = []
    whole = similarity.rouge_l
    monkeypatch.setattr(similarity, "rouge_l", lambda a, b: joined.append(1) or whole(a, b))
    text = {k: t.split() for k, t in docs}
    score = lambda a, b: round(2 * similarity._lcs(a, b) / (len(a) + len(b)), 9) if a and b else 0.0
    for limit in (0.1, 0.6, 0.95):
        got = [r.j for r in similarity._later(candidates, records, limit, "doc_id").collect()]
        assert sorted(got) == sorted({j for i, j in pairs if score(text[i], text[j]) > limit})
    assert len(joined) > 3  # more rounds than one for some limit


def test_blocks_are_arrow_views(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(700, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<float>")
    found = similarity.cosine_pairs(vectors, 0.9)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert {(r.i, r.j) for r in found.collect()} == {(int(i), int(j)) for i, j in np.argwhere(np.triu(u @ u.T > 0.9, 1))}
