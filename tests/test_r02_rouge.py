"""ROUGE-L of pairs is worked out once for all copies of two texts, which are read once."""

import random
from itertools import combinations

import numpy as np

from spanlake.operators import similarity


def test_ends_in_common():
    draw = random.Random(1)
    for _ in range(300):
        a, b = (draw.choices("ab" if draw.random() < 0.5 else "abcdef", k=draw.randint(0, 9)) for _ in range(2))
        ends = [draw.choices("ab", k=draw.randint(0, 4)) for _ in range(2)]
        x, y = ends[0] + a + ends[1], ends[0] + b + ends[1]
        assert similarity._lcs_between(np.array(x, dtype=object), np.array(y, dtype=object)) == similarity._lcs(x, y)


def test_copies_are_measured_once(spark):
    draw = random.Random(4)
    texts = ["a b c d", "a b x d", "A, b! c d", "", None, "d c b a", " ".join(draw.choices("abcd", k=300))]
    docs = [(i, texts[i % 7]) for i in range(70)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = list(combinations(range(70), 2)) + [(3, 999)]
    found = similarity.rouge_pairs(spark.createDataFrame(pairs, "i long, j long"), frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # texts were read, once
    assert plan.index("Distinct" if "Distinct" in plan else "Aggregate [da") > plan.index("lcs_length")  # below it: pairs of different texts
    words = {i: (t or "").lower().replace(",", "").replace("!", "").split() for i, t in docs}
    score = lambda a, b: round(2 * similarity._lcs(a, b) / (len(a) + len(b)), 9) if a and b else 0.0
    got = [((r.i, r.j), r.rouge_l) for r in found.collect()]
    assert len(got) == len(pairs) - 1 and dict(got) == {(i, j): score(words[i], words[j]) for i, j in pairs[:-1]}
