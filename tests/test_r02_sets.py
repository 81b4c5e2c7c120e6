"""sets meet in an equal part, not in a rare token, and texts are read once."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spanlake.operators import similarity


def near(draw, n, universe):
    own = draw.sample(range(universe), n)
    return [own, *([w for w in own if draw.random() > r] + draw.sample(range(universe, 2 * universe), draw.randint(0, 1 + n // 20)) for r in (0.0, 0.02, 0.05, 0.08, 0.12))]


@pytest.mark.parametrize("percent", [80, 85, 90, 95, 99, 100])
def test_all_pairs_above(spark, percent):
    draw = random.Random(percent)
    sets = [s for n in (1, 2, 5, 9, 10, 11, 12, 19, 20, 21, 40, 90, 200, 700) for s in near(draw, n, 2000)]
    rows = [(i, "xy"[i % 17 == 0], " ".join(f"w{w}" for w in s)) for i, s in enumerate(sets)] + [(1000 + i, "x", " ".join(f"w{w}" for w in sets[i])) for i in (3, 40)] + [(2000, "x", None), (2001, "x", "")]
    bags = {i: (k, set((t or "").split())) for i, k, t in rows}
    want = {}
    for i, j in combinations(sorted(bags), 2):
        shared, united = len(bags[i][1] & bags[j][1]), len(bags[i][1] | bags[j][1])
        if bags[i][0] == bags[j][0] and shared * 100 > united * percent:
            want[i, j] = (shared, united)
    got = [((r.i, r.j), (r.shared, r.united)) for r in similarity.token_set_pairs(spark.createDataFrame(rows, "doc_id long, k string, text string"), ["k"], percent).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_every_close_size_meets():
    for percent in (80, 90, 95, 99):
        least, cut = similarity._size_classes(percent)
        cls = lambda n: sum(x <= n for x in least[:400]) - 1
        for y in range(1, 300):
            for x in range(y * percent // 100, y + 1):
                for apart in range(y - x, x + y):  # tokens in which they differ
                    if (x + y - apart) * 100 > (x + y + apart) * percent and (x + y - apart) % 2 == 0:
                        assert cls(y) - cls(x) in (0, 1) and cut[cls(x)] > apart


def test_rare_tokens_in_common_make_no_pairs(spark):
    """Unlike sets that share their rarest tokens: by prefixes nearly all meet."""
    draw = random.Random(2)
    rows = [(i, "x", " ".join([*(f"rare{k}" for k in range(12)), *(f"w{w}" for w in draw.sample(range(200), 90))])) for i in range(100)]
    rows += [(1000 + i, "x", " ".join(f"w{w}" for w in draw.sample(range(200), 20))) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, k string, text string")
    pairs = similarity.token_set_pairs(frame, ["k"], 90)
    assert "regexp_extract_all" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # texts were read, once
    s = F.array_sort(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    nodes = frame.select(F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("g"), s.alias("s"))
    found = similarity._by_prefix(nodes, 90).count(), similarity._by_parts(nodes, 90).count()
    assert found[0] > 4000 and found[1] < 400, found
