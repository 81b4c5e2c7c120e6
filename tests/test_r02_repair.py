"""places in one scan a needle, without sorting structs, and worked out once."""

from pyspark.sql import functions as F

from spanlake.operators import records as R

ROWS = [(1, "aaXbaa", [("T", "aa"), ("T", "aa"), ("T", "aa"), ("U", "aa"), ("U", "lost"), ("U", "lost"), ("V", ""), ("W", "X")]), (2, None, [("T", "a")]), (3, "a", None), (4, "😀a😀é", [("T", "😀"), ("U", "é"), ("V", None)])]


def held(spark):
    rows = [(k, t, None if es is None else [(a, b, 7, True, "f", "LOW") for a, b in es]) for k, t, es in ROWS]
    return spark.createDataFrame(rows, f"record_id long, text string, entities array<{R.ENTITY}>")


def brute(text, es):
    groups = list(dict.fromkeys(e for e in es if e[1]))
    out = []
    for k, (kind, s) in enumerate(groups):
        at = [i for i in range(len(text or "")) if text.startswith(s, i)]
        m = es.count((kind, s))
        out += [((i, i + len(s), k, n), (kind, s, n, i, i + len(s), "ok" if m < len(at) else "no_change")) for n, i in enumerate(at)]
        out += [((2**31, 2**31, k, n), (kind, s, 7, None, None, "string_not_in_text")) for n in range(0 if at else m)]
    return [x for _, x in sorted(out, key=lambda x: x[0])]


def test_repair_against_brute_force(spark):
    for r in R.repair(held(spark)).collect():
        es = dict((k, e) for k, _, e in ROWS)[r.record_id]
        own = r.entities and [(e.entity_type, e.entity_string, e.mention_index, e.start, e.end, e.repair_status) for e in r.entities]
        assert own == (None if es is None else brute(r.text, es))
    sums = {r.record_id: tuple(r)[1:] for r in R.repair_sums(held(spark)).collect()}
    assert sums[1] == (8, 7, 1, 1, 2) and sums[2] == (1, 1, 0, 0, 1) and sums[4] == (3, 3, 1, 1, 0)


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "filter (size(" not in plan(R.exploded(R.repair(held(spark)))) and "array_sort" not in plan(R.repair(held(spark)))
    totals = plan(R.repair_totals(held(spark)))
    assert "array_sort" not in totals and "arraysort" not in totals and "split" not in totals


def test_many_places(spark):
    n = 200_000
    one = spark.createDataFrame([(1, "a" * n, [("T", "a", 0, True, "f", "LOW")])], f"record_id long, text string, entities array<{R.ENTITY}>")
    got = R.exploded(R.repair(one)).agg(F.count("*"), F.sum("start"), F.max("mention_index")).first()
    assert tuple(got) == (n, n * (n - 1) // 2, n - 1)
