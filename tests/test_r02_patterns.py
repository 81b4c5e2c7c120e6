"""a plan row isn't given its type's whole catalog."""

from collections import Counter

from pyspark.sql import functions as F

from spanlake.plans import planning


def test_attach_patterns_by_number(spark):
    items = [(f"P{i % 37}", "AB"[i % 2], [None, "EN", "DE", ""][i // 2 % 4], ["Adjacency-tight"] if i % 5 == 0 else None) for i in range(90)]
    catalog = spark.createDataFrame(items, "pattern_id string, entity_type string, language_hint string, dimensions array<string>")
    rows = [(i, [None, "EN", "DE", "FR", ""][i % 5], ["tight", "near", None][i % 3], "ABC"[i // 15 % 3]) for i in range(300)]
    plan = spark.createDataFrame(rows, "record_id long, language string, adjacency string, target_entity_type string")
    made = planning.attach_patterns(plan, catalog)
    drawn = {r.record_id: r.d for r in plan.select("record_id", planning._draw(F.col("record_id").cast("string"), "pattern").alias("d")).collect()}
    got = {r.record_id: r.target_pattern_id for r in made.collect()}
    for k, language, adjacency, kind in rows:
        pool = [x for x in items if x[1] == kind]
        if language is not None and language != "EN":
            pool = [x for x in pool if x[2] == language] or pool
        if adjacency == "tight":
            pool = [x for x in pool if x[3]] or pool
        assert got[k] == (sorted(x[0] for x in pool)[int(drawn[k] * len(pool))] if pool else None)
    assert Counter(r[0] for r in rows) == Counter(got.keys())
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
