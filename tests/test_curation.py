"""Routing, folding, gates, reports and plan fields on hand-made rows."""

from pyspark.sql import functions as F

from spanlake.operators import curation, measures, similarity
from spanlake.plans import planning

ENTITY = "array<struct<entity_type:string,entity_string:string>>"


def test_routed(spark):
    rows = [(1, "Rome", [("City", "Rome")]), (2, "Rome", [("City", "Oslo")]), (3, "Ann, Bo", []), (4, None, None)]
    docs = spark.createDataFrame([(i, t, e, "coverage", [], "", "Zed; Bo") for i, t, e in rows], f"id int, text string, entities {ENTITY}, mode string, frozen array<string>, target_entity_type string, example string")
    got = {r.id: (r.route, [tuple(e) for e in r.entities]) for r in curation.routed(docs).collect()}
    assert got[1] == ("enrich", [("City", "Rome")]) and got[2] == ("verify>enrich", [("City", "Oslo")])
    assert got[3] == ("verify>repair>enrich", [("Full_Name", "Bo")]) and got[4] == ("verify>repair>enrich", [])
    fixed = curation.routed(docs, lambda d: d.withColumn("entities", F.array(F.struct(F.lit("City").alias("entity_type"), F.lit("x").alias("entity_string")))))
    assert {r.id: r.route for r in fixed.collect()}[3] == "verify>enrich"
    assert curation.routed(docs.limit(0)).count() == 0


def test_labels_and_rendering(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("v")).first().v
    assert pick(curation.fold_label(F.lit("City"))) == "LOC" and pick(curation.fold_label(F.lit("Gender"))) is None
    assert pick(curation.fold_label(F.lit("Gender"), ("low",))) == "DEM" and pick(curation.fold_label(F.lit(None).cast("string"))) is None
    assert [pick(curation.translated_prefix(F.lit(p), F.lit(t))) for p, t in (("CR-1", "Crime"), ("PA-2", "Political_Party"), ("PA-2", "Passport_Number"), ("PP-3", "Passport_Number"))] == ["CRIME-1", "PP-2", "PA-2", "PA-3"]
    entity = F.struct(F.lit("City").alias("entity_type"), F.lit("Rome").alias("entity_string"), F.lit(None).cast("string").alias("sensitivity_tier"), F.lit(False).alias("disclosed"))
    assert pick(curation.rendered_entities(F.array(entity, entity), 1)) == '- City: "Rome" (sensitivity=?, disclosed=False)\n... and 1 more'
    assert pick(curation.filled_template(F.lit("a {{ x }} {{y}}"), {"x": F.lit(1), "y": F.lit(None).cast("string")})) == "a 1 "
    assert pick(curation.shortened(F.lit("abc"), 2, "+")) == "ab+" and pick(curation.shortened(F.lit("ab"), 2, "+")) == "ab"


def test_name_triples_and_gates(spark):
    rows = [(1, "Full_Name", "Ann De Lee", 0, "Ann De Lee"), (1, "First_Given_Name", "Ann", 0, "Ann De Lee"), (1, "Last_Family_Name", "De Lee", 0, "Ann De Lee"), (2, "Full_Name", "Bo Ek", 0, "Bo Ek"), (2, "Full_Name", "Cher", 0, "Bo Ek")]
    e = spark.createDataFrame(rows, "record_id long, entity_type string, entity_string string, mention_index int, text string")
    assert {r.record_id: (r.full_names, r.compliant) for r in curation.name_triples(e).collect()} == {1: (1, 1), 2: (2, 1)}
    held = e.groupBy("record_id").agg(F.first("text").alias("text"), F.collect_list(F.struct("entity_type", "entity_string", "mention_index")).alias("entities"))
    got = {r.gate: (r.passed, r.total, r["pass"]) for r in curation.gate_report(held, 1).collect()}
    assert got["offset_accuracy"] == (4, 5, False) and got["zero_entity_rate"] == (2, 2, True)
    assert got["triple_names"] == (2, 3, False) and got["type_floor"] == (3, 51, False) and got["all"][2] is False
    none = {r.gate: r["pass"] for r in curation.gate_report(held.limit(0)).collect()}
    assert none["offset_accuracy"] is False and none["triple_names"] is True


def test_reports(spark):
    m = spark.createDataFrame([("d", "exact", "City", 1, 1, 0), ("d", "exact", "State", 0, 0, 2)], "detector string, mode string, entity_type string, tp long, fp long, fn long")
    r = curation.detector_report(m, 4).first()
    assert (r.precision, round(r.recall, 4), r.micro_f1, round(r.macro_f1, 4)) == (0.5, 0.3333, 0.4, 0.1667)
    g = curation.recall_gaps(m, "entity_type", "City", "State").first()
    assert (g.recall_high, g.recall_low, g.gap) == (1.0, 0.0, 1.0)


def test_distinct_ngrams(spark):
    docs = spark.createDataFrame([("a b a b",), ("a",), ("",), (None,)], "text string")
    got = {r.n: (r.distinct_grams, r.total_grams) for r in measures.distinct_n(docs).collect()}
    assert got == {1: (2, 5), 2: (2, 3), 3: (2, 2)}
    assert {r.n for r in measures.distinct_n(docs, (2,)).collect()} == {2}


def test_patterns_and_scenarios(spark):
    catalog = spark.createDataFrame([("A-1", "City", "", ["Adjacency-tight"]), ("A-2", "City", "DE", ["Masked"]), ("A-3", "City", "", None)], "pattern_id string, entity_type string, language_hint string, dimensions array<string>")
    plan = spark.createDataFrame([(1, "City", "DE", "tight"), (2, "City", "EN", "tight"), (3, "State", "EN", "none"), (4, "City", "FR", "none")], "record_id long, target_entity_type string, language string, adjacency string")
    got = {r.record_id: r.target_pattern_id for r in planning.attach_patterns(plan, catalog).collect()}
    assert got[1] == "A-2" and got[2] == "A-1" and got[3] is None and got[4] in ("A-1", "A-2", "A-3")
    made = spark.range(1).select(planning.scenario(F.lit("space"), F.lit("log_entry"), F.lit("City")).alias("v")).first().v
    assert made == "A log entry in the space domain. (target entity: City)"
    ids = spark.range(50).select(planning.fictional_national_id(F.col("id").cast("string"), F.lit("PT_BR")).alias("x")).select("x.*").collect()
    assert all(len(r.value) == 14 and r.pattern_id == "NID-007" for r in ids)


def test_stratified_dedup(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "x", 1), (3, "a b c", "y", 1), (4, "a b c", "x", 2)], "doc_id long, text string, s string, mode int")
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3, 4)], "vec_id long, embedding array<double>")
    kept = similarity.similarity_dedup(docs, v, strata=["s"], exempt=F.col("mode") == 2)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
