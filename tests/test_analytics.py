"""Validation, cleaning, similarity, span resolution, plans, sources and streams against hand-made rows and brute force."""

import json
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.operators import measures, records, resolve, similarity, validation
from spanlake.plans import planning
from spanlake.sources import corpus_io
from spanlake.streaming import resume


def good():
    entity = {"entity_type": "City", "entity_string": "Rome", "mention_index": 0, "disclosed": True, "disclosure_form": "complete", "sensitivity_tier": "LOW"}
    axes = dict.fromkeys(consts.AXIS_FIELDS, "x") | {"adjacency": "none"}
    return {"record_id": 1, "mode": "coverage", "axes": axes, "target_entity_type": "City", "target_pattern_id": None, "behavioral_frame": "x", "text": "Rome", "entities": [entity], "entity_count": 1, "generation_status": "ok"}


def errors_of(spark, *records):
    raw = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "record_index long, raw string")
    return [r.errors for r in validation.validation_errors(raw).orderBy("record_index").collect()]


def test_validation(spark):
    dup = good()
    dup["entities"] = dup["entities"] * 2
    dup["entity_count"] = 2
    odd = good() | {"mode": "m", "generation_status": "json_error", "text": "", "axes": 3, "entity_count": "1"}
    del odd["record_id"]
    bad = good()
    bad["entities"] = [7, {"entity_type": "City"}, good()["entities"][0] | {"entity_type": "Foo", "entity_string": "", "mention_index": -1, "disclosed": "no", "disclosure_form": None, "sensitivity_tier": "X"}]
    true_index = good()
    true_index["entities"][0]["mention_index"] = True
    got = errors_of(spark, good(), dup, odd, bad, good() | {"entities": {}}, "nonsense", "[1]", None, true_index)
    assert got[0] == [] and got[8] == []
    assert got[1] == ["entity[1]:duplicate_mention_index:City:Rome:0"]
    assert got[2] == ["missing_top_level_fields:record_id", "axes_not_dict", "invalid_mode:m", "invalid_generation_status:json_error", "text_empty", "entity_count_mismatch:declared=1,actual=1"]
    assert got[3] == ["entity_count_mismatch:declared=1,actual=3", "entity[0]:not_dict", "entity[1]:missing_fields:disclosed,disclosure_form,entity_string,mention_index,sensitivity_tier"] + [f"entity[2]:{x}" for x in ("non_canonical_type:Foo", "entity_string_invalid", "mention_index_invalid:-1", "disclosed_not_bool:no", "invalid_disclosure_form:None", "invalid_sensitivity_tier:X")]
    assert got[4] == ["entities_missing_or_not_list"]
    assert got[5:8] == [["json_error"]] * 3


def test_cleaning(spark):
    kinds = spark.createDataFrame([("SSN",), ("Ethnicity",), ("Foo",), ("City",)], "t string")
    assert [r.x for r in kinds.select(validation.remapped(F.col("t")).alias("x")).collect()] == ["National_Identification_Number", None, "Foo", "City"]
    rows = [("b a b", [("T", " b ", None, None, None, ""), ("T", "b", None, None, None, ""), ("U", "z", 5, False, "partial", ""), ("T", "", 0, True, "", ""), ("T", "a", None, None, None, "")])]
    frame = spark.createDataFrame(rows, f"text string, es array<{records.ENTITY}>")
    got = frame.select(validation.coerced(F.col("es"), F.col("text")).alias("x")).first().x
    assert [(e.entity_string, e.mention_index, e.disclosed, e.disclosure_form) for e in got] == [("z", 5, False, "partial"), ("b", 0, True, "complete"), ("b", 1, True, "complete"), ("a", 0, True, "complete")]
    checked = frame.select(validation.self_check(F.lit("b"), F.slice("es", 2, 2), F.lit("paired_sweep"), F.array(F.lit("q"))).alias("f")).first().f
    assert checked == ["entity_not_in_text[1]", "frozen_values_missing"]
    found = spark.range(1).select(validation.recovered(F.lit("in Rome"), F.lit(""), F.lit("Oslo| Rome;Bern")).alias("x")).first().x
    assert [(e.entity_type, e.entity_string) for e in found] == [("Full_Name", "Rome")]
    entity = lambda t, m: (t, "x", m, True, "complete", "LOW")
    pooled = spark.createDataFrame([(1, "x x x", [entity("A", 0), entity("B", 0)])], f"record_id long, text string, entities array<{records.ENTITY}>")
    assert [(e.entity_type, e.mention_index) for e in pooled.select(records.added_mentions(F.col("text"), F.col("entities")).alias("e")).first().e] == [("A", 1)]


def test_cosine_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    x[60:] = x[:60] + rng.normal(size=(60, 6)) * 0.4
    x[7] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    for threshold in (0.85, 0.3, -0.2):
        want = {(i, j) for i, j in combinations(range(120), 2) if u[i] @ u[j] > threshold}
        got = [(r.i, r.j) for r in similarity.cosine_pairs(frame, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert similarity.cosine_pairs(frame.limit(0), 0.5).count() == 0
    kernel = np.linalg.eigvalsh(u @ u.T / len(u)).clip(1e-12)
    p = kernel / kernel.sum()
    got = similarity.vendi(frame, dimensions=6).first().vendi
    assert got == pytest.approx(float(np.exp(-(p * np.log(p)).sum())), rel=1e-4)


def test_token_sets_and_dedup(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 9))) for _ in range(80)]
    rows = [(i, rng.choice(["x", "y", None]), t) for i, t in enumerate(texts)]
    sets = {i: (k, set(t.split())) for i, k, t in rows}
    for percent in (50, 80):
        want = {(i, j) for i, j in combinations(range(80), 2) if sets[i][0] == sets[j][0] and sets[i][1] and 100 * len(sets[i][1] & sets[j][1]) > percent * len(sets[i][1] | sets[j][1])}
        got = [(r.i, r.j) for r in similarity.token_set_pairs(spark.createDataFrame(rows, "doc_id long, k string, text string"), ["k"], percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    chain = spark.createDataFrame([(0, 1), (1, 2)], "i long, j long")
    kept = similarity.drop_later(spark.range(4).withColumnRenamed("id", "doc_id"), chain, "doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_and_bleu(spark):
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randint(0, 12)) for _ in range(2))
        assert similarity._lcs(a, b) == lcs(a, b)
    docs = [rng.choices("abcde", k=rng.randint(0, 14)) for _ in range(12)] + [["q"], []]

    def bleu(i):
        own, others, total = docs[i], docs[:i] + docs[i + 1 :], 0.0
        for n in (1, 2, 3):
            grams = lambda w: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))  # noqa: E731, B023
            count, refs = grams(own), [grams(o) for o in others]
            hit = sum(min(c, max(r[g] for r in refs)) for g, c in count.items())
            if n == 1 and not hit:
                return 0.0
            total += np.log((hit or 0.1) / max(sum(count.values()), 1)) / 3
        ref = min((abs(len(o) - len(own)), len(o)) for o in others)[1]
        return float(np.exp(total + (0 if len(own) > ref else 1 - ref / len(own))))

    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert similarity.self_bleu(frame, 3).first().self_bleu == pytest.approx(np.mean([bleu(i) for i in range(len(docs))]), abs=2e-6)


def test_resolution(spark):
    text = "google.com, google! Ann Lee met Ann. 山田太郎"
    assert [(s["start"], s["text"]) for s in resolve.greedy(text, [("A", "google"), ("B", "Ann"), ("C", "Ann Lee"), ("D", "田")])] == [(12, "google"), (20, "Ann Lee"), (32, "Ann"), (38, "田")]
    assert len(resolve.greedy("x x x", [("A", "x"), ("A", "x")])) == 2 and len(resolve.greedy("x x x", [("A", "x")], every=True)) == 3
    one = lambda s, e, t="A", **k: {"start": s, "end": e, "type": t, "text": "abcdefghij"[s:e], **k}
    voted = resolve.vote([[one(0, 5)], [one(0, 6)], [one(7, 9)]])
    assert [(s["start"], s["end"], s["agreement"]) for s in voted] == [(0, 6, 2)]
    assert resolve.vote([[one(0, 5)], [one(0, 6)]], mode="exact") == []
    assert [s["end"] for s in resolve.without_overlaps([one(0, 3), one(1, 6), one(5, 7)])] == [6]
    merged = resolve.reconcile([one(0, 5)], [one(0, 5, "B", agreement=2), one(7, 9, "C", agreement=2)])
    assert [(s["type"], s["start"]) for s in merged] == [("B", 0), ("C", 7)]
    near = resolve.suppressed([one(0, 10, score=0.5), one(1, 10, score=0.9), one(0, 10, "B", score=0.1)])
    assert sorted((s["type"], s["score"]) for s in near) == [("A", 0.9), ("B", 0.1)]
    assert [(s["start"], s["end"]) for s in resolve.merged([[one(0, 5)], [one(4, 6), one(3, 9)], [one(8, 9)]])] == [(3, 9)]  # later spans must overlap the seed itself
    assert resolve.merged([[one(0, 5), one(0, 5)]]) == []
    whole = resolve.reconciled("Ann met Bo, Bo met Ann", [{"start": 0, "end": 3, "type": "X", "text": "Ann"}], [{"start": 8, "end": 10, "type": "P", "text": "Bo", "source": "string_match"}], [{"type": "P", "text": "Bo", "context": "Bo met Ann"}, {"type": "P", "text": "Ann", "start": 0, "end": 3}, {"type": "Q", "text": "met"}, {"type": "Z", "text": "nn"}], {("P", "ann"): 2})
    assert [(s["start"], s["type"], s["source"]) for s in whole] == [(0, "P", "consensus_override"), (4, "Q", "consensus"), (8, "P", "string_match"), (12, "P", "consensus")]
    assert [(s["type"], s["start"], s["end"]) for s in resolve.tagged_spans(["X", "I-X", None, "I-Y", "E-Z", "B-X"], [(0, 2), (2, 2), (2, 4), (4, 6), (6, 8), (8, 9)])] == [("X", 0, 2), ("Z", 6, 8), ("X", 8, 9)]
    tags = resolve.tagged_spans(["B-X", "E-X", "O", "S-Y", "I-Z", "I-Z", "B-X"], [(k * 2, k * 2 + 2) for k in range(7)])
    assert [(s["type"], s["start"], s["end"]) for s in tags] == [("X", 0, 4), ("Y", 6, 8), ("Z", 8, 12), ("X", 12, 14)]
    for answer in ('{"City": ["Rome"]}', '```json\n{"City": [{"text": "Rome", "context": "in Rome"}]}\n```', 'So: [{"entity_type": "City", "entity_string": "Rome"}] ok', json.dumps('{"City": "Rome"}')):
        assert [s["start"] for s in resolve.model_spans("to Rome in Rome", resolve.listed_entities(resolve.parse_response(answer)))] == [11 if "context" in answer else 3]
    assert resolve.parse_response("no json") == {} and resolve.parse_response(None) == {}
    coarse = resolve.parse_response('{"city": ["Rome", {"text": "Bern", "context": "in Bern"}], "Person": "Ann", "FOO": ["x"], "AGE": {"text": "7"}}')
    assert resolve.listed_entities(coarse, consts.COARSE_LABELS) == [{"type": "CITY", "text": "Rome", "context": None}, {"type": "CITY", "text": "Bern", "context": "in Bern"}, {"type": "PERSON", "text": "Ann", "context": None}]
    assert [e["type"] for e in resolve.listed_entities({"entities_extracted": {"Foo": ["x"]}}, consts.COARSE_LABELS)] == ["Foo"] and len(consts.COARSE_LABELS) == 21
    assert resolve.responses_to_spans("in Rome", {"a": '{"City": ["Rome"]}', "b": '{"City": ["Rome"]}', "c": ""})[0]["agreement"] == 2
    frame = spark.createDataFrame([(1, "x y x", ["x"]), (2, "", None)], "record_id long, t string, v array<string>")
    made = frame.select(resolve.per_record(lambda t, v: resolve.greedy(t, [("A", x) for x in v or []], every=True), F.col("t"), F.col("v")).alias("s")).collect()
    assert [len(r.s) for r in made] == [2, 0] and made[0].s[1].start == 4


def test_plans(spark):
    rows = planning.covering_array(planning.AXES)
    assert planning.uncovered(rows, planning.AXES) == 0 and len(rows) < 500
    plan = planning.generation_plan(spark).cache()
    assert plan.count() == 5510 and plan.select("record_id").distinct().count() == 5510
    assert plan.groupBy("target_entity_type").count().agg(F.min("count"), F.count("*")).first()[:] == (51, 51) or plan.groupBy("target_entity_type").count().agg(F.min("count")).first()[0] >= 50
    assert plan.filter("co_occurrence_pattern <> 'none'").groupBy("co_occurrence_pattern").count().filter("count >= 3").count() == 15
    assert plan.filter("(adjacency = 'tight') <> (behavioral_frame = 'co_occurrence')").count() == 0
    anchors = spark.range(1, 101).select(F.col("id").alias("anchor_id"), *[F.lit("x").alias(a) for a in ("format", "domain", "difficulty", "density")])
    counts = {r.sweep_axis: r["count"] for r in planning.paired_plan(anchors).groupBy("sweep_axis").count().collect()}
    assert counts == {"text_format": 350, "text_domain": 360, "difficulty_x_density": 180}


def test_statistics(spark):
    ranks = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "k int, a double, b double")
    assert measures.spearman(ranks).first().rho == 1.0
    assert measures.bootstrap_kendall(ranks.limit(2)).first()[:] == (None, None)
    low, high = measures.bootstrap_kendall(ranks, 200).first()
    assert 0 < low <= high <= 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([good(), good() | {"record_id": 2}]))
    (tmp_path / "w.json").write_text(json.dumps({"records": [good()]}))
    (tmp_path / "l.jsonl").write_text(json.dumps(good()) + "\n\n" + '{"record_id": "x')
    array = corpus_io.read_array(spark, str(tmp_path / "a.json"))
    assert [(r.record_id, r._source_file, r.entities[0].entity_string) for r in array.collect()] == [(1, "a.json", "Rome"), (2, "a.json", "Rome")]
    assert corpus_io.read_wrapped(spark, [str(tmp_path / "a.json"), str(tmp_path / "w.json")]).count() == 3
    assert [r.record_id for r in corpus_io.read_lines(spark, str(tmp_path / "l.jsonl"), tolerant=True).collect()] == [1]
    corpus_io.write_corpus(array, str(tmp_path / "out"))
    assert "_source_file" not in spark.read.parquet(str(tmp_path / "out")).columns
    corpus_io.write_split(array.withColumn("text", F.when(F.col("record_id") == 2, "").otherwise("t")), str(tmp_path / "split"))
    assert {r.outcome: r["count"] for r in spark.read.json(str(tmp_path / "split")).groupBy("outcome").count().collect()} == {"clean": 1, "failed": 1}
    corpus_io.write_sheets(array.select("record_id"), str(tmp_path / "sheets"), ["p", "q"], ["answer"])
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets")).count() == 4
    assert corpus_io.not_done(array, array.filter("record_id = 1"), "record_id").count() == 1
    with pytest.raises(ValueError):
        corpus_io.concatenate([array, array], 3)
    (tmp_path / "c.md").write_text('# T\n## Entity 3: City\n| ID | P | D | E |\n|---|---|---|---|\n| CI-001 | name | words | Rome, Bern (a, b), "x, y" |\n')
    row = corpus_io.read_catalog(spark, str(tmp_path / "c.md")).first()
    assert (row.entity_number, row.entity_type, row.pattern_id, row.examples) == (3, "City", "CI-001", ["Rome", "Bern (a, b)", '"x, y"'])
    assert (row.entity_category, row.language_hint, row.dimensions, row.declared) == ("Geographic", None, [], None)
    (tmp_path / "d.md").write_text("## Entity 1: Password\n### Natural Patterns\n| ID | P | D | E |\n|---|---|---|---|\n| PW-001 | German word | x | a |\n| PW-002 | y | kanji | b |\n**Total patterns for Password: 3**\n### Cross-Cutting Consistency Sweep\n| Dimension | S | IDs |\n|---|---|---|\n| Masked | ✓ | PW-002, PW-001 |\n| Nested | ✗ | PW-001 |\n| Old | yes | PW-002 |\n## Entity 2: Foo\n| FO-001 | a | b | c |\n")
    got = {r.pattern_id: (r.entity_category, r.language_hint, r.dimensions, r.declared) for r in corpus_io.read_catalog(spark, str(tmp_path / "d.md")).collect()}
    assert got == {"PW-001": ("Digital and Other", "DE", ["Masked"], 3), "PW-002": ("Digital and Other", "JA", ["Masked", "Old"], 3), "FO-001": ("Unknown", None, [], None)}
    corpus_io.write_report(array.groupBy().count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["count"] == 2
    raw = corpus_io.raw_lines(spark, str(tmp_path / "l.jsonl"))
    assert [r.raw[:13] for r in raw.orderBy("record_index").collect()] == [json.dumps(good())[:13], '{"record_id":'] and raw.select("record_index").distinct().count() == 2


def test_stream_windows(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    rows = [("a", "2024-01-01 00:10:00", "x"), ("a", "2024-01-01 00:20:00", "x"), ("b", "2024-01-01 01:10:00", "y")]
    (source / "1.json").write_text("\n".join(json.dumps({"k": k, "at": t, "g": g}) for k, t, g in rows))
    lines = spark.readStream.schema("k string, at timestamp, g string").json(str(source))

    def run(frame, name, mode):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.k for r in run(resume.distinct_records(lines, "k", "at"), "once", "append")) == ["a", "b"]
    assert sorted((str(r.start)[11:16], r.g, r.n) for r in run(resume.windowed_counts(lines, "at", "g"), "counts", "complete")) == [("00:00", "x", 2), ("01:00", "y", 1)]


def test_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = (str(source), str(tmp_path / "out"), str(tmp_path / "cp"), "k long, v string", lambda f: f.withColumn("n", F.length("v")))
    for part in (1, 2):
        (source / f"{part}.json").write_text(json.dumps({"k": part, "v": "ab"}))
        resume.process(spark, *args).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == part
