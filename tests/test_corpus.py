"""Corpus operators on hand-made rows."""

import ipaddress

from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import corpus, detection, measures
from spanlake.operators import records as R


def value(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("v")).first().v


def test_text_functions(spark):
    t, s = F.col("t"), F.col("s")
    assert value(spark, T.occurrences(t, s), t="aaaa", s="aa") == [0, 1, 2]
    assert value(spark, T.occurrences(t, s), t="aaaa", s="") == []
    assert value(spark, T.occurrences(t, s), t="a\\Eb x\\Eb", s="\\Eb") == [1, 6]
    assert value(spark, T.occurrences(t, s), t="\U0001f600é.é.", s="é.") == [1, 3] and value(spark, T.occurrences(t, s), t="ab", s="abc") == []
    for n in (256, 257, 258, 400, 3000):
        assert value(spark, T.occurrences(t, s), t="ba" * n, s="a") == list(range(1, 2 * n, 2)) and value(spark, T.occurrences(t, s), t="ab" * n, s="a") == list(range(0, 2 * n, 2))
    assert value(spark, T.occurrences(t, s), t=None, s="a") == [] and value(spark, T.occurrences(t, s), t="x", s="x") == [0]
    assert value(spark, T.count_apart(t, s), t="aaaa", s="aa") == 2
    assert value(spark, T.tokens(t), t="हिन्दी ok") == ["ह", "न", "द", "ok"]
    assert value(spark, T.check_iban(t), t="GB82 WEST 1234 5698 7654 32") is True
    assert value(spark, T.check_ssn(t), t="123-456789") is False
    assert value(spark, T.check_luhn(t), t="4111 1111 1111 1111") is True
    assert value(spark, T.check_ipv4(t), t="1.2.3.256") is False


def record(spark, *rows):
    """Records of (id, text, [(type, string, index)])."""
    full = [(i, t, [(k, x, m, True, "complete", "LOW") for k, x, m in es]) for i, t, es in rows]
    return spark.createDataFrame(full, f"record_id long, text string, entities array<{R.ENTITY}>")


def test_repair_and_filter(spark):
    held = record(spark, (1, "aaaa", [("City", "aa", 0)]), (2, "none", [("City", "Z", 0)]), (3, "x A", [("City", "A", 0), ("City", "A", 1)]), (4, "Rome and Rome", [("City", "Rome", 1)]), (5, "Rome and Rome", [("City", "Rome", 0), ("City", "Rome", 0), ("City", "", 0)]), (6, None, [("City", "A", 0)]), (7, "x", []))
    got = {(r.record_id, r.mention_index): (r.start, r.end, r.repair_status) for r in R.exploded(R.repair(held)).collect()}
    assert got == {(1, 0): (0, 2, "ok"), (1, 1): (1, 3, "ok"), (1, 2): (2, 4, "ok"), (2, 0): (None, None, "string_not_in_text"), (3, 0): (2, 3, "no_change"), (4, 0): (0, 4, "ok"), (4, 1): (9, 13, "ok"), (5, 0): (0, 4, "no_change"), (5, 1): (9, 13, "no_change"), (6, 0): (None, None, "string_not_in_text")}
    assert tuple(R.repair_totals(held).first()) == (9, 10, 2, 3, 2)
    assert R.repair(held.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, "b a b", [("City", "b", 7, False, "partial", "HIGH"), ("State", "zz", 0, True, "complete", "LOW"), ("City", "a", 0, True, "complete", "LOW"), ("City", "b", 0, True, "complete", "LOW")])], held.schema)
    own = R.repair(mixed).first().entities
    assert [(e.entity_string, e.mention_index, e.start, e.disclosed) for e in own] == [("b", 0, 0, False), ("a", 0, 2, True), ("b", 1, 4, False), ("zz", 0, None, True)]  # the first entity is the template; what the text lacks comes last
    entity = F.array(F.struct(F.lit("Foo").alias("entity_type"), F.lit("NONE").alias("sensitivity_tier"), F.lit("complete").alias("disclosure_form")))
    assert value(spark, corpus.filter_reasons(F.lit("ok"), F.lit("x"), entity)) == ["F3_invalid_sensitivity"]
    assert value(spark, corpus.filter_reasons(F.lit("json_error"), F.lit(" "), entity)) == ["F1_json_error", "F2_empty_text"]


def test_measures(spark):
    tau = measures.kendall(spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 3)], "k int, a int, b int")).first().tau
    assert round(tau, 4) == 0.6667
    same = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int")
    assert measures.cohen(same, "a", "b").first().kappa == 1.0 and measures.krippendorff(same, "a", "b").first().alpha == 1.0
    sizes = spark.createDataFrame([(k, "x") for k, n in ((1, 1), (2, 2), (3, 3), (4, 4)) for _ in range(n)], "record_id long, t string")
    assert corpus.entities_per_record(sizes).first().upper_median == 3


def test_matching(spark):
    span = "array<struct<entity_type:string,entity_string:string,start:int,end:int,form:string>>"
    rows = [
        (1, "en", [("t", "a", 0, 10, "x")], [("t", "a", 0, 3, ""), ("u", "a", 0, 10, "")]),
        (2, "de", [("t", "a", None, None, "x"), ("t", "b", 5, 9, "y")], [("t", "a", 1, 2, ""), ("t", "q", 8, 12, ""), ("t", "b", 5, 9, "")]),
        (3, "de", None, [("t", "c", 0, 1, "")]),
        (4, "en", [("t", "a", 0, 4, "")], None),
    ]
    held = spark.createDataFrame(rows, f"record_id long, lang string, gold {span}, pred {span}")
    count = lambda mode: {r.record_id: (r.tp, r.fp, r.fn) for r in detection.match_records(held, mode).collect()}
    # the string decides where gold has no place; the first free prediction in list order is taken
    assert count("partial") == {1: (1, 1, 0), 2: (2, 1, 0), 3: (0, 1, 0), 4: (0, 0, 1)}
    assert count("fuzzy") == {1: (1, 1, 0), 2: (2, 1, 0), 3: (0, 1, 0), 4: (0, 0, 1)}
    assert count("exact")[2] == (2, 1, 0) and count("exact")[1] == (0, 2, 1)
    by = {r.stratum: (r.tp, r.fp, r.fn) for r in detection.by_type(held.filter("record_id < 3"), "partial", ["t", "u"]).collect()}
    assert by == {"t": (3, 2, 0), "u": (0, 5, 0), "article_9": (0, 5, 0)}
    assert {r.lang: (r.tp, r.fn) for r in detection.by_axis(held, "lang", "partial").collect()} == {"en": (1, 1), "de": (2, 0)}
    assert {r.form: (r.tp, r.fp, r.fn) for r in measures.match_by_field(held.filter("gold is not null and pred is not null"), "form").collect()} == {"x": (2, 3, 0), "y": (1, 2, 0)}


def test_formats(spark):
    good = ["::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "fe80::1%a", " 2001:DB8::a "]
    bad = ["", ":", "1", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "g::", "12345::", "1.2.3.4::", "::1%", "::1%a%b", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7"]
    for x in good + bad:
        try:
            want = bool(ipaddress.ip_address(x.strip()))
        except ValueError:
            want = False
        assert want == (x in good) and value(spark, T.check_ip(F.col("t")), t=x) is want, x
    assert value(spark, T.check_ssn(F.col("t")), t=" 123456789 ") is True and value(spark, T.check_ssn(F.col("t")), t="000456789") is False
    assert value(spark, T.like_ssn(F.col("t")), t="123-456789") is True and value(spark, T.like_iban(F.col("t")), t="g b 8 2 x") is True
    bands = [(3, 25, "medium"), (1, 200, "low"), (6, 50, "high"), (8, 1000, "medium"), (18, 800, "high"), (12, 3000, "low"), (60, 3000, "high"), (0, 10, None)]
    assert all(value(spark, T.density_band(F.col("e"), F.col("t")), e=e, t=t) == b for e, t, b in bands)


def test_coverage_and_statistics(spark):
    frame = spark.createDataFrame([("a", "x", None), ("b", "y", "p"), ("a", "y", None)], "one string, two string, three string")
    got = {r.pair: (r.seen, r.possible) for r in corpus.pairwise_coverage(frame, ["one", "two", "three"]).collect()}
    assert got == {"one*two": (3, 4), "one*three": (1, 2), "two*three": (1, 2)}
    assert corpus.coverage_summary(corpus.pairwise_coverage(frame.limit(0), ["one", "two"])).first().mean_rate == 1.0
    held = record(spark, (1, "x", [("Religion", "x", 0), ("City", "x", 0)]), (2, None, []))
    got = {(r.section, r.name): r.n for r in corpus.statistics(held.withColumn("language", F.lit(None).cast("string")), ["language"]).collect()}
    assert got[("language", "?")] == 2 and got[("article_9", "entities")] == got[("article_9", "records")] == 1 and got[("overall", "entities")] == 2


def test_postprocessing(spark):
    rows = [(1, "A b A", [("SSN", "A", 0, True, "complete", ""), ("Ethnicity", "b", 0, True, "complete", "LOW"), ("Foo", "b", 5, True, "complete", None)], [("SSN", "A", "direct")], None), (2, None, None, None, None)]
    held = spark.createDataFrame(rows, f"record_id long, text string, entities array<{R.ENTITY}>, direct_indirect_classification array<{R.CLASSES}>, disclosure_policy array<{R.POLICIES}>")
    got = {r.record_id: r for r in R.postprocessed(held).collect()}
    one = got[1]
    assert [(e.entity_type, e.entity_string, e.mention_index, e.sensitivity_tier) for e in one.entities] == [("National_Identification_Number", "A", 0, "HIGH"), ("Foo", "b", 5, "MEDIUM"), ("National_Identification_Number", "A", 1, "HIGH")]
    assert tuple(one.sums) == (1, 1, 2, 1, ["Foo"]) and one.entity_count == 3 and got[2].entity_count == 0
    assert [tuple(c) for c in one.direct_indirect_classification] == [("SSN", "A", "direct"), ("Foo", "b", "indirect")] and len(one.disclosure_policy) == 2
    moved = spark.range(1).select(R.fixed_offsets(F.lit("Rome x"), F.expr("array(named_struct('entity_type', 'C', 'entity_string', 'Rome', 'start', 2, 'end', 6), named_struct('entity_type', 'C', 'entity_string', 'Rome', 'start', 0, 'end', 4), named_struct('entity_type', 'C', 'entity_string', 'Bern', 'start', 0, 'end', 4))")).alias("e")).first().e
    assert [tuple(e) for e in moved] == [("C", "Rome", 0, 4)]
