"""Record and entity views, validation, cleaning, repair, coverage and statistics of annotated corpora."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T
from spanlake.operators import records as R

tier = R.tier


def proposals(docs: DataFrame) -> DataFrame:
    """record_id, lang, source, text, entity_type, entity_string, pos and mention_index of every proposed entity; nothing is shuffled."""
    each = docs.select(F.col("doc_id").alias("record_id"), "lang", "source", "text", F.explode(R.proposed(F.col("text"))).alias("e"))
    return each.select("record_id", "lang", "source", "text", "e.*")


def records(docs: DataFrame) -> DataFrame:
    """record_id, lang, source, text and entities: each document as a record of its proposed entities."""
    made = F.transform(R.proposed(F.col("text")), lambda e: F.struct(e["entity_type"], e["entity_string"], e["mention_index"], F.lit(True).alias("disclosed"), F.lit("complete").alias("disclosure_form"), tier(e["entity_type"]).alias("sensitivity_tier")))
    return docs.select(F.col("doc_id").alias("record_id"), "lang", "source", "text", F.coalesce(made, R.empty(R.ENTITY)).alias("entities"))


def filter_reasons(status: Column, text: Column, entities: Column) -> Column:
    """Why a record goes: a JSON error, blank text (ends the test), or its first entity with a bad tier, type or form."""
    bad = F.filter(F.transform(entities, lambda e: F.when(~F.coalesce(e["sensitivity_tier"].isin("HIGH", "MEDIUM", "LOW"), F.lit(False)), "F3_invalid_sensitivity").when(~F.coalesce(e["entity_type"].isin(*consts.TIERS), F.lit(False)), "F4_non_canonical_type").when(~F.coalesce(e["disclosure_form"].isin(*consts.FORMS), F.lit(False)), "F5_invalid_form")), lambda r: r.isNotNull())
    first = F.array_compact(F.array(F.when(status == "json_error", F.lit("F1_json_error"))))
    rest = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array(F.lit("F2_empty_text"))).otherwise(F.slice(bad, 1, 1))
    return F.concat(first, rest)


def axis_counts(frame: DataFrame, axes: list[str]) -> DataFrame:
    """axis, value and n for each axis, null values as '?': one scan, one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("?")).alias("value")) for a in axes]))
    return frame.select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


def entities_per_record(entities: DataFrame) -> DataFrame:
    """Total, upper median (element n div 2), least and most entities of a record; counts are histogrammed first, so nothing is sorted on one task but the distinct counts."""
    sizes = entities.groupBy("record_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    run = sizes.select("k", "n", F.sum("n").over(Window.orderBy("k")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("records"))
    return run.agg(F.sum(F.col("k") * F.col("n")).alias("n_entities"), F.max("records").alias("n_records"), F.min(F.when(F.col("upto") > F.expr("records div 2"), F.col("k"))).alias("upper_median"), F.min("k").alias("least"), F.max("k").alias("most"))


def type_floor(entities: DataFrame, floor: int, types: list[str] | None = None) -> DataFrame:
    """Records that hold each type, and whether they reach the floor; zero-filled over ``types`` where given."""
    held = entities.filter("entity_type <> ''").select("record_id", "entity_type").distinct().groupBy("entity_type").agg(F.count("*").alias("n_records"))
    if types is not None:
        every = entities.sparkSession.createDataFrame([(t,) for t in types], "entity_type string")
        held = every.join(held, "entity_type", "left").select("entity_type", F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"))
    return held.withColumn("meets_floor", F.col("n_records") >= floor)


def pairwise_coverage(frame: DataFrame, axes: list[str]) -> DataFrame:
    """For each pair of axes: value pairs seen, and the product of the axes' observed values, nulls left out. One pass: pairs, and each axis's values as a pair with itself, are made distinct on the map side."""
    named = {a: F.col(a).cast("string") for a in axes}
    both = [*((a, a) for a in axes), *combinations(axes, 2)]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), named[a].alias("v1"), named[b].alias("v2")) for a, b in both]
    seen = frame.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("v1 is not null and v2 is not null").distinct()
    counts = seen.groupBy("a", "b").agg(F.count("*").alias("seen"))  # a row for each pair of axes
    own = counts.filter("a = b").select(F.col("a").alias("axis"), F.col("seen").alias("n"))
    pairs = frame.sparkSession.createDataFrame([(a, b) for a, b in combinations(axes, 2)], "a string, b string").join(counts, ["a", "b"], "left")
    pairs = pairs.join(own.select(F.col("axis").alias("a"), F.col("n").alias("na")), "a", "left").join(own.select(F.col("axis").alias("b"), F.col("n").alias("nb")), "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pairs.select(F.concat("a", F.lit("*"), "b").alias("pair"), zero("seen").alias("seen"), (zero("na") * zero("nb")).alias("possible"))


def coverage_summary(pairs: DataFrame, target: float = 0.98) -> DataFrame:
    """Mean rate over the pairs of ``pairwise_coverage`` (1 where no pair is possible), to four digits each, and whether it reaches the target."""
    rate = F.bround(F.coalesce(F.try_divide(F.col("seen").cast("double"), F.col("possible")), F.lit(1.0)), 4)
    return pairs.agg(F.count("*").alias("n_axis_pairs"), F.round(F.avg(rate), 9).alias("mean_rate"), (F.coalesce(F.avg(rate), F.lit(1.0)) >= target).alias("meets_target"))


def pattern_coverage(frame: DataFrame, pattern: str, size: int = 4127) -> DataFrame:
    """Distinct non-empty patterns, their share of a catalog of ``size``, and whether it is half or more."""
    seen = F.countDistinct(F.nullif(F.col(pattern), F.lit("")))
    return frame.agg(seen.alias("exercised"), F.round(seen / F.lit(float(size)), 9).alias("rate"), (seen * 2 >= size).alias("meets_target"))


def language_coverage(frame: DataFrame, language: str, tiers: dict[str, tuple[str, ...]] = consts.LANGUAGE_TIERS) -> DataFrame:
    """tier, target, seen, missing (comma-joined, sorted) and whether all are seen, of each tier of languages."""
    every = frame.sparkSession.createDataFrame([(t, x) for t, own in tiers.items() for x in own], "tier string, language string")
    held = every.join(frame.select(F.col(language).alias("language"), F.lit(True).alias("seen")).distinct(), "language", "left")
    lost = F.array_join(F.sort_array(F.collect_list(F.when(F.col("seen").isNull(), F.col("language")))), ",")  # a few dozen languages
    return held.groupBy("tier").agg(F.count("*").alias("target"), F.count_if("seen").alias("n_seen"), lost.alias("missing"), F.bool_and(F.col("seen").isNotNull()).alias("whole"))


def frame_matrix(entities: DataFrame, frame: str = "behavioral_frame") -> DataFrame:
    """Distinct behavioural frames of each type, null values as '?'."""
    named = lambda c: F.coalesce(F.col(c), F.lit("?"))
    return entities.groupBy(named("entity_type").alias("entity_type")).agg(F.countDistinct(named(frame)).alias("n_frames"))


def crosstab(frame: DataFrame, one: str, two: str, ones: list[str], twos: list[str]) -> DataFrame:
    """Cells of two axes' domains that are seen, all cells, and their rate."""
    both = frame.filter(F.col(one).isin(ones) & F.col(two).isin(twos)).select(one, two).distinct()
    return both.agg(F.count("*").alias("seen")).select("seen", F.lit(len(ones) * len(twos)).cast("long").alias("possible"), F.round(F.col("seen") / float(len(ones) * len(twos)), 9).alias("rate"))


def statistics(records: DataFrame, axes: list[str]) -> DataFrame:
    """section, name and n: counts of each axis's values, and of the entities' types, tiers, forms, disclosure and identifier classes.

    Null values count as '?'. ``article_9`` has the entities of those types and the records that hold one; ``overall``
    records and entities. One scan: entities are counted by their fields first, map-side, and these few counts become the
    sections; a record's own cells ride on its first row. ``records`` may have direct_indirect_classification.
    """
    kind = "struct<section:string,name:string>"
    cell = lambda section, name: F.struct(F.lit(section).alias("section"), F.coalesce(name.cast("string"), F.lit("?")).alias("name")).cast(kind)
    none = F.lit(None).cast(kind)  # marks an entity's row
    special = lambda t: F.coalesce(t.isin(*consts.ARTICLE_9), F.lit(False))
    holds = F.exists("entities", lambda e: special(e["entity_type"]))
    cells = [F.array(none, *[cell(a, F.col(a)) for a in axes], cell("overall", F.lit("records"))), F.when(holds, F.array(cell("article_9", F.lit("records")))).otherwise(R.empty(kind))]
    if "direct_indirect_classification" in records.columns:
        cells.append(F.transform(F.coalesce("direct_indirect_classification", R.empty(R.CLASSES)), lambda c: cell("identifier_class", c["identifier_class"])))
    each = records.select(F.concat(*cells).alias("cells"), "entities").select("cells", F.posexplode_outer("entities").alias("pos", "e"))
    rows = each.select("pos", "e", F.explode(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("cells")).otherwise(F.array(none))).alias("c"))
    entity = F.col("c").isNull()
    fields = [F.when(entity, F.col(f"e.{f}").cast("string")).alias(f) for f in ("entity_type", "sensitivity_tier", "disclosure_form")]
    fields.append(F.when(entity, F.coalesce("e.disclosed", F.lit(False)).cast("string")).alias("disclosed"))
    counted = rows.filter(~entity | F.col("pos").isNotNull()).groupBy("c", *fields).agg(F.count("*").alias("n"))
    told = F.array(*[cell(f, F.col(f)) for f in ("entity_type", "sensitivity_tier", "disclosure_form", "disclosed")], cell("overall", F.lit("entities")))
    told = F.concat(told, F.when(special(F.col("entity_type")), F.array(cell("article_9", F.lit("entities")))).otherwise(R.empty(kind)))
    shown = counted.select("n", F.explode(F.when(entity, told).otherwise(F.array("c"))).alias("c"))
    return shown.groupBy("c.section", "c.name").agg(F.sum("n").alias("n"))


def _checked(entities: DataFrame, checkers: dict) -> tuple[Column, Column]:
    """The section that checks an entity (null: none), and whether it passes."""
    section = passed = None
    for name, (types, gate, check) in checkers.items():
        here = F.col("entity_type").isin(*types) & gate(F.col("entity_string"))
        section = F.when(here, name) if section is None else section.when(here, name)
        passed = F.when(here, check(F.col("entity_string"))) if passed is None else passed.when(here, check(F.col("entity_string")))
    return section, F.coalesce(passed, F.lit(False))


def format_compliance(entities: DataFrame, checkers: dict = T.CHECKERS, target: float = 0.95) -> DataFrame:
    """section, checked, passed, rate and whether it reaches the target: by type, and for IBANs and social security numbers among the strings shaped like them."""
    section, passed = _checked(entities, checkers)
    out = entities.select(section.alias("section"), passed.alias("passed")).filter("section is not null").groupBy("section").agg(F.count("*").alias("checked"), F.count_if("passed").alias("passed"))
    return out.withColumn("rate", F.round(F.col("passed") / F.col("checked"), 9)).withColumn("meets_target", F.col("passed") >= F.col("checked") * F.lit(target))


def format_failures(entities: DataFrame, checkers: dict = T.CHECKERS, most: int = 10, width: int = 80) -> DataFrame:
    """section, record_id and entity_string (cut) of the first ``most`` failures of each section; groups are trimmed before the shuffle."""
    section, passed = _checked(entities, checkers)
    bad = entities.select(section.alias("section"), "record_id", "mention_index", F.left("entity_string", F.lit(width)).alias("entity_string"), passed.alias("ok")).filter("section is not null and not ok")
    order = Window.partitionBy("section").orderBy("record_id", "entity_string", "mention_index")
    return bad.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("section", "record_id", "mention_index", "entity_string")


def windows(docs: DataFrame, size: int = 1200, stride: int = 1000) -> DataFrame:
    """Chunks of ``size`` code points each ``stride``, the last ending at the text's end."""
    n = F.greatest(F.length("text"), F.lit(1))
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select("doc_id", "chunk", (F.col("chunk") * stride).alias("start"), F.length(F.substring(F.col("text"), F.col("chunk") * stride + 1, F.lit(size))).alias("n_chars"))
