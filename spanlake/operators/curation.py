"""Routing, label folding, rendering, capped examples, name triples, critical gates and repair totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T
from spanlake.operators import corpus, validation
from spanlake.operators import records as R


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key in a small constant table; null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def routed(records: DataFrame, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records after the branches self-check -> verify or enrich, verify -> repair or enrich, with ``route``: the steps taken.

    ``records`` has text, entities, mode, frozen, target_entity_type and example. ``verify`` (a model, as a rule) gets
    only the records that failed; those without entities after it take the first part of their example that the text holds.
    Null entities count as none.
    """
    listed = F.coalesce("entities", F.array().cast(records.schema["entities"].dataType))
    checked = records.withColumn("entities", listed).withColumn("__failed", F.size(validation.self_check(F.col("text"), F.col("entities"), F.col("mode"), F.col("frozen"))) > 0)
    sound = checked.filter(~F.col("__failed")).drop("__failed").withColumn("route", F.lit("enrich"))
    failed = checked.filter("__failed").drop("__failed")
    seen = verify(failed) if verify else failed
    empty = F.size("entities") <= 0
    fields = records.schema["entities"].dataType.elementType.fieldNames()
    found = validation.recovered(F.col("text"), F.col("target_entity_type"), F.col("example"))
    kept = F.transform(found, lambda e: F.struct(*[e[f] for f in fields]))
    mended = seen.withColumn("route", F.when(empty, "verify>repair>enrich").otherwise("verify>enrich")).withColumn("entities", F.when(empty, kept).otherwise(F.col("entities")))
    return sound.unionByName(mended)


def fold_label(entity_type: Column, sure: tuple[str, ...] = ("high",)) -> Column:
    """The external label a type folds into, of the labels whose mapping is ``sure``; null for others."""
    return lookup({t: label for label, (how, types) in consts.FOLDS.items() if how in sure for t in types}, entity_type)


def translated_prefix(pattern_id: Column, entity_type: Column) -> Column:
    """A pattern id of the third catalog as the fourth writes it: CR becomes CRIME; PA of parties PP, PP of passports PA."""
    number = F.regexp_extract(pattern_id, "^[A-Z]+-(.*)$", 1)
    prefix = F.regexp_extract(pattern_id, "^([A-Z]+)-", 1)
    moved = F.when(prefix == "CR", "CRIME").when((prefix == "PA") & (entity_type == "Political_Party"), "PP").when((prefix == "PP") & (entity_type == "Passport_Number"), "PA")
    return F.when(moved.isNotNull(), F.concat(moved, F.lit("-"), number)).otherwise(pattern_id)


def rendered_entities(entities: Column, cap: int = 25) -> Column:
    """One line for each of the first ``cap`` entities, and how many more there are."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    line = F.transform(F.slice(entities, 1, cap), lambda e: F.concat(F.lit("- "), shown(e["entity_type"]), F.lit(': "'), F.coalesce(e["entity_string"], F.lit("")), F.lit('" (sensitivity='), shown(e["sensitivity_tier"]), F.lit(", disclosed="), F.initcap(shown(e["disclosed"])), F.lit(")")))
    more = F.when(F.size(entities) > cap, F.array(F.concat(F.lit("... and "), F.size(entities) - cap, F.lit(" more")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(line, more), "\n")


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{{ name }}`` replaced by values; null as the empty string."""
    for name, value in values.items():
        for mark in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            template = F.replace(template, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return template


def shortened(text: Column, width: int, suffix: str = "") -> Column:
    """The first ``width`` characters, with a suffix where some are cut off."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit(suffix))).otherwise(text)


def capped_examples(frame: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark trims groups before the shuffle, so a hot group doesn't gather."""
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= most).drop("__rank")


def name_triples(entities: DataFrame) -> DataFrame:
    """Full_Name mentions of each record and how many comply: one word, or first and last names annotated beside it."""
    words = F.filter(F.split("entity_string", r"\s+"), lambda w: w != "")
    full = entities.filter("entity_type = 'Full_Name'").select("record_id", words.alias("w"))
    full = full.groupBy("record_id", "w").agg(F.count("*").alias("n")).withColumn("first", F.get("w", F.lit(0))).withColumn("last", F.array_join(F.slice("w", 2, 1000000), " "))
    part = lambda kind, name: entities.filter(F.col("entity_type") == kind).select("record_id", F.col("entity_string").alias(name)).distinct().withColumn(f"has_{name}", F.lit(True))
    joined = full.join(part("First_Given_Name", "first"), ["record_id", "first"], "left").join(part("Last_Family_Name", "last"), ["record_id", "last"], "left")
    fine = (F.size("w") < 2) | (F.col("has_first").isNotNull() & F.col("has_last").isNotNull())
    return joined.groupBy("record_id").agg(F.sum("n").alias("full_names"), F.coalesce(F.sum(F.when(fine, F.col("n"))), F.lit(0)).alias("compliant"))


def gate_report(records: DataFrame, floor: int = 50) -> DataFrame:
    """gate, passed and total of the six critical gates and ``pass``; the row ``all`` is their conjunction.

    ``records`` has record_id, text and entities. Empty corpora: offsets and floor fail, the rest pass. One scan sums
    within records; a second one counts records by type.
    """
    listed, text = F.col("entities"), F.coalesce("text", F.lit(""))
    aligned = F.filter(listed, lambda e: F.size(T.occurrences(text, e["entity_string"])) > e["mention_index"])
    full = F.filter(listed, lambda e: e["entity_type"] == "Full_Name")
    holds = lambda kind, name: F.exists(listed, lambda o: (o["entity_type"] == kind) & (o["entity_string"] == name))

    def named(e: Column) -> Column:
        words = F.filter(F.split(e["entity_string"], r"\s+"), lambda w: w != "")
        return (F.size(words) < 2) | (holds("First_Given_Name", F.get(words, F.lit(0))) & holds("Last_Family_Name", F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), " ")))

    groups = R.mention_groups(F.col("text"), listed)
    empty = F.filter(R.groups(listed), lambda g: F.length(g["entity_string"]) == 0)
    gates = {
        "offset_accuracy": (F.size(aligned), F.size(listed)),
        "zero_entity_rate": (F.when(F.size(listed) > 0, 1).otherwise(0), F.lit(1)),
        "triple_names": (F.size(F.filter(full, named)), F.size(full)),
        "canonical_types": (F.size(F.filter(listed, lambda e: F.coalesce(e["entity_type"].isin(*consts.TIERS), F.lit(False)))), F.size(listed)),
        "multi_mentions": (F.size(F.filter(groups, lambda g: g["complete"])), F.size(groups) + F.size(empty)),
    }
    cells = records.select(*[F.struct(a.cast("long").alias("passed"), b.cast("long").alias("total")).alias(g) for g, (a, b) in gates.items()])
    sums = cells.agg(*[F.coalesce(F.sum(f"{g}.{c}"), F.lit(0)).alias(f"{g}_{c}") for g in gates for c in ("passed", "total")])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"{g}_passed").alias("passed"), F.col(f"{g}_total").alias("total")) for g in gates])).alias("x")).select("x.*")
    held = corpus.type_floor(R.exploded(records), floor, list(consts.TIERS))
    out = rows.unionByName(held.agg(F.lit("type_floor").alias("gate"), F.count_if("meets_floor").alias("passed"), F.count("*").alias("total")))
    p, n = F.col("passed"), F.col("total")
    passed = F.when(F.col("gate") == "zero_entity_rate", (n - p) * 1000 <= n * 5).when(F.col("gate") == "multi_mentions", p * 100 >= n * 95).when(F.col("gate") == "offset_accuracy", (p == n) & (n > 0)).otherwise(p == n)
    judged = out.withColumn("pass", passed)
    both = judged.select(F.explode(F.array("gate", F.lit("all"))).alias("gate"), "passed", "total", "pass")
    return both.groupBy("gate").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.bool_and("pass").alias("pass"))


def offending_types(entities: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` frequent types that aren't canonical; ties by name."""
    bad = entities.filter(~F.coalesce(F.col("entity_type").isin(*consts.TIERS), F.lit(False)))
    return bad.groupBy(F.coalesce("entity_type", F.lit("?")).alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(most)


def record_summary(text: Column, entities: Column, fields: dict[str, Column], width: int = 2200, cap: int = 12) -> Column:
    """A record as JSON for a judge: fields, the text cut to ``width``, and the first ``cap`` entities."""
    own = F.transform(F.slice(entities, 1, cap), lambda e: F.struct(*[e[c].alias(c) for c in ("entity_string", "entity_type", "disclosed", "disclosure_form", "sensitivity_tier")]))
    body = shortened(F.coalesce(text, F.lit("")), width, " ... [truncated]")
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], body.alias("text"), own.alias("annotated_entities")), {"ignoreNullFields": "false"})


def config_hash(frame: DataFrame, without: tuple[str, ...] = ("record_id",)) -> Column:
    """SHA-256 of a row's other columns as JSON, by name, so that it doesn't depend on their order; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in frame.columns if c not in without)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def drop_details(reasons: DataFrame, key: str = "record_id", most: int = 200) -> DataFrame:
    """The first ``most`` dropped records by key, with their reasons (an array); each task passes on at most ``most``."""
    return reasons.filter(F.size("reasons") > 0).orderBy(key).limit(most)


def anchor_completeness(plan: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """sweep_axis, anchors and how many of them have all variants that the sweep makes."""
    each = plan.groupBy("sweep_axis", "anchor_id").agg(F.countDistinct("sweep_value").alias("n"))
    wanted = lookup({k: str(v) for k, v in sizes.items()}, F.col("sweep_axis")).cast("int")
    return each.groupBy("sweep_axis").agg(F.count("*").alias("anchors"), F.count_if(F.col("n") == wanted).alias("whole"))


def run_multiplicity(frame: DataFrame, key: str, wanted: int = 3) -> DataFrame:
    """Keys that don't have exactly ``wanted`` rows, and how many they have."""
    return frame.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") != wanted)


def looked_up(plan: DataFrame, catalog: DataFrame, key: str = "target_pattern_id") -> DataFrame:
    """``plan`` with description and first example of its pattern, null for unknown ones; of repeated pattern ids the least row counts."""
    first = catalog.groupBy(F.col("pattern_id").alias(key)).agg(F.min(F.struct("description", F.get("examples", F.lit(0)).alias("example"))).alias("p"))
    return plan.join(first, key, "left").withColumns({"target_pattern_desc": F.col("p.description"), "target_pattern_example": F.col("p.example")}).drop("p")


def paired_reports(one: DataFrame, two: DataFrame, key: str = "detector", score: str = "f1") -> DataFrame:
    """k, a and b: the scores of two corpora joined by detector, for the rank statistics."""
    return one.select(F.col(key).alias("k"), F.col(score).alias("a")).join(two.select(F.col(key).alias("k"), F.col(score).alias("b")), "k")


def detector_report(matched: DataFrame, n_types: int = len(consts.TIERS)) -> DataFrame:
    """Micro precision, recall and F1 by detector and mode of (detector, mode, entity_type, tp, fp, fn), and macro F1 over all ``n_types``: types never seen count 0."""
    each = matched.groupBy("detector", "mode", "entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    f1 = lambda tp, fp, fn: ratio(2 * tp, 2 * tp + fp + fn)
    scored = each.withColumn("f", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return scored.groupBy("detector", "mode").agg(F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(f1(tp, fp, fn), 9).alias("micro_f1"), F.round(F.sum("f") / n_types, 9).alias("macro_f1"))


def recall_gaps(matched: DataFrame, field: str, high: str, low: str) -> DataFrame:
    """By detector: recall at two values of a field of (detector, field, tp, fn), and their difference; 0 without gold."""
    part = lambda v: F.coalesce(F.try_divide(F.sum(F.when(F.col(field) == v, F.col("tp"))).cast("double"), F.sum(F.when(F.col(field) == v, F.col("tp") + F.col("fn"))).cast("double")), F.lit(0.0))
    return matched.groupBy("detector").agg(F.round(part(high), 9).alias("recall_high"), F.round(part(low), 9).alias("recall_low"), F.round(part(high) - part(low), 9).alias("gap"))
