"""Schema validation of raw records, and cleaning of typed ones. All of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T
from spanlake.operators.records import tier

NONE = "cast(array() as array<string>)"


def _at(v: str, name: str) -> str:
    return f"variant_get({v}, '$.{name}', 'variant')"


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _shown(v: str) -> str:
    """A value as messages show it."""
    return f"case when {_kind(v)} = 'BOOLEAN' then initcap(variant_get({v}, '$', 'string')) else coalesce(variant_get({v}, '$', 'string'), 'None') end"


def _missing(v: str, names: list[str]) -> str:
    """The missing keys, sorted and joined by commas; a JSON null isn't missing."""
    return "concat_ws(',', " + ", ".join(f"if({_at(v, n)} is null, '{n}', null)" for n in sorted(names)) + ")"


def _one_of(v: str, values: tuple[str, ...] | list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in values)
    return f"coalesce({_kind(v)} = 'STRING' and variant_get({v}, '$', 'string') in ({listed}), false)"


def _present(v: str) -> str:
    return f"({v} is not null and {_kind(v)} <> 'VOID')"


def validation_errors(raw: DataFrame, column: str = "raw", key: str = "record_index") -> DataFrame:
    """``key`` and errors (array of strings, empty where valid) of each raw JSON record.

    Checks run on VARIANT values, so a missing key and a null differ. Text that isn't JSON, isn't an object or is null
    has the one error ``json_error``. Spark's parser repairs a truncated tail, which then shows as missing fields.
    """
    v = raw.select(key, F.expr(f"try_parse_json({column})").alias("v"))
    fields = {n: F.expr(_at("v", n)).alias(f"f_{n}") for n in ("axes", "mode", "generation_status", "text", "entities", "entity_count")}
    v = v.select(key, F.when(F.expr(f"{_kind('v')} like 'OBJECT<%'"), F.col("v")).alias("v")).select(key, "v", *fields.values())
    axes = f"{_kind('f_axes')} like 'OBJECT<%'"
    adjacency = _at("f_axes", "adjacency")
    lost_axes = _missing("f_axes", consts.AXIS_FIELDS)
    lost = _missing("v", consts.RECORD_FIELDS)
    top = [
        f"if({lost} <> '', concat('missing_top_level_fields:', {lost}), null)",
        f"if(f_axes is not null and not {axes}, 'axes_not_dict', null)",
        f"if({axes} and {lost_axes} <> '', concat('missing_axis_fields:', {lost_axes}), null)",
        f"if({axes} and {_present(adjacency)} and not {_one_of(adjacency, consts.ADJACENCY)}, concat('invalid_adjacency:', {_shown(adjacency)}), null)",
        f"if({_present('f_mode')} and not {_one_of('f_mode', consts.MODES)}, concat('invalid_mode:', {_shown('f_mode')}), null)",
        f"if({_present('f_generation_status')} and not {_one_of('f_generation_status', consts.STATUSES)}, concat('invalid_generation_status:', {_shown('f_generation_status')}), null)",
        f"case when f_text is null or {_kind('f_text')} <> 'STRING' then 'text_missing_or_not_str' when variant_get(f_text, '$', 'string') = '' then 'text_empty' end",
        f"if(f_entities is null or {_kind('f_entities')} not like 'ARRAY<%', 'entities_missing_or_not_list', null)",
        f"if({_kind('f_entities')} like 'ARRAY<%' and {_present('f_entity_count')} and not coalesce(try_variant_get(f_entity_count, '$', 'double') = size(es) and {_kind('f_entity_count')} <> 'STRING', false), concat('entity_count_mismatch:declared=', {_shown('f_entity_count')}, ',actual=', size(es)), null)",
    ]
    index = _at("e", "mention_index")
    whole = f"coalesce({_kind(index)} in ('BIGINT', 'BOOLEAN'), false)"
    number = f"case when {_kind(index)} = 'BOOLEAN' then cast(variant_get({index}, '$', 'boolean') as bigint) when {_kind(index)} = 'BIGINT' then variant_get({index}, '$', 'bigint') end"
    named = lambda n: _at("e", n)
    own = [
        f"if(not {_one_of(named('entity_type'), list(consts.TIERS))}, concat('non_canonical_type:', {_shown(named('entity_type'))}), null)",
        f"if(not coalesce({_kind(named('entity_string'))} = 'STRING' and variant_get({named('entity_string')}, '$', 'string') <> '', false), 'entity_string_invalid', null)",
        f"if(not ({whole} and coalesce({number} >= 0, false)), concat('mention_index_invalid:', {_shown(index)}), null)",
        f"if({_kind(named('disclosed'))} <> 'BOOLEAN', concat('disclosed_not_bool:', {_shown(named('disclosed'))}), null)",
        f"if(not {_one_of(named('disclosure_form'), consts.FORMS)}, concat('invalid_disclosure_form:', {_shown(named('disclosure_form'))}), null)",
        f"if(not {_one_of(named('sensitivity_tier'), ('HIGH', 'MEDIUM', 'LOW'))}, concat('invalid_sensitivity_tier:', {_shown(named('sensitivity_tier'))}), null)",
    ]
    gone = _missing("e", consts.ENTITY_FIELDS)
    each = f"case when {_kind('e')} not like 'OBJECT<%' then array('not_dict') when {gone} <> '' then array(concat('missing_fields:', {gone})) else array_compact(array({', '.join(own)})) end"
    keyed = f"transform(es, e -> if({_kind('e')} like 'OBJECT<%' and {named('entity_type')} is not null and {named('entity_string')} is not null and {whole}, struct({_shown(named('entity_type'))} as t, {_shown(named('entity_string'))} as s, {number} as m), null))"
    twice = "filter(transform(ks, (k, i) -> if(k is not null and exists(slice(ks, 1, i), p -> p = k), concat('entity[', i, ']:duplicate_mention_index:', k.t, ':', k.s, ':', k.m), null)), x -> x is not null)"
    listed = v.withColumn("es", F.expr(f"if({_kind('f_entities')} like 'ARRAY<%', try_variant_get(f_entities, '$', 'array<variant>'), cast(array() as array<variant>))"))
    listed = listed.withColumn("ks", F.expr(keyed))
    entity = f"flatten(transform(es, (e, i) -> transform({each}, m -> concat('entity[', i, ']:', m))))"
    errors = f"case when v is null then array('json_error') else concat(array_compact(array({', '.join(top)})), {entity}, {twice}) end"
    return listed.select(key, F.expr(errors).alias("errors"))


def error_categories(errors: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` most frequent error categories (what precedes the first colon); ties by name."""
    # outer: from an inner explode the optimizer infers a filter on the array, and works its expressions out again in each condition
    each = errors.select(F.explode_outer("errors").alias("e")).filter(F.col("e").isNotNull()).select(F.substring_index("e", ":", 1).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def remapped(entity_type: Column) -> Column:
    """The canonical type; null where entities of the type go; unknown types stay."""
    pairs = [F.lit(x) for alias, canonical in consts.REMAP.items() for x in (alias, canonical or "")]
    found = F.try_element_at(F.create_map(*pairs), entity_type)
    return F.when(entity_type.isin(*consts.TIERS) | found.isNull(), entity_type).when(found != "", found)


def filled_tier(value: Column, entity_type: Column) -> Column:
    """The tier, or the type's where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), tier(entity_type))


def remap_entities(entities: Column) -> Column:
    """Entities with canonical types and tiers; those whose type is to be dropped go."""
    typed = F.transform(entities, lambda e: e.withField("entity_type", remapped(e["entity_type"])))
    return F.transform(F.filter(typed, lambda e: e["entity_type"].isNotNull()), lambda e: e.withField("sensitivity_tier", filled_tier(e["sensitivity_tier"], e["entity_type"])))


def coerced(entities: Column, text: Column) -> Column:
    """Entities trimmed, without those lacking type or string, defaults filled, in the order of their first place.

    A missing mention_index becomes the number of earlier entities of the same type and string. Strings that the text
    lacks come first; order is otherwise stable.
    """
    clean = F.transform(entities, lambda e: e.withField("entity_type", F.trim(F.coalesce(e["entity_type"], F.lit("")))).withField("entity_string", F.trim(F.coalesce(e["entity_string"], F.lit("")))))
    clean = F.filter(clean, lambda e: (e["entity_type"] != "") & (e["entity_string"] != ""))

    def filled(e: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(clean, F.lit(1), i), lambda p: (p["entity_type"] == e["entity_type"]) & (p["entity_string"] == e["entity_string"])))
        full = e.withField("mention_index", F.coalesce(e["mention_index"], before)).withField("disclosed", F.coalesce(e["disclosed"], F.lit(True))).withField("disclosure_form", F.coalesce(F.nullif(e["disclosure_form"], F.lit("")), F.lit("complete")))
        return F.struct(F.position(e["entity_string"], text).alias("at"), i.alias("i"), full.alias("e"))

    return F.transform(F.array_sort(F.transform(clean, filled)), lambda x: x["e"])


def self_check(text: Column, entities: Column, mode: Column, frozen: Column) -> Column:
    """Failures of a record: empty text, no entities, entities or frozen values that the text lacks."""
    body = F.coalesce(text, F.lit(""))
    lacking = F.filter(F.transform(entities, lambda e, i: F.when(~F.contains(body, e["entity_string"]), F.concat(F.lit("entity_not_in_text["), i, F.lit("]")))), lambda x: x.isNotNull())
    held = F.forall(F.coalesce(frozen, F.expr(NONE)), lambda f: F.contains(body, F.trim(f)))
    head = F.array_compact(F.array(F.when(F.trim(body) == "", "empty_text"), F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, "no_entities")))
    return F.concat(head, F.coalesce(lacking, F.expr(NONE)), F.array_compact(F.array(F.when((mode == "paired_sweep") & ~held, "frozen_values_missing"))))


def route(failures: Column, entities: Column) -> Column:
    """Next step: verify after a failed check; of those, repair where there are no entities; else enrich."""
    return F.when((F.size(failures) > 0) & (F.size(entities) <= 0), "repair").when(F.size(failures) > 0, "verify").otherwise("enrich")


def recovered(text: Column, target_type: Column, example: Column) -> Column:
    """For a record without entities: the first part of its example that its text holds, or none."""
    parts = F.filter(F.transform(F.split(F.coalesce(example, F.lit("")), r"[|,;]"), lambda c: F.trim(c)), lambda c: (c != "") & F.contains(text, c))
    kind = F.coalesce(F.nullif(F.trim(target_type), F.lit("")), F.lit("Full_Name"))
    return F.transform(F.slice(parts, 1, 1), lambda c: F.struct(kind.alias("entity_type"), c.alias("entity_string"), F.lit(0).alias("mention_index"), F.lit(True).alias("disclosed"), F.lit("complete").alias("disclosure_form"), F.lit("").alias("sensitivity_tier")))


def identifier_class(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*consts.DIRECT), "direct").otherwise("indirect")


def policy(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*consts.MUST_HIDE), "must_hide").otherwise("may_disclose")


def sane_predictions(predicted: Column, text: Column) -> Column:
    """Predictions of canonical types whose offsets lie in the text."""
    return F.filter(predicted, lambda p: F.coalesce(p["entity_type"].isin(*consts.TIERS) & (p["start"] >= 0) & (p["start"] < p["end"]) & (p["end"] <= F.length(text)), F.lit(False)))


def language_hint(text: Column, tokens: list[tuple[str, str]]) -> Column:
    """The language of the first token, in the order given, that the lower-case text holds."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(token)), F.lit(language)) for language, token in tokens])
