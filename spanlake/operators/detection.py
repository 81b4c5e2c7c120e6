"""Gold and predicted spans of a record compared, stratified and counted. One row is one record with its arrays ``gold`` and ``pred``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T

MODES = ("exact", "partial", "fuzzy")


def _test(mode: str) -> str:
    """Whether gold ``x`` and prediction ``p`` match: by string where gold has no offsets."""
    by_place = {
        "exact": "x.start = p.start and x.`end` = p.`end`",
        "partial": "not (x.`end` <= p.start or p.`end` <= x.start)",
        "fuzzy": "2 * greatest(0, least(x.`end`, p.`end`) - greatest(x.start, p.start)) >= least(x.`end` - x.start, p.`end` - p.start)",
    }[mode]
    return f"p.entity_type <=> x.entity_type and if(x.start is null or x.`end` is null, p.entity_string <=> x.entity_string, coalesce({by_place}, false))"


def matched(mode: str, gold: str = "gold", pred: str = "pred") -> Column:
    """Number of matches when each gold span, in list order, takes the first prediction in list order that is still free."""
    places = f"if(size({pred}) > 0, sequence(0, size({pred}) - 1), cast(array() as array<int>))"
    free = f"filter({places}, i -> not array_contains(u, i) and exists(array(get({pred}, i)), p -> {_test(mode)}))"
    return F.expr(f"size(aggregate({gold}, cast(array() as array<int>), (u, x) -> concat(u, slice({free}, 1, 1))))")


def match_records(records: DataFrame, mode: str, *keep: str) -> DataFrame:
    """record_id, ``keep`` columns, tp, fp and fn of each record. Null arrays count as empty."""
    none = lambda c: F.coalesce(c, F.array().cast(records.schema[c].dataType))
    held = records.withColumns({"gold": none("gold"), "pred": none("pred")}).withColumn("tp", matched(mode).cast("long"))
    return held.select("record_id", *keep, "tp", (F.size("pred") - F.col("tp")).alias("fp"), (F.size("gold") - F.col("tp")).alias("fn"))


def scores(counts: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by keys; 0 where nothing divides."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    summed = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return summed.select(*keys, "tp", "fp", "fn", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


def by_predicate(records: DataFrame, strata: dict[str, Callable[[Column], Column]], mode: str) -> DataFrame:
    """Scores by stratum: gold of the stratum against all predictions, over every record (also those without such gold)."""
    cells = F.array(*[F.struct(F.lit(name).alias("stratum"), F.filter("gold", holds).alias("gold")) for name, holds in strata.items()])
    each = records.select("record_id", "pred", F.explode(cells).alias("c")).select("record_id", "pred", "c.*")
    return scores(match_records(each, mode, "stratum"), "stratum")


def by_type(records: DataFrame, mode: str, types: list[str]) -> DataFrame:
    """Scores of each of some types (over every record), and of all Article 9 types together."""
    of = lambda t: lambda e: e["entity_type"] == t
    return by_predicate(records, {t: of(t) for t in types} | {"article_9": lambda e: e["entity_type"].isin(*consts.ARTICLE_9)}, mode)


def by_axis(records: DataFrame, axis: str, mode: str) -> DataFrame:
    """Scores by a column of the record."""
    return scores(match_records(records, mode, axis), axis)


def mapped_labels(labels: dict[str, str], spans: Column) -> Column:
    """Spans whose label a detector's table knows, with our type as entity_type and the label as raw_type."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    known = F.filter(spans, lambda s: F.try_element_at(table, s["entity_type"]).isNotNull())
    return F.transform(known, lambda s: s.withField("raw_type", s["entity_type"]).withField("entity_type", F.try_element_at(table, s["entity_type"])))


def run_stats(runs: DataFrame) -> DataFrame:
    """detector, records, entities, failures and mean entities of a record, of (detector, entities: null for a failed call)."""
    done = F.col("entities").isNotNull()
    out = runs.groupBy("detector").agg(F.count_if(done).alias("records"), F.coalesce(F.sum(F.when(done, F.size("entities"))), F.lit(0)).cast("long").alias("entities"), F.count_if(~done).alias("failures"))
    return out.withColumn("mean", F.round(F.coalesce(F.try_divide(F.col("entities").cast("double"), F.col("records")), F.lit(0.0)), 1))


def response_texts(raw: DataFrame, column: str, key: str) -> DataFrame:
    """``key`` and content: the text of a model's answer in any of its known JSON shapes. What isn't JSON is the text itself; other JSON gives null."""
    held = raw.select(key, F.col(column).alias("r"), F.expr(f"try_parse_json(`{column}`)").alias("v"))
    out = lambda path: f"try_variant_get(v, '{path}', 'variant')"
    string = lambda path: f"if(schema_of_variant({out(path)}) = 'STRING', try_variant_get(v, '{path}', 'string'), null)"
    blocks = lambda path: f"filter(coalesce(if(schema_of_variant({out(path)}) like 'ARRAY<%', try_variant_get(v, '{path}', 'array<variant>'), null), array()), b -> schema_of_variant(b) like 'OBJECT<%')"
    first = lambda path, test: f"get(transform(filter({blocks(path)}, b -> {test}), b -> try_variant_get(b, '$.text', 'string')), 0)"
    has = "try_variant_get(b, '$.text', 'variant') is not null"
    typed = "coalesce(try_variant_get(b, '$.type', 'string') = 'text', false)"
    shapes = [first("$.output.message.content", has), string("$.output.message.content"), string("$.choices[0].message.content"), first("$.choices[0].message.content", typed), f"nullif({string('$.choices[0].text')}, '')", string("$.content"), first("$.content", f"({typed} or {has})"), string("$.text")]
    return held.select(key, F.expr(f"case when v is null then r when schema_of_variant(v) like 'OBJECT<%' then coalesce({', '.join(shapes)}) end").alias("content"))


def answered_spans(raw: Column, text: Column) -> Column:
    """Spans of every occurrence, overlapping ones too, of the entities in the outermost braces of a model's answer; each (start, end, type) once."""
    made = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), "entities array<struct<entity_type:string,entity_string:string>>")["entities"]
    told = F.filter(F.coalesce(made, F.array().cast("array<struct<entity_type:string,entity_string:string>>")), lambda e: (F.coalesce(e["entity_type"], F.lit("")) != "") & (F.coalesce(e["entity_string"], F.lit("")) != ""))
    body = F.coalesce(text, F.lit(""))
    each = F.transform(told, lambda e: F.transform(T.occurrences(body, e["entity_string"]), lambda at: F.struct(e["entity_type"], e["entity_string"], at.alias("start"), (at + F.length(e["entity_string"])).alias("end"))))
    return F.array_distinct(F.flatten(each))
