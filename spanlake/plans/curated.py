"""Queries of routing, folding, rendering, gates, reports and plan fields, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.operators import corpus, curation, measures
from spanlake.operators import records as R
from spanlake.plans import planning
from spanlake.plans.registry import _ENT, _GP, _MEN, _OCC, _REP, _gold_pred

Query = Callable[[SparkSession, str], DataFrame]

TYPES = list(consts.TIERS)
DOMAINS, FORMATS = [*planning.AXES["domain"], "space"], planning.AXES["format"]
#: A catalog made of parts: its type, language and dimensions follow from the key.
LANGUAGES = ["EN", "DE", "FR", ""]


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _e(s: SparkSession, d: str) -> DataFrame:
    return corpus.proposals(_t(s, d, "documents"))


def _nth(values: list[str], at) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def _names(s: SparkSession, d: str) -> DataFrame:
    """Each customer's market segment words as a full name, with first names for even keys and last names for multiples of three."""
    c = _t(s, d, "customer")
    whole = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    first, last = F.split_part(whole, F.lit(" "), F.lit(1)), F.split_part(whole, F.lit(" "), F.lit(2))
    kinds = F.array(F.struct(F.lit("Full_Name").alias("t"), whole.alias("s")), F.struct(F.when(F.col("c_custkey") % 2 == 0, "First_Given_Name").otherwise("City").alias("t"), first.alias("s")), F.struct(F.when(F.col("c_custkey") % 3 == 0, "Last_Family_Name").otherwise("City").alias("t"), last.alias("s")))
    return c.select(F.col("c_custkey").alias("record_id"), F.explode(kinds).alias("x")).select("record_id", F.col("x.t").alias("entity_type"), F.col("x.s").alias("entity_string"))


def _routed(s: SparkSession, d: str) -> DataFrame:
    k, low = F.col("doc_id"), F.lower("text")
    e = F.struct(F.lit("City").alias("entity_type"), F.when(k % 4 == 0, "no such place 0").otherwise(F.substring("text", 1, 3)).alias("entity_string"))
    none = F.expr("cast(array() as array<struct<entity_type:string,entity_string:string>>)")
    docs = _t(s, d, "documents").select("doc_id", "text", F.when(k % 3 == 0, none).otherwise(F.array(e)).alias("entities"), F.lit("coverage").alias("mode"), F.expr("cast(array() as array<string>)").alias("frozen"), F.lit("").alias("target_entity_type"), F.concat(F.lit("qqqq0; "), F.substring("text", 1, 1)).alias("example"))
    return curation.routed(docs).select("doc_id", "route", F.size("entities").alias("n_entities"))


def _matched(s: SparkSession, d: str) -> DataFrame:
    gold, pred = _gold_pred(s, d)
    found = measures.match_exact(gold, pred, ["entity_type"])
    return found.select(F.lit("cut").alias("detector"), F.lit("exact").alias("mode"), "entity_type", "tp", "fp", "fn")


def _tiered(s: SparkSession, d: str) -> DataFrame:
    return _matched(s, d).withColumn("tier", corpus.tier(F.col("entity_type")))


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return _t(s, d, "documents").select("doc_id", planning.scenario(_nth(DOMAINS, k), _nth(FORMATS, k), F.lit("City")).alias("scenario"))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    dims = F.when(k % 5 == 0, F.array(F.lit("Adjacency-tight"), F.lit("Masked"))).otherwise(F.array(F.lit("Masked")))
    pid = F.concat(F.lit("P-"), F.pmod(k, F.lit(150)).cast("string"))
    return _t(s, d, "part").select(pid.alias("pattern_id"), _nth(TYPES, k).alias("entity_type"), F.col("p_brand").alias("entity_category"), dims.alias("dimensions"), _nth(LANGUAGES, k).alias("language_hint"), F.lit(4).alias("declared"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    """One row a document, with cyclic axis values."""
    k = F.col("doc_id")
    axes = [_nth(v, F.floor(k / (i + 1))).alias(a) for i, (a, v) in enumerate(planning.AXES.items())]
    return _t(s, d, "documents").select(k.alias("record_id"), *axes, _nth(TYPES, k).alias("target_entity_type"), F.lit("none").alias("co_occurrence_pattern"), F.lit("isolation").alias("behavioral_frame"), F.lit("cyclic").alias("source"))


def _chosen(s: SparkSession, d: str) -> DataFrame:
    """How many patterns each plan row's choice came from, by what it preferred: checks the fallbacks, not the draw."""
    catalog = _catalog(s, d)
    own = catalog.select(F.col("pattern_id").alias("target_pattern_id"), F.col("entity_type").alias("target_entity_type"), F.lit(True).alias("known")).distinct()
    made = planning.attach_patterns(_plan(s, d), catalog).join(own, ["target_pattern_id", "target_entity_type"], "left")
    return made.groupBy("target_entity_type").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))


def _fictional(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    language, domain = _nth(planning.AXES["language"], F.col("doc_id")), _nth(DOMAINS, F.col("doc_id"))
    nid, title, org = planning.fictional_national_id(k, language), planning.fictional_title(k), planning.fictional_organisation(k, domain)
    return _t(s, d, "documents").select("doc_id", nid.alias("nid"), title.alias("title"), org.alias("org"), planning.fictional_email(k, F.lit("Ann"), F.lit("Lee"), language).alias("email"))


def _rendered(s: SparkSession, d: str) -> DataFrame:
    own = _e(s, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("entity_type", "pos", "entity_string"))).alias("es"))
    full = F.transform("es", lambda x: F.struct(x["entity_type"].alias("entity_type"), x["entity_string"].alias("entity_string"), corpus.tier(x["entity_type"]).alias("sensitivity_tier"), F.lit(True).alias("disclosed")))
    body = curation.filled_template(F.lit("Record {{ id }}:\n{{ entities }}"), {"id": F.col("record_id"), "entities": curation.rendered_entities(full, 3)})
    return own.select("record_id", curation.shortened(body, 400, "...").alias("prompt"))


def queries() -> dict[str, Query]:
    return {
        "routed_records": _routed,
        "label_folding": lambda s, d: _plan(s, d).groupBy("target_entity_type", curation.fold_label(F.col("target_entity_type")).alias("label")).agg(F.count("*").alias("n")),
        "prefix_translation": lambda s, d: _t(s, d, "part").select("p_partkey", curation.translated_prefix(F.concat(_nth(["CR-", "PA-", "PP-", "FUN-"], F.col("p_partkey")), F.col("p_size").cast("string")), _nth(["Political_Party", "Passport_Number", "Crime"], F.col("p_partkey"))).alias("pattern_id")),
        "pattern_choice": _chosen,
        "rendered_prompts": _rendered,
        "capped_examples": lambda s, d: curation.capped_examples(_e(s, d).select("entity_type", "record_id", "mention_index", curation.shortened(F.col("entity_string"), 80).alias("entity_string")).distinct(), ["entity_type"], ["record_id", "entity_string", "mention_index"], 10),
        "scenario_texts": _scenarios,
        "detector_report": lambda s, d: curation.detector_report(_matched(s, d)),
        "tier_recall_gap": lambda s, d: curation.recall_gaps(_tiered(s, d), "tier", "HIGH", "MEDIUM"),
        "plan_report": lambda s, d: planning.plan_report(_plan(s, d)),
        "catalog_stats": lambda s, d: planning.catalog_stats(_catalog(s, d)),
        "repair_totals": lambda s, d: R.repair_totals(corpus.records(_t(s, d, "documents"))),
        "name_triples": lambda s, d: curation.name_triples(_names(s, d)),
        "gate_report": lambda s, d: curation.gate_report(corpus.records(_t(s, d, "documents"))),
        "fictional_values": _fictional,
    }


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values: list[str], k: str) -> str:
    return f"{_list(values)}[CAST(({k}) % {len(values)} AS BIGINT) + 1]"


def oracle_sql() -> dict[str, str]:
    fold = " ".join(f"WHEN '{t}' THEN '{label}'" for label, (how, types) in consts.FOLDS.items() if how == "high" for t in types)
    tiers = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in consts.TIERS.items())
    axes = ", ".join(f"{_at(v, f'doc_id // {i + 1}')} AS {a}" for i, (a, v) in enumerate(planning.AXES.items()))
    plan = f"plan AS (SELECT doc_id AS record_id, {axes}, {_at(TYPES, 'doc_id')} AS target_entity_type, 'none' AS co_occurrence_pattern, 'isolation' AS behavioral_frame, 'cyclic' AS source FROM documents)"
    catalog = f"cat AS (SELECT concat('P-', p_partkey % 150) AS pattern_id, {_at(TYPES, 'p_partkey')} AS entity_type, p_brand AS entity_category, CASE WHEN p_partkey % 5 = 0 THEN ['Adjacency-tight', 'Masked'] ELSE ['Masked'] END AS dimensions, {_at(LANGUAGES, 'p_partkey')} AS language_hint, 4 AS declared FROM part)"
    known = " ".join("WHEN '" + f"{d}|{f}" + "' THEN '" + text.replace("'", "''") + "'" for (d, f), text in consts.SCENARIOS.items())
    every = " UNION ALL ".join(f"SELECT '{a}' AS section, {a} AS name, count(*) AS n FROM plan GROUP BY {a}" for a in "source target_entity_type co_occurrence_pattern behavioral_frame language domain format adjacency".split())
    types = ", ".join(f"('{t}')" for t in TYPES)
    filled = f"f AS (SELECT t, count(record_id) AS n FROM (VALUES {types}) v(t) LEFT JOIN plan ON target_entity_type = t GROUP BY t)"
    pairs = " UNION ALL ".join(f"SELECT 'pair {a} x {b}', 'observed', count(DISTINCT ({a}, {b})) FROM plan HAVING count(*) > 0 UNION ALL SELECT 'pair {a} x {b}', 'expected', {len(planning.AXES[a]) * len(planning.AXES[b])}" for a, b in planning.SPOT_CHECKS)
    matched = f'{_GP}, gc AS (SELECT entity_type, record_id, start, "end", count(*) AS g FROM gold GROUP BY ALL), pc AS (SELECT entity_type, record_id, start, "end", count(*) AS p FROM pred GROUP BY ALL), b AS (SELECT entity_type, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM gc FULL JOIN pc USING (entity_type, record_id, start, "end")), s AS (SELECT entity_type, sum(least(g, p)) AS tp, sum(p) - sum(least(g, p)) AS fp, sum(g) - sum(least(g, p)) AS fn FROM b GROUP BY entity_type)'
    names = "n AS (SELECT c_custkey AS record_id, replace(c_name, '#', ' ') AS w, c_custkey % 2 = 0 AS hf, c_custkey % 3 = 0 AS hl FROM customer)"
    holds = "(SELECT count(*) FILTER (doc_id IN (SELECT record_id FROM em)) FROM documents)"
    groups = "mm AS (SELECT record_id, entity_type, entity_string, text, count(*) AS m, count(DISTINCT mention_index) AS dm, max(mention_index) AS top FROM em GROUP BY ALL), mc AS (SELECT dm = m AND top = m - 1 AND (length(text) - length(replace(text, entity_string, ''))) // length(entity_string) = m AS complete FROM mm)"
    floors = f"fl AS (SELECT t, count(DISTINCT record_id) AS n FROM (VALUES {types}) v(t) LEFT JOIN em ON entity_type = t GROUP BY t)"
    gates = f"g AS (SELECT 'offset_accuracy' AS gate, count(*) FILTER (len({_OCC}) > mention_index) AS passed, count(*) AS total FROM em UNION ALL SELECT 'zero_entity_rate', {holds}, count(*) FROM documents UNION ALL SELECT 'triple_names', count(*) FILTER (entity_type = 'Full_Name'), count(*) FILTER (entity_type = 'Full_Name') FROM em UNION ALL SELECT 'canonical_types', count(*), count(*) FROM em UNION ALL SELECT 'multi_mentions', count(*) FILTER (complete), count(*) FROM mc UNION ALL SELECT 'type_floor', count(*) FILTER (n >= 50), count(*) FROM fl), j AS (SELECT *, CASE gate WHEN 'zero_entity_rate' THEN (total - passed) * 1000 <= total * 5 WHEN 'multi_mentions' THEN passed * 100 >= total * 95 WHEN 'offset_accuracy' THEN passed = total AND total > 0 ELSE passed = total END AS pass FROM g)"
    rend = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in consts.TIERS.items() if t in consts.PROPOSALS)
    return {
        "routed_records": "WITH k AS (SELECT doc_id, text, doc_id % 3 = 0 AS none, trim(coalesce(text, '')) = '' OR (doc_id % 3 <> 0 AND (doc_id % 4 = 0 AND NOT contains(text, 'no such place 0'))) AS bad FROM documents) SELECT doc_id, CASE WHEN none THEN 'verify>repair>enrich' WHEN bad THEN 'verify>enrich' ELSE 'enrich' END AS route, CAST(CASE WHEN none THEN CASE WHEN trim(substring(text, 1, 1)) NOT IN ('', '|', ',', ';') OR contains(text, 'qqqq0') THEN 1 ELSE 0 END ELSE 1 END AS INTEGER) AS n_entities FROM k",
        "label_folding": f"WITH {plan} SELECT target_entity_type, CASE target_entity_type {fold} END AS label, count(*) AS n FROM plan GROUP BY ALL",
        "prefix_translation": f"WITH k AS (SELECT p_partkey, {_at(['CR-', 'PA-', 'PP-', 'FUN-'], 'p_partkey')} AS p, p_size AS s, {_at(['Political_Party', 'Passport_Number', 'Crime'], 'p_partkey')} AS t FROM part) SELECT p_partkey, concat(CASE WHEN p = 'CR-' THEN 'CRIME-' WHEN p = 'PA-' AND t = 'Political_Party' THEN 'PP-' WHEN p = 'PP-' AND t = 'Passport_Number' THEN 'PA-' ELSE p END, s) AS pattern_id FROM k",
        "pattern_choice": f"WITH {plan}, {catalog} SELECT target_entity_type, count(*) AS n, count(*) FILTER (target_entity_type IN (SELECT entity_type FROM cat)) AS n_known FROM plan GROUP BY target_entity_type",
        "rendered_prompts": f"WITH {_ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY entity_type, pos, entity_string) AS k, count(*) OVER (PARTITION BY record_id) AS c FROM e), l AS (SELECT record_id, max(c) AS c, string_agg(concat('- ', entity_type, ': \"', entity_string, '\" (sensitivity=', CASE entity_type {rend} ELSE 'MEDIUM' END, ', disclosed=True)'), chr(10) ORDER BY k) FILTER (k <= 3) AS lines FROM r GROUP BY record_id), p AS (SELECT record_id, concat('Record ', record_id, ':', chr(10), lines, CASE WHEN c > 3 THEN concat(chr(10), '... and ', c - 3, ' more') ELSE '' END) AS p FROM l) SELECT record_id, CASE WHEN length(p) > 400 THEN concat(substring(p, 1, 400), '...') ELSE p END AS prompt FROM p",
        "capped_examples": f"WITH {_MEN}, x AS (SELECT DISTINCT entity_type, record_id, mention_index, substring(entity_string, 1, 80) AS entity_string FROM em), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY record_id, entity_string, mention_index) AS k FROM x) SELECT entity_type, record_id, mention_index, entity_string FROM r WHERE k <= 10",
        "scenario_texts": f"WITH k AS (SELECT doc_id, {_at(DOMAINS, 'doc_id')} AS d, {_at(FORMATS, 'doc_id')} AS f FROM documents) SELECT doc_id, concat(coalesce(CASE concat(d, '|', f) {known} END, concat('A ', replace(f, '_', ' '), ' in the ', d, ' domain.')), ' (target entity: City)') AS scenario FROM k",
        "detector_report": f"WITH {matched} SELECT 'cut' AS detector, 'exact' AS mode, round(CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fp)), 9) AS precision, round(CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fn)), 9) AS recall, round(2.0 * CAST(sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(sum(2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn)) / {len(TYPES)}, 9) AS macro_f1 FROM s",
        "tier_recall_gap": f"WITH {matched}, c AS (SELECT coalesce(CASE entity_type {tiers} END, 'MEDIUM') AS tier, CAST(tp AS DOUBLE) AS tp, fn FROM s), r AS (SELECT coalesce(sum(tp) FILTER (tier = 'HIGH') / sum(tp + fn) FILTER (tier = 'HIGH'), 0.0) AS h, coalesce(sum(tp) FILTER (tier = 'MEDIUM') / sum(tp + fn) FILTER (tier = 'MEDIUM'), 0.0) AS l FROM c) SELECT 'cut' AS detector, round(h, 9) AS recall_high, round(l, 9) AS recall_low, round(h - l, 9) AS gap FROM r",
        "plan_report": f"WITH {plan}, {filled} {every} UNION ALL SELECT 'below_floor', t, n FROM f WHERE n < 50 UNION ALL SELECT 'target_entity_type range', 'least', min(n) FROM f UNION ALL SELECT 'target_entity_type range', 'most', max(n) FROM f UNION ALL SELECT 'co_occurrence_pattern range', 'least', 0 UNION ALL SELECT 'co_occurrence_pattern range', 'most', 0 UNION ALL {pairs}",
        "catalog_stats": f"WITH {catalog} SELECT 'entity_type' AS stat, entity_type AS name, count(*) AS n FROM cat GROUP BY entity_type UNION ALL SELECT 'category', entity_category, count(*) FROM cat GROUP BY entity_category UNION ALL SELECT 'language', language_hint, count(*) FROM cat WHERE language_hint <> '' GROUP BY language_hint UNION ALL SELECT 'dimension', d, count(*) FROM (SELECT unnest(dimensions) AS d FROM cat) GROUP BY d UNION ALL SELECT 'duplicate_id', pattern_id, count(*) FROM cat GROUP BY pattern_id HAVING count(*) > 1 UNION ALL SELECT 'declared_mismatch', entity_type, count(*) FROM cat GROUP BY entity_type HAVING count(*) <> 4",
        "repair_totals": f"WITH {_REP}, k AS (SELECT m, len(occ) AS o FROM g) SELECT CAST(sum(m) AS BIGINT) AS original_entities, CAST(sum(CASE WHEN o = 0 THEN m ELSE o END) AS BIGINT) AS repaired_entities, count(*) FILTER (o > m) AS groups_expanded, CAST(sum(CASE WHEN o > m THEN o - m ELSE 0 END) AS BIGINT) AS entities_added, CAST(sum(CASE WHEN o = 0 THEN m ELSE 0 END) AS BIGINT) AS offset_mismatches FROM k",
        "name_triples": f"WITH {names} SELECT record_id, CAST(1 AS BIGINT) AS full_names, CAST(CASE WHEN NOT contains(w, ' ') OR (hf AND hl) THEN 1 ELSE 0 END AS BIGINT) AS compliant FROM n",
        "gate_report": f"WITH {_MEN}, {groups}, {floors}, {gates} SELECT gate, passed, total, pass FROM j UNION ALL SELECT 'all', CAST(sum(passed) AS BIGINT), CAST(sum(total) AS BIGINT), bool_and(pass) FROM j",
    }
