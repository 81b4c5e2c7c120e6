"""Queries of validation, cleaning, similarity, span resolution, statistics and plans, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T
from spanlake.operators import corpus, measures, resolve, similarity, validation
from spanlake.operators import records as R
from spanlake.plans import planning

Query = Callable[[SparkSession, str], DataFrame]

#: Hints by language, in order.
HINTS = [("DE", "kunde"), ("FR", "facture"), ("ES", "cliente"), ("EN", "the ")]
#: Weights of judged dimensions. Fixed values.
WEIGHTS = {"quality": 2.0, "toxic": 1.5}

#: A raw record made from a document's id, with a different fault for each divisor; both engines make the same text.
RAW = (
    "concat('{\"record_id\":', doc_id, ',\"mode\":\"', case when doc_id % 5 = 0 then 'other' else 'coverage' end, '\",\"axes\":', case when doc_id % 6 = 0 then '3' else '{\"domain\":\"HR\",\"adjacency\":\"near\"}' end, "
    "case when doc_id % 7 = 0 then '' else ',\"target_entity_type\":\"City\",\"target_pattern_id\":null,\"behavioral_frame\":\"negation\"' end, ',\"text\":', case when doc_id % 4 = 0 then '\"\"' when doc_id % 4 = 1 then 'null' else '\"Rome\"' end, "
    "',\"entities\":', case when doc_id % 11 = 0 then '{}' else concat('[1,{\"entity_type\":\"', case when doc_id % 3 = 0 then 'Foo' else 'City' end, '\",\"entity_string\":\"Rome\",\"mention_index\":0,\"disclosed\":true,\"disclosure_form\":\"complete\",\"sensitivity_tier\":\"LOW\"},{\"entity_type\":\"City\",\"entity_string\":\"Rome\",\"mention_index\":0,\"disclosed\":1,\"disclosure_form\":\"odd\",\"sensitivity_tier\":null}]') end, "
    "',\"entity_count\":', 2 + doc_id % 2, ',\"generation_status\":\"ok\"}')"
)


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents")


def _entities(s: SparkSession, d: str) -> DataFrame:
    return corpus.proposals(_docs(s, d))


def _raw(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select(F.col("doc_id").alias("record_index"), F.expr(RAW).alias("raw"))


def _by_record(s: SparkSession, d: str) -> DataFrame:
    """record_id, text and es: its proposed entities in order."""
    order = F.array_sort(F.collect_list(F.struct("entity_type", "pos", "entity_string")))
    return _entities(s, d).groupBy("record_id").agg(F.first("text").alias("text"), order.alias("es"))


def _spans(frame: DataFrame, made) -> DataFrame:
    each = frame.select("record_id", F.explode(made).alias("x"))
    return each.select("record_id", "x.start", "x.end", "x.type", "x.source", F.coalesce("x.agreement", F.lit(-1)).alias("agreement"))


def _wanted(es: list[dict]) -> list[tuple[str, str]]:
    return [(e["entity_type"], e["entity_string"]) for e in es]


def _greedy(s: SparkSession, d: str, every: bool) -> DataFrame:
    own = _by_record(s, d)
    return _spans(own, resolve.per_record(lambda text, es: resolve.greedy(text, _wanted(es), every=every), F.col("text"), F.col("es")))


def _vote(s: SparkSession, d: str) -> DataFrame:
    """Three models: all strings, those of even places, and strings without their last character."""

    def work(text: str, es: list[dict]) -> list[dict]:
        models = [_wanted(es), _wanted(es[::2]), [(t, v[:-1]) for t, v in _wanted(es)]]
        return resolve.vote([resolve.model_spans(text, [{"type": t, "text": v} for t, v in m]) for m in models])

    own = _by_record(s, d)
    return _spans(own, resolve.per_record(work, F.col("text"), F.col("es")))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    def work(text: str, es: list[dict]) -> list[dict]:
        first = resolve.greedy(text, _wanted(es[:1]))
        swept = resolve.sweep(text, _wanted(es), first)
        return resolve.reconcile(first, [{**x, "agreement": 2} for x in swept])

    own = _by_record(s, d)
    return _spans(own, resolve.per_record(work, F.col("text"), F.col("es")))


def _systems(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 7).alias("b"))


def _forms(s: SparkSession, d: str) -> DataFrame:
    """Records with gold spans that have a form, and predictions that are cut or lacking for some records; both by place."""
    held = R.repair(corpus.records(_docs(s, d)))
    spans = F.array_sort(F.transform(F.filter("entities", lambda e: e["start"].isNotNull()), lambda e: F.struct(e["start"], e["end"], e["entity_type"], e["entity_string"], F.when(F.pmod(e["start"], F.lit(2)) == 0, "complete").otherwise("partial").alias("form"))))
    held = held.select("record_id", spans.alias("gold"))
    cut = F.transform("gold", lambda e: e.withField("end", e["end"] - 1))
    return held.withColumn("pred", F.when(F.pmod("record_id", F.lit(3)) < 2, cut).otherwise(F.slice("gold", 1, 0)))


def _offsets(s: SparkSession, d: str) -> DataFrame:
    kth = F.size(T.occurrences(F.col("text"), F.col("entity_string"))) > F.col("mention_index")
    return _entities(s, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(kth).alias("aligned"))


def _gates(s: SparkSession, d: str) -> DataFrame:
    """One row with the gates' figures and the decision."""
    e = _entities(s, d)
    aligned = _offsets(s, d).agg(F.sum("aligned").alias("aligned"), F.sum("n").alias("n"))
    held = _docs(s, d).select(F.col("doc_id").alias("record_id")).join(e.select("record_id").distinct().withColumn("has", F.lit(1)), "record_id", "left")
    zero = held.agg(F.count_if(F.col("has").isNull()).alias("zero"), F.count("*").alias("records"))
    ok = (F.col("aligned") == F.col("n")) & (F.col("zero") * 1000 <= F.col("records") * 5)
    return aligned.crossJoin(zero).select("aligned", "n", "zero", "records", ok.alias("pass"))  # one row each


def _judged(s: SparkSession, d: str) -> DataFrame:
    judge = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).alias("score")) for n in ("quality", "toxic")]))
    return measures.judge_means(_t(s, d, "labels").select(judge.alias("judge"), dims.alias("x")).select("judge", "x.*"), WEIGHTS)


def _aliases(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("SSN", "Ethnicity", "Foo", "City", "IBAN")))
    own = _docs(s, d).select(F.get(kinds, F.pmod("doc_id", F.lit(5)).cast("int")).alias("alias"))
    made = validation.remapped(F.col("alias"))
    return own.groupBy("alias", made.alias("entity_type"), validation.filled_tier(F.lit(""), made).alias("tier")).agg(F.count("*").alias("n"))


def _invariants(plan: DataFrame) -> DataFrame:
    """Rows, ids, and whether each type, each pattern and each pair of axis values has its least number of rows."""
    least = lambda c: plan.filter(F.col(c) != "none").groupBy(c).count().agg(F.count("*").alias(f"n_{c}"), F.min("count").alias("m"))
    types, patterns = least("target_entity_type"), least("co_occurrence_pattern")
    whole = plan.agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_ids"), F.count_if((F.col("adjacency") == "tight") != (F.col("behavioral_frame") == "co_occurrence")).alias("n_wrong"))
    pairs = corpus.pairwise_coverage(plan.filter("source = 'covering_array'"), list(planning.AXES)).agg(F.bool_and(F.col("seen") == F.col("possible")).alias("covers"))
    out = whole.crossJoin(types.withColumn("floored", F.col("m") >= 50).drop("m")).crossJoin(patterns.withColumn("patterned", F.col("m") >= 3).drop("m"))  # one row each
    return out.crossJoin(pairs)


def queries() -> dict[str, Query]:
    e = _entities
    return {
        "schema_validation": lambda s, d: validation.validation_errors(_raw(s, d)).select("record_index", F.array_join("errors", "|").alias("errors")),
        "validation_categories": lambda s, d: validation.error_categories(validation.validation_errors(_raw(s, d))),
        "type_remap": _aliases,
        "identifier_policies": lambda s, d: e(s, d).groupBy("entity_type", validation.identifier_class(F.col("entity_type")).alias("identifier_class"), validation.policy(F.col("entity_type")).alias("policy")).agg(F.count("*").alias("n")),
        "language_hints": lambda s, d: _docs(s, d).select("doc_id", validation.language_hint(F.col("text"), HINTS).alias("hint")),
        "offset_accuracy": _offsets,
        "critical_gates": _gates,
        "cosine_pairs": lambda s, d: similarity.cosine_pairs(_t(s, d, "embeddings"), 0.35).select("i", "j", F.round("cosine", 6).alias("cosine")),
        "token_set_pairs": lambda s, d: similarity.token_set_pairs(_docs(s, d), ["lang", "source"], 90),
        "rouge_l_pairs": lambda s, d: similarity.rouge_pairs(similarity.token_set_pairs(_docs(s, d), ["lang", "source"], 90).select("i", "j"), _docs(s, d)),
        "similarity_dedup": lambda s, d: similarity.similarity_dedup(_docs(s, d).select("doc_id", "text"), _t(s, d, "embeddings"), 0.35, 0.1).select("doc_id"),
        "self_bleu": lambda s, d: similarity.self_bleu(_docs(s, d)),
        "vendi_score": lambda s, d: similarity.vendi(_t(s, d, "embeddings")),
        "type_token_ratio": lambda s, d: measures.type_token_ratio(_docs(s, d)),
        "pattern_density": lambda s, d: measures.density(e(s, d), "lang", "entity_type", "entity_string"),
        "match_by_form": lambda s, d: measures.match_by_field(_forms(s, d), "form"),
        "spearman_rho": lambda s, d: measures.spearman(_systems(s, d)),
        "mean_delta": lambda s, d: measures.mean_delta(_systems(s, d)),
        "bootstrap_interval": lambda s, d: measures.bootstrap_kendall(_systems(s, d)),
        "judge_means": _judged,
        "sample_topped_up": lambda s, d: measures.topped_up(_docs(s, d).select("doc_id", "lang"), "doc_id", "lang", 100, "42"),
        "json_parse_rate": lambda s, d: _t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("parsed")),
        "greedy_spans": lambda s, d: _greedy(s, d, False),
        "all_spans": lambda s, d: _greedy(s, d, True),
        "voted_spans": _vote,
        "swept_spans": _sweep,
        "generation_plan": lambda s, d: planning.generation_plan(s),
        "paired_sweep": lambda s, d: planning.paired_plan(planning.anchors(s)).groupBy("sweep_axis").agg(F.count("*").alias("n"), F.countDistinct("sweep_value").alias("n_values"), F.countDistinct("anchor_id").alias("n_anchors")),
        "anchor_strata": lambda s, d: planning.anchors(s).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("co_occurrence_pattern").alias("n_patterns"), F.count_if((F.col("adjacency") == "tight") != (F.col("co_occurrence_pattern") != "none")).alias("n_wrong")).withColumn("n_patterns", F.when(F.col("category") == "co_pattern", F.col("n_patterns")).otherwise(F.lit(0))),
        "plan_invariants": lambda s, d: _invariants(planning.generation_plan(s)),
        "mean_rouge_l": lambda s, d: similarity.mean_rouge(_docs(s, d), sample=60),
    }


def _greedy_sql(ent: str, every: bool, some: str = "true") -> str:
    """Greedy placing as a recursion over each record's queue, longest strings first: places that stand free and are not yet claimed."""
    letter = "[\\p{L}\\p{N}]"
    near = lambda c, beyond: f"(regexp_full_match({c}, '{letter}|@') OR ({c} = '.' AND regexp_full_match({beyond}, '{letter}')))"
    char = lambda at: f"CASE WHEN {at} > 0 THEN substring(text, {at}, 1) ELSE '' END"
    size = "length(q[k + 1].v)"
    free = f"substring(text, i, {size}) = q[k + 1].v AND NOT {near(char('i - 1'), char('i - 2'))} AND NOT {near(char(f'i + {size}'), char(f'i + {size} + 1'))} AND len(list_filter(c, lambda x: x.s < i + {size} AND i < x.e)) = 0"
    took = f"list_transform(list_filter(range(1, length(text) - {size} + 2), lambda i: {free}){'' if every else '[1:1]'}, lambda i: {{'s': i, 'e': i + {size}, 't': q[k + 1].t}})"
    wanted = f"SELECT record_id, text, entity_type, entity_string, min(o) AS o FROM w WHERE {some} GROUP BY ALL" if every else f"SELECT * FROM w WHERE {some}"
    return (
        f"WITH RECURSIVE {ent}, w AS (SELECT record_id, text, entity_type, entity_string, row_number() OVER (PARTITION BY record_id ORDER BY entity_type, pos, entity_string) AS o FROM e), u AS ({wanted}), "
        "qs AS (SELECT record_id, text, list({'t': entity_type, 'v': entity_string} ORDER BY length(entity_string) DESC, o) AS q FROM u GROUP BY record_id, text), "
        f"st AS (SELECT record_id, text, q, 0 AS k, CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR)[]) AS c FROM qs UNION ALL SELECT record_id, text, q, k + 1, list_concat(c, {took}) FROM st WHERE k < len(q)), "
        "f AS (SELECT record_id, unnest(c) AS x FROM st WHERE k = len(q)) SELECT record_id, CAST(x.s - 1 AS INTEGER) AS start, CAST(x.e - 1 AS INTEGER) AS \"end\", x.t AS type, 'greedy' AS source, -1 AS agreement FROM f"
    )


_TOKS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"

#: Pairs of documents by their shared distinct words.
_PAIRS = f"s AS (SELECT doc_id, lang, source, list_distinct({_TOKS}) AS s FROM documents), x AS (SELECT doc_id, lang, source, len(s) AS n, unnest(s) AS t FROM s), p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared, a.n + b.n - count(*) AS united FROM x a JOIN x b ON a.t = b.t AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)"


def oracle_sql() -> dict[str, str]:
    from spanlake.plans.registry import _ENT, _MEN, _OCC, _REP

    bad = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS lost, 1 AS axes, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS adj, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mode, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS blank, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS notext, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS nolist, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS l, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS cnt, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS foo FROM documents"
    cats = {
        "missing_top_level_fields": "lost",
        "axes_not_dict": "1 - adj",
        "missing_axis_fields": "adj",
        "invalid_adjacency": "adj",
        "invalid_mode": "mode",
        "text_empty": "blank",
        "text_missing_or_not_str": "notext",
        "entities_missing_or_not_list": "nolist",
        "entity_count_mismatch": "l * cnt",
        "entity[0]": "l",
        "entity[1]": "l * foo",
        "entity[2]": "l * (3 + 1 - foo)",
    }
    each = " UNION ALL ".join(f"SELECT '{c}' AS category, CAST(sum({x}) AS BIGINT) AS n FROM k" for c, x in cats.items())
    lost = ",".join(sorted(set(consts.AXIS_FIELDS) - {"domain", "adjacency"}))
    found = [
        ("lost = 1", "'missing_top_level_fields:behavioral_frame,target_entity_type,target_pattern_id'"),
        ("adj = 0", "'axes_not_dict'"),
        ("adj = 1", f"'missing_axis_fields:{lost}'"),
        ("adj = 1", "'invalid_adjacency:near'"),
        ("mode = 1", "'invalid_mode:other'"),
        ("notext = 1", "'text_missing_or_not_str'"),
        ("blank = 1", "'text_empty'"),
        ("nolist = 1", "'entities_missing_or_not_list'"),
        ("l * cnt = 1", "'entity_count_mismatch:declared=2,actual=3'"),
        ("l = 1", "'entity[0]:not_dict'"),
        ("l * foo = 1", "'entity[1]:non_canonical_type:Foo'"),
        ("l = 1", "'entity[2]:disclosed_not_bool:1'"),
        ("l = 1", "'entity[2]:invalid_disclosure_form:odd'"),
        ("l = 1", "'entity[2]:invalid_sensitivity_tier:None'"),
        ("l = 1 AND foo = 0", "'entity[2]:duplicate_mention_index:City:Rome:0'"),
    ]
    texts = ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in found)
    remap = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in (("SSN", "National_Identification_Number"), ("Foo", "Foo"), ("City", "City"), ("IBAN", "Account_Statements")))
    tiers = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in consts.TIERS.items())
    direct, hide = (", ".join(f"'{t}'" for t in x) for x in (consts.DIRECT, consts.MUST_HIDE))
    hints = " ".join(f"WHEN contains(lower(text), '{t}') THEN '{n}'" for n, t in HINTS)
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM tok WHERE len(w) >= {n}" for n in (1, 2, 3, 4))
    return {
        "schema_validation": f"WITH k AS ({bad}), l AS (SELECT doc_id, [{texts}] AS e FROM k) SELECT doc_id AS record_index, array_to_string(list_filter(e, lambda x: x IS NOT NULL), '|') AS errors FROM l",
        "validation_categories": f"WITH k AS ({bad}), c AS ({each}) SELECT category, n FROM c WHERE n > 0",
        "type_remap": f"WITH a AS (SELECT ['SSN', 'Ethnicity', 'Foo', 'City', 'IBAN'][doc_id % 5 + 1] AS alias FROM documents), r AS (SELECT alias, CASE alias {remap} END AS entity_type FROM a) SELECT alias, entity_type, coalesce(CASE entity_type {tiers} END, 'MEDIUM') AS tier, count(*) AS n FROM r GROUP BY ALL",
        "identifier_policies": f"WITH {_ENT} SELECT entity_type, CASE WHEN entity_type IN ({direct}) THEN 'direct' ELSE 'indirect' END AS identifier_class, CASE WHEN entity_type IN ({hide}) THEN 'must_hide' ELSE 'may_disclose' END AS policy, count(*) AS n FROM e GROUP BY ALL",
        "paired_sweep": "SELECT 'text_format' AS sweep_axis, CAST(350 AS BIGINT) AS n, CAST(7 AS BIGINT) AS n_values, CAST(50 AS BIGINT) AS n_anchors UNION ALL SELECT 'text_domain', 360, 12, 30 UNION ALL SELECT 'difficulty_x_density', 180, 9, 20",
        "anchor_strata": "SELECT 'stress_test' AS category, CAST(30 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_patterns, CAST(0 AS BIGINT) AS n_wrong UNION ALL SELECT 'article_9', 30, 0, 0 UNION ALL SELECT 'non_latin', 25, 0, 0 UNION ALL SELECT 'co_pattern', 15, 15, 0",
        "plan_invariants": "SELECT CAST(5510 AS BIGINT) AS n_rows, CAST(5510 AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS n_wrong, CAST(51 AS BIGINT) AS n_target_entity_type, true AS floored, CAST(15 AS BIGINT) AS n_co_occurrence_pattern, true AS patterned, true AS covers",
        "greedy_spans": _greedy_sql(_ENT, False),
        "all_spans": _greedy_sql(_ENT, True),
        # the models agree where the second one, which has every other entity, places what the first one places; the third one's strings end inside words
        "voted_spans": f"SELECT a.record_id, a.start, a.\"end\", a.type, 'span_consensus' AS source, 2 AS agreement FROM ({_greedy_sql(_ENT, False)}) a JOIN ({_greedy_sql(_ENT, False, 'o % 2 = 1')}) b USING (record_id, start, \"end\", type)",
        "swept_spans": f"SELECT a.record_id, a.start, a.\"end\", a.type, CASE WHEN b.start IS NULL THEN 'string_match' ELSE 'greedy' END AS source, CASE WHEN b.start IS NULL THEN 2 ELSE -1 END AS agreement FROM ({_greedy_sql(_ENT, True)}) a LEFT JOIN ({_greedy_sql(_ENT, False, 'o = 1')}) b USING (record_id, start, \"end\", type)",
        "language_hints": f"SELECT doc_id, CASE {hints} END AS hint FROM documents",
        "offset_accuracy": f"WITH {_MEN} SELECT entity_type, count(*) AS n, count(*) FILTER (len({_OCC}) > mention_index) AS aligned FROM em GROUP BY entity_type",
        "critical_gates": f"WITH {_MEN}, a AS (SELECT count(*) FILTER (len({_OCC}) > mention_index) AS aligned, count(*) AS n FROM em), z AS (SELECT count(*) FILTER (doc_id NOT IN (SELECT record_id FROM em)) AS zero, count(*) AS records FROM documents) SELECT aligned, n, zero, records, aligned = n AND zero * 1000 <= records * 5 AS pass FROM a, z",
        "cosine_pairs": "WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT i, j, round(c, 6) AS cosine FROM p WHERE c > 0.35",
        "token_set_pairs": f"WITH {_PAIRS} SELECT i, j, CAST(shared AS INTEGER) AS shared, CAST(united AS INTEGER) AS united FROM p WHERE shared * 100 > united * 90",
        "self_bleu": f"WITH tok AS (SELECT doc_id, {_TOKS} AS w FROM documents), x AS ({grams}), c AS (SELECT doc_id, n, g, count(*) AS c FROM x GROUP BY ALL), b AS (SELECT n, g, max(c, 2) AS top FROM c GROUP BY n, g), h AS (SELECT doc_id, n, sum(least(c, CASE WHEN c = top[1] THEN coalesce(top[2], 0) ELSE top[1] END)) AS hit, sum(c) AS total FROM c JOIN b USING (n, g) GROUP BY doc_id, n), f AS (SELECT t.doc_id, o.n, coalesce(hit, 0) AS hit, greatest(coalesce(total, 0), 1) AS total FROM tok t CROSS JOIN (VALUES (1), (2), (3), (4)) o(n) LEFT JOIN h ON h.doc_id = t.doc_id AND h.n = o.n), l AS (SELECT doc_id, len(w) AS len FROM tok), r AS (SELECT a.doc_id, a.len, arg_min(b.len, (abs(b.len - a.len), b.len)) AS ref FROM l a JOIN l b ON a.doc_id <> b.doc_id GROUP BY a.doc_id, a.len), s AS (SELECT r.doc_id, r.len, ref, sum(ln(CASE WHEN hit > 0 THEN hit ELSE 0.1 END / total)) / 4 AS lg, max(CASE WHEN f.n = 1 THEN hit END) AS uni FROM r JOIN f USING (doc_id) GROUP BY r.doc_id, r.len, ref) SELECT round(avg(CASE WHEN len = 0 OR uni = 0 THEN 0.0 ELSE exp(lg + CASE WHEN len > ref THEN 0 ELSE 1 - ref / len END) END), 6) AS self_bleu, count(*) AS n_docs FROM s",
        "type_token_ratio": f"WITH w AS (SELECT unnest({_TOKS}) AS w FROM documents), c AS (SELECT count(*) AS c FROM w GROUP BY w) SELECT round(count(*) / sum(c), 9) AS ttr, round(1e4 * (sum(c * c) - sum(c)) / (CAST(sum(c) AS DOUBLE) * CAST(sum(c) AS DOUBLE)), 6) AS yule_k, CAST(sum(c) AS BIGINT) AS n_words FROM c",
        "pattern_density": f"WITH {_ENT}, k AS (SELECT lang, entity_type, count(DISTINCT entity_string) AS p FROM e GROUP BY lang, entity_type) SELECT lang, CAST(sum(p) AS BIGINT) AS n_patterns, count(*) AS n_types FROM k GROUP BY lang",
        "spearman_rho": "WITH r AS (SELECT count(*) OVER (ORDER BY n_regionkey) - count(*) OVER (ORDER BY n_nationkey % 7) AS d FROM nation) SELECT round(1 - 6.0 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 9) AS rho, count(*) AS n FROM r",
        "mean_delta": "SELECT round(avg(abs(n_regionkey - n_nationkey % 7)), 9) AS delta, count(*) AS n FROM nation",
        "judge_means": "WITH x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS judge, avg(quality) AS q, avg(toxic) AS t FROM labels GROUP BY 1) SELECT judge, round((2 * q + 1.5 * t) / 3.5, 9) AS weighted, round((q + t) / 2, 9) AS mean FROM x",
        "sample_topped_up": "WITH h AS (SELECT doc_id, lang, md5(concat(doc_id, '42')) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r, 100 // (SELECT count(DISTINCT lang) FROM documents) AS part FROM h) SELECT doc_id, lang FROM r ORDER BY CASE WHEN r > part THEN 1 ELSE 0 END, h, doc_id LIMIT 100",
        "json_parse_rate": "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS parsed FROM events GROUP BY event_type",
        "match_by_form": f"WITH RECURSIVE {_REP}, gold AS (SELECT record_id, entity_type, start, start + length(entity_string) AS e, CASE WHEN start % 2 = 0 THEN 'complete' ELSE 'partial' END AS form FROM rep), pred AS (SELECT record_id, list({{'s': start, 'e': e - 1, 't': entity_type}} ORDER BY start, e - 1, entity_type) AS p FROM gold WHERE record_id % 3 < 2 GROUP BY record_id), gg AS (SELECT record_id, form, list({{'s': start, 'e': e, 't': entity_type}} ORDER BY start, e, entity_type) AS g FROM gold GROUP BY record_id, form), st AS (SELECT record_id, form, g, coalesce(p, []) AS p, 0 AS k, CAST([] AS BIGINT[]) AS u FROM gg LEFT JOIN pred USING (record_id) UNION ALL SELECT record_id, form, g, p, k + 1, list_concat(u, list_filter(range(1, len(p) + 1), lambda i: NOT list_contains(u, i) AND p[i].t = g[k + 1].t AND p[i].e > g[k + 1].s AND p[i].s < g[k + 1].e)[1:1]) FROM st WHERE k < len(g)) SELECT form, CAST(sum(len(u)) AS BIGINT) AS tp, CAST(sum(len(p) - len(u)) AS BIGINT) AS fp, CAST(sum(len(g) - len(u)) AS BIGINT) AS fn FROM st WHERE k = len(g) GROUP BY form",
    }
