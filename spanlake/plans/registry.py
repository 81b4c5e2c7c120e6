"""Queries of the corpus operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T
from spanlake.operators import corpus, measures
from spanlake.operators import records as R

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return _t(spark, d, "documents").select("doc_id", F.upper("lang").alias("language"), F.col("source").alias("domain"), band.alias("length"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return corpus.proposals(_t(spark, d, "documents"))


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    e = F.struct(F.when(k % 7 == 0, "Foo").otherwise("City").alias("entity_type"), F.when(k % 5 == 0, "NONE").otherwise("LOW").alias("sensitivity_tier"), F.when(k % 11 == 0, "odd").otherwise("complete").alias("disclosure_form"))
    return _t(spark, d, "documents").select("doc_id", corpus.filter_reasons(F.when(k % 13 == 0, "json_error").otherwise("ok"), F.when(k % 17 == 0, "  ").otherwise(F.col("text")), F.array(e)).alias("reasons"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """The repaired proposals, one row each."""
    return R.exploded(R.repair(corpus.records(_t(spark, d, "documents")))).drop("pos")


def _gold_pred(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spans_ = spans(spark, d).filter("start is not null")
    gold = spans_.select("record_id", "entity_type", "start", "end")
    pred = gold.filter(F.pmod("record_id", F.lit(3)) < 2).select("record_id", "entity_type", "start", F.when(F.pmod("record_id", F.lit(2)) == 0, F.col("end")).otherwise(F.col("end") - 1).alias("end"))
    return gold, pred


def queries() -> dict[str, Query]:
    e, r = _entities, _records
    axes = ["language", "domain", "length"]
    return {
        "format_compliance": lambda s, d: corpus.format_compliance(e(s, d)),
        "corpus_axis_counts": lambda s, d: corpus.axis_counts(r(s, d), axes),
        "entity_type_tiers": lambda s, d: e(s, d).groupBy("entity_type", corpus.tier(F.col("entity_type")).alias("tier")).agg(F.count("*").alias("n")),
        "entities_per_record": lambda s, d: corpus.entities_per_record(e(s, d)),
        "type_floor": lambda s, d: corpus.type_floor(e(s, d), 12, list(consts.TIERS)),
        "pairwise_coverage": lambda s, d: corpus.pairwise_coverage(r(s, d), axes),
        "multi_mention": lambda s, d: R.multi_mention(corpus.records(_t(s, d, "documents"))),
        "span_repair": lambda s, d: spans(s, d).select("record_id", "entity_type", "entity_string", "mention_index", "start", "end", "repair_status"),
        "filter_reasons": lambda s, d: _dirty(s, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
        "window_chunks": lambda s, d: corpus.windows(_t(s, d, "documents")),
        "entity_entropy": lambda s, d: measures.entropy(e(s, d).groupBy("entity_type").agg(F.count("*").alias("n"))),
        "distinct_ngrams": lambda s, d: measures.distinct_n(_t(s, d, "documents")),
        "cosine_diversity": lambda s, d: measures.mean_cosine_distance(_t(s, d, "embeddings"), "embedding"),
        "exact_duplicates": lambda s, d: measures.exact_duplicates(_t(s, d, "documents"), ["lang"]),
        "span_match_exact": lambda s, d: measures.match_exact(*_gold_pred(s, d), ["entity_type"]),
        "rank_correlation": lambda s, d: measures.kendall(_t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 7).alias("b"))),
        "cohen_kappa": lambda s, d: measures.cohen(_t(s, d, "labels"), "quality", "toxic"),
        "krippendorff_alpha": lambda s, d: measures.krippendorff(_t(s, d, "labels"), "quality", "toxic"),
        "stratified_sample": lambda s, d: measures.stratified(_t(s, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 10, "42"),
        "duplicate_ids": lambda s, d: _t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1"),
    }


_ENT = "e AS (SELECT doc_id AS record_id, lang, source, text, entity_type, unnest(m) AS entity_string, generate_subscripts(m, 1) - 1 AS pos FROM (" + " UNION ALL ".join(f"SELECT *, '{t}' AS entity_type, regexp_extract_all(text, '{p}') AS m FROM documents" for t, p in consts.PROPOSALS.items()) + "))"
_MEN = _ENT + ", em AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id, entity_type, entity_string ORDER BY pos) - 1 AS INTEGER) AS mention_index FROM e)"
_REC = "r AS (SELECT doc_id, upper(lang) AS language, source AS domain, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS length FROM documents)"
_OCC = "list_filter(range(1, length(text) - length(entity_string) + 2), lambda i: substring(text, i, length(entity_string)) = entity_string)"
_REP = _MEN + f", g AS (SELECT record_id, entity_type, entity_string, count(*) AS m, {_OCC} AS occ FROM em GROUP BY record_id, entity_type, entity_string, text), rep AS (SELECT record_id, entity_type, entity_string, CAST(generate_subscripts(occ, 1) - 1 AS INTEGER) AS mention_index, CAST(unnest(occ) - 1 AS INTEGER) AS start, CASE WHEN m < len(occ) THEN 'ok' ELSE 'no_change' END AS repair_status FROM g)"
_TYPES = ", ".join(f"('{t}', '{v}')" for t, v in consts.TIERS.items())
_GP = _REP + ', gold AS (SELECT record_id, entity_type, start, start + length(entity_string) AS "end" FROM rep), pred AS (SELECT record_id, entity_type, start, CASE WHEN record_id % 2 = 0 THEN "end" ELSE "end" - 1 END AS "end" FROM gold WHERE record_id % 3 < 2)'
_TOK = "tok AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)"


def oracle_sql() -> dict[str, str]:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    luhn = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(entity_string[i] AS INTEGER) > 9 THEN 2 * CAST(entity_string[i] AS INTEGER) - 9 ELSE 2 * CAST(entity_string[i] AS INTEGER) END ELSE CAST(entity_string[i] AS INTEGER) END)) % 10 = 0"
    pairs = " UNION ALL ".join(f"SELECT '{a}*{b}' AS pair, CAST(count(DISTINCT ({a}, {b})) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS seen, CAST(count(DISTINCT {a}) * count(DISTINCT {b}) AS BIGINT) AS possible FROM r" for a, b in (("language", "domain"), ("language", "length"), ("domain", "length")))
    kappa = "SELECT round((po - pe) / (1 - pe), 9) AS kappa, CAST(t AS BIGINT) AS n FROM (SELECT count(*) AS t, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po, (sum(quality) * 1.0 * sum(toxic) + sum(1 - quality) * 1.0 * sum(1 - toxic)) / (count(*) * count(*)) AS pe FROM labels)"
    grams = " UNION ALL ".join(f"SELECT {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM tok WHERE len(w) >= {n}" for n in (1, 2, 3))
    return {
        "format_compliance": f"WITH {_ENT}, c AS (SELECT entity_type AS section, count(*) AS checked, count(*) FILTER (CASE entity_type WHEN 'Work_Email_Address' THEN regexp_matches(entity_string, '{consts.EMAIL}') WHEN 'Static_IP_Address' THEN regexp_matches(entity_string, '^{part}(\\.{part}){{3}}$') ELSE {luhn} END) AS passed FROM e WHERE entity_type <> 'Password' GROUP BY entity_type) SELECT *, round(passed / checked, 9) AS rate, passed >= checked * 0.95 AS meets_target FROM c",
        "corpus_axis_counts": f"WITH {_REC} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, coalesce({a}, '?') AS value, count(*) AS n FROM r GROUP BY {a}" for a in ("language", "domain", "length")),
        "entity_type_tiers": f"WITH {_ENT}, tiers(entity_type, tier) AS (VALUES {_TYPES}) SELECT e.entity_type, coalesce(tier, 'MEDIUM') AS tier, count(*) AS n FROM e LEFT JOIN tiers USING (entity_type) GROUP BY ALL",
        "entities_per_record": f"WITH {_ENT}, k AS (SELECT count(*) AS k FROM e GROUP BY record_id), s AS (SELECT list_sort(list(k)) AS l FROM k) SELECT CAST(list_sum(l) AS BIGINT) AS n_entities, CAST(len(l) AS BIGINT) AS n_records, l[len(l) // 2 + 1] AS upper_median, l[1] AS least, l[len(l)] AS most FROM s",
        "type_floor": f"WITH {_ENT}, tiers(entity_type, tier) AS (VALUES {_TYPES}) SELECT t.entity_type, count(DISTINCT record_id) AS n_records, count(DISTINCT record_id) >= 12 AS meets_floor FROM tiers t LEFT JOIN e USING (entity_type) GROUP BY t.entity_type",
        "pairwise_coverage": f"WITH {_REC} {pairs}",
        "multi_mention": f"WITH {_MEN}, g AS (SELECT record_id, entity_type, entity_string, text, count(*) AS m, count(DISTINCT mention_index) AS dm, max(mention_index) AS top FROM em GROUP BY ALL), c AS (SELECT *, (length(text) - length(replace(text, entity_string, ''))) // length(entity_string) AS apart FROM g) SELECT record_id, entity_type, entity_string, m, dm = m AND top = m - 1 AND apart = m AS complete, apart > m AS missing_mentions FROM c",
        "span_repair": f'WITH {_REP} SELECT record_id, entity_type, entity_string, mention_index, start, CAST(start + length(entity_string) AS INTEGER) AS "end", repair_status FROM rep',
        "filter_reasons": "WITH k AS (SELECT doc_id, doc_id % 13 = 0 AS j, doc_id % 17 = 0 OR trim(text) = '' AS b, CASE WHEN doc_id % 5 = 0 THEN 'F3_invalid_sensitivity' WHEN doc_id % 7 = 0 THEN 'F4_non_canonical_type' WHEN doc_id % 11 = 0 THEN 'F5_invalid_form' END AS x FROM documents), a AS (SELECT 'F1_json_error' AS reason FROM k WHERE j UNION ALL SELECT 'F2_empty_text' FROM k WHERE b UNION ALL SELECT x FROM k WHERE NOT b AND x IS NOT NULL) SELECT reason, count(*) AS n FROM a GROUP BY reason",
        "window_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((greatest(length(text), 1) - 1200) / 1000.0), 0) AS BIGINT) + 1)) AS k FROM documents) SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(k * 1000 AS INTEGER) AS start, CAST(length(substring(text, k * 1000 + 1, 1200)) AS INTEGER) AS n_chars FROM c",
        "entity_entropy": f"WITH {_ENT}, c AS (SELECT count(*) AS n FROM e GROUP BY entity_type), t AS (SELECT sum(n) AS t FROM c) SELECT round(-sum(n / t * log2(n / t)), 9) AS entropy, round(log2(count(*)), 9) AS max_entropy, count(*) AS n_classes FROM c, t",
        "distinct_ngrams": f"WITH {_TOK}, x AS ({grams}) SELECT CAST(n AS INTEGER) AS n, count(DISTINCT g) AS distinct_grams, count(*) AS total_grams FROM x GROUP BY n",
        "cosine_diversity": "WITH u AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM u), p AS (SELECT generate_subscripts(v, 1) AS i, unnest(v) / l AS x FROM n), s AS (SELECT i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM p GROUP BY i) SELECT round(1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS mean_distance, max(n) AS n_vectors FROM s",
        "exact_duplicates": "WITH h AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS t FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, t) AS first_id FROM h) SELECT doc_id, first_id FROM f WHERE doc_id <> first_id",
        "span_match_exact": f'WITH {_GP}, gc AS (SELECT entity_type, record_id, start, "end", count(*) AS g FROM gold GROUP BY ALL), pc AS (SELECT entity_type, record_id, start, "end", count(*) AS p FROM pred GROUP BY ALL), b AS (SELECT entity_type, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM gc FULL JOIN pc USING (entity_type, record_id, start, "end")), s AS (SELECT entity_type, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p) - sum(least(g, p)) AS BIGINT) AS fp, CAST(sum(g) - sum(least(g, p)) AS BIGINT) AS fn FROM b GROUP BY entity_type) SELECT *, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s',
        "rank_correlation": "SELECT round(avg(sign((x.n_regionkey - y.n_regionkey) * (x.n_nationkey % 7 - y.n_nationkey % 7))), 9) AS tau, count(*) AS n_pairs FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey",
        "cohen_kappa": kappa,
        "krippendorff_alpha": "SELECT round(1 - avg(1.0 * (quality - toxic) * (quality - toxic)) / (2 * (avg((quality + toxic) / 2.0) - avg((quality + toxic) / 2.0) * avg((quality + toxic) / 2.0))), 9) AS alpha, count(*) AS n FROM labels",
        "stratified_sample": "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, '42')), doc_id) AS k FROM documents) SELECT doc_id, lang FROM k WHERE k <= 10",
        "duplicate_ids": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1",
    }
