"""The queries of the training-data operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licences, neardup, ordinal, pii, repeats, rules, secrets, shards

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select(_table(spark, sf_dir, "documents"), grades(_table(spark, sf_dir, "labels")), grades=3)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).select("doc_id", *pii.digests())


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    listed = F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s["line"], s["family"])), ",")
    return found.select("row.doc_id", F.size(F.filter("licences", lambda s: s["family"] != "unknown")).cast("long").alias("n_licences"), F.size(F.filter("licences", lambda s: s["family"] == "unknown")).cast("long").alias("n_unknown"), F.array_join(licences.families(), ",").alias("families"), listed.alias("paragraphs"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", *decontaminate.OUT[:-1])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shuffle(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE))
    return found.select(
        "row.doc_id",
        *[secrets.count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("secret_spans")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return judged.select("row.doc_id", *rules.COUNTS, "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4, which SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return op9_secrets(spark, sf_dir).select("doc_id", *[f"n_{r.kind}" for r in secrets.BASE], "base_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of op10."""
    return op10_quality_rules(spark, sf_dir).drop("kept")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes of the whole table, and slots of op8's shards."""
    dealt = op8_shards(spark, sf_dir)
    own = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("n_slots"))
    return own.crossJoin(F.broadcast(dealt.agg(F.sum("size").alias("total"))))  # one row


def queries() -> dict[str, Query]:
    own = (op1_ordinal_quality, op2_bpe, op3_minhash_hamming, op4_pii, op5_licences, op6_decontaminate, op7_repeats, op8_shards, op9_secrets, op10_quality_rules)
    parts = (pii_base, secrets_base, quality_counts, shard_counts)
    return {f.__name__: f for f in own} | {"pipeline": pipeline} | {f.__name__: f for f in parts}


def _places(kind: str, pattern: str, group: int = 0) -> str:
    """A table of one kind's matches: r, s (0-based start), m (text) and g (a group), from the pieces between the matches."""
    pattern = pattern.replace("'", "''")
    return (
        f"{kind}_m AS (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')), "
        f"{kind}_a AS (SELECT r, m[i] AS m, g[i] AS g, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {kind}_m, unnest(range(1, len(m) + 1)) AS u(i))"
    )


def _span_sql(kinds: dict[str, tuple[str, int, str]]) -> str:
    """doc_id, counts and digest of the spans of some kinds: pattern, group, and the test of a match (m, g)."""
    tables = ", ".join(_places(k, p, g) for k, (p, g, _) in kinds.items())
    every = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {i} AS o, s, s + length(m) AS e FROM {k}_a WHERE {test}" for i, (k, (_, _, test)) in enumerate(kinds.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    shown = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    return (
        f"WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), {tables}, x AS ({every}), "
        f"c AS (SELECT r, {counts}, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) AS l FROM x GROUP BY r) SELECT doc_id, {shown}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN c USING (r)"
    )


_LUHN = "list_sum(list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) WHEN CAST(x AS INTEGER) > 4 THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END)) % 10 = 0"
_N_DIGITS = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
#: The base patterns, as the contract writes them.
OP4_BASE_SQL = _span_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
        "card": (r"[0-9]([\x20-]?[0-9])+", 0, f"{_N_DIGITS} BETWEEN 14 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"{_N_DIGITS} BETWEEN 10 AND 15"),
    }
)
OP9_BASE_SQL = _span_sql(
    {
        "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(g) >= 8"),
        "access": (r"AKIA[A-Z0-9]+", 0, "length(m) >= 16"),
        "hex": (r"[0-9a-f]{32,}", 0, "true"),
    }
)
#: Words, windows of three of them, and lines, counted over whole texts.
OP10_BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM tri),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM again, unnest([0, 1, 2]) AS u(j) WHERE n > 1 GROUP BY r),
line AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words FROM d JOIN line USING (r) LEFT JOIN hit USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
OP8_COUNTS_SQL = """
WITH t AS (SELECT count(*) AS rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 16) AS BIGINT) AS total FROM documents), s AS (SELECT shard, rows // 40 + CASE WHEN shard < rows % 40 THEN 1 ELSE 0 END AS n, total FROM t, unnest(range(0, 40)) AS u(shard))
SELECT CAST(shard AS INTEGER) AS shard, n, CAST(0 AS BIGINT) AS first, n - 1 AS last, n AS n_slots, total FROM s
"""
#: Every 200-byte string by a digest of its hexadecimal form; runs of repeated ones cut from each text.
OP7_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, length(h) // 2 - 199)) AS u(i)),
twice AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
rep AS (SELECT r, i FROM p JOIN twice USING (k)),
edge AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM rep),
run AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM edge),
span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, g),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS done, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN done IS NULL THEN h ELSE concat(x, substring(h, 2 * done + 1)) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: The words of ``bench`` and ``documents`` numbered, windows matched by their text at every place.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win), starts AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hit AS (SELECT s.r, s.i, s.n, win.item_id FROM starts s JOIN win ON s.k = win.k AND s.n = win.n),
words AS (SELECT DISTINCT r, i + j AS p FROM (SELECT DISTINCT r, i, n FROM hit), unnest(range(0, n)) AS u(j)),
nh AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
ni AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

#: Shared shingles by an equi-join of the distinct sets, components by a recursive reach.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS sh FROM d
), node AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM node),
pair AS (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
link AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
reach AS (SELECT rep AS x, rep AS y FROM node UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
root AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(root.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(root.component_id, s.doc_id) AS kept
FROM s LEFT JOIN node ON s.sh = node.sh LEFT JOIN root ON node.rep = root.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_hamming": OP3_SQL, "op6_decontaminate": OP6_SQL, "op7_repeats": OP7_SQL, "pii_base": OP4_BASE_SQL, "secrets_base": OP9_BASE_SQL, "quality_counts": OP10_BASE_SQL, "shard_counts": OP8_COUNTS_SQL}
