"""Diversity, agreement, rank statistics, span matching, exact duplicates and sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import grams as G
from spanlake.functions import text as T
from spanlake.operators import detection


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of a column of counts, its maximum, and the number of classes."""
    total = counts.agg(F.sum(n).alias("t"))
    return counts.crossJoin(F.broadcast(total)).agg(F.round(-F.sum(F.col(n) / F.col("t") * F.log2(F.col(n) / F.col("t"))), 9).alias("entropy"), F.round(F.log2(F.count("*").cast("double")), 9).alias("max_entropy"), F.count("*").alias("n_classes"))  # one row is broadcast


def _hashed(seed: int) -> Column:
    return F.transform("w", lambda w: F.xxhash64(F.lit(seed), w))


def distinct_n(docs: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """n, distinct and total n-grams of a corpus, told apart by 90 bits of two chained hashes.

    A task packs each chunk's distinct grams by buckets of their hashes, ten bytes a gram; a bucket is counted by one sort.
    """
    sizes = tuple(sizes)

    def pack(batches):
        for lengths, (words, others) in G.chunks(batches):
            owner = np.repeat(np.arange(len(lengths)), lengths)
            # totals go with a bucket that no gram has
            made = [*((-1, n, int(np.maximum(lengths - n + 1, 0).sum()), None) for n in sizes), *((k, n, 0, g) for k, n, g in G.distinct(words, others, owner, sizes))]
            for i in range(0, len(made), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made[i : i + 1024]), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "n", "total", "g"])

    def count(batches):
        found, held, own = {n: [0, 0] for n in sizes}, [], None

        def flush():
            if held:
                found[own[1]][0] += G.n_distinct(b"".join(held))
                held.clear()

        for batch in batches:
            for bucket, n, total, g in zip(*(x.to_pylist() for x in batch.columns)):
                found[n][1] += total
                if g is not None:
                    if own != (bucket, n):
                        flush()
                        own = bucket, n
                    held.append(g)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([d for d, _ in found.values()], pa.int64()), pa.array([t for _, t in found.values()], pa.int64())], names=["n", "d", "t"])

    tokens = docs.select(T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    hashed = tokens.select(*[_hashed(seed).alias(f"h{seed}") for seed in (0, 1)])
    packed = hashed.mapInArrow(pack, "bucket long, n int, total long, g binary")
    counted = packed.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(count, "n int, d long, t long")
    return counted.groupBy("n").agg(F.sum("d").alias("distinct_grams"), F.sum("t").alias("total_grams")).filter("total_grams > 0")


def mean_cosine_distance(vectors: DataFrame, column: str) -> DataFrame:
    """1 - mean pairwise cosine, in closed form from the sum of unit vectors: no pairs are made."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.select(F.transform(F.col(column), lambda x: x.cast("double") / norm).alias("u"))
    sums = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return sums.agg(F.round(1 - (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1)), 6).alias("mean_distance"), F.max("n").alias("n_vectors"))


def exact_duplicates(docs: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id and the first doc_id of rows whose keys and normalised text (lower case, single spaces) are equal. Only digests are shuffled."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f]+", " "))
    hashed = docs.select("doc_id", *keys, F.sha2(norm.cast("binary"), 256).alias("text_hash"))
    first = hashed.groupBy(*keys, "text_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(first, [*keys, "text_hash"]).filter("doc_id <> first_id").select("doc_id", "first_id")


def match_exact(gold: DataFrame, predicted: DataFrame, strata: list[str]) -> DataFrame:
    """tp, fp and fn of one-to-one exact matches by record, type, start and end, summed over strata: one full join of counts."""
    key = list(dict.fromkeys([*strata, "record_id", "entity_type", "start", "end"]))
    g = gold.groupBy(*key).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    both = g.join(p, key, "full").select(*strata, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    tp = F.sum(F.least("g", "p"))
    out = both.groupBy(*strata).agg(tp.alias("tp"), (F.sum("p") - tp).alias("fp"), (F.sum("g") - tp).alias("fn"))
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 9))


def kendall(pairs: DataFrame) -> DataFrame:
    """Kendall tau-a of (k, a, b), a small table of systems: ties count 0 against n(n-1)/2 pairs."""
    x, y = pairs.alias("x"), pairs.alias("y")
    joined = x.join(y, F.col("x.k") < F.col("y.k"))
    return joined.agg(F.round(F.avg(F.signum((F.col("x.a") - F.col("y.a")) * (F.col("x.b") - F.col("y.b")))), 9).alias("tau"), F.count("*").alias("n_pairs"))


def cohen(rated: DataFrame, one: str, two: str) -> DataFrame:
    """Cohen's kappa of two columns; 0 without rows, 1 where chance agreement is whole."""
    cells = rated.groupBy(F.col(one).alias("x"), F.col(two).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"))
    left = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("l"))
    right = cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "v").agg(F.sum(F.col("l") * F.col("r")).alias("c"))
    po, pe = F.col("agree") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.round(F.when(F.col("t").isNull(), 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 9).alias("kappa"), F.col("t").alias("n"))


def krippendorff(rated: DataFrame, one: str, two: str) -> DataFrame:
    """Krippendorff's alpha (two raters, interval) in closed form: 1 - mean squared difference over twice the pooled variance."""
    a, b = F.col(one).cast("double"), F.col(two).cast("double")
    sums = rated.agg(F.count("*").alias("n"), F.avg((a - b) * (a - b)).alias("do"), F.avg((a + b) / 2).alias("m"), F.avg((a * a + b * b) / 2).alias("q"))
    de = 2 * (F.col("q") - F.col("m") * F.col("m"))
    return sums.select(F.round(F.when(F.col("n") < 2, None).when(F.col("do") == 0, 1.0).when(de == 0, 0.0).otherwise(1 - F.col("do") / de), 9).alias("alpha"), "n")


def stratified(frame: DataFrame, key: str, stratum: str, each: int, seed: str) -> DataFrame:
    """The ``each`` rows of every stratum of smallest seeded digest: exact sizes, the same on every run."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key)
    return frame.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= each).drop("__rank")


def spearman(pairs: DataFrame) -> DataFrame:
    """Spearman's rho of (k, a, b), a small table of systems, by 6 sum d^2; rows that tie share the last rank of theirs."""

    def rank(c: str) -> Column:
        return F.count("*").over(Window.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))

    gap = rank("a") - rank("b")
    each = pairs.select(gap.alias("d"))
    n = F.count("*")
    return each.agg(F.round(1 - F.try_divide(6.0 * F.sum(F.col("d") * F.col("d")), (n * (n * n - 1)).cast("double")), 9).alias("rho"), n.alias("n"))


def mean_delta(pairs: DataFrame) -> DataFrame:
    """Mean absolute difference of a and b."""
    return pairs.agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 9).alias("delta"), F.count("*").alias("n"))


def bootstrap_kendall(pairs: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 % percentiles (index int(q n)) of tau over resamples of (k, a, b), a small table; null below three rows.

    Each round draws n rows by hashes of (seed, round, draw); rounds run in parallel.
    """
    rows = pairs.agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("r"), F.count("*").alias("n"))  # one row
    drawn = pairs.sparkSession.range(rounds).crossJoin(F.broadcast(rows)).filter("n >= 3")
    nth = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.element_at("r", (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.col("n")) + 1).cast("int")))
    drawn = drawn.select("id", "n", F.posexplode(nth).alias("i", "x"))
    x, y = drawn.alias("x"), drawn.alias("y")
    sign = F.signum((F.col("x.x.a") - F.col("y.x.a")) * (F.col("x.x.b") - F.col("y.x.b")))
    taus = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.i") < F.col("y.i"))).groupBy("x.id").agg(F.avg(sign).alias("tau"))
    ordered = taus.agg(F.array_sort(F.collect_list("tau")).alias("t"))  # ``rounds`` values
    at = lambda q: F.round(F.get("t", F.floor(F.size("t") * q).cast("int")), 9)
    return ordered.select(at(0.025).alias("low"), at(0.975).alias("high"))


def type_token_ratio(docs: DataFrame) -> DataFrame:
    """Distinct words over words of the corpus, and Yule's K, from one count of words."""
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return words.agg(F.round(F.try_divide(F.count("*").cast("double"), n), 9).alias("ttr"), F.round(F.try_divide(1e4 * (F.sum(F.col("c") * F.col("c")) - n), n.cast("double") * n), 6).alias("yule_k"), n.alias("n_words"))


def vocabulary_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Distinct words of two corpora, those in both, and their Jaccard similarity."""
    words = lambda d, k: d.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).distinct().withColumn(k, F.lit(1))
    both = words(one, "a").join(words(two, "b"), "w", "full")
    shared = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.agg(F.count("a").alias("n_one"), F.count("b").alias("n_two"), shared.alias("n_shared"), F.round(F.coalesce(F.try_divide(shared.cast("double"), F.count("*")), F.lit(1.0)), 9).alias("jaccard"))


def record_ttr(docs: DataFrame, key: str) -> DataFrame:
    """``key`` and ttr: distinct words over words of each record; null without words."""
    words = T.tokens(F.coalesce("text", F.lit("")))
    return docs.select(key, words.alias("w")).select(key, F.round(F.try_divide(F.size(F.array_distinct("w")).cast("double"), F.size("w")), 9).alias("ttr"))


def density(entities: DataFrame, language: str, kind: str, pattern: str) -> DataFrame:
    """Distinct patterns summed over types, and types, of each language."""
    each = entities.groupBy(language, kind).agg(F.countDistinct(pattern).alias("p"))
    return each.groupBy(language).agg(F.sum("p").alias("n_patterns"), F.count("*").alias("n_types"))


def match_by_field(records: DataFrame, field: str, mode: str = "partial") -> DataFrame:
    """Matches by a value of gold's field: only gold of the value, all predictions of the records that hold it. Null and empty values are left out."""
    values = F.filter(F.array_distinct(F.transform("gold", lambda g: g[field])), lambda v: v.isNotNull() & (v != ""))
    each = records.select("record_id", "gold", "pred", F.explode(values).alias("value"))
    each = each.withColumn("gold", F.filter("gold", lambda g: g[field] == F.col("value")))
    found = detection.match_records(each, mode, "value")
    return found.groupBy(F.col("value").alias(field)).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def judge_means(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the dims present and plain mean, of a long table (judge, dim, score), by judge."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dim")), F.lit(0.0))
    dims = scores.filter("score is not null").groupBy("judge", "dim").agg(F.avg("score").alias("m"))
    return dims.groupBy("judge").agg(F.round(F.try_divide(F.sum(w * F.col("m")), F.sum(w)), 9).alias("weighted"), F.round(F.avg("m"), 9).alias("mean"))


def verdict(score: Column) -> Column:
    """Band of a weighted mean score."""
    return F.when(score >= 8.5, "EXCELLENT").when(score >= 7, "GOOD").when(score >= 5.5, "ACCEPTABLE").when(score >= 3.5, "POOR").when(score.isNotNull(), "FAIL")


def score_bin(score: Column) -> Column:
    """Three bins of a ten-point score."""
    return F.when(score <= 4, 0).when(score <= 7, 1).when(score.isNotNull(), 2)


def record_verdicts(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """record_id, weighted mean over the dims present of the judges' mean scores, and its verdict, of (record_id, judge, dim, score)."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dim"))
    dims = scores.filter("score is not null").groupBy("record_id", "dim").agg(F.avg("score").alias("m")).withColumn("w", w).filter("w is not null")
    out = dims.groupBy("record_id").agg(F.round(F.sum(F.col("w") * F.col("m")) / F.sum("w"), 9).alias("weighted"))
    return out.withColumn("verdict", verdict(F.col("weighted")))


def kappa_matrix(scores: DataFrame) -> DataFrame:
    """Cohen's kappa of the binned scores of each pair of judges by dim, over the records that both scored; 1 where chance agreement is whole."""
    held = scores.filter("score is not null").select("record_id", "dim", "judge", score_bin(F.col("score")).alias("b"))
    one, two = (held.select("record_id", "dim", F.col("judge").alias(f"judge_{n}"), F.col("b").alias(n)) for n in ("x", "y"))
    cells = one.join(two, ["record_id", "dim"]).filter("judge_x < judge_y").groupBy("judge_x", "judge_y", "dim", "x", "y").agg(F.count("*").alias("n"))
    count = lambda c, k: F.sum(F.when(F.col(c) == k, F.col("n")).otherwise(0))
    sums = cells.groupBy("judge_x", "judge_y", "dim").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"), sum((count("x", k) * count("y", k) for k in range(3)), F.lit(0)).alias("c"))
    po, pe = F.col("agree") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return sums.select("judge_x", "judge_y", "dim", F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 9).alias("kappa"), F.col("t").alias("n"))


def simple_sample(frame: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """Exactly ``size`` rows (or all), those of smallest seeded digest: each task passes on at most ``size``."""
    return frame.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))).orderBy("__h", key).limit(size).drop("__h")


def stratified_cut(frame: DataFrame, key: str, stratum: str, size: int, seed: str) -> DataFrame:
    """An equal part of each stratum (at least one row) and at most ``size`` rows in all, without filling up short strata."""
    parts = frame.select(stratum).distinct().count()  # strata are few
    return simple_sample(stratified(frame, key, stratum, max(1, size // max(1, parts)), seed), key, size, seed + "-all")


def short_strata(frame: DataFrame, stratum: str, each: int) -> DataFrame:
    """Strata with fewer rows than a sample wants, and how many they have."""
    return frame.groupBy(stratum).agg(F.count("*").alias("n")).filter(F.col("n") < each)


def topped_up(frame: DataFrame, key: str, stratum: str, total: int, seed: str) -> DataFrame:
    """``total`` rows: an equal part of each stratum, then what is lacking from the rest, both in the order of a seeded digest.

    No window ranks a whole stratum: its part are its first rows (Spark trims them within tasks), and the rest is
    an ordered limit over the others.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    parts = frame.select(stratum).distinct().count()  # strata are few
    held = frame.withColumn("__h", digest)
    ranked = held.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key)))
    first = ranked.filter(F.col("__r") <= max(total // max(1, parts), 1)).drop("__r").orderBy("__h", key).limit(total)
    rest = held.join(F.broadcast(first.select(key, F.lit(True).alias("__in")).distinct()), key, "left").filter("__in is null").drop("__in").orderBy("__h", key).limit(total)  # at most ``total`` keys are broadcast
    both = first.withColumn("__late", F.lit(0)).unionByName(rest.withColumn("__late", F.lit(1)))
    return both.orderBy("__late", "__h", key).limit(total).drop("__h", "__late")
