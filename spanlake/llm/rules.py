"""Quality rules with a robust multivariate outlier test, in DataFrame and SQL functions alone.

Word, symbol, line and repetition counts of each text feed fixed base rules. Texts that pass them
are described by a transformed vector (mean word length, symbol share, repeated-line share and
repeated-window share). For each language and source, each language and all rows the
minimum-covariance-determinant centre and scatter are sought from six starts: medians and
quartile ranges, spatial signs, plain moments, and three seeded draws of five vectors. A
concentration step keeps the share ``CORE`` of rows nearest by Mahalanobis distance and takes their
moments anew; after two steps the two starts of smallest determinant go on until it stops falling,
and the smaller one wins. One reweighting step follows. Scatters carry the factor that makes them
consistent for normal rows, and ``FLOOR`` is added to their diagonals, without which groups whose
rows mostly agree in a coordinate would be singular; the determinants compared include it.

A step is one aggregation with map-side combining. Rows are summed by bins of distance (1 % wide),
bins are taken from the nearest on until they hold exactly the core's number of rows, and the bin
that exceeds it counts in part: memory is bounded for any group and rows' order has no influence.
A text's distance is the mean of those under its group's estimate, its language's and that of all
rows; the larger a group, the more its own estimate weighs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage, text_or_empty, unstage, whole_row

CORE = 0.75
#: Steps of every start, starts that go on, and the most steps they go on for (they stop once determinants change less than ``SETTLED``).
TRIAL_STEPS, FINALISTS, MOST_STEPS, SETTLED = 2, 2, 12, 1e-6
#: Seeded draws of DIM + 1 vectors.
DRAWS = 3
#: Share of normal rows that reweighting keeps, and that of normal rows beyond the final cutoff.
REWEIGHT, TAIL = 0.975, 1e-5
#: Least standard deviation of each coordinate: a smaller spread says nothing about quality. Over a clean group each coordinate
#: alone can exceed the cutoff: repeated lines and windows, at most 1 and 0.71 past the base rules, from 0.54.
FLOOR = (0.15, 0.05, 0.10, 0.10)
#: An estimate of this many rows weighs as much as that of the level above it.
LEAST = 50
#: Estimates (about 400 bytes each at most) that are broadcast.
GROUPS = 100_000
#: Bins of an octave of squared distance, and bins of a unit of a coordinate.
OCTAVE, UNIT = 64, 1024
SPACE = " \t\n\x0b\f\r"
DIM = ("x0", "x1", "x2", "x3")
_LOWER = [(i, j) for i in range(len(DIM)) for j in range(i + 1)]
#: Columns of an estimate: centre and covariance.
MOMENTS = (*(f"m{i}" for i in range(len(DIM))), *(f"c{i}{j}" for i, j in _LOWER))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_square(d2: float, freedom: int = len(DIM)) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-d2 / 2) * sum((d2 / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def quantile(share: float) -> float:
    """The squared distance that a share of normal rows stays within."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows must be multiplied by."""
    return share / chi_square(quantile(share), len(DIM) + 2)


CUTOFF = quantile(1 - TAIL)


def _counted(held: DataFrame) -> DataFrame:
    """``held`` (any columns, text not null) with the five counts in place of ``text``."""
    others = [c for c in held.columns if c != "text"]
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    held = held.withColumn("trim", F.trim("text", F.lit(SPACE)))
    held = held.withColumn("words", F.when(F.col("trim") == "", none("string")).otherwise(F.split("trim", r"[\x20\x09-\x0D]+")))
    held = held.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != ""))
    n = F.size("words")
    held = held.withColumn("tri", F.slice(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(n, F.lit(1))).alias("b"), F.slice("words", F.lit(3), F.greatest(n, F.lit(1))).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0))))
    held = held.withColumn("hash", F.transform("tri", lambda t: F.xxhash64(t["a"], t["b"], t["c"])))
    # equal windows have equal hashes: without two of those nothing repeats, whatever hashes collide
    some = F.size(F.array_distinct("hash")) < F.size("hash")
    place = F.arrays_zip(F.col("hash").alias("h"), F.col("tri").alias("t"), F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))).alias("i"))
    kind = "struct<h:bigint,t:struct<a:string,b:string,c:string>,i:int>"
    # windows by hash, words and place: equal ones are neighbours
    held = held.withColumn("sorted", F.when(some, F.sort_array(place)).otherwise(none(kind)))
    rest = F.greatest(F.size("sorted") - 1, F.lit(0))
    held = held.withColumn("next", F.slice("sorted", F.lit(2), F.greatest(rest, F.lit(1))))
    held = held.withColumn("same", F.filter(F.zip_with("sorted", "next", lambda a, b: F.when((a["h"] == b["h"]) & (a["t"] == b["t"]), F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    held = held.withColumn("at", F.array_distinct(F.flatten("same")))
    return held.select(
        *others,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
    )


def stats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those of ``carry``) and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text (null: none of each)."""
    return _counted(docs.select(whole_row(docs, carry), text_or_empty().alias("text")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.sqrt(F.least(a / b, F.lit(1.0)))
    return [F.log(chars / words), share(F.col("n_symbols"), chars), share(F.col("n_dup_lines"), F.col("n_dup_lines") + words / 10), share(F.col("n_repeat_words"), words)]


def _factored(found: DataFrame) -> DataFrame:
    """The Cholesky factor l* in place of the covariance, and the logarithm of its determinant."""
    out = found
    for i, j in _LOWER:
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}"))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 100))) if i == j else rest / F.col(f"l{j}{j}"))
    log = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(len(DIM))]) * 2
    return out.withColumn("logdet", log).drop(*MOMENTS[len(DIM) :])


def _distance(level: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution, under the estimate whose columns end in ``level``."""
    y: list[Column] = []
    for i in range(len(DIM)):
        left = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}{level}") * y[k] for k in range(i)], F.col(DIM[i]) - F.col(f"m{i}{level}"))
        y.append(left / F.col(f"l{i}{i}{level}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _beside(frame: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``frame`` joined with staged rows of its groups: broadcast while they are at most ``GROUPS``; beyond, the join is Spark's, which splits hot keys at run time."""
    return frame.join(F.broadcast(groups) if groups.count() <= GROUPS else groups, key, how)


def _floored(out: DataFrame, factor: float) -> DataFrame:
    """Consistent, floored covariances from the means m* and mean products s*."""
    for i, j in _LOWER:
        cov = F.lit(factor) * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
        out = out.withColumn(f"c{i}{j}", F.greatest(cov, F.lit(0.0)) + F.lit(FLOOR[i] ** 2) if i == j else cov)
    return out.select("g", "start", *MOMENTS)


def _starts(vectors: DataFrame) -> DataFrame:
    """The starts of each group: g, start, m*, c*."""
    each = vectors.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * UNIT).cast("int").alias("bin")) for i, x in enumerate(DIM)])).alias("v"))
    counts = each.groupBy("g", "v.i", "v.bin").agg(F.count("*").alias("n"))
    run = counts.select("g", "i", "bin", F.sum("n").over(Window.partitionBy("g", "i").orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy("g", "i")).alias("all"))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, (F.col("bin") + 0.5) / UNIT))
    quarters = run.groupBy("g", "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("i") + 1)
    told = quarters.select("g", "i", "mid", F.greatest((F.col("high") - F.col("low")) / 1.349, floor).alias("scale"))
    wide = told.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in ("mid", "scale") for i in range(len(DIM))])
    marks = stage(wide, "marks")
    z = [(F.col(x) - F.col(f"mid{i}")) / F.col(f"scale{i}") for i, x in enumerate(DIM)]
    held = _beside(vectors, marks, "g").withColumns({f"z{i}": v for i, v in enumerate(z)})
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(DIM))]))
    held = held.withColumn("norm", F.when(norm > 0, norm))
    product = lambda cs: {(i, j): F.col(cs[i]) * F.col(cs[j]) for i, j in _LOWER}
    sums = [F.avg(x).alias(f"a{i}") for i, x in enumerate(DIM)] + [F.avg(p).alias(f"p{i}{j}") for (i, j), p in product(DIM).items()]
    sums += [F.avg(F.coalesce(p / (F.col("norm") * F.col("norm")), F.lit(0.0))).alias(f"u{i}{j}") for (i, j), p in product([f"z{i}" for i in range(len(DIM))]).items()]
    drawn = [(k, r) for k in range(DRAWS) for r in range(len(DIM) + 1)]
    sums += [F.min_by(F.struct(*DIM), F.xxhash64(F.lit(k), F.lit(r), *DIM)).alias(f"d{k}_{r}") for k, r in drawn]
    found = held.groupBy("g").agg(*sums, *[F.max(f"{c}{i}").alias(f"{c}{i}") for c in ("mid", "scale") for i in range(len(DIM))])

    def start(number: int, centre: list[Column], products: dict) -> Column:
        return F.struct(F.lit(number).alias("start"), *[c.alias(f"m{i}") for i, c in enumerate(centre)], *[products[ij].alias(f"s{ij[0]}{ij[1]}") for ij in _LOWER])

    mids, scales = ([F.col(f"{c}{i}") for i in range(len(DIM))] for c in ("mid", "scale"))
    about = lambda cov: {ij: cov[ij] + mids[ij[0]] * mids[ij[1]] for ij in _LOWER}
    starts = [
        start(0, mids, about({(i, j): scales[i] * scales[j] * (1.0 if i == j else 0.0) for i, j in _LOWER})),
        start(1, mids, about({(i, j): scales[i] * scales[j] * F.col(f"u{i}{j}") * len(DIM) for i, j in _LOWER})),
        start(2, [F.col(f"a{i}") for i in range(len(DIM))], {ij: F.col(f"p{ij[0]}{ij[1]}") for ij in _LOWER}),
    ]
    size = float(len(DIM) + 1)
    for k in range(DRAWS):
        mean = lambda f: reduce(lambda a, b: a + b, [f(F.col(f"d{k}_{r}")) for r in range(len(DIM) + 1)]) / size  # noqa: B023, E731
        starts.append(start(3 + k, [mean(lambda d, x=x: d[x]) for x in DIM], {(i, j): mean(lambda d, i=i, j=j: d[DIM[i]] * d[DIM[j]]) for i, j in _LOWER}))
    return _floored(found.select("g", F.explode(F.array(*starts)).alias("s")).select("g", "s.*"), 1.0)


def _sums(near: DataFrame, *keys: str) -> DataFrame:
    return near.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(DIM)], *[F.sum(F.col(DIM[i]) * F.col(DIM[j])).alias(f"t{i}{j}") for i, j in _LOWER])


def _concentrated(vectors: DataFrame, held: DataFrame, core: float) -> DataFrame:
    """One concentration step of every start: the moments of the core's rows."""
    near = _beside(vectors, held, "g").withColumn("bin", F.floor(F.log2(_distance() + F.lit(1e-9)) * OCTAVE).cast("int"))
    bins = _sums(near, "g", "start", "bin")
    one = Window.partitionBy("g", "start")
    run = bins.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("h", F.ceil(F.sum("n").over(one) * F.lit(core)))
    share = F.greatest(F.least(F.col("n"), F.col("h") - F.col("upto") + F.col("n")), F.lit(0)) / F.col("n") / F.col("h")
    taken = lambda c: F.sum(F.col(c) * share)
    out = run.groupBy("g", "start").agg(*[taken(f"t{i}").alias(f"m{i}") for i in range(len(DIM))], *[taken(f"t{i}{j}").alias(f"s{i}{j}") for i, j in _LOWER])
    return _floored(out, consistency(core))


def estimates(vectors: DataFrame, core: float = CORE) -> DataFrame:
    """Robust centre and scatter by group: columns g, m*, c*, logdet of the raw estimate. ``vectors`` has g and the coordinates."""
    best = lambda frame, k: frame.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))).filter(F.col("k") <= k).drop("k")
    keep = lambda found: found.join(_factored(found).select("g", "start", "logdet"), ["g", "start"])
    told = stage(keep(_starts(vectors)), "starts")
    for step in range(TRIAL_STEPS + MOST_STEPS):
        new = keep(stage(_concentrated(vectors, stage(_factored(told.drop("logdet")), "factors"), core), "mcd"))
        new = stage(best(new, FINALISTS) if step + 1 == TRIAL_STEPS else new, "mcd")
        change = new.alias("a").join(told.alias("b"), ["g", "start"]).agg(F.max(F.abs(F.col("a.logdet") - F.col("b.logdet")))).first()[0] if step >= TRIAL_STEPS else None
        unstage(told)
        told = new
        if step >= TRIAL_STEPS and (change is None or change < SETTLED):
            break
    raw = best(told, 1).withColumn("start", F.lit(0))
    near = _beside(vectors, stage(_factored(raw.drop("logdet")), "factors"), "g").filter(_distance() <= quantile(REWEIGHT))
    sums = _sums(near, "g", "start")
    means = sums.select("g", "start", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(len(DIM))], *[(F.col(f"t{i}{j}") / F.col("n")).alias(f"s{i}{j}") for i, j in _LOWER])
    return _floored(means, consistency(REWEIGHT)).drop("start").join(raw.select("g", "logdet"), "g")


def judge(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those of ``carry``, unchanged), the five counts, base_failed, distance (squared; null where the base failed) and kept.

    One row for each row, repeated ones too. Null and empty texts fail the base rules; null language
    or source (or a missing column) is a group of its own. The distance under an estimate of n passing
    rows has weight n / (n + ``least``) against that of its language, and this against that of all
    rows, so every row is judged; where all rows agree every distance is 0. Texts of any length are counted whole. An
    empty table gives none.
    """
    plain = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    held = _counted(docs.select(whole_row(docs, carry), text_or_empty().alias("text"), plain("lang").alias("lang"), plain("source").alias("source")))
    key = lambda level, *cols: F.to_json(F.struct(F.lit(level).alias("level"), *cols), {"ignoreNullFields": "false"})
    held = held.withColumn("base_failed", base_failed()).withColumns(dict(zip(DIM, _vector(), strict=True)))
    held = held.withColumns({"own": key("own", "lang", "source"), "wide": key("wide", "lang")}).drop("lang", "source")
    held = stage(held, "rules")
    good = held.filter(~F.col("base_failed")).select("own", "wide", F.lit("all").alias("whole"), *DIM)
    use = good.groupBy("own").agg(F.first("wide").alias("wide"), F.first("whole").alias("whole"))
    # a group's rows count for its own estimate, for its language's and for that of all rows
    vectors = stage(good.select(F.explode(F.array("own", "wide", "whole")).alias("g"), *DIM), "vectors")
    found = estimates(vectors).join(vectors.groupBy("g").agg((F.count("*") / (F.count("*") + F.lit(least))).alias("w")), "g")
    found = stage(_factored(found).drop("logdet"), "levels")
    for level in ("own", "wide", "whole"):
        use = _beside(use, found.select(F.col("g").alias(level), *[F.col(c).alias(f"{c}_{level}") for c in found.columns if c != "g"]), level)
    use = stage(use.drop("wide", "whole"), "estimates")
    out = _beside(held, use, "own", "left")
    mixed = lambda level, above: F.col(f"w_{level}") * _distance(f"_{level}") + (1 - F.col(f"w_{level}")) * above
    out = out.withColumn("distance", F.when(~F.col("base_failed"), mixed("own", mixed("wide", _distance("_whole")))))
    unstage(vectors, found)
    return out.select("row", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))
