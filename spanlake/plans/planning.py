"""Generation plans: covering arrays, deficits, weighted choices, sweeps and synthetic values.

Choices come from hashes of (row, name, seed), so plans are the same on every run and any partitioning.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake import consts

SEED = 42

#: Axis values. Fixed values.
AXES = {
    "domain": "healthcare legal finance education government technology HR insurance customer_service law_enforcement social_media e_commerce".split(),
    "format": "plain_text email chat_transcript ticket_worknotes json_record key_value_pairs log_entry".split(),
    "difficulty": "easy medium hard".split(),
    "length": "small medium large very_large".split(),
    "density": "low medium high".split(),
    "code_switching": "none light heavy".split(),
    "language": "EN FR DE IT ES PT_BR FR_CA JA NL SV FI CS HE HU KO NO PT_EU RU ZH_CN ZH_TW TH TR AR DA HI".split(),
    "adjacency": "none loose tight".split(),
}
#: Date patterns by language; others as EN. Fixed values.
DATES = {"EN": "MM/dd/yyyy", "DE": "dd.MM.yyyy", "FR": "dd/MM/yyyy", "ES": "dd/MM/yyyy", "IT": "dd/MM/yyyy", "PT_BR": "dd/MM/yyyy", "JA": "yyyy年M月d日", "ZH_CN": "yyyy年M月d日", "ZH_TW": "yyyy年M月d日", "KO": "yyyy년 M월 d일", "RU": "dd.MM.yyyy", "NL": "dd-MM-yyyy", "SV": "yyyy-MM-dd", "HU": "yyyy.MM.dd", "FR_CA": "yyyy-MM-dd"}


def covering_array(axes: dict[str, list[str]]) -> list[dict[str, str]]:
    """Rows in which each pair of values of two axes occurs. Small: about the product of the two longest axes.

    The longest two axes are laid out in full. Each further axis takes, row by row, the value that covers most pairs
    still open; what stays open fills rows of its own, sharing them where values don't conflict.
    """
    names = sorted(axes, key=lambda a: -len(axes[a]))
    if len(names) < 2:
        return [{a: v} for a in names for v in axes[a]]
    rows: list[dict[str, str]] = [dict(zip(names[:2], p)) for p in product(axes[names[0]], axes[names[1]])]
    for k in range(2, len(names)):
        new = names[k]
        left = {(a, v, w) for a in names[:k] for v in axes[a] for w in axes[new]}
        for at, row in enumerate(rows):
            turn = axes[new][at % len(axes[new]) :] + axes[new][: at % len(axes[new])]
            row[new] = max(turn, key=lambda w: sum((a, v, w) in left for a, v in row.items()))
            left -= {(a, v, row[new]) for a, v in row.items() if a != new}
        extra: list[dict[str, str]] = []
        for a, v, w in sorted(left):
            home = next((r for r in extra if r[new] == w and a not in r), None)
            if home is None:
                extra.append(home := {new: w})
            home[a] = v
        for row in extra:
            for a in names[:k]:
                row.setdefault(a, axes[a][0])
        rows += extra
    return rows


def uncovered(rows: list[dict[str, str]], axes: dict[str, list[str]]) -> int:
    """Pairs of values that no row has."""
    return sum(len(set(product(axes[a], axes[b])) - {(r[a], r[b]) for r in rows}) for a, b in combinations(axes, 2))


def _draw(key: Column, name: str, seed: int = SEED) -> Column:
    """Uniform in [0, 1) by row and name."""
    return F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))


def pick(key: Column, name: str, values: list[str], seed: int = SEED) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(_draw(key, name, seed) * len(values)) + 1).cast("int"))


def weighted(key: Column, name: str, options: list[tuple[str, float]], seed: int = SEED) -> Column:
    total, upto, out = sum(w for _, w in options), 0.0, None
    at = _draw(key, name, seed)
    for value, weight in options[:-1]:
        upto += weight / total
        out = F.when(at < upto, value) if out is None else out.when(at < upto, value)
    return F.lit(options[-1][0]) if out is None else out.otherwise(options[-1][0])


def frame(key: Column, adjacency: Column) -> Column:
    """Behavioural frame: co_occurrence where tight, else a weighted choice of the others."""
    rest = [f for f in consts.FRAMES if f[0] != "co_occurrence"]
    return F.when(adjacency == "tight", "co_occurrence").otherwise(weighted(key, "frame", rest))


def co_pattern(key: Column, adjacency: Column) -> Column:
    return F.when(adjacency == "tight", pick(key, "co", [f"CO-{i:03d}" for i in range(1, 16)])).otherwise("none")


def deficits(have: DataFrame, wanted: DataFrame, column: str, floor: int) -> DataFrame:
    """``column`` once for each row that its value lacks to reach ``floor``; ``have`` has the column once a row."""
    counts = have.groupBy(column).agg(F.count("*").alias("n"))
    short = wanted.join(counts, column, "left").withColumn("lack", F.lit(floor) - F.coalesce("n", F.lit(0))).filter("lack > 0")
    return short.select(column, F.explode(F.sequence(F.lit(1), F.col("lack").cast("int"))).alias("nth"))


def _filled(rows: DataFrame, key: Column, source: str) -> DataFrame:
    return rows.select(*[pick(key, f"{source}-{a}", v).alias(a) for a, v in AXES.items()], "target_entity_type", F.lit(source).alias("source"), key.alias("k"))


def generation_plan(spark: SparkSession, total: int = 5510, floor: int = 50, co_floor: int = 3, seed: int = SEED) -> DataFrame:
    """record_id, axes, target type, frame, co-occurrence pattern and source: the covering array, then at least
    ``co_floor`` rows of each pattern, ``floor`` of each type, and a random fill up to ``total``; shuffled, numbered from 1."""
    types = list(consts.TIERS)
    first = spark.createDataFrame([(i, *(r[a] for a in AXES)) for i, r in enumerate(covering_array(AXES))], "i long, " + ", ".join(f"{a} string" for a in AXES))
    base = first.select(*AXES, pick(F.col("i"), "type", types).alias("target_entity_type"), F.lit("covering_array").alias("source"), F.concat(F.lit("c"), "i").alias("k"))
    base = base.withColumn("co", co_pattern(F.col("k"), F.col("adjacency")))
    patterns = spark.createDataFrame([(f"CO-{i:03d}",) for i in range(1, 16)], "co string")
    lacking = deficits(base.filter("co <> 'none'").select("co"), patterns, "co", co_floor).withColumn("k", F.concat(F.lit("o"), "co", F.lit("-"), F.col("nth").cast("string")))
    extra = lacking.select(*[(F.lit("tight") if a == "adjacency" else pick(F.col("k"), f"co_supplement-{a}", v)).alias(a) for a, v in AXES.items()], pick(F.col("k"), "type", types).alias("target_entity_type"), F.lit("co_supplement").alias("source"), "k", "co")
    both = base.unionByName(extra)
    every = spark.createDataFrame([(t,) for t in types], "target_entity_type string")
    needed = deficits(both.select("target_entity_type"), every, "target_entity_type", floor)
    floored = _filled(needed, F.concat(F.lit("f"), "target_entity_type", F.lit("-"), F.col("nth").cast("string")), "floor_supplement")
    floored = floored.withColumn("co", co_pattern(F.col("k"), F.col("adjacency")))
    made = both.unionByName(floored)
    rest = spark.range(max(0, total - made.count())).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("key"))
    rest = _filled(rest.select("key", pick(F.col("key"), "type", types).alias("target_entity_type")), F.col("key"), "diversity_fill")
    made = made.unionByName(rest.withColumn("co", co_pattern(F.col("k"), F.col("adjacency"))))
    order = Window.orderBy(F.xxhash64("k", F.lit(seed)), "k")  # a plan is a few thousand rows
    return made.select(F.row_number().over(order).cast("long").alias("record_id"), *AXES, "target_entity_type", F.col("co").alias("co_occurrence_pattern"), frame(F.col("k"), F.col("adjacency")).alias("behavioral_frame"), "source")


def sweep(anchors: DataFrame, column: str, values: list[str], axis: str) -> DataFrame:
    """Each anchor once for each value of a column, with sweep_axis and sweep_value."""
    return anchors.withColumn(column, F.explode(F.array(*map(F.lit, values)))).withColumn("sweep_axis", F.lit(axis)).withColumn("sweep_value", F.col(column))


def sweep_two(anchors: DataFrame, one: str, ones: list[str], two: str, twos: list[str], axis: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product(ones, twos)]))
    each = anchors.withColumn("__cell", cells).withColumn(one, F.col("__cell.a")).withColumn(two, F.col("__cell.b"))
    return each.withColumn("sweep_axis", F.lit(axis)).withColumn("sweep_value", F.concat_ws("_x_", "__cell.a", "__cell.b")).drop("__cell")


def paired_plan(anchors: DataFrame, key: str = "anchor_id", shares: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Sweeps of format (the first half of anchors in hashed order), domain (30 %), and difficulty with density (the rest)."""
    order = Window.orderBy(F.xxhash64(key, F.lit(SEED)), key)  # anchors are few
    ranked = anchors.withColumn("__q", (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy()))
    first, second = shares[0], shares[0] + shares[1]
    out = sweep(ranked.filter(F.col("__q") < first), "format", AXES["format"], "text_format")
    out = out.unionByName(sweep(ranked.filter((F.col("__q") >= first) & (F.col("__q") < second)), "domain", AXES["domain"], "text_domain"))
    out = out.unionByName(sweep_two(ranked.filter(F.col("__q") >= second), "difficulty", AXES["difficulty"], "density", AXES["density"], "difficulty_x_density"))
    return out.drop("__q")


#: What anchors of each category draw from. Fixed values.
CO_PATTERNS = [f"CO-{i:03d}" for i in range(1, 16)]
NON_LATIN = "JA ZH_CN ZH_TW KO AR HE TH HI RU".split()
ANCHORS = {
    "stress_test": (30, {"difficulty": ["hard"], "length": ["very_large"], "density": ["high"], "code_switching": ["none", "light"], "language": ["EN", "FR", "DE", "ES", "JA"], "adjacency": ["loose", "tight"]}),
    "article_9": (30, {"domain": ["healthcare", "legal", "finance", "HR", "government"], "length": ["medium", "large"], "density": ["medium", "high"], "code_switching": ["none"], "language": ["EN", "FR", "DE", "ES", "AR", "PT_BR"], "adjacency": ["loose", "tight"]}),
    "non_latin": (25, {"length": ["small", "medium", "large"], "density": ["medium", "high"], "code_switching": ["none", "light"], "language": NON_LATIN, "adjacency": ["loose", "tight"]}),
    "co_pattern": (15, {"difficulty": ["medium", "hard"], "length": ["small", "medium"], "density": ["medium", "high"], "code_switching": ["none"], "language": ["EN", "FR", "DE", "ES", "JA", "AR"], "adjacency": ["tight"]}),
}


def anchors(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """anchor_id, category, axes and co-occurrence pattern of the paired plan's hundred anchors; those of ``co_pattern`` have one pattern each."""
    rows = [(f"{category}-{i:03d}", category, i) for category, (n, _) in ANCHORS.items() for i in range(n)]
    out = spark.createDataFrame(rows, "anchor_id string, category string, nth int")
    key = F.col("anchor_id")
    for axis, values in AXES.items():
        made = pick(key, axis, values, seed)
        for category, (_, own) in ANCHORS.items():
            if axis in own:
                made = F.when(F.col("category") == category, pick(key, axis, own[axis], seed)).otherwise(made)
        out = out.withColumn(axis, made)
    own = F.element_at(F.array(*map(F.lit, CO_PATTERNS)), F.least(F.col("nth"), F.lit(len(CO_PATTERNS) - 1)) + 1)
    drawn = F.when(F.col("adjacency") == "tight", pick(key, "co", CO_PATTERNS, seed)).otherwise("none")
    return out.withColumn("co_occurrence_pattern", F.when(F.col("category") == "co_pattern", own).otherwise(drawn)).drop("nth")


def _whole(key: Column, name: str, low: int, high: int) -> Column:
    return (F.floor(_draw(key, name) * (high - low + 1)) + low).cast("int")


def _by(key: Column, name: str, pools: dict[str, list], which: Column, rest: str) -> Column:
    """A hashed choice from the pool that ``which`` names, or from ``rest``."""
    of = lambda values: pick(key, name, values)
    out = None
    for k, values in pools.items():
        out = F.when(which == k, of(values)) if out is None else out.when(which == k, of(values))
    return out.otherwise(of(pools[rest]))


def fictional_email(key: Column, first: Column, last: Column, language: Column | None = None) -> Column:
    local = lambda c, none: F.coalesce(F.nullif(F.regexp_replace(F.lower(c), "[^a-z]", ""), F.lit("")), F.lit(none))
    f, n = local(first, "x"), local(last, "y")
    host = _by(key, "host", consts.HOSTS, language if language is not None else F.lit("default"), "default")
    shapes = F.array(F.concat(f, F.lit("."), n, F.lit("@"), host, F.lit(".com")), F.concat(f, F.lit("_"), n, F.lit("@"), host, F.lit(".org")), F.concat(f, F.lit("@"), host, F.lit(".io")), F.concat(F.substring(f, 1, 1), n, F.lit("@"), host, F.lit(".net")))
    return F.element_at(shapes, _whole(key, "shape", 1, 4))


def fictional_birth_date(key: Column, language: Column) -> Column:
    day = F.make_date(_whole(key, "year", 1950, 2005), _whole(key, "month", 1, 12), _whole(key, "day", 1, 28))
    out = None
    for name, pattern in DATES.items():
        out = F.when(language == name, F.date_format(day, pattern)) if out is None else out.when(language == name, F.date_format(day, pattern))
    return out.otherwise(F.date_format(day, DATES["EN"]))


def fictional_record_number(key: Column) -> Column:
    return F.format_string("MED-%d-%s", _whole(key, "mrn", 10000, 99999), pick(key, "mrn-end", ["A", "B"]))


def fictional_employee(key: Column) -> Column:
    return F.format_string("%s-%05d", pick(key, "prefix", ["EMP", "NOW", "SAP", "WD"]), _whole(key, "employee", 1000, 99999))


def fictional_national_id(key: Column, language: Column) -> Column:
    """value and pattern_id of a synthetic national number in the language's grouping; every group has its full width."""
    part = lambda name, width: F.lpad(_whole(key, f"nid-{name}", 0, 10**width - 1).cast("string"), width, "0")
    group = lambda sep, *widths: F.concat_ws(sep, *[part(f"{i}-{w}", w) for i, w in enumerate(widths)])
    made = lambda value, pattern: F.struct(value.alias("value"), F.lit(pattern).alias("pattern_id"))
    brazil = F.concat_ws("-", group(".", 3, 3, 3), part("check", 2))
    return F.when(language == "PT_BR", made(brazil, "NID-007")).when(language == "DE", made(group(" ", 2, 3, 3, 3), "NID-003")).when(language == "FR", made(group(" ", 1, 2, 2, 2, 3, 3, 2), "NID-004")).when(language == "JA", made(group(" ", 4, 4, 4), "NID-008")).otherwise(made(group("-", 3, 2, 4), "NID-001"))


def _named(chosen: Column) -> Column:
    return F.struct(F.split_part(chosen, F.lit("|"), F.lit(1)).alias("value"), F.split_part(chosen, F.lit("|"), F.lit(2)).alias("pattern_id"))


def fictional_title(key: Column) -> Column:
    return _named(pick(key, "title", ["|".join(x) for x in consts.BUSINESS_TITLES]))


def fictional_organisation(key: Column, domain: Column) -> Column:
    return _named(_by(key, "org", {d: ["|".join(x) for x in v] for d, v in consts.ORGANISATIONS.items()}, domain, "technology"))


def scenario(domain: Column, form: Column, target: Column) -> Column:
    """Scenario text of a domain and format, or a general sentence, with the target type."""
    table = F.create_map(*[F.lit(x) for (d, f), text in consts.SCENARIOS.items() for x in (f"{d}|{f}", text)])
    known = F.try_element_at(table, F.concat_ws("|", domain, form))
    general = F.concat(F.lit("A "), F.replace(form, F.lit("_"), F.lit(" ")), F.lit(" in the "), domain, F.lit(" domain."))
    return F.concat(F.coalesce(known, general), F.lit(" (target entity: "), target, F.lit(")"))


def attach_patterns(plan: DataFrame, catalog: DataFrame, key: str = "record_id", seed: int = SEED) -> DataFrame:
    """``plan`` with target_pattern_id: a hashed choice among the patterns of its type; other languages than EN and tight
    rows prefer patterns of theirs, where the type has any. Null without patterns.

    ``catalog`` (pattern_id, entity_type, language_hint, dimensions) is numbered within each pool (a type's patterns, those
    of a language, the tight ones of either), so a row needs its pool's size and one join to the drawn number; only sizes
    are broadcast.
    """
    hint, tight = F.col("language_hint"), F.coalesce(F.array_contains("dimensions", "Adjacency-tight"), F.lit(False))
    pool = lambda when, h, t: F.when(when, F.struct(h.cast("string").alias("__hint"), F.lit(t).alias("__tight")))
    own = F.array_compact(F.array(pool(F.lit(True), F.lit(None), False), pool(tight, F.lit(None), True), pool(hint.isNotNull(), hint, False), pool(tight & hint.isNotNull(), hint, True)))
    kind = F.col("entity_type").alias("target_entity_type")
    pooled = catalog.select(kind, F.col("pattern_id").alias("__id"), F.explode(own).alias("p")).select("target_entity_type", "__id", "p.*")
    number = F.row_number().over(Window.partitionBy("target_entity_type", "__hint", "__tight").orderBy("__id")) - 1
    numbered = pooled.select(F.col("target_entity_type").alias("__type"), "__hint", "__tight", "__id", number.alias("__at"))
    sizes = pooled.groupBy("target_entity_type", "__hint").agg(F.count_if(~F.col("__tight")).alias("n"), F.count_if("__tight").alias("nt"))
    whole = sizes.filter(F.col("__hint").isNull()).select("target_entity_type", F.col("n").alias("__n"), F.col("nt").alias("__nt"))
    spoken = sizes.filter(F.col("__hint").isNotNull()).select("target_entity_type", F.col("__hint").alias("language"), F.col("n").alias("__ln"), F.col("nt").alias("__lnt"))
    out = plan.join(F.broadcast(whole), "target_entity_type", "left").join(F.broadcast(spoken), ["target_entity_type", "language"], "left")
    by_hint = F.coalesce((F.col("language") != "EN") & (F.col("__ln") > 0), F.lit(False))
    tights = F.when(by_hint, F.col("__lnt")).otherwise(F.col("__nt"))
    by_tight = F.coalesce((F.col("adjacency") == "tight") & (tights > 0), F.lit(False))
    size = F.when(by_tight, tights).when(by_hint, F.col("__ln")).otherwise(F.col("__n"))
    at = F.floor(_draw(F.col(key).cast("string"), "pattern", seed) * size).cast("int")
    out = out.withColumns({"__h": F.when(by_hint, F.col("language")), "__t": by_tight, "__k": at})
    same = (F.col("target_entity_type") == F.col("__type")) & F.col("__h").eqNullSafe(F.col("__hint")) & (F.col("__t") == F.col("__tight")) & (F.col("__k") == F.col("__at"))
    kept = [c for c in plan.columns if c not in ("target_entity_type", "target_pattern_id")]
    return out.join(numbered, same, "left").select("target_entity_type", *kept, F.col("__id").alias("target_pattern_id"))


#: Pairs of axes whose coverage a plan's report shows. Fixed values.
SPOT_CHECKS = [("language", "domain"), ("language", "format"), ("language", "adjacency"), ("domain", "format"), ("difficulty", "density"), ("length", "density")]


def plan_report(plan: DataFrame, floor: int = 50) -> DataFrame:
    """section, name and n of a plan: distributions, types below the floor, least and most rows of types and patterns, and
    pairs seen and expected over the axes' full domains. Counts are made in one pass over rows; the rest reads counts."""
    axes = ["source", "target_entity_type", "co_occurrence_pattern", "behavioral_frame", "language", "domain", "format", "adjacency"]
    cells = [F.struct(F.lit(a).alias("section"), F.coalesce(F.col(a).cast("string"), F.lit("?")).alias("name")) for a in axes]
    cells += [F.struct(F.lit(f"pair {a} x {b}").alias("section"), F.when(F.col(a).isin(*AXES[a]) & F.col(b).isin(*AXES[b]), F.concat_ws("|", a, b)).alias("name")) for a, b in SPOT_CHECKS]
    counts = plan.select(F.explode(F.array(*cells)).alias("c")).filter("c.name is not null").groupBy("c.section", "c.name").agg(F.count("*").alias("n"))
    dims = counts.filter(~F.col("section").startswith("pair "))
    spark = plan.sparkSession
    every = spark.createDataFrame([("target_entity_type", t) for t in consts.TIERS] + [("co_occurrence_pattern", f"CO-{i:03d}") for i in range(1, 16)], "section string, name string")
    filled = every.join(counts, ["section", "name"], "left").select("section", "name", F.coalesce("n", F.lit(0)).alias("n"))
    below = filled.filter((F.col("section") == "target_entity_type") & (F.col("n") < floor)).select(F.lit("below_floor").alias("section"), "name", "n")
    least = filled.groupBy("section").agg(F.min("n").alias("a"), F.max("n").alias("b")).select("section", F.explode(F.array(F.struct(F.lit("least").alias("k"), F.col("a").alias("n")), F.struct(F.lit("most").alias("k"), F.col("b").alias("n")))).alias("x")).select(F.concat("section", F.lit(" range")).alias("section"), F.col("x.k").alias("name"), F.col("x.n").alias("n"))
    seen = counts.filter(F.col("section").startswith("pair ")).groupBy("section").agg(F.count("*").alias("n")).select("section", F.lit("observed").alias("name"), "n")
    expected = spark.createDataFrame([(f"pair {a} x {b}", "expected", len(AXES[a]) * len(AXES[b])) for a, b in SPOT_CHECKS], "section string, name string, n long")
    return dims.unionByName(below).unionByName(least).unionByName(seen).unionByName(expected)


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """stat, name and n of a catalog (pattern_id, entity_type, entity_category, dimensions, language_hint, declared): patterns
    by type, category, dimension and language, ids that occur more than once, and types whose declared count isn't theirs."""
    one = lambda stat, value: F.struct(F.lit(stat).alias("stat"), value.cast("string").alias("name"))
    dims = F.transform(F.coalesce("dimensions", F.expr("cast(array() as array<string>)")), lambda d: one("dimension", d))
    cells = F.concat(F.array(one("entity_type", F.col("entity_type")), one("category", F.col("entity_category")), one("language", F.nullif("language_hint", F.lit(""))), one("duplicate_id", F.col("pattern_id"))), dims)
    counts = catalog.select(F.explode(cells).alias("c")).filter("c.name is not null").groupBy("c.stat", "c.name").agg(F.count("*").alias("n"))
    wrong = catalog.groupBy("entity_type").agg(F.count("*").alias("n"), F.max("declared").alias("declared")).filter("declared <> n").select(F.lit("declared_mismatch").alias("stat"), F.col("entity_type").alias("name"), "n")
    return counts.filter("stat <> 'duplicate_id' or n > 1").unionByName(wrong)
