"""Similarity joins and pairwise text measures: cosine, token sets, ROUGE-L, self-BLEU and Vendi."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from spanlake.functions import grams as G
from spanlake.functions import text as T

#: Rows of a block in the blocked cosine join: a block is one row of a few hundred kilobytes.
BLOCK = 512
#: Most pivots of the cosine join: a bounded model of the space.
PIVOTS = 4096
#: Jaccard percent from which sets meet by parts: below it a part has less than four tokens.
PARTS_FROM = 80
#: Keys up to this number are broadcast (8 bytes each).
FEW_KEYS = 500_000


def _unit(vectors: DataFrame, key: str, column: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.filter(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform(F.col(column), lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0))).alias("u"))


def pivots(vectors: DataFrame, key: str, column: str, count: int) -> np.ndarray:
    """Unit vectors of the ``count`` rows of smallest hashed key: a bounded model of the space, which only steers the join."""
    rows = _unit(vectors, key, column).orderBy(F.xxhash64("id"), "id").limit(count).collect()
    return np.array([r.u for r in rows], dtype=np.float64)


def _matrix(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a block."""
    ids = np.array(block.field("id").to_pylist()) if pa.types.is_string(block.field("id").type) else block.field("id").to_numpy(zero_copy_only=False)
    return ids, block.field("u").flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding", n_pivots: int | None = None) -> DataFrame:
    """All pairs i < j of cosine above ``threshold``: i, j and cosine. Exact.

    Each vector has its home in the cell of its nearest pivot. By the triangle inequality of angles, a partner within
    angle t of x can have its home only in cells whose pivot is at most 2t farther from x than x's own; x visits just
    these, and only those after its own home, as its partner there comes to the later of both. Homes and visitors of a cell are packed into blocks, and blocks meet by an equi-join on the cell, so a large
    cell is spread over many tasks. Null vectors are left out; zero vectors have cosine 0.
    """
    spark = vectors.sparkSession
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    # beyond a right angle hardly any cell is out of reach, so more cells would only mean more visits
    centres = pivots(vectors, key, column, n_pivots or (16 if reach > math.pi / 2 else min(PIVOTS, max(16, math.isqrt(vectors.count())))))
    if not len(centres):
        return spark.createDataFrame([], f"i {vectors.schema[key].dataType.simpleString()}, j {vectors.schema[key].dataType.simpleString()}, cosine double")
    id_type = vectors.schema[key].dataType.simpleString()

    def place(frames):
        for pdf in frames:
            yield from map(placed_rows, (pdf.iloc[k : k + 1024] for k in range(0, len(pdf), 1024)))

    def placed_rows(pdf):
        x = np.array(pdf["u"].tolist(), dtype=np.float64)
        angle = np.arccos(np.clip(x @ centres.T, -1.0, 1.0))
        home = angle.argmin(axis=1)
        near = angle - angle[np.arange(len(x)), home][:, None] <= reach
        rows, cells = np.nonzero(near & (np.arange(len(centres)) >= home[:, None]))
        return pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "u": [pdf["u"].iloc[r] for r in rows], "cell": cells.astype(np.int32), "home": cells == home[rows]})

    placed = _unit(vectors, key, column).mapInPandas(place, f"id {id_type}, u array<double>, cell int, home boolean")
    sizes = placed.groupBy("cell", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    salted = placed.join(sizes, ["cell", "home"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = salted.groupBy("cell", "home", "block").agg(F.collect_list(F.struct("id", "u")).alias("m"))  # about BLOCK rows each
    homes = packed.filter("home").select("cell", F.col("m").alias("a"))
    visits = packed.select("cell", F.col("m").alias("b"))

    kinds = pa.schema([("i", to_arrow_type(vectors.schema[key].dataType)), ("j", to_arrow_type(vectors.schema[key].dataType)), ("cosine", pa.float64())])

    def multiply(batches):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):  # views of the batch: one pair of blocks is worked on at a time
                (ia, ua), (ib, ub) = _matrix(a.values), _matrix(b.values)
                cos = ua @ ub.T
                p, q = np.nonzero((cos > threshold) & (ia[:, None] != ib[None, :]))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia[p], ib[q]), kinds[0].type), pa.array(np.maximum(ia[p], ib[q]), kinds[1].type), pa.array(cos[p, q])], schema=kinds)

    met = homes.join(visits, "cell").select("a", "b").mapInArrow(multiply, f"i {id_type}, j {id_type}, cosine double")
    return met.groupBy("i", "j").agg(F.max("cosine").alias("cosine"))


def _kept_apart(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the folder of spark.checkpoint.dir; without one, on the executors' disks."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.localCheckpoint()


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    """The distinct keys of a table of pairs, as ``name``; broadcast if they are few."""
    one, two = pairs.columns
    keys = _kept_apart(pairs.select(F.col(one).alias(name)).union(pairs.select(F.col(two).alias(name))).distinct())
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one big-integer step for each element of ``b``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_between(x: np.ndarray, y: np.ndarray) -> int:
    """The same of arrays: what both begin and end with is counted without steps."""
    n = min(len(x), len(y))
    head = int(np.argmax(np.append(x[:n] != y[:n], True)))
    n -= head
    tail = int(np.argmax(np.append(x[len(x) - n :][::-1] != y[len(y) - n :][::-1], True)))
    return head + tail + _lcs(x[head : len(x) - tail].tolist(), y[head : len(y) - tail].tolist())


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays."""
    return pd.Series([_lcs_between(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b)])


def rouge_l(a: Column, b: Column) -> Column:
    """ROUGE-L F1 of two token arrays; 0 where either is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(2 * lcs_length(a, b) / total)


def rouge_pairs(pairs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """i, j and rouge_l of the given pairs of documents.

    Only the texts of pairs are read, once, and the measure is computed once for each two different sequences of words, however
    many copies of them meet. Words are 64-bit hashes, sequences two of them.
    """
    pairs = _kept_apart(pairs.select("i", "j"))
    hashed = F.transform(T.tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)).alias("w")
    met = docs.select(F.col(key).alias("k"), F.col(text)).join(_ends(pairs, "k"), "k", "left_semi")
    digest = F.struct(F.xxhash64(F.lit(0), "w").alias("h0"), F.xxhash64(F.lit(1), "w").alias("h1"), F.size("w").alias("n"))
    texts = _kept_apart(met.select("k", hashed).select("k", digest.alias("d"), "w"))
    words = _kept_apart(texts.groupBy("d").agg(F.first("w").alias("w")))
    own = texts.select("k", "d")
    both = _kept_apart(pairs.join(own.select(F.col("k").alias("i"), F.col("d").alias("di")), "i").join(own.select(F.col("k").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", F.least("di", "dj").alias("da"), F.greatest("di", "dj").alias("db")))
    unlike = both.filter((F.col("da") != F.col("db")) & (F.col("da")["n"] > 0) & (F.col("db")["n"] > 0)).select("da", "db").distinct()
    side = lambda d, w: words.select(F.col("d").alias(d), F.col("w").alias(w))
    scored = unlike.join(side("da", "wa"), "da").join(side("db", "wb"), "db").select("da", "db", F.round(rouge_l(F.col("wa"), F.col("wb")), 9).alias("rouge_l"))
    like = F.when((F.col("da") == F.col("db")) & (F.col("da")["n"] > 0), 1.0).otherwise(0.0)
    return both.join(scored, ["da", "db"], "left").select("i", "j", F.coalesce("rouge_l", like).alias("rouge_l"))


def mean_rouge(docs: DataFrame, key: str = "doc_id", sample: int = 300) -> DataFrame:
    """Mean ROUGE-L over all pairs of the ``sample`` documents of smallest hashed key: the sample is the operator's feature."""
    own = docs.select(F.col(key).alias("k"), "text").orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(sample)
    ids = own.agg(F.sort_array(F.collect_list("k")).alias("ks"))  # at most ``sample`` keys
    pairs = ids.select("ks", F.explode("ks").alias("i")).select("i", F.explode(F.filter("ks", lambda x: x > F.col("i"))).alias("j"))
    return rouge_pairs(pairs, own.withColumnRenamed("k", key), key).agg(F.round(F.avg("rouge_l"), 6).alias("mean_rouge_l"), F.count("*").alias("n_pairs"))


def _size_classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least sizes of the classes, and into how many parts a class's sets are cut.

    A set's partner of a Jaccard above ``percent`` that is no larger is of its class or the one before. The two differ in
    fewer tokens than the class has parts, so some part is the same in both.
    """
    least = [1]
    while least[-1] < 1 << 31:
        n = max(least[-1] + 1, ((least[-1] - 1) * 100 + percent - 1) // percent)
        least.append(n)
    parts = []
    for n in (x - 1 for x in least[1:]):  # the largest of a class, and its largest partner
        larger = (n * 100 - 1) // percent
        parts.append(((n + larger) * (100 - percent) - 1) // (100 + percent) + 1)
    return np.array(least[:-1], dtype=np.int64), np.array(parts, dtype=np.int64)


def _part_keys(g: np.ndarray, values: np.ndarray, sizes: np.ndarray, cls: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One key for each part of each set, empty ones too. ``values``: the sets' sorted token hashes, end to end; a part is a range of hashes."""
    first = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = ((values.astype(np.float64) / 2.0**64 + 0.5) * parts[owner]).astype(np.int64)
    at = first[owner] + np.minimum(place, parts[owner] - 1)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    held = np.zeros(int(parts.sum()), dtype=np.uint64)
    held[at[starts]] = np.add.reduceat(G.mixed(values.view(np.uint64)), starts)
    of = np.repeat(np.arange(len(sizes)), parts)
    number = (np.arange(len(of)) - first[of]).astype(np.uint64)
    salt = G.mixed(G.mixed(g.view(np.uint64)[of] + cls.astype(np.uint64)[of] * np.uint64(0x9E3779B97F4A7C15)) + number)
    return G.mixed(held + salt).view(np.int64)


def _by_parts(nodes: DataFrame, percent: int) -> DataFrame:
    """a < b of sets of which a part is equal: every pair above ``percent``, and few others.

    A part of some tokens is far rarer than any one token of a prefix, so a larger corpus brings few more chance meetings.
    """
    least, cut = _size_classes(percent)
    kind = nodes.schema["rep"].dataType

    def work(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                rows = batch.slice(k, 256)
                g = rows.column("g").to_numpy()
                sizes, values = np.diff(rows.column("s").offsets.to_numpy()), rows.column("s").flatten().to_numpy()
                home = np.searchsorted(least, sizes, side="right") - 1
                for probe in (0, 1):  # as one of its class, and as one that seeks smaller ones
                    some = np.flatnonzero(home >= probe)
                    cls = home[some] - probe
                    times = cut[cls]
                    keys = _part_keys(g[some], values[np.repeat(home >= probe, sizes)], sizes[some], cls, times)
                    who = np.repeat(some, times)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), rows.column("rep").take(pa.array(who)), pa.array(sizes[who].astype(np.int32)), pa.array(np.full(len(who), bool(probe)))], names=["key", "rep", "n", "probe"])

    keyed = nodes.select("g", "rep", "s").mapInArrow(work, f"key long, rep {kind.simpleString()}, n int, probe boolean")
    met = _kept_apart(keyed.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1").drop("c"))
    left = met.filter("not probe").select("key", F.col("rep").alias("x"), F.col("n").alias("nx"))
    right = met.select("key", F.col("rep").alias("y"), F.col("n").alias("ny"), "probe")
    close = F.least("nx", "ny") * 100 > F.greatest("nx", "ny") * percent
    both = left.join(right, "key").filter((F.col("probe") | (F.col("x") < F.col("y"))) & close)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _by_prefix(nodes: DataFrame, percent: int) -> DataFrame:
    """a < b of sets that share one of their |x| - ceil(|x| percent / 100) + 1 rarest tokens, as all pairs above ``percent`` do."""
    each = nodes.select("g", "rep", F.size("s").alias("n"), F.explode("s").alias("t"))
    rarity = each.groupBy("g", "t").agg(F.count("*").alias("f"))
    order = Window.partitionBy("rep").orderBy("f", "t")
    ranked = each.join(rarity, ["g", "t"]).withColumn("k", F.row_number().over(order))
    prefix = ranked.filter((F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("f") > 1)).select("g", "t", "rep", "n")
    left, right = (prefix.select("g", "t", F.col("rep").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    close = F.least("na", "nb") * 100 > F.greatest("na", "nb") * percent
    return left.join(right, ["g", "t"]).filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def token_set_pairs(docs: DataFrame, keys: list[str], percent: int, key: str = "doc_id") -> DataFrame:
    """i, j, shared and united of all pairs i < j with equal ``keys`` (null-safe) and Jaccard above ``percent`` of their token sets.

    From ``PARTS_FROM`` on, sets meet in an equal part, below it in a rare token; both miss no pair, and what they find is
    confirmed on the sets. Equal sets are one node, and pairs expand from their nodes at the end. Tokens are 64-bit hashes,
    sets two of them; texts are read once.
    """
    group = F.xxhash64(F.to_json(F.struct(*[F.col(k) for k in keys])))
    hashed = F.transform(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    sets = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), group.alias("g"), F.array_sort(F.array_distinct(hashed)).alias("s")).filter(F.size("s") > 0)
    sets = sets.select("id", "g", F.xxhash64(F.lit(0), "s").alias("h0"), F.xxhash64(F.lit(1), "s").alias("h1"), "s")
    nodes = _kept_apart(sets.groupBy("g", "h0", "h1").agg(F.min("id").alias("rep"), F.first("s").alias("s"), F.collect_list("id").alias("ids")).select("g", "rep", "s", "ids"))
    pairs = nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0) if percent >= 100 else (_by_parts if percent >= PARTS_FROM else _by_prefix)(nodes, percent)
    pairs = _kept_apart(pairs)
    own = nodes.select("rep", "g", "s").join(_ends(pairs, "rep"), "rep", "left_semi")  # most sets meet no other
    met = pairs.join(own.select(F.col("rep").alias("a"), F.col("g").alias("ga"), F.col("s").alias("sa")), "a").join(own.select(F.col("rep").alias("b"), F.col("g").alias("gb"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    met = met.filter("ga = gb").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("united")).filter(F.col("shared") * 100 > F.col("united") * percent)
    same = nodes.filter(F.size("ids") > 1).select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.size("s").alias("shared"), F.size("s").alias("united"))
    member = nodes.select("rep", F.explode("ids").alias("id"))
    both = met.unionByName(same if percent < 100 else same.limit(0)).join(member.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    out = both.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "shared", "united")


def drop_later(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Records without those that are the later one (j) of any pair; a dropped record still drops others."""
    return records.join(pairs.select(F.col("j").alias(key)).distinct(), key, "left_anti")


def _later(candidates: DataFrame, records: DataFrame, rouge: float, key: str) -> DataFrame:
    """j: each later record of a candidate pair whose ROUGE-L exceeds ``rouge``. Exact, without the texts of all pairs at once.

    ``rouge`` is 0 or more. One earlier record is enough to drop j, so candidates are tried in rounds of about as many pairs as there are records,
    those of nearest length first, and a j that is found leaves. Pairs whose lengths alone rule the threshold out are
    never tried. Words go as 64-bit hashes.
    """
    words = _kept_apart(records.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.transform(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") > 0))
    size = lambda c: words.select(F.col("k").alias(c), F.size("w").alias(f"n{c}"))
    sized = candidates.join(size("i"), "i").join(size("j"), "j")
    # the longest common subsequence has at most the shorter's words
    able = sized.filter(F.round(2 * F.least("ni", "nj") / (F.col("ni") + F.col("nj")), 9) > rouge)
    near = F.array_sort(F.collect_list(F.struct(F.abs(F.col("ni") - F.col("nj")).alias("d"), "i")))
    todo = _kept_apart(able.groupBy("j").agg(near.alias("c")).select("j", F.transform("c", lambda x: x["i"]).alias("c")))
    each = words.count()
    found = todo.select("j").limit(0)
    while left := todo.count():
        width = max(1, each // left)
        now = todo.select("j", F.explode(F.slice("c", 1, width)).alias("i"))
        both = now.join(words.select(F.col("k").alias("i"), F.col("w").alias("wi")), "i").join(words.select(F.col("k").alias("j"), F.col("w").alias("wj")), "j")
        hits = _kept_apart(both.filter(F.round(rouge_l(F.col("wi"), F.col("wj")), 9) > rouge).select("j").distinct())
        found = found.unionByName(hits)
        rest = todo.filter(F.size("c") > width).join(hits, "j", "left_anti")
        todo = _kept_apart(rest.select("j", F.slice("c", F.lit(width + 1), F.size("c")).alias("c")))
    return found


def similarity_dedup(records: DataFrame, vectors: DataFrame, cosine: float = 0.85, rouge: float = 0.70, key: str = "doc_id", vector_key: str = "vec_id", column: str = "embedding", strata: list[str] | None = None, exempt: Column | None = None) -> DataFrame:
    """Records kept when j goes if an earlier i exceeds both thresholds; ROUGE-L is computed for the cosine pairs only.

    With ``strata`` only pairs of equal (null-safe) values there count; rows for which ``exempt`` holds neither go nor drop others.
    """
    candidates = cosine_pairs(vectors, cosine, vector_key, column).select("i", "j")
    if strata or exempt is not None:
        group = F.to_json(F.struct(*[F.col(c) for c in strata or []])) if strata else F.lit("")
        own = records.filter(~F.coalesce(exempt, F.lit(False))) if exempt is not None else records
        side = lambda c: own.select(F.col(key).alias(c), group.alias(f"g{c}"))
        candidates = candidates.join(side("i"), "i").join(side("j"), "j").filter("gi = gj").select("i", "j")
    return drop_later(records, _later(candidates, records, rouge, key), key)


def _clipped_hits(words: DataFrame, order: int) -> DataFrame:
    """len and ``1_hit`` .. of each row of a column of hashed words: its n-grams, clipped to the most any other row has.

    Grams go by buckets of their hashes, packed chunk by chunk; a task adds up what its buckets give for each chunk's rows.
    """

    def pack(batches):
        for k, (sizes, (hashes,)) in enumerate(G.chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) + k
            made = [(-1 - chunk, 0, sizes.astype(np.int32).tobytes(), None, None), *G.counted(sizes, hashes, order)]
            for i in range(0, len(made), 1024):
                bucket, n, g, doc, c = zip(*made[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int32()), pa.array([chunk] * len(n), pa.int64()), pa.array([len(sizes)] * len(n), pa.int32()), pa.array(g, pa.binary()), pa.array(doc, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "n", "chunk", "docs", "g", "doc", "c"])

    def meet(batches):
        base, docs = {}, 0  # chunks' first rows
        hits = np.zeros((order, 0), dtype=np.int64)
        held, own = [], None

        def flush():
            if held:
                g, who, c = (np.concatenate(x) for x in zip(*held))
                at, hit = G.clipped(g, c)
                hits[own[1] - 1, :docs] += np.bincount(who[at], weights=hit, minlength=docs).astype(np.int64)
                held.clear()

        def row(chunk, data):
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data.dtype.itemsize], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "width", "data"])

        for batch in batches:
            for bucket, n, chunk, size, g, doc, c in zip(*(x.to_pylist() for x in batch.columns)):
                if not n:
                    yield row(chunk, np.append(0, np.frombuffer(g, dtype=np.int32)).astype(np.int64))  # lengths, after a mark
                    continue
                if own != (bucket, n):
                    flush()
                    own = bucket, n
                if chunk not in base:
                    base[chunk], docs = (docs, size), docs + size
                    if docs > hits.shape[1]:
                        hits = np.pad(hits, ((0, 0), (0, 2 * docs - hits.shape[1])))
                held.append((G.from_low_bytes(g, 6), base[chunk][0] + G.from_gaps(doc), np.diff(G.from_gaps(c), prepend=0) + 1))
        flush()
        for chunk, (first, size) in base.items():
            own_hits = np.append(1, hits[:, first : first + size].ravel())
            yield row(chunk, own_hits.astype(np.min_scalar_type(int(own_hits.max()))))

    def add(table):
        hit, sizes = 0, None
        for width, data in zip(table.column("width").to_pylist(), table.column("data").to_pylist()):
            x = np.frombuffer(data, dtype=f"u{width}").astype(np.int64)
            if x[0]:
                hit = hit + x[1:]
            else:
                sizes = x[1:]
        hit = (np.zeros(order * len(sizes), dtype=np.int64) + hit).reshape(order, -1)
        return pa.table([pa.array(sizes), *map(pa.array, hit)], names=["len", *(f"{n}_hit" for n in range(1, order + 1))])

    packed = words.mapInArrow(pack, "bucket long, n int, chunk long, docs int, g binary, doc binary, c binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(meet, "chunk long, width int, data binary")
    return met.groupBy("chunk").applyInArrow(add, "len long, " + ", ".join(f"{n}_hit long" for n in range(1, order + 1)))


def self_bleu(docs: DataFrame, order: int = 4, key: str = "doc_id") -> DataFrame:
    """Mean BLEU of each document against all others: self_bleu and n_docs.

    The references' clipped count of an n-gram is the most any other document has, so the two highest counts of each
    n-gram serve all documents: no pairs are made. Grams are 60-bit hashes, counted within their document. Zero
    counts are smoothed to 0.1; without a common word the score is 0; the brevity penalty takes the closest reference
    length, the shorter of ties.
    """
    words = docs.select(F.transform(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("w"))
    sizes = _kept_apart(_clipped_hits(words, order))
    lengths = sizes.groupBy("len").agg(F.count("*").alias("docs"))  # distinct lengths, few
    run = Window.orderBy("len")
    near = lengths.withColumn("below", F.lag("len").over(run)).withColumn("above", F.lead("len").over(run))
    closest = F.when(F.col("docs") > 1, F.col("len")).when(F.col("above").isNull() | (F.col("len") - F.col("below") <= F.col("above") - F.col("len")), F.col("below")).otherwise(F.col("above"))
    joined = sizes.join(near.select("len", closest.alias("ref")), "len")
    hit = lambda n: F.col(f"{n}_hit")
    whole = lambda n: F.greatest(F.col("len") - (n - 1), F.lit(1))
    logs = sum((F.log(F.when(hit(n) > 0, hit(n).cast("double")).otherwise(F.lit(0.1)) / whole(n)) for n in range(1, order + 1)), F.lit(0.0)) / order
    penalty = F.when(F.col("len") > F.coalesce("ref", F.lit(0)), 0.0).otherwise(1 - F.col("ref") / F.col("len"))
    score = F.when((F.col("len") == 0) | (hit(1) == 0), 0.0).otherwise(F.exp(logs + penalty))
    return joined.agg(F.round(F.avg(score), 6).alias("self_bleu"), F.count("*").alias("n_docs"))


def vendi(vectors: DataFrame, column: str = "embedding", dimensions: int = 64) -> DataFrame:
    """exp of the entropy of the eigenvalues of the cosine kernel over n.

    The d x d Gram matrix has the same non-zero eigenvalues as the n x n kernel; it is summed map-side, and only its
    d * d values reach the driver. The n - d others are the clip of 1e-12.
    """

    def gram(frames):
        total, n = np.zeros((dimensions, dimensions)), 0
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["u"].tolist(), dtype=np.float64)
                total += x.T @ x
                n += len(x)
        yield pd.DataFrame({"cell": np.arange(dimensions**2 + 1), "value": np.append(total.ravel(), n)})

    unit = _unit(vectors.withColumn("__k", F.lit(0)), "__k", column).select("u")
    cells = unit.mapInPandas(gram, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(dimensions**2 + 1)
    for r in cells:
        flat[r.cell] = r.value
    n = int(flat[-1])
    if not n:
        return vectors.sparkSession.createDataFrame([(0.0, 0)], "vendi double, n_vectors long")
    own = np.clip(np.linalg.eigvalsh(flat[:-1].reshape(dimensions, dimensions) / n), 1e-12, None)
    if n < dimensions:
        own = np.sort(own)[::-1][:n]
    rest = max(n - dimensions, 0)
    total = own.sum() + rest * 1e-12
    p, q = own / total, 1e-12 / total
    value = math.exp(-(p * np.log(p)).sum() - rest * q * math.log(q))
    return vectors.sparkSession.createDataFrame([(round(value, 6), n)], "vendi double, n_vectors long")
