"""MinHash near-duplicates by a multi-index Hamming join.

Each document's set of 5-word shingles gets a MinHash signature of ``CHUNKS`` chunks of ``WIDTH``
positions. By pigeonhole, two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` places
have a chunk with at most one error; every chunk is indexed under each choice of the one position
left out, so all pairs up to that distance (17 of 45) meet in a bucket. Pairs beyond it meet with
high chance too: at a similarity of exactly 0.85 a pair is missed with probability 9e-8. Candidates
are confirmed on the full shingle sets (64-bit fingerprints of the shingles).

Groups never expand into all their pairs. Equal sets are one node, numbered when the nodes are staged.
Joins on bucket keys and hubs deal hot keys over several tasks (``components.split_join``). A bucket of more than ``HOT``
nodes is joined as a star around its most central node, its hub. Nodes that the star leaves in other
components are compared by their differences from the hub (see ``apart``): these are short, and two
nodes can only be linked where they overlap. The bounds are exact, so no link between different texts
is lost: a pair is skipped only where it can't be a link or both ends are already in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import SPLIT, components, hot, split_join
from .stage import arrow_map, stage, text_or_empty, unstage, whole_row

SHINGLE = 5
PERCENT = 85
CHUNKS, WIDTH, ERRORS = 9, 5, 1
#: Signature distance beyond which a candidate isn't confirmed: a pair at 0.85 exceeds it with probability 3e-8.
FAR = 22
#: Larger buckets are joined as stars.
HOT = 64
#: What parts words.
SPACE = " \t\n\x0b\f\r"
#: Distinct words whose hashes a worker remembers in each of two generations.
MEMORY = 200_000

_RNG = np.random.default_rng(20_240_601)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _HASH, _ADD = _ODD(SHINGLE), _ODD(CHUNKS * WIDTH), _ODD(CHUNKS * WIDTH)
_POSITION, _SALT = _ODD(CHUNKS * WIDTH).reshape(CHUNKS, WIDTH), _ODD(CHUNKS * WIDTH).reshape(CHUNKS, WIDTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets and signatures; remembers word hashes."""

    def __init__(self) -> None:
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        value = self.old.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word)
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[word] = value
        return value

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit fingerprints of a text's shingles; empty without words."""
        words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII space only
        if not words:
            return np.empty(0, np.uint64)
        get, miss = self.young.get, self._word
        ids = np.fromiter([v if (v := get(w)) is not None else miss(w) for w in words], np.uint64, len(words))
        n = len(ids)
        if n < SHINGLE:
            return _mix(np.atleast_1d((ids * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)))
        total = ids[: n - 4] * _PLACE[0]
        for k in range(1, SHINGLE):
            total += ids[k : n - 4 + k] * _PLACE[k]
        return np.unique(_mix(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(CHUNKS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            low = np.minimum(low, (shingles[at : at + 2048, None] * _HASH + _ADD).min(axis=0))
        return low

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """Bucket keys: each chunk with each of its positions left out."""
        parts = _mix(signature).reshape(CHUNKS, WIDTH) * _POSITION
        return _mix(parts.sum(axis=1, dtype=np.uint64)[:, None] - parts + _SALT).ravel()


def _hashes() -> list[Column]:
    """h1 and h2: a 128-bit hash of doc_id and text (columns of these names, text not null). Rows alike in both are repeated rows."""
    return [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def signatures(rows: DataFrame) -> DataFrame:
    """h1, h2, doc_id, n_shingles, sid (digest of the set; null without words), keys and sig of (h1, h2, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sizes, sids, keys, sigs = [], [], [], []
            for value in batch.column(3):
                own = shingler.shingles(value.as_py())
                sizes.append(len(own))
                sids.append(_digest(own))
                signature = shingler.signature(own) if len(own) else None
                keys.append(shingler.keys(signature).view(np.int64) if len(own) else None)
                sigs.append(_mix(signature).astype(np.uint16).tobytes() if len(own) else None)
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["h1", "h2", "doc_id", "n_shingles", "sid", "keys", "sig"])

    return arrow_map(rows.select("h1", "h2", "doc_id", "text"), run, "h1 long, h2 long, doc_id long, n_shingles long, sid binary, keys array<long>, sig binary")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node and shingles (array<long>, distinct) of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(v.as_py()).view(np.int64) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return arrow_map(rows.select("node", "text"), run, "node long, shingles array<long>")


def _enough(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar enough."""
    pairs = stage(pairs, "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = split_join(split_join(pairs, left, "a", hot(pairs, "a")), right, "b", hot(pairs, "b"))
    return joined.filter(_enough(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def distance(a: Column, b: Column) -> Column:
    """Differing positions of two signatures (hex, four digits a position)."""
    places = F.sequence(F.lit(1), F.lit(4 * CHUNKS * WIDTH - 3), F.lit(4))
    return F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(4)) != F.substring(b, i, F.lit(4))))


def links(rows: DataFrame, nodes: DataFrame, percent: int = PERCENT, crowded: int = HOT) -> DataFrame:
    """The components (node, root) that confirmed links give the nodes (node, h1, h2, keys, sig, size). ``rows`` has h1, h2 and text."""
    ratio = F.lit(percent)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    buckets = stage(split_join(keyed, shared, "key", shared.filter(F.col("members") > SPLIT).select("key", F.col("members").alias("n"))), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    facts = stage(wanted.select("node", "size", "h1", "h2", F.hex("sig").alias("sig")), "facts")
    texts = rows.select("h1", "h2", "text").join(facts.select("h1", "h2", "node"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])  # repeated rows give one set
    sets = stage(shingle_sets(texts), "sets")
    unstage(shared)

    def side(name: str) -> DataFrame:
        return facts.select(F.col("node").alias(name), F.col("size").alias(f"n{name}"), F.col("sig").alias(f"s{name}"))

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_enough(F.least("na", "nb"), F.col("na"), F.col("nb"), percent))
        return both.filter(distance(F.col("sa"), F.col("sb")) <= FAR).select("a", "b")

    # small buckets: all pairs, at most ``crowded`` for each node
    small = buckets.filter(F.col("members") <= crowded).select("key", "node")
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    # large ones: shingles that no other member of a large bucket has can't be shared there
    big = buckets.filter(F.col("members") > crowded).select("key", "node", "members")
    crowd = big.select("node").distinct()
    alone = sets.join(crowd, "node", "left_semi").select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    crowd = stage(facts.join(crowd, "node", "left_semi").join(alone, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own")), "crowd")
    big = stage(big.join(crowd, "node"), "big")
    able = F.col("size") - F.col("own")  # shingles that may be shared
    hubs = big.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("size")).alias("part"), F.col("node").alias("hub"))).alias("x"), F.min("size").alias("least"), F.max("members").alias("n")).select("key", "x.hub", "x.part", "least", "n")
    hubs = stage(hubs, "hubs")
    heavy = hubs.filter(F.col("n") > SPLIT).select("key", "n")
    stars = split_join(big, hubs.select("key", "hub"), "key", heavy).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = stage(confirm(near(pairs.union(stars).distinct()), sets, percent), "links")
    found = components(first)
    if not hubs.take(1):
        unstage(buckets, facts, sets, crowd, big, hubs, first)
        return found
    # what the stars left: members in other components of the bucket that could still have a partner there
    # buckets whose hubs are in one component share the most central of these
    middle = hubs.join(found.withColumnRenamed("node", "hub"), "hub", "left").withColumn("root", F.coalesce("root", "hub"))
    centres = middle.groupBy("root").agg(F.min(F.struct("part", "hub")).alias("x")).select("root", F.col("x.hub").alias("centre"))
    centred = stage(middle.join(centres, "root").select("key", F.col("centre").alias("hub"), "least"), "centred")
    placed = split_join(big, centred, "key", heavy).filter("node <> hub").filter(able * 100 >= (F.col("size") + F.greatest(F.col("least"), able) - able) * ratio)
    rest = apart(placed.select("hub", "node", "size").distinct(), found, sets, percent)
    more = stage(confirm(near(rest), sets, percent), "links")
    if more.take(1):
        found = components(more.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    unstage(buckets, facts, sets, crowd, big, hubs, centred, first, more)
    return found


def apart(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (hub, node, size) of one hub that lie in different components and may yet be links.

    With D(x) the symmetric difference of x and the hub, that of a and b has |D(a)| + |D(b)| - 2 o
    elements, o being the overlap of D(a) and D(b). A link needs it to be at most
    (|a| + |b|) (100 - percent) / (100 + percent), so it needs a least overlap, which is at least 1 as both
    are links of the hub otherwise (those links are given too). Members that can't reach it with any member of another
    component go; the others are joined on the rarest elements of their D, as many as a prefix filter takes.
    """
    roots = found.select("node", "root")
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("middle")), "hub", "left").withColumn("middle", F.coalesce("middle", "hub"))
    mixed = placed.filter("root <> middle").select("hub").distinct()
    own = sets.select("node", F.col("shingles").alias("sr"))
    hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sh"))
    differing = F.concat(F.array_except("sh", "sr"), F.array_except("sr", "sh"))
    linked = F.size("differ") * (100 + percent) <= (F.size("sh") + F.col("size")) * (100 - percent)
    placed = stage(placed.join(mixed, "hub", "left_semi"), "placed")
    told = split_join(placed.join(own, "node"), hub, "hub", hot(placed, "hub")).withColumn("differ", differing).withColumn("link", linked)
    told = told.select("hub", "node", "size", F.when(F.col("link"), F.col("middle")).otherwise(F.col("root")).alias("root"), ((F.col("root") == F.col("middle")) | F.col("link")).alias("inside"), (F.col("link") & (F.col("root") != F.col("middle"))).alias("new"), "differ")
    told = stage(told, "apart")
    each = told.select("hub", "node", F.explode("differ").alias("s"))
    common = each.groupBy("hub", "s").agg(F.count("*").alias("n")).filter("n > 1")
    each = stage(each.join(common, ["hub", "s"]), "differ")  # an element of one member's alone adds to no overlap
    facts = told.select("hub", "node", "size", "root", "inside", F.size("differ").alias("d")).join(each.groupBy("hub", "node").agg(F.count("*").alias("e")), ["hub", "node"])
    limit = (F.col("size") + F.least(F.col("most"), F.col("size") * 100 / percent)) * (100 - percent) / (100 + percent)
    need = lambda other: F.greatest(F.lit(1), F.ceil((F.col("d") + other - limit) / 2 - 1e-9))
    groups = told.groupBy("hub").agg(F.min(F.when(~F.col("inside"), F.size("differ"))).alias("out"), F.max("size").alias("most"))
    facts = stage(facts.join(groups, "hub"), "facts")
    inner = facts.filter("inside").withColumn("need", need(F.col("out"))).filter("e >= need")
    nearest = inner.groupBy("hub").agg(F.min("d").alias("in"))
    outer = facts.filter("not inside").join(nearest, "hub", "left").withColumn("need", need(F.least("out", "in"))).filter("e >= need").drop("in")
    able = inner.unionByName(outer).select("hub", "node", "root", "size", "d", "e", (F.col("e") - F.col("need") + 1).alias("take"))
    order = Window.partitionBy("hub", "node").orderBy("n", "s")
    prefix = stage(each.join(able, ["hub", "node"]).withColumn("k", F.row_number().over(order)).filter("k <= take").select("hub", "s", "node", "root", "size", "d", "e"), "prefix")
    left, right = (prefix.select("hub", "s", F.col("node").alias(n), *[F.col(c).alias(c + n) for c in ("root", "size", "d", "e")]) for n in ("a", "b"))
    overlap = (F.col("da") + F.col("db") - (F.col("sizea") + F.col("sizeb")) * (100 - percent) / (100 + percent)) / 2 - 1e-9  # the least that this pair needs
    pairs = left.join(right, ["hub", "s"]).filter((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & (overlap <= F.least("ea", "eb"))).select("a", "b")
    return pairs.union(told.filter("new").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))).distinct()


def _grouped(rows: DataFrame, percent: int, crowded: int) -> DataFrame:
    """h1, h2, doc_id, n_shingles, group (a number; null without words) and component_id of each row of (h1, h2, doc_id, text)."""
    signed = stage(signatures(rows), "signed")
    sets = signed.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("h1", "h2")).alias("at"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    # the numbers are fixed once the table is written
    nodes = stage(sets.select(F.monotonically_increasing_id().alias("node"), "sid", "least", "at.h1", "at.h2", "keys", "sig", "size"), "nodes")
    found = links(rows, nodes, percent, crowded)
    members = found.union(found.select(F.col("root").alias("node"), "root")).distinct()
    named = members.join(nodes.select("node", "least"), "node")
    labels = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = members.join(labels, "root")
    placed = nodes.select("sid", "node", "least").join(placed, "node", "left").select("sid", F.coalesce("root", "node").alias("group"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return signed.select("h1", "h2", "doc_id", "n_shingles", "sid").join(placed, "sid", "left").drop("sid")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Texts without words (null or empty too) link with nothing and are their own component. Equal texts
    link through their equal sets; very long texts are taken whole. Rows that share a doc_id link by
    their texts like any others. A row without doc_id takes part; its component is the smallest doc_id
    reachable, and it is kept only where there is none (component null). Only doc_id and text are
    read; an empty table gives none.
    """
    out = _grouped(docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", *_hashes()), percent, hot)
    component = F.coalesce("component_id", F.when(F.col("group").isNull(), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def representatives(docs: DataFrame, percent: int = PERCENT, crowded: int = HOT) -> DataFrame:
    """One row of each near-duplicate group, all columns unchanged: that of the smallest doc_id (rows without one come last), then of the smallest text hash.

    Rows go only for their texts: different texts under one doc_id stay, and repeated rows are one.
    Texts without words stay, each row of them.
    """
    held = docs.select(whole_row(docs), "doc_id", text_or_empty().alias("text")).select("row", "doc_id", "text", *_hashes())
    found = _grouped(held.select("h1", "h2", "doc_id", "text"), percent, crowded).filter("group is not null")
    chosen = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h1", "h2")).alias("x")).select("x.h1", "x.h2")
    worded = F.trim("text", F.lit(SPACE)) != ""
    kept = held.filter(worded).select("row", "h1", "h2").join(chosen, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return kept.select("row.*").unionByName(held.filter(~worded).select("row.*"))
