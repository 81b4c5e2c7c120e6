"""A uniform shuffle into shards of exact sizes, in DataFrame and SQL functions alone.

Rows fall into a fixed number of logical partitions by a hash of their content. From the partitions'
row counts a communication matrix is drawn: how many rows of each partition go to each shard, which
under a uniform shuffle is multivariate hypergeometric with the shard sizes as column sums. Rows are
permuted within their partition, dealt to shards by the matrix's running sums, and permuted again
within their shard. Only counts, at most ``PARTITIONS`` x shards of them, reach the driver. Both
permutations order by a seeded hash and are cut into hash ranges, so no task sorts a whole partition
or shard: a row's place is its range's offset plus its place in the range.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage, text_or_empty

SHARDS = 40
PARTITIONS = 64
#: Hash ranges that a partition or shard is cut into; more rows call for more, at most this many.
RANGES = 4096
ROWS_PER_RANGE = 20_000
SEED = 20_240_601


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _log_fact(n: np.ndarray) -> np.ndarray:
    """log n!: summed where n is small, Stirling's series above."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 16.0) + 1.0
    series = (m - 0.5) * np.log(m) - m + 0.5 * np.log(2 * np.pi) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 17)))])
    return np.where(n <= 16, table[np.minimum(n, 16).astype(np.int64)], series)


def hypergeometric(good: int, rest: int, drawn: int, rng: np.random.Generator) -> int:
    """Number of good ones among ``drawn`` of ``good + rest``, by inversion over all values that matter in double precision."""
    low, high = max(0, drawn - rest), min(good, drawn)
    if low == high:
        return low
    mean = drawn * good / (good + rest)
    spread = 40 + 14 * np.sqrt(max(mean * (1 - good / (good + rest)), 0.0))
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.int64)
    weight = -(_log_fact(k) + _log_fact(good - k) + _log_fact(drawn - k) + _log_fact(rest - drawn + k))
    weight = np.exp(weight - weight.max())
    run = np.cumsum(weight)
    return int(k[min(np.searchsorted(run, rng.random() * run[-1], side="right"), len(k) - 1)])


def communication(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition (row sums ``counts``) to each shard (column sums ``sizes``)."""
    rng = np.random.default_rng(seed)
    left, total, matrix = list(sizes), sum(sizes), []
    for count in counts:
        row, need, pool = [], count, total
        for room in left:
            got = hypergeometric(room, pool - room, need, rng)
            row.append(got)
            need, pool = need - got, pool - room
        matrix.append(row)
        left, total = [a - b for a, b in zip(left, row, strict=True)], total - count
    return matrix


def _unit(*cols: Column) -> Column:
    """A hash as a non-negative long below 2^62."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))


def _places(rows: DataFrame, group: str, order: str, ranges: int, name: str) -> DataFrame:
    """``rows`` with the 0-based place of each in its group by ``order`` (a hash below 2^62).

    Counts of the hash ranges are summed to offsets; at most groups x ``ranges`` of them exist, so
    their broadcast has a fixed bound.
    """
    width = (1 << 62) // ranges + 1
    rows = rows.withColumn("__range", F.expr(f"`{order}` div {width}").cast("int"))
    counts = rows.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select(F.col(group), F.col("__range"), before.alias("__before")))
    own = F.row_number().over(Window.partitionBy(group, "__range").orderBy(order, "doc_id", "text_crc32"))
    return rows.withColumn("__own", own).join(offsets, [group, "__range"]).withColumn(name, (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__range", "__own", "__before")


def shuffle(docs: DataFrame, shards: int = SHARDS, partitions: int = PARTITIONS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row.

    Counts of the shards differ by at most one; slots run from 0 without gaps. A null text has no
    bytes (size 16, crc 0); null doc_ids and repeated rows are dealt like any others; an empty table
    gives none. Other columns are dropped.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), text).alias("__h"))
    rows = stage(rows.withColumn("__part", F.pmod("__h", F.lit(partitions)).cast("int")), "shuffle")
    found = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # a number for each logical partition
    counts = [found.get(p, 0) for p in range(partitions)]
    total = sum(counts)
    ranges = lambda groups: int(min(RANGES, max(1, -(-total // (groups * ROWS_PER_RANGE)))))
    matrix = communication(counts, shard_sizes(total, shards), seed)
    upto = [[int(x) for x in np.cumsum(row)] for row in matrix]
    bounds = F.from_json(F.lit(json.dumps(upto)), "array<array<bigint>>")  # a constant of fixed size
    placed = _places(rows.withColumn("__first", _unit(F.lit(1), "__h")), "__part", "__first", ranges(partitions), "__rank")
    shard = F.size(F.filter(F.get(bounds, F.col("__part")), lambda x: x <= F.col("__rank")))
    dealt = stage(placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), _unit(F.lit(2), "__h", "__rank").alias("__second")), "dealt")
    return _places(dealt, "shard", "__second", ranges(shards), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
