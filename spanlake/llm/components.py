"""Connected components by alternating large-star and small-star steps, edges staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import stage, unstage

#: Rows of one key that a task joins; keys with more are dealt over several tasks.
SPLIT = 2048
#: Such keys that are broadcast (16 bytes each); beyond, hot partitions are left to Spark, which splits them at run time.
HEAVY = 200_000


def split_join(rows: DataFrame, keyed: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Inner join of ``rows``, in which a key may be hot, with ``keyed``, in which it is unique. ``heavy`` (key, n) has the keys of more than ``SPLIT`` rows."""
    heavy = stage(heavy.select(key, F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "heavy")
    found = heavy.count()
    if not found or found > HEAVY:
        return rows.join(keyed, key)
    few = F.broadcast(heavy)
    dealt = rows.withColumn("part", F.xxhash64(*rows.columns)).join(few, key, "left").withColumn("part", F.pmod("part", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = keyed.join(few, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def hot(rows: DataFrame, key: str) -> DataFrame:
    """key and n of the keys of more than ``SPLIT`` rows, counted within partitions first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest, to see whether a round changed anything."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long, not null) but the roots themselves; root is the smallest node reachable."""
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.filter("v > u")
        large = stage(split_join(above, least, "u", hot(above, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u", hot(large, "u")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, stage(small, "edges")
        unstage(before, large)
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
