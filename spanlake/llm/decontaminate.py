"""Benchmark decontamination with one Aho-Corasick automaton over normalised text.

Texts are lower-cased (A-Z), every ASCII byte that is neither a letter nor a digit becomes a space,
and words are joined by single spaces. The benchmark's word windows, framed by spaces, are the
automaton's patterns; a text is scanned once and every occurrence is mapped back to words and, for
``spans``, to code points of the original.

The patterns are the stated query set. Their size is measured before anything is sent: they are dealt
into blocks of about ``max_chars`` characters, one automaton each (one block unless the benchmark
exceeds that), and the driver holds one block at a time. A block's findings are a small staged
table; texts are never rewritten.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stage import arrow_map, own_columns, stage, text_or_empty, unstage, whole_row

WINDOW = 10
#: Characters of patterns in one automaton; about 60 bytes of memory each.
MAX_CHARS = 4_000_000
#: Word bytes are digits, letters and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (pattern, item_id): each run of ``window`` words of an item, or the whole of a shorter one. Items without words or with null text have none."""
    words = F.filter(F.split(F.regexp_replace(F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), " "), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        own_columns(benchmark, "item_id", "text")
        .select("item_id", words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(window)), " "))).alias("pattern"))
        .distinct()
    )


def _patterns(benchmark: DataFrame, window: int, max_chars: int) -> tuple[DataFrame, int]:
    """The staged patterns (block, pattern, items), dealt by their hash, and the number of blocks."""
    grouped = windows(benchmark, window).groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    grouped = stage(grouped, "patterns")
    size = grouped.agg(F.sum(F.octet_length("pattern") + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-size // max_chars))
    return grouped.select(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block"), "pattern", "items"), blocks


def _block(patterns: DataFrame, block: int) -> list[tuple[bytes, tuple]]:
    """One block's patterns with their items, for the broadcast."""
    return [(r.pattern.encode(), tuple(r.items)) for r in patterns.filter(F.col("block") == block).collect()]


@functools.lru_cache(maxsize=1)
def _automaton(held: object) -> tuple:
    """The automaton of one broadcast block, built once in each worker: value = (pattern number, words)."""
    automaton = ahocorasick.Automaton()
    for k, (pattern, _) in enumerate(held.value):
        automaton.add_word(" " + pattern.decode("latin-1") + " ", (k, pattern.count(b" ") + 1))
    automaton.make_automaton()
    return automaton, [items for _, items in held.value]


def _found(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged runs of hit words as (first, end), and the numbers of the patterns that occur."""
    line = " " + b" ".join(words).decode("latin-1") + " "
    runs: list[tuple[int, int]] = []
    patterns: set[int] = set()
    hits = []
    for end, (k, n) in automaton.iter(line):
        patterns.add(k)
        hits.append((end, n))
    if not hits:
        return runs, patterns
    stops, at = [], 0  # position of the space behind each word
    for w in words:
        at += len(w) + 1
        stops.append(at)
    for last, n in sorted((bisect.bisect_left(stops, end), n) for end, n in hits):
        first, stop = last - n + 1, last + 1
        while runs and runs[-1][1] >= first:
            a, b = runs.pop()
            first, stop = min(a, first), max(b, stop)
        runs.append((first, stop))
    return runs, patterns


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those of ``carry``, unchanged), n_words, n_hit, n_items, items_sha256, contaminated and spans of each document.

    ``spans`` (array of start and end, code points of the original text) covers each maximal run of
    hit words. Rows are kept as they come: repeated rows repeat, null text has no words, texts of any
    length are scanned whole. Benchmark rows with a null item_id contaminate but are not listed; an
    empty benchmark finds nothing, an empty table gives none.
    """
    spark = docs.sparkSession
    patterns, blocks = _patterns(benchmark, window, max_chars)
    plain = docs.select(whole_row(docs, carry), text_or_empty().alias("text"))
    if blocks == 1:
        return _pass(plain, spark.sparkContext.broadcast(_block(patterns, 0)))
    # more patterns than one automaton may hold: findings are told by a 128-bit hash of the text and joined at the end
    plain = plain.select("row", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    found = []
    for k in range(blocks):
        held = spark.sparkContext.broadcast(_block(patterns, k))
        found.append(stage(_findings(plain.select("h1", "h2", "text"), held).dropDuplicates(["h1", "h2"]), "findings"))
        held.destroy()
    every = functools.reduce(DataFrame.union, found)
    met = stage(every.groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "met")  # a list for each block
    unstage(*found)
    return _pass(plain.join(met, ["h1", "h2"], "left").select("row", "text", "runs", "items"), spark.sparkContext.broadcast([]))


OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def _findings(plain: DataFrame, held: object) -> DataFrame:
    """h1, h2, runs and items of the texts in which patterns of a block occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = _automaton(held)
        for batch in batches:
            out = [[] for _ in range(4)]
            for h1, h2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs, met = _found(automaton, normal_words(text)) if items else ([], set())
                if runs:
                    row = (h1, h2, [{"a": a, "b": b} for a, b in runs], sorted({str(x) for k in met for x in items[k]}))
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
            yield pa.record_batch([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), RUNS, pa.list_(pa.string())), strict=True)], names=["h1", "h2", "runs", "items"])

    return arrow_map(plain, run, "h1 long, h2 long, runs array<struct<a:int,b:int>>, items array<string>")


def _pass(plain: DataFrame, held: object) -> DataFrame:
    """The findings of one block on (row, text) and those carried along (runs, items), as the operator's columns."""
    carried = "runs" in plain.columns
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = _automaton(held)
        for batch in batches:
            before = [batch.column(2 + i).to_pylist() if carried else None for i in (0, 1)]
            out = [[] for _ in OUT]
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                words = normal_words(text)
                runs, met = _found(automaton, words) if items else ([], set())
                ids = {str(x) for k in met for x in items[k]}
                if carried and before[0][i]:
                    ids |= set(before[1][i])
                    runs = _merge(runs, [(x["a"], x["b"]) for x in before[0][i]])
                hit = sum(b - a for a, b in runs)
                listed = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
                for o, v in zip(out, (len(words), hit, len(ids), listed, hit > 0, _original(text, runs, word)), strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS]
            yield pa.record_batch([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["row", *OUT])

    told = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>")
    return arrow_map(plain, run, StructType([plain.schema["row"], *told.fields]))


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(one + two):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _original(text: str, runs: list[tuple[int, int]], word: re.Pattern) -> list[dict]:
    if not runs:
        return []
    at = [m.span() for m in word.finditer(text.translate(_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
