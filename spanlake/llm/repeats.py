"""Removal of every byte of a repeated 200-byte string, by prefix-free parsing.

Rolling-hash triggers cut each text into phrases (see ``parsing``). Every phrase overlaps the next by
199 bytes, so each 200-byte string lies in exactly one phrase, at a start of that phrase's run, and
equal strings have equal triggers. The corpus is then a dictionary of distinct phrases and a parse,
the phrases' places. Its suffixes in lexicographic order, to the depth of ``LENGTH``, follow from
the two: the dictionary's suffix array orders the strings, and the parse's order, needed to its
first symbol only as no string reaches into a second phrase, says how often each phrase stands. A
string is repeated if its neighbour in that order is equal or if its phrase stands twice.

1. Triggers whose core (the ``CORE`` bytes that any string with this trigger holds) stands once
   in the corpus can't take part in a repeat.
2. The parse is sorted: the dictionary has each distinct phrase of the other triggers once, with its
   number of places. All strings of a phrase that stands twice are repeats.
3. The dictionary is dealt by core, as equal strings share theirs, and the suffix array of each
   core's phrases is sorted: neighbours that are equal are repeats. Cores of more than ``SMALL``
   phrases, whose suffixes no task should hold, have their strings sorted and counted by Spark
   under 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import LENGTH, Chunk, chunks
from .stage import arrow_map, stage, text_or_empty

#: Cores with more distinct phrases are counted string by string.
SMALL = 48


def _id() -> Column:
    """Rows are told apart by a 64-bit hash of doc_id and text and a 31-bit checksum of the text; rows alike in both are repeated rows, which share their findings."""
    return F.xxhash64("doc_id", "text")


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of some strings of a buffer, as two columns of longs."""
    digest = xxhash.xxh3_128_digest
    made = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), ">i8").astype(np.int64)
    return made[::2], made[1::2]


def _parsed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Chunk]]:
    texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(column)]
    for a, b in chunks([len(t) for t in texts]):
        yield a, b, Chunk(texts[a:b])


def _cut(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Values by ascending row as a list column of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def cores(rows: DataFrame) -> DataFrame:
    """id, crc and the core hashes of each row's triggers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, _, chunk in _parsed(batch, 2):
                found.append(chunk.cores().view(np.int64))
                owners.append(chunk.doc + a)
            yield pa.record_batch([batch.column(0), batch.column(1), _cut(np.concatenate(found), np.concatenate(owners), batch.num_rows)], names=["id", "crc", "cores"])

    return arrow_map(rows.select("id", "crc", "text"), run, "id long, crc long, cores array<long>")


def _tag(crc: Column, number: Column) -> Column:
    return F.shiftleft(crc, 32).bitwiseOR(number.cast("long"))


def _by_row(tagged: DataFrame, name: str, *more: Column) -> DataFrame:
    """Numbers of (id, tag) rows as a sorted list by (id, crc)."""
    return tagged.groupBy("id", F.shiftrightunsigned("tag", 32).alias("crc")).agg(F.sort_array(F.collect_list(F.struct(F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ord"), *more) if more else F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(name))


def _lists(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.asarray(v.values if v.is_valid else [], np.int64) if not v.is_valid or v.values is not None else np.empty(0, np.int64) for v in batch.column(column)]


def _pick(chunk: Chunk, numbers: list[np.ndarray]) -> np.ndarray:
    """Runs of a chunk by their documents' lists of run numbers."""
    first = np.searchsorted(chunk.doc, np.arange(len(numbers)))
    return np.concatenate([np.empty(0, np.int64), *(f + x for f, x in zip(first, numbers, strict=True))]).astype(np.int64)


def phrases(held: DataFrame) -> DataFrame:
    """core, u, w (128-bit digest), id and tag of each phrase of ``held`` whose core isn't in ``once``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = _lists(batch, 3)
            ids, crcs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, chunk in _parsed(batch, 2):
                keep = np.ones(len(chunk.doc), bool)
                keep[_pick(chunk, once[a:b])] = False
                pick = np.flatnonzero(keep)
                u, w = _digests(chunk.buffer.tobytes(), chunk.lo[pick], chunk.hi[pick] + LENGTH)
                doc = chunk.doc[pick] + a
                cols = [chunk.cores()[pick].view(np.int64), u, w, ids[doc], crcs[doc] << 32 | chunk.ord[pick]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["core", "u", "w", "id", "tag"])

    return arrow_map(held.select("id", "crc", "text", "once"), run, "core long, u long, w long, id long, tag long")


def contexts(wanted: DataFrame) -> DataFrame:
    """core, id, tag, single, left and bytes of the listed phrases; ``left`` bytes stand before the trigger, ``late`` is the last start's distance before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()
            ids, crcs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, chunk in _parsed(batch, 2):
                numbers = [np.array([x["ord"] for x in own], np.int64) for own in lists[a:b]]
                pick = _pick(chunk, numbers)
                cores_ = chunk.cores()[pick].view(np.int64)
                out = [[] for _ in range(7)]
                k = 0
                raw = chunk.buffer.tobytes()
                for d, own in enumerate(lists[a:b], a):
                    for x in own:
                        r = pick[k]
                        lo, hi, anchor = int(chunk.lo[r]), int(chunk.hi[r]), int(chunk.anchor[r])
                        for o, v in zip(out, (int(cores_[k]), ids[d], crcs[d] << 32 | x["ord"], x["single"], anchor - lo, anchor - hi, raw[lo : hi + LENGTH]), strict=True):
                            o.append(v)
                        k += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["core", "id", "tag", "single", "left", "late", "data"])

    return arrow_map(wanted.select("id", "crc", "text", "small"), run, "core long, id long, tag long, single boolean, left int, late int, data binary")


def _repeated(group: list[tuple]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For each phrase of a core that stands once: the distances before the trigger (from, to) at which its strings stand in another phrase too."""
    suffixes = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH) for *_, data in group]
    table = np.concatenate(suffixes)
    order = np.argsort(np.ascontiguousarray(table).view(f"V{LENGTH}").ravel(), kind="stable")  # the core's suffix array
    ordered = table[order]
    equal = (ordered[1:] == ordered[:-1]).all(axis=1)
    again = np.zeros(len(order), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    at = 0
    for (id_, tag, single, before, _, _), own in zip(group, suffixes, strict=True):
        held = again[at : at + len(own)]
        at += len(own)
        if single and held.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
            yield id_, tag, [(before - int(e) + 1, before - int(s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def compare(held: DataFrame) -> DataFrame:
    """id, tag, near and far of repeats in the phrases of small cores; groups arrive whole and sorted, at most ``SMALL`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        core = None
        out: list[list[int]] = [[], [], [], []]

        def flush() -> None:
            for id_, tag, found in _repeated(group) if len(group) > 1 else ():
                for near, far in found:
                    for o, v in zip(out, (id_, tag, near, far), strict=True):
                        o.append(v)

        def batch_out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(o, pa.int64()) for o in out], names=["id", "tag", "near", "far"])
            for o in out:
                o.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != core:
                    flush()
                    group, core = [], row[0]
                group.append(row[1:])
            yield batch_out()
        flush()
        yield batch_out()

    ordered = held.repartition("core").sortWithinPartitions("core")
    return arrow_map(ordered.select("core", "id", "tag", "single", "left", "late", "data"), run, "id long, tag long, near long, far long")


def strings(wanted: DataFrame) -> DataFrame:
    """u, w, id, tag and far (distance before the trigger) of every string of the listed phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _lists(batch, 3)
            ids, crcs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, chunk in _parsed(batch, 2):
                pick = _pick(chunk, lists[a:b])
                if not len(pick):
                    continue
                at = chunk.starts(pick)
                run_of = np.repeat(pick, chunk.hi[pick] - chunk.lo[pick] + 1)
                doc = chunk.doc[run_of] + a
                u, w = _digests(chunk.buffer.tobytes(), at, at + LENGTH)
                cols = [u, w, ids[doc], crcs[doc] << 32 | chunk.ord[run_of], chunk.anchor[run_of] - at]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["u", "w", "id", "tag", "far"])

    return arrow_map(wanted.select("id", "crc", "text", "large"), run, "u long, w long, id long, tag long, far long")


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans from text, ``once`` (cores that stand once), ``alone`` (phrases that stand once), ``found`` (ord, near, far), ``large`` (those of large cores) and their ``lone`` strings (ord, far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once, alone, found, large, lone = _lists(batch, 3), _lists(batch, 4), batch.column(5).to_pylist(), _lists(batch, 6), batch.column(7).to_pylist()
            out = [[] for _ in range(5)]
            for a, b, chunk in _parsed(batch, 2):
                keep = np.ones(len(chunk.doc), bool)
                keep[_pick(chunk, once[a:b])] = False
                keep[_pick(chunk, alone[a:b])] = False
                whole = np.flatnonzero(keep)
                lo, hi = [chunk.lo[whole]], [chunk.hi[whole]]
                first = np.searchsorted(chunk.doc, np.arange(b - a))
                for d in range(a, b):
                    if found[d]:
                        own = np.array([(x["ord"], x["near"], x["far"]) for x in found[d]], np.int64)
                        anchor = chunk.anchor[first[d - a] + own[:, 0]]
                        lo.append(anchor - own[:, 2])
                        hi.append(anchor - own[:, 1])
                    if len(large[d]):  # every string of these phrases but the lone ones
                        at = chunk.starts(first[d - a] + large[d])
                        if lone[d]:
                            own = np.array([(x["ord"], x["far"]) for x in lone[d]], np.int64)
                            at = np.setdiff1d(at, chunk.anchor[first[d - a] + own[:, 0]] - own[:, 1])
                        lo.append(at)
                        hi.append(at)
                cover = np.zeros(len(chunk.buffer) + 1, np.int32)
                np.add.at(cover, np.concatenate(lo), 1)
                np.add.at(cover, np.concatenate(hi) + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for d in range(a, b):
                    begin, end = chunk.begin[d - a], chunk.begin[d - a + 1]
                    own, data = gone[begin:end], chunk.buffer[begin:end]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    row = (int(end - begin), int(own.sum()), len(edge) // 2, hashlib.sha256(data[~own].tobytes()).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.record_batch([batch.column(8), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return arrow_map(rows.select("id", "crc", "text", "once", "alone", "found", "large", "lone", "doc_id"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets) of each row.

    Null text counts as empty. Texts under 200 bytes lose nothing; repeated rows lose everything from
    200 bytes on; rows with null doc_ids take part like any others; texts of any length are taken
    whole; an empty table gives none. Other columns are dropped.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).select(_id().alias("id"), F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("crc"), "text", "doc_id")
    held = _with_lone_cores(rows)
    book = _dictionary(held)
    open_ = _open_phrases(book)
    texts = held.filter("long").select("id", "crc", "text")
    pairs = _small_cores(texts, open_, small)
    lone = _large_cores(texts, open_, small)
    large = _by_row(open_.filter((F.col("members") > small) & F.col("single")), "large")
    alone = _by_row(book.filter("single"), "alone")
    full = held.join(alone, ["id", "crc"], "left").join(_by_row(pairs, "found", F.col("near"), F.col("far")), ["id", "crc"], "left").join(large, ["id", "crc"], "left").join(_by_row(lone, "lone", F.col("far")), ["id", "crc"], "left")
    none = lambda name, kind: F.coalesce(name, F.expr(f"cast(array() as array<{kind}>)")).alias(name)
    return _removed(full.select("id", "crc", "text", "doc_id", "once", none("alone", "bigint"), none("found", "struct<ord:bigint,near:bigint,far:bigint>"), none("large", "bigint"), none("lone", "struct<ord:bigint,far:bigint>")))


def _with_lone_cores(rows: DataFrame) -> DataFrame:
    """Step 1: each row with ``once``, its triggers whose core stands once, and whether it is ``long`` enough for any string."""
    each = cores(rows).select("id", "crc", F.posexplode("cores").alias("ord", "core"))
    lone = each.select("core", "id", _tag(F.col("crc"), F.col("ord")).alias("tag")).groupBy("core").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("tag").alias("tag")).filter("n = 1")
    joined = rows.join(_by_row(lone, "once"), ["id", "crc"], "left")
    return stage(joined.select("id", "crc", "text", "doc_id", F.coalesce("once", F.expr("cast(array() as array<bigint>)")).alias("once"), (F.octet_length("text") >= LENGTH).alias("long")), "held")


def _dictionary(held: DataFrame) -> DataFrame:
    """Step 2: distinct phrases, whether each stands once, and one place of each."""
    listed = phrases(held.filter("long"))
    book = listed.groupBy("u", "w").agg(F.count("*").alias("n"), F.min("core").alias("core"), F.min(F.struct("id", "tag")).alias("at"))
    return stage(book.select("core", F.col("at.id").alias("id"), F.col("at.tag").alias("tag"), (F.col("n") == 1).alias("single")), "book")


def _open_phrases(book: DataFrame) -> DataFrame:
    """Step 3: phrases of cores that have more than one, one of which stands once."""
    mixed = book.groupBy("core").agg(F.count("*").alias("members"), F.max("single").alias("open")).filter("members > 1 and open")
    return stage(book.join(mixed.select("core", "members"), "core"), "open")


def _once(rows: DataFrame) -> DataFrame:
    """One of each group of repeated rows: a dictionary entry has one place however often its row stands."""
    return rows.dropDuplicates(["id", "crc"])


def _small_cores(texts: DataFrame, open_: DataFrame, small: int) -> DataFrame:
    wanted = _by_row(open_.filter(F.col("members") <= small), "small", F.col("single"))
    return stage(compare(contexts(_once(texts.join(wanted, ["id", "crc"])))), "found")


def _large_cores(texts: DataFrame, open_: DataFrame, small: int) -> DataFrame:
    """Strings of large cores' phrases that stand in no other phrase."""
    wanted = _by_row(open_.filter(F.col("members") > small), "large")
    each = strings(_once(texts.join(wanted, ["id", "crc"])))
    return stage(each.groupBy("u", "w").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("tag").alias("tag"), F.min("far").alias("far")).filter("n = 1").select("id", "tag", "far"), "lone")
