"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's part boundaries and the rank of every adjacent pair sit in two parallel lists. The
smallest rank is found by a scan, its right boundary is deleted, and the two neighbouring ranks
are looked up again. That is quadratic in the word's length, so words above ``SHORT`` bytes use a
heap over linked parts, which applies the same merges in the same order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .stage import arrow_map, own_columns, text_or_empty

#: Words up to this many bytes are merged by array scans.
SHORT = 128
#: Distinct words in each of the two generations of a worker's memory; a full young one replaces the old one.
MEMORY = 150_000
#: Longer words are not remembered.
MEMORY_CHARS = 48

NO_MERGE = 1 << 62
ID_MASK = (1 << 20) - 1

#: The public byte-level pre-tokenization pattern. Its \s is Unicode's White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    spare = 0x100
    for b in range(256):
        if chr(b) not in table or b not in plain:
            table[chr(spare)] = b
            spare += 1
    return table


class ByteBPE:
    """Encoder and decoder over one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {tok: bytes(letters[c] for c in tok) for tok in vocab if tok not in special}
        self.token_bytes: dict[int, bytes] = {vocab[t]: b for t, b in raw.items()}
        self.token_bytes |= {i: t.encode() for t, i in special.items()}
        self.byte_id = {b[0]: vocab[t] for t, b in raw.items() if len(b) == 1}
        #: ids of two parts, as left << 20 | right -> rank << 20 | id of the whole
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[left] << 20 | vocab[right], rank << 20 | vocab[left + right])
        self.special = special
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.shared = list(range(max(self.token_bytes) + 1))
        self.decimal = [str(i) for i in self.shared]

    # -- encoding -------------------------------------------------------------------------------
    def merge_word(self, data: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in data]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        find = self.merge.get
        ranks = [find(a << 20 | b, NO_MERGE) for a, b in itertools.pairwise(parts)]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            at = ranks.index(best)
            parts[at] = best & ID_MASK
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find(parts[at] << 20 | parts[at + 1], NO_MERGE)
            if at:
                ranks[at - 1] = find(parts[at - 1] << 20 | parts[at], NO_MERGE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, find = len(parts), self.merge.get
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (m := find(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(heap, (m >> 20, i, parts[i], parts[j], m & ID_MASK))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = whole, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or tuple([self.shared[i] for i in self.merge_word(word.encode("utf-8"))])
        if len(word) <= MEMORY_CHARS:
            if len(self.memory) >= MEMORY:
                self.old, self.memory = self.memory, {}
            self.memory[word] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        get, miss, extend = self.memory.get, self._word, out.extend
        memory = self.memory
        for word in self.words.findall(text):
            extend(get(word) or miss(word))
            if memory is not self.memory:
                memory, get = self.memory, self.memory.get

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens become their ids."""
        out: list[int] = []
        if self.split_special is None or not any(t in text for t in self.special):
            self._plain(text, out)
            return out
        for piece in self.split_special.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                self._plain(piece, out)
        return out

    # -- decoding -------------------------------------------------------------------------------
    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One encoder for each worker process and vocabulary file."""
    return ByteBPE(path)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and the ids (array<int>) of each whole text, however long. Null text counts as empty; empty text has no ids; repeated rows are kept; an empty table gives none. Other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = own_columns(docs, "doc_id", "text")
    return arrow_map(rows.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and the text of each row of ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return arrow_map(own_columns(encoded, "doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Encode and decode every whole text in one pass, returning digests.

    doc_id, n_tokens, ids_sha256, decoded_sha256 and lossless (the decoded text equals the input).
    Null text counts as empty (0 tokens, digests of the empty string); repeated rows repeat; a null
    doc_id stays null; texts of any length are encoded whole; an empty table gives none. Other columns
    are dropped.
    """
    plain = own_columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            counts, enc, dec, same = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                ids = bpe.encode(text)
                back = bpe.decode(ids)
                counts.append(len(ids))
                enc.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                dec.append(sha(back.encode()).hexdigest())
                same.append(back == text)
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string()), pa.array(same, pa.bool_())]
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return arrow_map(plain, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
