"""Column functions: tokens, n-grams, occurrences, format checks. All but those of a row's many needles stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spanlake import consts


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores (combining marks split words)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Contiguous n-grams as strings joined by a space; none for shorter arrays."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    made = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.expr("cast(array() as array<string>)"))


def with_gram_hashes(frame: DataFrame, words: str, sizes: int, name: str = "h", seed: int = 0) -> DataFrame:
    """``frame`` with columns ``name``1 .. : the 64-bit hashes of the n-grams of a column of words, each from the hash of the gram that is a word shorter; no gram is built."""
    out = frame.withColumn(f"{name}1", F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)))
    for n in range(2, sizes + 1):
        left = F.greatest(F.size(words) - n + 1, F.lit(0))
        out = out.withColumn(f"{name}{n}", F.zip_with(F.slice(f"{name}{n - 1}", F.lit(1), left), F.slice(words, F.lit(n), left), lambda h, w: F.xxhash64(h, w)))
    return out


def run_lengths(values: Column) -> Column:
    """Distinct values (v) of an array of longs and how often each stands in it (c), by one sort."""
    ordered = F.sort_array(values)

    def counted(xs: Column) -> Column:
        new = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(new), lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(xs, s).alias("v"), (F.coalesce(F.get(starts, k + 1), F.size(xs)) - s).alias("c"))))

    return F.flatten(F.flatten(F.transform(F.array(ordered), counted)))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too; none for an empty needle.

    The text is split before each occurrence and the pieces' lengths are added up, within blocks of about the root of
    their number and then over the blocks: one scan of the text, and k places cost k^1.5 copies, not k^2.
    """
    none = F.expr("cast(array() as array<int>)")
    before = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    sizes = F.transform(F.split(text, before), F.length)
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found"))
    running = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def added(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width), lambda i: F.slice(xs, i + 1, width))
        starts = lambda bs: F.concat(F.array(F.lit(0)), running(F.transform(bs, total), F.lit(0)))
        whole = lambda bs: F.transform(F.array(starts(bs)), lambda at: F.flatten(F.transform(bs, lambda b, i: running(b, F.get(at, i)))))
        return F.flatten(F.flatten(F.transform(F.array(blocks), whole)))

    # within a lambda, the lengths are worked out once
    later = F.flatten(F.transform(F.array(F.slice(sizes, F.lit(1), F.size(sizes) - 1)), lambda xs: F.when(F.size(xs) > 256, added(xs)).otherwise(running(xs, F.lit(0)))))
    fits = (F.length(needle) > 0) & F.contains(text, needle)
    return F.when(fits, F.concat(F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(none), later)).otherwise(none)


def _starts(text: str, needle: str) -> list[int]:
    found, at = [], text.find(needle)
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def _count(text: str, needle: str) -> int:
    if any(needle.startswith(needle[i:]) for i in range(1, len(needle))):  # it can overlap itself
        return len(_starts(text, needle))
    return text.count(needle)


@F.arrow_udf(ArrayType(IntegerType()))
def occurrence_counts(texts: pa.Array, needles: pa.Array) -> pa.Array:
    """How often each of a row's needles (none empty) stands in its text, overlapping places too."""
    return pa.array([[_count(t.as_py(), n) for n in ns.as_py() or []] for t, ns in zip(texts, needles)], pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("at", "which", "nth")])))
def merged_occurrences(texts: pa.Array, needles: pa.Array) -> pa.Array:
    """All places of a row's needles (none empty) in its text, by start, end and needle: start, the needle's number, and how many of its places come before.

    One scan for each needle and one sort a row: time is in proportion to text and places but for the sort.
    """
    columns: list[list[np.ndarray]] = [[], [], []]
    ends = [0]
    for t, ns in zip(texts, needles):
        text, own = t.as_py(), ns.as_py() or []
        found = [np.array(_starts(text, n), dtype=np.int32) for n in own]
        sizes = [len(f) for f in found]
        ends.append(ends[-1] + sum(sizes))
        if not sum(sizes):
            continue
        at, which = np.concatenate(found), np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        nth = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        order = np.lexsort((which, np.repeat([len(n) for n in own], sizes), at))
        for column, values in zip(columns, (at, which, nth)):
            column.append(values[order])
    flat = [pa.array(np.concatenate(c) if c else np.empty(0, np.int32), pa.int32()) for c in columns]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["at", "which", "nth"]))


# so that no filter on what is made of them is pushed below, where they would be worked out again
occurrence_counts, merged_occurrences = occurrence_counts.asNondeterministic(), merged_occurrences.asNondeterministic()


def count_apart(text: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def check_email(s: Column) -> Column:
    return F.rlike(F.trim(s), F.lit(consts.EMAIL))


def check_luhn(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def check_ipv4(s: Column) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.rlike(s, F.lit(rf"^{part}(\.{part}){{3}}$"))


def check_ipv6(s: Column) -> Column:
    """IPv6 with an optional scope: eight groups of one to four hex digits, or fewer around one ``::``; the last two may be an IPv4 address."""
    body = F.split_part(s, F.lit("%"), F.lit(1))
    scope = F.when(F.contains(s, F.lit("%")), (F.size(F.split(s, "%", -1)) == 2) & ~F.endswith(s, F.lit("%"))).otherwise(F.lit(True))
    tail = F.substring_index(body, ":", -1)
    four = F.contains(body, F.lit(":")) & check_ipv4(tail)
    plain = F.when(four, F.concat(F.substring(body, F.lit(1), F.length(body) - F.length(tail)), F.lit("0:0"))).otherwise(body)
    halves = F.split(plain, "::", -1)
    groups = lambda half: F.when(half == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(half, ":", -1))
    own = F.flatten(F.transform(halves, groups))
    fine = F.forall(own, lambda g: F.rlike(g, F.lit("^[0-9a-fA-F]{1,4}$")))
    whole = ((F.size(halves) == 1) & (F.size(own) == 8)) | ((F.size(halves) == 2) & (F.size(own) <= 7))
    return F.contains(body, F.lit(":")) & scope & whole & fine


def check_ip(s: Column) -> Column:
    bare = F.trim(s)
    return check_ipv4(bare) | check_ipv6(bare)


def _bare(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, r"\s", ""))


def check_iban(s: Column) -> Column:
    bare = _bare(s)
    moved = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))
    value = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(F.rlike(c, F.lit("[0-9]")), 10).otherwise(100) + value(c)) % 97)
    return F.when(F.rlike(bare, F.lit(consts.IBAN)), rest == 1).otherwise(F.lit(False))


def like_iban(s: Column) -> Column:
    """Whether a string starts like an IBAN, so that it is checked at all."""
    return F.rlike(_bare(s), F.lit("^[A-Z]{2}[0-9]{2}"))


def check_ssn(s: Column) -> Column:
    """With both dashes, or nine digits without any."""
    bare = F.trim(s)
    dashed = F.when(F.rlike(bare, F.lit("^[0-9]{9}$")), F.concat_ws("-", F.substring(bare, 1, 3), F.substring(bare, 4, 2), F.substring(bare, 6, 4))).otherwise(bare)
    return F.rlike(dashed, F.lit(consts.SSN))


def like_ssn(s: Column) -> Column:
    return F.rlike(F.trim(s), F.lit("^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$"))


def always(s: Column) -> Column:
    return F.lit(True)


#: Sections of the format report: the types checked, the strings among them that are, and the check.
CHECKERS = {
    "Work_Email_Address": (("Work_Email_Address",), always, check_email),
    "Personal_Email_Address": (("Personal_Email_Address",), always, check_email),
    "Credit_Card_Numbers": (("Credit_Card_Numbers",), always, check_luhn),
    "Static_IP_Address": (("Static_IP_Address",), always, check_ip),
    "iban": (("Customer_Reference_Number", "Account_Statements"), like_iban, check_iban),
    "us_ssn": (("National_Identification_Number",), like_ssn, check_ssn),
}


def density_band(entities: Column, tokens: Column) -> Column:
    """Band of entities per thousand tokens: high from 16 and five entities, medium from 5 and three, or from the floor alone in texts too short for a rate, else low; none without entities."""
    rate = F.coalesce(F.try_divide(entities * 1000.0, tokens.cast("double")), F.lit(0.0))
    return F.when(entities < 1, F.lit(None).cast("string")).when((rate >= 16) & (entities >= 5), "high").when((rate >= 5) & (entities >= 3), "medium").otherwise("low")


def length_band(tokens: Column) -> Column:
    """Band of a text's tokens."""
    return F.when(tokens < 200, "small").when(tokens < 600, "medium").when(tokens < 2000, "large").otherwise("very_large")


def estimated_tokens(text: Column, language: Column) -> Column:
    """Tokens by characters, at the rate of the language's script."""
    rates = F.create_map(*[F.lit(x) for kv in consts.TOKEN_RATES.items() for x in kv])
    return F.round(F.length(F.coalesce(text, F.lit(""))) * F.coalesce(F.try_element_at(rates, language), F.lit(0.25))).cast("int")
