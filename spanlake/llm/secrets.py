"""Secret scans through a trigram inverted index, in DataFrame and SQL functions alone.

Each rule's regular expression yields a Boolean trigram query, of whose conjunctions the two rarest
trigrams by their letters are kept. The index has, for every trigram that some query names, its
posting lists: the sorted numbers of the rows that hold it, in blocks of about ``BLOCK`` rows, so that
no list grows with a hot trigram. Texts are read once for it. A query is answered block by block: AND
intersects posting lists, OR unites them. The rows found are the rule's candidates; these, joined to
their texts, are verified by the expression. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams as T
from .stage import stage, text_or_empty, unstage, whole_row


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  #: code points that ``group`` has at least
    group: int = 0


#: The base rules, in the order in which spans of one start are listed. Fixed values.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: A PEM key: through the END line of its label, or (where that is missing) through the headers and base64 lines that follow.
#: Possessive loops, which Java runs without recursion. The last, shorter base64 line must end its line.
_BREAK = r"""(?:[\s"'>#*|,]|\\[nrt])*+"""
_PEM = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info|Comment): [^\r\n\\]*+)*+(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"""(?:[\x20\t]*+(?:\r?\n|\\n|\\r\\n)[\s>#*|]*+[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*(?:[\r\n"'\\]|$)))?)"""
)
#: What the method adds.
MORE = (
    Rule("private_key", _PEM),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: Runs of a single class need not be listed when they are too short: the same matches come from a bounded repeat.
_BOUNDED = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}

#: Rows of a block of the index, on average.
BLOCK = 4096
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def any_of(words: list[str]) -> str:
    """An expression for any of some strings, sharing their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    tails = {h: [r for r in rest if r] for h, rest in heads.items()}
    return "|".join(re.escape(h) + (f"(?:{any_of(tails[h])})" + ("?" if "" in rest else "") if tails[h] else "") for h, rest in sorted(heads.items()))


def numbered(text: Column, *more: Column) -> Column:
    """A row's number: a hash of its text and more. Rows of one number only share their candidates, which are verified each by its own text."""
    return F.xxhash64(text, *more)


def index(docs: DataFrame, named: list[str], block: int = BLOCK) -> DataFrame:
    """block, trigram and rows (sorted numbers) for the named trigrams of (number, text); texts count in lower case."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({any_of(sorted(named))}))"), F.lit(1)))
    held = stage(docs.select("number", found.alias("found")).filter(F.size("found") > 0), "trigrams")
    blocks = max(1, -(-held.count() // block))
    each = held.select(F.pmod("number", F.lit(blocks)).cast("int").alias("block"), "number", F.explode("found").alias("trigram"))
    lists = stage(each.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("number")).alias("rows")), "postings")
    unstage(held)
    return lists


def answer(query: object, postings: Column) -> Column:
    """The rows that satisfy a trigram query in one block, from a map of trigrams to their rows."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    kind, parts = query
    lists = [answer(p, postings) for p in sorted(parts, key=lambda p: (not isinstance(p, str), str(p)))]
    return reduce(F.array_intersect if kind == "and" else F.array_union, lists)


def candidates(lists: DataFrame, queries: dict[int, object]) -> DataFrame:
    """number and rules (those whose query the row satisfies) from an index and the queries by rule."""
    blocks = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("postings"))  # a block has a bounded number of rows and trigrams
    found = F.array(*[F.struct(F.lit(k).alias("rule"), answer(q, F.col("postings")).alias("rows")) for k, q in queries.items()])
    each = blocks.select(F.explode(found).alias("x")).select("x.rule", F.explode("x.rows").alias("number"))
    return each.groupBy("number").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def matches(rule: Rule, rank: int) -> Column:
    """Spans of a rule in ``text``: the pieces between matches give the matches their places."""
    pattern = F.lit(_BOUNDED.get(rule.kind, rule.pattern))
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    bound = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split("text", _BOUNDED.get(rule.kind, rule.pattern), -1)
    zipped = F.arrays_zip(found.alias("m"), bound.alias("g"), gaps.alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those of ``carry``, unchanged) and ``secret_spans`` (start, rank, end, kind; code points, sorted).

    One row for each row, repeated ones too; null and empty texts have no spans; texts of any length
    are indexed and verified whole; an empty table gives none. ``docs`` is read twice, so a costly
    plan should be staged before.
    """
    own = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit("")
    held = docs.select(whole_row(docs, carry), text_or_empty().alias("text"), numbered(text_or_empty(), own).alias("number"))
    queries = {k: T.thinned(q) for k, r in enumerate(rules) if (q := T.derive(r.pattern)) is not True}
    if queries:
        lists = index(held.select("number", "text"), sorted(set().union(*map(T.trigrams, queries.values()))))
        held = held.join(stage(candidates(lists, queries), "candidates"), "number", "left")
        unstage(lists)
    none = F.expr(f"cast(array() as {SPAN})")
    spans = []
    for k, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains("rules", F.lit(k)), F.lit(False)) if k in queries else F.lit(True)
        spans.append(F.when(wanted & F.rlike("text", F.lit(_BOUNDED.get(rule.kind, rule.pattern))), matches(rule, k)).otherwise(none))
    return held.select("row", F.sort_array(F.concat(*spans)).alias("secret_spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
