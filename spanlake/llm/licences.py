"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Sparse multinomial logistic regression over word uni- and bigrams is trained here, on variations
(crops, dropped and inserted words) of public notices and paragraphs of each family, of other licences
(class ``unknown``) and of text without a licence (class ``none``). A temperature, and the
probability that a known family must have, are set on held-out variations and on licences that the
training has not seen (``calibration`` tells the errors). A prediction counts once its paragraph also
holds enough of one of the family's templates: bigrams count by how few families have them.

A paragraph is the lines between two without letters or digits (so comment leaders and line breaks
don't part a notice). It is scored as a whole, and so are its lines and its overlapping windows of
``SPAN`` words, where prose around a notice can't outweigh it. Texts are scored by DataFrame functions
alone, within their row: nothing is shuffled. Weights depend on the notices only and go out as
literals. Paragraphs without a gate term are passed over: no family can be confirmed in them
(``gate_terms`` follow from the templates), and what is called unknown must name a licence (``GATE``).
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import licence_texts as L
from .secrets import any_of
from .stage import text_or_empty, whole_row

TEMPLATES = {f: tuple(dict.fromkeys((*(frame.format(n) for n in L.NAMES[f] for frame in L.FRAMES), *(L.SPDX.format(i) for i in L.IDENTIFIERS[f]), *L.PARAGRAPHS.get(f, ())))) for f in L.NAMES}
CLASSES = (*TEMPLATES, "unknown", "none")
#: A template counts as found with this share of its bigrams, weighted.
CONFIRM = 0.5
#: Words of a window; longer templates are found by the whole paragraph or by shorter ones.
SPAN = 48
#: What is of class unknown holds one of these.
GATE = r"licen[sc]|permission|compliance|redistribut|public\W+domain|creative\W+commons|\bcc\b|\bcc0\b|copyright|rights\W+reserved|version\W+2\W+of|later\W+version|encumbered|source\W+code\W+form"
#: Line starts that are no text; other comment leaders have no letters.
LEADER = r"(?i)^\s*(?:@?rem|dnl|c(?=\s\s))(?=\s|$)"
#: Buckets of grams, by checksum: a lookup searches one of them.
BUCKETS = 512


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(text: str) -> list[str]:
    own = words(text)
    return sorted({*own, *(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))})


def pairs(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g]


@functools.lru_cache(maxsize=1)
def rarity() -> dict[str, float]:
    """The weight of each template bigram: one over the number of families that have it."""
    held = Counter(g for ts in TEMPLATES.values() for g in {g for t in ts for g in pairs(t)})
    return {g: 1 / n for g, n in held.items()}


def template_share(own: list[str], family: str) -> float:
    """The largest weighted share of a template of the family whose bigrams are among some grams; one bigram alone confirms no longer template."""
    held, weight, best = set(own), rarity(), 0.0
    for whole in filter(None, map(pairs, TEMPLATES.get(family, ()))):
        met = [weight[g] for g in whole if g in held]
        if len(met) >= min(2, len(whole)):
            best = max(best, sum(met) / sum(weight[g] for g in whole))
    return best


def _varied(rng: random.Random, text: str, kind: int) -> str:
    """A whole notice, a crop of it (a line's length or most of it), or one that lacks words; some with words around."""
    own = text.split()
    if kind == 1 and len(own) > 12:
        size = rng.choice((rng.randrange(8, 15), rng.randrange(len(own) * 6 // 10, len(own) + 1)))
        at = rng.randrange(max(1, len(own) - size + 1))
        own = own[at : at + size]
    if kind == 2:
        own = [w for w in own if rng.random() > 0.1] or own
    for _ in range(rng.choice((0, 0, 0, 2, 5, 20))):
        own.insert(rng.choice((0, len(own))), "".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))))
    return " ".join(own)


def _others(held_out: int) -> list[str]:
    return [frame.format(n) for n in L.OTHER_NAMES[held_out] for frame in L.FRAMES] + [L.SPDX.format(i) for i in L.OTHER_IDENTIFIERS[held_out]] + list(L.OTHER_PARAGRAPHS[held_out])


def examples(rng: random.Random, each: int, held_out: int) -> list[tuple[list[str], int]]:
    """Grams and class of variations: ``each`` of a family, and as many times more of the others."""
    out = []
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)})
    for k, family in enumerate(TEMPLATES):
        out += [(grams(_varied(rng, rng.choice(TEMPLATES[family]), i % 3)), k) for i in range(each)]
    others = _others(held_out)
    out += [(grams(_varied(rng, rng.choice(others), i % 3)), len(CLASSES) - 2) for i in range(4 * each)]
    for i in range(6 * each):
        if i % 3 == 0:
            text = " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))
        elif i % 3 == 1:
            whole = rng.choice(rng.choice(list(TEMPLATES.values()))).split()
            at = rng.randrange(len(whole))
            text = " ".join(whole[at : at + 1])
        else:
            text = _varied(rng, rng.choice(L.PLAIN), 0) + " " + " ".join(rng.sample(vocabulary, 2))
        out.append((grams(text), len(CLASSES) - 1))
    return out


@functools.lru_cache(maxsize=1)
def model(each: int = 90, steps: int = 120, seed: int = 11) -> tuple[dict[str, list[float]], list[float], float, dict[str, float]]:
    """Weights by gram and biases (both over the temperature), the least probability of a known family, and held-out shares."""
    rng = random.Random(seed)
    train, held = examples(rng, each, 0), examples(rng, each // 2, 1)
    known = sorted({g for t in (*(t for ts in TEMPLATES.values() for t in ts), *_others(0)) for g in grams(t)})
    number = {g: i for i, g in enumerate(known)}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(known)), np.float32)
        for i, (own, _) in enumerate(rows):
            x[i, [number[g] for g in own if g in number]] = 1.0
        return x, np.array([k for _, k in rows])

    x, y = matrix(train)
    w, b, n = np.zeros((len(known), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), len(y)

    def chances(x: np.ndarray, w: np.ndarray, b: np.ndarray, heat: float = 1.0) -> np.ndarray:
        z = (x @ w + b) / heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    ahead, turn, rate = (w, b), 1.0, 0.5
    for _ in range(steps):  # accelerated proximal gradient steps
        p = chances(x, *ahead)
        p[np.arange(n), y] -= 1
        low = ahead[0] - rate * (x.T @ p / n)
        new = np.sign(low) * np.maximum(np.abs(low) - rate * 1e-4, 0), ahead[1] - rate * p.mean(axis=0)
        later = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        ahead = tuple(v + (turn - 1) / later * (v - u) for v, u in zip(new, (w, b), strict=True))
        (w, b), turn = new, later
    x2, y2 = matrix(held)
    heat = min((0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: float(-np.log(np.maximum(chances(x2, w, b, t)[np.arange(len(y2)), y2], 1e-12)).mean()))
    p = chances(x2, w, b, heat)
    families = len(TEMPLATES)
    other, top = y2 >= families, p[:, :families].max(axis=1)
    # what the templates don't confirm is no family, however probable
    found = np.array([template_share(own, list(TEMPLATES)[k]) >= CONFIRM for (own, _), k in zip(held, p[:, :families].argmax(axis=1), strict=True)])
    top = np.where(found, top, 0.0)
    wrong = np.sort(top[other])
    least = float(min(0.9, max(0.5, wrong[int(0.99 * len(wrong))])))  # about one in a hundred of the others passes
    unseen = y2 == families
    told = {
        "families right": float((p[~other].argmax(axis=1) == y2[~other]).mean()),
        "families taken for another": float(((top[~other] >= least) & (p[~other, :families].argmax(axis=1) != y2[~other])).mean()),
        "families sure": float((top[~other] >= least).mean()),
        "unseen licences taken for a family": float((top[unseen] >= least).mean()),
        "unseen licences called none": float((p[unseen, -1] >= 0.5).mean()),
        "others taken for a licence": float((p[y2 == families + 1, -1] < 0.5).mean()),
    }
    kept = {g: [round(float(v), 4) for v in w[i] / heat] for g, i in number.items() if np.abs(w[i]).sum() > 0 or g in rarity()}
    return kept, [round(float(v), 4) for v in b / heat], least, told


def calibration() -> dict[str, float]:
    """Shares of held-out variations; the licences among the others were not in the training."""
    return model()[3]


#: Words (of any language) too usual to look for by themselves: bigrams with them are looked for instead.
USUAL = frozenset(w for t in L.PLAIN for w in t.split()) | frozenset(
    "of mit into you this with are or no met form forms by be at either copy use it not is to and in without any s v on an can should will but file as from has other even means list your code"
    " system program available authors useful option subject names terms provided required received purpose prior products published released written writing notice publisher possible included"
    " including whether connection contract damages deal agreed applicable commercial compile stored persons obtain obtaining modify binary clause conditions distributed fee hope limitation"
    " universal transmitted sa nc nd domain dedicated documentation except compile only later general public version international".split()
)


#: Words of names and identifiers, which may be short.
NAMED = frozenset(w for own in (*L.NAMES.values(), *L.IDENTIFIERS.values()) for n in own for w in words(n) if len(w) > 1)


@functools.lru_cache(maxsize=8)
def gate_terms(confirm: float = CONFIRM) -> tuple[str, ...]:
    """Words and bigrams such that each weighted share of ``confirm`` or more of a template's bigrams holds one of them."""
    chosen: set[str] = set()
    weight = rarity()
    for t in sorted((t for ts in TEMPLATES.values() for t in ts), key=len):
        own = pairs(t)
        whole = sum(weight[p] for p in own)
        while (left := [p for p in own if not chosen & {p, *p.split()}]) and sum(weight[p] for p in left) >= confirm * whole:
            terms = {w for p in left for w in p.split() if len(w) > 6 or w in NAMED} - USUAL
            chosen.add(max(sorted(terms or left), key=lambda w: (sum(weight[p] for p in left if w in (p, *p.split())), len(w))))
    return tuple(sorted(chosen))


def gate(confirm: float = CONFIRM) -> str:
    """The expression, on lower-case text, that every paragraph of interest matches."""
    return f"(?<![a-z0-9])(?:{any_of(gate_terms(confirm)).replace('\\ ', '[^a-z0-9]+')})(?![a-z0-9])|{GATE}"


def best_family(text: str) -> tuple[str, float, float, float]:
    """Family, its probability, that of none, and the template share of one piece of text, in plain Python."""
    weights, bias, *_ = model()
    own = grams(text)
    z = np.array(bias) + sum((np.array(weights[g]) for g in own if g in weights), np.zeros(len(bias)))
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = CLASSES[int(p.argmax())]
    return family, float(p.max()), float(p[-1]), template_share(own, family)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(own: Column) -> Column:
    pair = F.zip_with(own, F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(own, F.filter(pair, lambda p: p.isNotNull())))


FOUND = "array<struct<line:int,family:string,probability:double,template_share:double>>"
#: Pieces of a paragraph.
LINE, WINDOW, WHOLE = 0, 1, 2


def _pieces(lines: Column) -> Column:
    """Lines (line, x) of one paragraph, as pieces (line, last, kind, w): its lines, its windows where these aren't its only line, and the whole of a longer one."""
    piece = lambda part, kind: F.struct(F.get(part, F.lit(0))["line"].alias("line"), F.element_at(part, -1)["line"].alias("last"), F.lit(kind).alias("kind"), F.transform(part, lambda t: t["w"]).alias("w"))
    worded = F.transform(lines, lambda s: F.transform(_words(s["x"]), lambda w: F.struct(s["line"].alias("line"), w.alias("w"))))
    kind = "array<struct<line:int,last:int,kind:int,w:array<string>>>"

    def cut(parts: Column) -> Column:
        own = F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: piece(p, LINE))
        return F.concat(own.cast(kind), F.flatten(F.transform(F.array(F.flatten(parts)), lambda t: windows(t, F.size(parts)))))

    def windows(t: Column, n_lines: Column) -> Column:
        more = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(t) - SPAN, F.lit(0)) / F.lit(SPAN // 2)).cast("int"))
        part = F.transform(more, lambda k: piece(F.slice(t, k * (SPAN // 2) + 1, F.lit(SPAN)), WINDOW))
        none = F.array().cast(kind)
        whole = F.when((n_lines > 1) & (F.size(t) > SPAN), F.array(piece(t, WHOLE)).cast(kind)).otherwise(none)
        return F.when((F.size(t) > 0) & ((n_lines > 1) | (F.size(t) > SPAN)), F.concat(part.cast(kind), whole)).otherwise(none)

    return F.flatten(F.transform(F.array(worded), cut))


def scan(docs: DataFrame, confirm: float = CONFIRM, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those of ``carry``, unchanged) and ``licences`` (line, family, probability, template_share).

    ``line`` counts from 0: a confirmed line, or the first line of a confirmed window or paragraph
    none of whose lines is confirmed for that family. Lines, or else windows, that name a licence, are
    rather not of class none, and fall short of every family in probability or template share are
    family 'unknown', unless they meet a confirmed window. Null and empty texts have none; texts of any
    length are scanned whole; one row for each row, repeated ones too; an empty table gives none.
    """
    weights, bias, least, _ = model()
    rare = rarity()
    buckets: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
    for g, own in weights.items():  # a gram's class weights, and what it weighs in a template
        buckets[zlib.crc32(g.encode()) % BUCKETS][g] = [*own, rare.get(g, 0.0)]
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<double>>>")
    known = lambda g: F.try_element_at(F.get(table, F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int")), g)
    shapes = F.from_json(F.lit(json.dumps([{"f": f, "g": pairs(t), "n": sum(rare[g] for g in pairs(t))} for f, ts in TEMPLATES.items() for t in ts if pairs(t)])), "array<struct<f:string,g:array<string>,n:double>>")
    names = F.array(*[F.lit(f) for f in CLASSES])
    pattern = gate(confirm)
    gated = lambda x: F.rlike(F.lower(x), F.lit(pattern))
    kept = lambda s, *names: [s[n].alias(n) for n in names]
    line = lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, LEADER, "").alias("x"), F.rlike(x, F.lit(r"[\p{L}\p{N}]")).alias("full"))
    held = docs.select(whole_row(docs, carry), text_or_empty().alias("text"))
    held = held.select("row", F.when(gated(F.col("text")), F.transform(F.split("text", "\n", -1), line)).otherwise(F.array().cast("array<struct<line:int,x:string,full:boolean>>")).alias("lines"))
    n = F.size("lines")
    around = F.arrays_zip(F.col("lines").alias("s"), F.concat(F.array(F.lit(False)), F.transform("lines", lambda s: s["full"])).alias("before"), F.concat(F.transform(F.slice("lines", F.lit(2), F.greatest(n, F.lit(1))), lambda s: s["full"]), F.array(F.lit(False))).alias("after"))
    held = held.withColumn("around", F.filter(around, lambda t: t["s"]["full"] & ~(t["before"] & t["after"])))
    first, last = (F.transform(F.filter("around", lambda t: ~t[side]), lambda t: t["s"]["line"]) for side in ("before", "after"))
    held = held.withColumn("ends", F.arrays_zip(first.alias("a"), last.alias("b")))
    held = held.withColumn("paragraphs", F.filter(F.transform("ends", lambda e: F.slice("lines", e["a"] + 1, e["b"] - e["a"] + 1)), lambda ls: gated(F.array_join(F.transform(ls, lambda s: s["x"]), " "))))
    pieces = F.filter(F.flatten(F.transform("paragraphs", _pieces)), lambda s: gated(F.array_join(s["w"], " ")))
    held = held.withColumn("pieces", F.transform(pieces, lambda s: F.struct(*kept(s, "line", "last", "kind"), F.rlike(F.array_join(s["w"], " "), F.lit(GATE)).alias("told"), _grams(s["w"]).alias("g"))))
    hits = lambda s: F.filter(F.transform(s["g"], known), lambda v: v.isNotNull())
    total = lambda s: F.aggregate(hits(s), F.array(*[F.lit(x) for x in (*bias, 0.0)]), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    held = held.withColumn("pieces", F.transform("pieces", lambda s: F.struct(*kept(s, "line", "last", "kind", "told", "g"), F.slice(total(s), 1, len(CLASSES)).alias("z"))))
    best = lambda s: F.array_max(s["z"])
    spread = lambda s: F.aggregate(s["z"], F.lit(0.0), lambda acc, z: acc + F.exp(z - best(s)))
    none = lambda s: F.exp(F.get(s["z"], F.lit(len(CLASSES) - 1)) - best(s)) / spread(s)
    held = held.withColumn("pieces", F.transform("pieces", lambda s: F.struct(*kept(s, "line", "last", "kind", "told", "g"), F.get(names, F.array_position(s["z"], best(s)).cast("int") - 1).alias("family"), (1 / spread(s)).alias("p"), none(s).alias("none"))))
    weigh = lambda gs: F.aggregate(gs, F.lit(0.0), lambda acc, g: acc + F.element_at(known(g), -1))
    enough = lambda met, t: F.when(F.size(met) >= F.least(F.lit(2), F.size(t["g"])), weigh(met) / t["n"]).otherwise(F.lit(0.0))
    share = lambda s: F.coalesce(F.array_max(F.transform(F.filter(shapes, lambda t: t["f"] == s["family"]), lambda t: enough(F.array_intersect(t["g"], s["g"]), t))), F.lit(0.0))
    held = held.withColumn("pieces", F.transform(F.filter("pieces", lambda s: s["none"] < 0.5), lambda s: F.struct(*kept(s, "line", "last", "kind", "told", "family"), F.round(s["p"], 6).alias("probability"), F.round(share(s), 6).alias("template_share"))))
    sure = lambda s: (s["probability"] >= least) & (s["template_share"] >= confirm)
    meet = lambda a, b: (a["line"] <= b["last"]) & (b["line"] <= a["last"])
    # a larger piece counts where no smaller or earlier one of its lines has said the same
    held = held.withColumn("sure", F.filter("pieces", sure)).withColumn("open", F.filter("pieces", lambda s: ~sure(s) & s["told"] & (s["kind"] < WHOLE)))
    fresh = lambda known: lambda s, i: ~F.exists(F.slice(known, F.lit(1), i), lambda o: (o["family"] == s["family"]) & meet(o, s))
    held = held.withColumn("open", F.filter("open", lambda s: ~F.exists("sure", lambda o: ((s["kind"] == WINDOW) | (o["kind"] == WINDOW)) & meet(o, s))))
    new = F.filter("open", lambda s, i: (s["kind"] == LINE) | ~F.exists(F.slice("open", F.lit(1), i), lambda o: meet(o, s)))
    said = lambda s, family: F.struct(s["line"].alias("line"), family.alias("family"), s["probability"].alias("probability"), s["template_share"].alias("template_share"))
    out = F.concat(F.transform(F.filter("sure", lambda s, i: (s["kind"] == LINE) | fresh("sure")(s, i)), lambda s: said(s, s["family"])), F.transform(new, lambda s: said(s, F.lit("unknown"))))
    return held.select("row", F.array_sort(out.cast(FOUND)).alias("licences"))


def families() -> Column:
    """Known families of a scanned row, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform("licences", lambda s: s["family"]), lambda f: f != "unknown")))
