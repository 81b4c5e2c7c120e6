"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The base kinds (email, ip, card, phone) follow fixed patterns and always stay, with their scores. The
method adds kinds that a checksum confirms: ``iban`` (mod-97), ``nir`` (mod-97), ``tax`` (mod-11,10),
``dni`` (mod-23), ``nhs`` (mod-11), ``routing`` (weighted mod-10), and ``ssn``, which has none. Where
a checksum leaves chance matches (one number in ten or eleven), words of the kind within ``NEAR``
code points must speak for a span; words of other numbers (orders, parts, versions) speak against it.
An added span counts from ``threshold`` on. All scans are linear in the text: quadratic starts are
avoided by working on whole runs of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import arrow_map, text_or_empty

NEAR = 40
THRESHOLD = 0.6
#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "nir", "tax", "dni", "nhs", "routing")
BASE = KINDS[:4]
#: Words that speak for a kind when they stand near it.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "banco", "banque"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "nir": ("nir", "insee", "sécurité", "vitale", "assuré"),
    "tax": ("steuer", "steuernummer", "idnr", "identifikationsnummer", "tin"),
    "dni": ("dni", "nif", "nie", "documento", "identidad"),
    "nhs": ("nhs", "patient", "health"),
    "routing": ("routing", "aba", "transit", "rtn"),
}
#: Words that speak against any number.
AGAINST = ("order", "invoice", "isbn", "version", "tracking", "serial", "part", "model", "article", "ticket", "rechnung", "factura", "facture", "commande", "pedido", "bestellung")
#: Score of a proposed span, what its check adds, what a near word adds, and what a contrary one takes.
PROPOSED = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "nir": 0.3, "tax": 0.2, "dni": 0.3, "nhs": 0.1, "routing": 0.1}
CHECKED = {"card": 0.5, "iban": 0.6, "ssn": 0.2, "ip": 0.1, "nir": 0.4, "tax": 0.3, "dni": 0.4, "nhs": 0.3, "routing": 0.3}
NEAR_ADDS, AGAINST_TAKES = 0.2, 0.2

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){1,30}")
#: Characters of an IBAN by country, from the registry.
_IBAN_SIZE = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO;16:BE;18:DK FI FK FO GL NL SD;19:MK SI;20:AT BA EE KZ LT LU MN XK;21:CH HR LI LV;22:BG BH CR DE GB GE IE ME RS VA;23:AE GI IL IQ OM SO TL;"
    "24:AD CZ ES MD PK RO SA SE SK TN VG;25:LY PT ST;26:IS TR;27:BI DJ FR GR IT MC MR SM;28:AL AZ BY CY DO GT HN HU LB NI PL SV;29:BR EG PS QA UA;30:JO MU YE;31:MT SC;32:LC;33:RU"
).split(";")) for c in cs.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:\x20?[0-9])*+(?![0-9A-Za-z])")
_DNI = re.compile(r"(?<![0-9A-Za-z])[XYZ0-9][0-9]{7}-?[A-Z](?![0-9A-Za-z])")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = max(done, at)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                size = sum(map(len, own)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                    yield at, at + size
                at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """At each start the country's length and then the longest allowed end, or all allowed ends where the country is unknown."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        stop = _IBAN_REST.match(text, at).end()
        ends = [e for e in range(stop, at, -1) if text[e - 1] != " " and not (e < len(text) and text[e].isascii() and text[e].isalnum())]
        own = _IBAN_SIZE.get(m[0][:2])
        size = lambda e: e - m.start() - text.count(" ", m.start(), e)
        for end in ends if own is None else [e for e in ends if size(e) == own] + ends[:1]:
            if size(end) >= 15 and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def _numbers(text: str, size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of exactly ``size`` digits, single spaces between them allowed."""
    for m in _NUMBER.finditer(text):
        digits = m[0].replace(" ", "")
        if len(digits) == size:
            yield m.start(), m.end(), [*map(int, digits)]


def nirs(text: str) -> Iterator[tuple[int, int]]:
    """Sex, month and key (97 less the rest of the first 13 digits by 97) of 15 digits."""
    for s, e, d in _numbers(text, 15):
        number = int("".join(map(str, d[:13])))
        if d[0] in (1, 2) and 1 <= 10 * d[3] + d[4] <= 12 and 97 - number % 97 == 10 * d[13] + d[14]:
            yield s, e


def taxes(text: str) -> Iterator[tuple[int, int]]:
    """11 digits whose last is the check digit of the product chain modulo 11 and 10; one of the others stands two or three times."""
    for s, e, d in _numbers(text, 11):
        product = 10
        for x in d[:10]:
            product = 2 * ((x + product) % 10 or 10) % 11
        if d[0] and (11 - product) % 10 == d[10] and max(map(d[:10].count, d[:10])) in (2, 3):
            yield s, e


def dnis(text: str) -> Iterator[tuple[int, int]]:
    """Eight digits (or X, Y, Z and seven) and the letter of their rest by 23."""
    for m in _DNI.finditer(text):
        number = int(m[0][:8].translate({ord("X"): "0", ord("Y"): "1", ord("Z"): "2"}))
        if _DNI_LETTERS[number % 23] == m[0][-1]:
            yield m.span()


def nhss(text: str) -> Iterator[tuple[int, int]]:
    """Ten digits; the last is 11 less the weighted sum's rest by 11."""
    for s, e, d in _numbers(text, 10):
        if (11 - sum((10 - i) * x for i, x in enumerate(d[:9])) % 11) % 11 == d[9]:
            yield s, e


def routings(text: str) -> Iterator[tuple[int, int]]:
    """Nine digits of weights 3, 7, 1 that sum to a multiple of 10, with a prefix in use."""
    for s, e, d in _numbers(text, 9):
        if sum((3, 7, 1)[i % 3] * x for i, x in enumerate(d)) % 10 == 0 and (1 <= 10 * d[0] + d[1] <= 12 or 21 <= 10 * d[0] + d[1] <= 32):
            yield s, e


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "nir": nirs, "tax": taxes, "dni": dnis, "nhs": nhss, "routing": routings}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score after its check, and by the whole words within ``NEAR`` code points."""
    value = PROPOSED[kind] + CHECKED.get(kind, 0.0)
    near = {w.lower() for part in (text[max(0, start - NEAR) : start], text[end : end + NEAR]) for w in _WORD.findall(part)}
    if not near.isdisjoint(CONTEXT[kind]):
        value += NEAR_ADDS
    if not near.isdisjoint(AGAINST):
        value -= AGAINST_TAKES
    return min(1.0, max(0.0, round(value, 6)))


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then kind; base kinds whatever their score."""
    out = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            value = score(text, kind, start, end)
            if rank < len(BASE) or value >= threshold:
                out.append((start, rank, end, kind, value))
    return [(kind, start, end, value) for start, _, end, kind, value in sorted(out)]


ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and entities (kind, start, end, score; code points) of each whole text, one row for each row.

    Null and empty texts have no entities; doc_id may be null; repeated rows repeat; texts of any
    length are scanned whole; an empty table gives none. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans(t.as_py(), threshold)] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, ENTITIES)], names=["doc_id", "entities"])

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, entities array<struct<kind:string,start:int,end:int,score:double>>")


def listed(entities: Column) -> Column:
    """kind:start:end of each entity, comma-joined."""
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")


def digests() -> list[Column]:
    """The counts, the digest of the base spans, all spans and their scores, from ``entities``."""
    of = lambda *kinds: F.filter("entities", lambda e: e["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    scores = F.array_join(F.transform("entities", lambda e: F.round(e["score"], 2).cast("string")), ",")
    return [*counts, F.sha2(listed(of(*BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("entities")).alias("spans"), scores.alias("scores")]
