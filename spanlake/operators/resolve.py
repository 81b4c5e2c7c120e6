"""Resolving strings to places and reconciling the spans of several models.

The state of claimed places makes these sequential within a record, so each record is one Arrow value worked on by plain
Python; records are independent, and no shuffle is needed. A span is a dict of start, end, type and text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Collection, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,type:string,text:string,source:string,agreement:int>>"
_EAST = ("CJK", "HANGUL", "HIRAGANA", "KATAKANA")


def _east_asian(c: str) -> bool:
    name = unicodedata.name(c, "")
    return any(script in name for script in _EAST)


def _blocks(text: str, near: int, beyond: int) -> bool:
    """Whether the character at ``near``, outside a match, ties it to a larger word, address or domain."""
    if not 0 <= near < len(text) or _east_asian(text[near]):
        return False
    c = text[near]
    return c.isalnum() or c == "@" or (c == "." and 0 <= beyond < len(text) and text[beyond].isalnum())


def free_standing(text: str, start: int, end: int) -> bool:
    """Whether [start, end) isn't part of a larger word, e-mail address or domain."""
    return not _blocks(text, start - 1, start - 2) and not _blocks(text, end, end + 1)


class Claimed:
    """Places taken so far, as sorted disjoint intervals in a bitmap of the text."""

    def __init__(self, text: str, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.map = bytearray(len(text))
        for s, e in spans:
            self.take(s, e)

    def free(self, start: int, end: int) -> bool:
        return self.map.find(1, start, end) < 0

    def take(self, start: int, end: int) -> None:
        self.map[start:end] = b"\x01" * (end - start)


def places(text: str, value: str, claimed: Claimed) -> list[tuple[int, int]]:
    """Free, free-standing matches in order; without any match in this case, those that differ in case."""
    if not value:
        return []
    pattern = re.escape(value)
    found = [m.span() for m in re.finditer(pattern, text)] or [m.span() for m in re.finditer(pattern, text, re.IGNORECASE)]
    return [(s, e) for s, e in found if free_standing(text, s, e) and claimed.free(s, e)]


def without_overlaps(spans: list[dict]) -> list[dict]:
    """Spans in order of start; of two that overlap the longer stays, else the earlier."""
    out: list[dict] = []
    for span in spans:
        if not out or span["start"] >= out[-1]["end"]:
            out.append(span)
        elif span["end"] - span["start"] > out[-1]["end"] - out[-1]["start"]:
            out[-1] = span
    return out


def layers(spans: list[dict]) -> list[list[dict]]:
    """Spans, which come by start, dealt to as few lists without overlaps as that order allows; the first holds the first span."""
    out: list[list[dict]] = []
    for span in spans:
        home = next((own for own in out if own[-1]["end"] <= span["start"]), None)
        if home is None:
            out.append([span])
        else:
            home.append(span)
    return out


def blanked(text: str, spans: list[dict]) -> str:
    """The text with spaces for all that ``spans``, in order and without overlaps, don't cover."""
    parts, at = [], 0
    for span in spans:
        parts += [" " * (span["start"] - at), text[span["start"] : span["end"]]]
        at = span["end"]
    return "".join([*parts, " " * (len(text) - at)])


def greedy(text: str, wanted: list[tuple[str, str]], claimed: Claimed | None = None, every: bool = False) -> list[dict]:
    """Places of (type, value) pairs, longest values first, each claiming what it takes.

    Each pair takes its next free place; with ``every``, distinct pairs take all of theirs.
    """
    claimed = claimed or Claimed(text)
    queue = sorted(dict.fromkeys(wanted) if every else wanted, key=lambda w: -len(w[1]))
    out = []
    for kind, value in queue:
        for s, e in places(text, value, claimed)[: None if every else 1]:
            if claimed.free(s, e):
                claimed.take(s, e)
                out.append({"start": s, "end": e, "type": kind, "text": text[s:e], "source": "greedy"})
    return sorted(out, key=lambda x: x["start"])


def containment(a: str, b: str) -> float:
    """1 where one text holds the other, else the shorter's characters that occur in the longer over the longer's length."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    return 1.0 if short in long else sum(c in long for c in short) / len(long)


def agree(a: dict, b: dict, mode: str = "overlap", tolerance: int = 2, alike: float = 0.8) -> bool:
    """Whether two spans of one type mean the same mention: equal; overlapping and alike; or (fuzzy) near and alike."""
    if (a["start"], a["end"]) == (b["start"], b["end"]):
        return True
    gap = max(a["start"], b["start"]) - min(a["end"], b["end"])
    near = gap < 0 if mode == "overlap" or not tolerance else gap <= tolerance
    return mode != "exact" and near and containment(a["text"], b["text"]) >= alike


def vote(models: list[list[dict]], least: int = 2, mode: str = "overlap", tolerance: int = 2, alike: float = 0.8) -> list[dict]:
    """Spans that at least ``least`` models have. A span joins the first group of its type with a span it agrees with; a group's longest stands for it."""
    groups: dict[str, list[list[tuple[int, dict]]]] = {}
    for model, spans in enumerate(models):
        for span in spans:
            own = groups.setdefault(span["type"], [])
            home = next((g for g in own if any(agree(span, other, mode, tolerance, alike) for _, other in g)), None)
            if home is None:
                own.append(home := [])
            home.append((model, span))
    out = []
    for group in (g for own in groups.values() for g in own):
        voters = len({m for m, _ in group})
        if voters >= least:
            out.append({**max((s for _, s in group), key=lambda s: s["end"] - s["start"]), "source": "span_consensus", "agreement": voters})
    return without_overlaps(sorted(out, key=lambda s: s["start"]))


def sweep(text: str, candidates: list[tuple[str, str]], existing: list[dict], shortest: int = 3) -> list[dict]:
    """Existing spans and all free, free-standing places of further candidates of at least ``shortest`` characters, longest first."""
    claimed = Claimed(text, ((s["start"], s["end"]) for s in existing))
    wanted = {v.strip(): t for t, v in reversed(candidates) if len(v.strip()) >= shortest}
    added = greedy(text, [(t, v) for v, t in sorted(wanted.items())], claimed, every=True)
    return sorted([*existing, *({**s, "source": "string_match"} for s in added)], key=lambda s: s["start"])


def context_variants(context: str) -> list[str]:
    """The context as given, with real line breaks and tabs written as escapes, and with escapes made real."""
    pairs = (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"))
    escaped, real = context, context
    for char, written in pairs:
        escaped, real = escaped.replace(char, written), real.replace(written, char)
    return list(dict.fromkeys((context, escaped, real)))


def in_context(text: str, value: str, context: str, claimed: Claimed) -> tuple[int, int] | None:
    """The first free place of ``value`` inside a place of its context, in this case first, then in any."""
    if not value or not context:
        return None
    for flags in (0, re.IGNORECASE):
        for variant in context_variants(context):
            for outer in re.finditer(re.escape(variant), text, flags):
                for inner in re.finditer(re.escape(value), text[outer.start() : outer.end()], flags):
                    s, e = outer.start() + inner.start(), outer.start() + inner.end()
                    if claimed.free(s, e) and free_standing(text, s, e):
                        return s, e
    return None


def model_spans(text: str, entities: list[dict]) -> list[dict]:
    """Spans of one model's entities (type, text, context): first by their contexts, the rest greedily."""
    text = unicodedata.normalize("NFC", text)
    claimed, out, rest = Claimed(text), [], []
    for e in entities:
        value = unicodedata.normalize("NFC", e.get("text") or "")
        at = in_context(text, value, unicodedata.normalize("NFC", e.get("context") or ""), claimed)
        if at:
            claimed.take(*at)
            out.append({"start": at[0], "end": at[1], "type": e["type"], "text": text[at[0] : at[1]], "source": "context"})
        else:
            rest.append((e["type"], value))
    return without_overlaps(sorted(out + greedy(text, rest, claimed), key=lambda s: s["start"]))


def reconcile(existing: list[dict], consensus: list[dict], ratio: float = 0.8, least: int = 2) -> list[dict]:
    """Consensus spans added where they cover nothing yet; one that overlaps a span of like length overrides its type."""
    out = [dict(s) for s in existing]
    for span in consensus:
        hit = next((s for s in out if s["start"] < span["end"] and span["start"] < s["end"]), None)
        if hit is None:
            out.append(dict(span))
            continue
        sizes = sorted((hit["end"] - hit["start"], span["end"] - span["start"]))
        if hit["type"] != span["type"] and sizes[0] >= ratio * sizes[1] and (span.get("agreement") or 0) >= least:
            hit.update(type=span["type"], source="consensus_override")
    return without_overlaps(sorted(out, key=lambda s: s["start"]))


def merged(models: list[list[dict]], least: int = 2) -> list[dict]:
    """The simple vote: each span not yet taken gathers later spans of its type and other models that overlap it; a group of ``least`` models gives its longest span. Overlaps stay."""
    spans = [{**s, "model": m} for m, own in enumerate(models) for s in own]
    taken: set[int] = set()
    out = []
    for i, seed in enumerate(spans):
        if i in taken:
            continue
        near = [j for j in range(i + 1, len(spans)) if j not in taken and spans[j]["type"] == seed["type"] and spans[j]["model"] != seed["model"] and seed["start"] < spans[j]["end"] and spans[j]["start"] < seed["end"]]
        taken.update(near)
        group = [seed, *(spans[j] for j in near)]
        if len({s["model"] for s in group}) >= least:
            best = max(group, key=lambda s: s["end"] - s["start"])
            out.append({k: best[k] for k in ("start", "end", "type", "text")})
    return sorted(out, key=lambda s: s["start"])


def reconciled(text: str, markers: list[dict], matches: list[dict], wanted: list[dict], agreed: dict[tuple[str, str], int] | None = None, every: bool = False, ratio: float = 0.8, least: int = 2) -> list[dict]:
    """Marker spans, string matches and consensus entities as one list without overlaps.

    ``wanted`` has type, text and perhaps context, start and end. Entities with places keep them; the others are looked
    for by context, longest first, and the rest greedily where nothing is claimed. A place that overlaps a span gives it
    its type where the lengths are alike and ``agreed`` (type, lower-case text) counts enough models; a free one is added.
    """
    text = unicodedata.normalize("NFC", text or "")
    spans = [{"source": "marker", **s} for s in markers] + [dict(s) for s in matches]
    claimed = Claimed(text, ((s["start"], s["end"]) for s in spans))
    queue = [{**w, "value": unicodedata.normalize("NFC", w["text"].strip())} for w in wanted]
    queue = sorted((w for w in queue if w["value"]), key=lambda w: -len(w["value"]))
    by_context, resolved, rest = Claimed(text), [], []
    for w in queue:
        at = (w["start"], w["end"]) if w.get("start") is not None and w.get("end") is not None else None
        at = at or in_context(text, w["value"], unicodedata.normalize("NFC", w.get("context") or ""), by_context)
        if at:
            by_context.take(*at)
            resolved.append((w["type"], *at, w["text"]))
        else:
            rest.append((w["type"], w["value"]))
    free = Claimed(text, [*((s["start"], s["end"]) for s in spans), *((s, e) for _, s, e, _ in resolved)])
    resolved += [(s["type"], s["start"], s["end"], s["text"]) for s in greedy(text, rest, free, every)]
    for kind, start, end, value in resolved:
        if not free_standing(text, start, end):
            continue
        hit = next((s for s in spans if s["start"] < end and start < s["end"]), None)
        if hit is None and claimed.free(start, end):
            spans.append({"start": start, "end": end, "type": kind, "text": text[start:end], "source": "consensus"})
            claimed.take(start, end)
        elif hit is not None and hit["type"] != kind:
            sizes = sorted((end - start, hit["end"] - hit["start"]))
            if sizes[0] > 0 and sizes[0] >= ratio * sizes[1] and (agreed or {}).get((kind, value.lower()), 0) >= least:
                hit.update(type=kind, source="consensus_override")
    return without_overlaps(sorted(spans, key=lambda s: s["start"]))


def parse_response(content: str | None) -> dict:
    """The JSON object of a model's answer: bare, fenced, escaped up to three times, or the outermost braces; else empty."""
    value: object = content or ""
    for _ in range(4):
        if isinstance(value, dict):
            return value
        if isinstance(value, list):
            return {"entities": value}
        body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", str(value))
        cuts = [body, *(body[body.find(a) : body.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= body.find(a) < body.rfind(b))]
        for cut in cuts:
            try:
                value = json.loads(cut)
                break
            except ValueError:
                continue
        else:
            return {}
    return value if isinstance(value, dict) else {}


def listed_entities(answer: dict, labels: Collection[str] | None = None) -> list[dict]:
    """type, text and context from {"entities": [...]}, from {"entities_extracted": {type: ...}} or from {type: [string or {text, context}]}.

    With ``labels`` (upper-case) the last form's types are folded to upper case, and types beyond these labels go.
    """
    inner = answer.get("entities_extracted")
    if isinstance(answer.get("entities"), list):
        rows = [(e.get("entity_type") or e.get("type"), e) for e in answer["entities"] if isinstance(e, dict)]
    else:
        told = inner if isinstance(inner, dict) else answer
        if labels is not None and told is answer:
            told = {t.upper(): own for t, own in answer.items() if t.upper() in labels and isinstance(own, (list, str))}
        rows = [(t, e) for t, own in told.items() for e in (own if isinstance(own, list) else [own])]
    out = []
    for kind, e in rows:
        value = e if isinstance(e, str) else (e.get("text") or e.get("entity_string")) if isinstance(e, dict) else None
        if isinstance(kind, str) and isinstance(value, str) and value.strip():
            out.append({"type": kind, "text": value.strip(), "context": e.get("context") if isinstance(e, dict) else None})
    return out


def responses_to_spans(text: str, responses: dict[str, str], least: int = 2, labels: Collection[str] | None = None) -> list[dict]:
    """The voted spans of several models' raw answers on one text."""
    return vote([model_spans(text, listed_entities(parse_response(r), labels)) for _, r in sorted(responses.items())], least)


def tagged_spans(labels: list[str | None], offsets: list[tuple[int, int]]) -> list[dict]:
    """Spans of BIOES tags over token offsets.

    Tokens without width are passed over; a null tag is O; a bare label means I. A tag that can't go on with the open
    span opens its own: B and S close what is open, I and E of another label take its place.
    """
    out: list[dict] = []
    open_span: dict | None = None
    for label, (start, end) in zip(labels, offsets, strict=True):
        if start == end:
            continue
        tag, _, kind = (label or "O").partition("-")
        tag, kind = (tag, kind) if kind or tag == "O" else ("I", tag)
        goes_on = tag in "IE" and open_span is not None and open_span["type"] == kind
        if open_span is not None and tag in "OBS":
            out.append(open_span)
            open_span = None
        if goes_on:
            open_span["end"] = end
        elif tag in ("B", "I", "E", "S"):
            open_span = {"start": start, "end": end, "type": kind}
        if tag in ("E", "S"):
            out.append(open_span)
            open_span = None
    return out + ([open_span] if open_span else [])


def suppressed(spans: list[dict], iou: float = 0.7) -> list[dict]:
    """Without spans that meet a kept one of their type by ``iou`` or more; the higher score stays."""
    kept: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["start"], -s["score"])):
        for i, other in enumerate(kept):
            shared = max(0, min(span["end"], other["end"]) - max(span["start"], other["start"]))
            whole = span["end"] - span["start"] + other["end"] - other["start"] - shared
            if span["type"] == other["type"] and shared and shared >= iou * whole:
                if span["score"] > other["score"]:
                    kept = [*kept[:i], *kept[i + 1 :], span]
                break
        else:
            kept.append(span)
    return sorted(kept, key=lambda s: s["start"])


def _full(span: dict) -> dict:
    return {k: span.get(k) for k in ("start", "end", "type", "text", "source", "agreement")}


def per_record(work: Callable[..., list[dict]], *inputs: Column) -> Column:
    """``work`` on each row's values of ``inputs`` (structs as dicts), as an array of spans."""
    fields = [("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("source", pa.string()), ("agreement", pa.int32())]
    kind = pa.list_(pa.struct(fields))

    @F.arrow_udf(SPAN)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([[_full(s) for s in work(*row.values())] for row in rows.to_pylist()], kind)

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]))
