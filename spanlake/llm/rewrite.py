"""Texts rewritten by spans, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of its ascending, disjoint spans replaced: the pieces between them, joined by the mask."""
    bounds = F.concat(F.array(F.struct(F.lit(0).alias("end"), F.lit(0).alias("start"))), F.transform(spans, lambda s: F.struct(s["end"].alias("end"), s["start"].alias("start"))))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(bounds, stops, lambda b, stop: F.substring(text, b["end"] + 1, stop - b["end"])), mask)


def merged(spans: Column) -> Column:
    """Spans sorted by start, overlapping ones united."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    last = lambda acc: F.element_at(acc, -1)
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    grow = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    return F.aggregate(plain, none, lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))), grow(acc, s)).otherwise(F.concat(acc, F.array(s))))


def rewritten(found: DataFrame, text: Column) -> DataFrame:
    """The columns of ``row`` with another text, and its length where there is a column n_chars for it."""
    fields = found.schema["row"].dataType.fields
    made = found.select("row", text.alias("text"))
    length = lambda f: F.length("text").cast(f.dataType).alias(f.name)
    return made.select(*[F.col("text") if f.name == "text" else length(f) if f.name == "n_chars" else F.col("row").getField(f.name).alias(f.name) for f in fields])
