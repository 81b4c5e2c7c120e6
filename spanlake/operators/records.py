"""Operators on records that hold their entities as an array.

A record is one row, so grouping its entities, finding their places and completing them needs no shuffle: texts stay
where they are, and rows are exploded last. ``records`` has record_id, text and entities (``ENTITY`` structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import consts
from spanlake.functions import text as T

#: A typed entity.
ENTITY = "struct<entity_type:string,entity_string:string,mention_index:int,disclosed:boolean,disclosure_form:string,sensitivity_tier:string>"
_OWN = ("entity_type", "entity_string", "mention_index", "disclosed", "disclosure_form", "sensitivity_tier")


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def tier(entity_type: Column) -> Column:
    """Sensitivity tier; MEDIUM for unknown types."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in consts.TIERS.items() for x in kv]), entity_type), F.lit("MEDIUM"))


def proposed(text: Column) -> Column:
    """Entities that the patterns propose, in the order of types and matches, with running mention indices."""

    def kind(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        earlier = lambda s, i: F.size(F.filter(F.slice(found, F.lit(1), i), lambda o: o == s))
        return F.transform(found, lambda s, i: F.struct(F.lit(name).alias("entity_type"), s.alias("entity_string"), i.alias("pos"), earlier(s, i).alias("mention_index")))

    return F.concat(*[kind(t, p) for t, p in consts.PROPOSALS.items()])


def exploded(records: DataFrame, *more: str) -> DataFrame:
    """One row for each entity: record_id, ``more`` columns of the record, pos and the entity's fields."""
    # outer: from an inner explode the optimizer infers a filter on the array, which works its expression out a second time
    each = records.select("record_id", *more, F.posexplode_outer("entities").alias("pos", "e")).filter(F.col("pos").isNotNull())
    return each.select("record_id", *more, "pos", "e.*")


def groups(entities: Column) -> Column:
    """Distinct (entity_type, entity_string) in the order of their first entities."""
    return F.array_distinct(F.transform(entities, lambda e: F.struct(e["entity_type"], e["entity_string"])))


def members(entities: Column, group: Column) -> Column:
    return F.filter(entities, lambda e: e["entity_type"].eqNullSafe(group["entity_type"]) & e["entity_string"].eqNullSafe(group["entity_string"]))


def _named(entities: Column) -> Column:
    return F.filter(groups(entities), lambda g: F.length(g["entity_string"]) > 0)


def repaired(text: Column, entities: Column) -> Column:
    """Entities with start, end and repair_status, by place.

    Each (type, string) group has one entity for each occurrence of its string, cloned from its first entity whatever its
    index and numbered from 0: ``ok`` where it had fewer, else ``no_change``. A string that the text lacks keeps its
    entities, without offsets and last; groups without a string vanish.
    """

    def placed(e: Column, index: Column, start: Column, end: Column, status: Column) -> Column:
        own = [index.alias(c) if c == "mention_index" else e[c].alias(c) for c in _OWN]
        return F.struct(*own, start.alias("start"), end.alias("end"), status.alias("repair_status"))

    none = F.lit(None).cast("int")

    def whole(x: Column) -> Column:
        # one-row arrays, so that inner lambdas read the groups instead of working them out for each place
        counts = F.transform(x["held"], lambda h, k: F.size(F.filter(x["places"], lambda p: p["which"] == k)))
        return F.flatten(F.transform(F.array(F.zip_with(x["held"], counts, lambda h, n: F.struct(h["own"].alias("own"), h["e"].alias("e"), n.alias("n"), F.length(h["e"]["entity_string"]).alias("size"), F.when(F.size(h["own"]) < n, "ok").otherwise("no_change").alias("status")))), lambda gs: listed(x, gs)))

    def listed(x: Column, gs: Column) -> Column:
        at = lambda p: F.get(gs, p["which"])
        found = F.transform(x["places"], lambda p: placed(at(p)["e"], p["nth"], p["at"], p["at"] + at(p)["size"], at(p)["status"]))
        lost = F.transform(F.filter(gs, lambda g: g["n"] == 0), lambda g: F.transform(g["own"], lambda e: placed(e, e["mention_index"], none, none, F.lit("string_not_in_text"))))
        return F.concat(found, F.flatten(lost))

    named = _named(entities)
    held = F.transform(named, lambda g: F.struct(members(entities, g).alias("own")))
    held = F.transform(held, lambda h: F.struct(h["own"].alias("own"), F.get(h["own"], F.lit(0)).alias("e")))
    places = T.merged_occurrences(F.coalesce(text, F.lit("")), F.transform(named, lambda g: g["entity_string"]))
    return F.flatten(F.transform(F.array(F.struct(held.alias("held"), places.alias("places"))), whole))


def repair(records: DataFrame) -> DataFrame:
    """``records`` with repaired entities."""
    return records.withColumn("entities", repaired(F.col("text"), F.col("entities")))


def repair_sums(records: DataFrame) -> DataFrame:
    """Of each record: entities before and after repair, groups that grew, entities they gained, and entities left without offsets."""
    named = _named(F.col("entities"))
    counts = T.occurrence_counts(F.coalesce("text", F.lit("")), F.transform(named, lambda g: g["entity_string"]))
    sizes = F.zip_with(F.transform(named, lambda g: F.size(members(F.col("entities"), g))), counts, lambda m, n: F.struct(m.alias("m"), n.alias("n")))
    held = records.select("record_id", "entities", sizes.alias("sizes"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    more = F.filter(F.transform("sizes", lambda s: s["n"] - s["m"]), lambda d: d > 0)
    after = total(F.transform("sizes", lambda s: F.when(s["n"] > 0, s["n"]).otherwise(s["m"])))
    lost = total(F.transform("sizes", lambda s: F.when(s["n"] > 0, 0).otherwise(s["m"])))
    return held.select("record_id", F.size("entities").alias("original_entities"), after.alias("repaired_entities"), F.size(more).alias("groups_expanded"), total(more).alias("entities_added"), lost.alias("offset_mismatches"))


def repair_totals(records: DataFrame) -> DataFrame:
    """The sums of ``repair_sums`` over a corpus, in one row."""
    sums = repair_sums(records)
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums.columns[1:]])


def mention_groups(text: Column, entities: Column) -> Column:
    """Of each (type, string) group with a string: m mentions, whether indices are 0..m-1 and the text holds m of them apart, and whether it holds more."""

    def told(g: Column) -> Column:
        own = members(entities, g)
        indices = F.array_sort(F.transform(own, lambda e: e["mention_index"]))
        m = F.size(own)
        apart = T.count_apart(F.coalesce(text, F.lit("")), g["entity_string"])
        whole = (indices == F.sequence(F.lit(0), m - 1)) & (apart == m)
        return F.struct(g["entity_type"], g["entity_string"], m.cast("long").alias("m"), F.coalesce(whole, F.lit(False)).alias("complete"), (apart > m).alias("missing_mentions"))

    return F.transform(F.filter(groups(entities), lambda g: F.length(g["entity_string"]) > 0), told)


def multi_mention(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.explode(mention_groups(F.col("text"), F.col("entities"))).alias("g")).select("record_id", "g.*")


def added_mentions(text: Column, entities: Column) -> Column:
    """Entities that give each string as many mentions as the text holds apart: clones of the string's first entity, of whatever type, with ascending indices."""

    # arrays of structs, so that inner lambdas read a string's values instead of working them out for each new mention
    strings = F.filter(F.array_distinct(F.transform(entities, lambda e: e["entity_string"])), lambda s: F.length(s) > 0)
    held = F.transform(strings, lambda s: F.struct(F.filter(entities, lambda e: e["entity_string"] == s).alias("own"), T.count_apart(F.coalesce(text, F.lit("")), s).alias("apart")))
    short = F.filter(held, lambda g: g["apart"] > F.size(g["own"]))
    top = lambda own: F.coalesce(F.array_max(F.transform(own, lambda e: F.coalesce(e["mention_index"], F.lit(0)))), F.lit(0))
    firsts = F.transform(short, lambda g: F.struct(F.get(g["own"], F.lit(0)).alias("e"), top(g["own"]).alias("top"), (g["apart"] - F.size(g["own"])).cast("int").alias("n")))
    return F.flatten(F.transform(firsts, lambda g: F.transform(F.sequence(F.lit(1), g["n"]), lambda i: g["e"].withField("mention_index", (g["top"] + i).cast("int")))))


def _listed(entities: Column, held: Column, made) -> Column:
    """A list completed by one row for each distinct string that it lacks; the first entity of a string gives the type."""
    strings = F.filter(F.array_distinct(F.transform(entities, lambda e: e["entity_string"])), lambda s: (F.length(s) > 0) & ~F.exists(held, lambda d: d["entity_string"] == s))
    kind = lambda s: F.get(F.filter(entities, lambda e: e["entity_string"] == s), F.lit(0))["entity_type"]
    return F.concat(held, F.transform(strings, lambda s: made(kind(s), s)))


CLASSES = "struct<entity_type:string,entity_string:string,identifier_class:string>"
POLICIES = "struct<entity_type:string,entity_string:string,policy:string>"


def postprocessed(records: DataFrame) -> DataFrame:
    """``records`` after remapping types, filling tiers, adding mentions and completing both identifier lists, with entity_count and ``sums``.

    ``records`` also has direct_indirect_classification and disclosure_policy (null: empty). ``sums`` has remapped_types,
    dropped_entities, tier_filled, mentions_added and unknown_types (an array).
    """
    from spanlake.operators import validation

    listed = F.coalesce("entities", empty(ENTITY))
    moved = F.transform(listed, lambda e: F.struct(e.alias("e"), validation.remapped(e["entity_type"]).alias("t")))
    held = records.withColumn("__moved", moved)
    kept = F.transform(F.filter("__moved", lambda x: x["t"].isNotNull()), lambda x: x["e"].withField("entity_type", x["t"]))
    held = held.withColumn("__kept", kept)
    bare = lambda e: F.coalesce(e["sensitivity_tier"], F.lit("")) == ""
    held = held.withColumn("__full", F.transform("__kept", lambda e: e.withField("sensitivity_tier", validation.filled_tier(e["sensitivity_tier"], e["entity_type"]))))
    held = held.withColumn("__more", added_mentions(F.col("text"), F.col("__full")))
    held = held.withColumn("__all", F.concat("__full", "__more"))
    changed = F.size(F.filter("__moved", lambda x: x["t"].isNotNull() & ~x["t"].eqNullSafe(x["e"]["entity_type"])))
    known = [F.lit(t) for t in consts.TIERS]
    sums = F.struct(
        changed.alias("remapped_types"),
        (F.size("__moved") - F.size("__kept")).alias("dropped_entities"),
        F.size(F.filter("__kept", bare)).alias("tier_filled"),
        F.size("__more").alias("mentions_added"),
        F.filter(F.transform("__kept", lambda e: e["entity_type"]), lambda t: ~t.isin(*known)).alias("unknown_types"),
    )
    direct = lambda t: F.when(F.coalesce(t.isin(*(k for k, v in consts.TIERS.items() if v != "LOW")), F.lit(False)), "direct").otherwise("indirect")
    # added mentions are clones, so the strings and their first entities are those of ``__full``
    classes = _listed(F.col("__full"), F.coalesce("direct_indirect_classification", empty(CLASSES)), lambda t, s: F.struct(t.alias("entity_type"), s.alias("entity_string"), direct(t).alias("identifier_class")))
    policies = _listed(F.col("__full"), F.coalesce("disclosure_policy", empty(POLICIES)), lambda t, s: F.struct(t.alias("entity_type"), s.alias("entity_string"), F.lit("may_disclose").alias("policy")))
    out = held.withColumns({"direct_indirect_classification": classes, "disclosure_policy": policies, "entities": F.col("__all"), "entity_count": F.size("__all"), "sums": sums})
    return out.drop("__moved", "__kept", "__full", "__more", "__all")


def postprocess_totals(processed: DataFrame) -> DataFrame:
    """stat and n: the sums of ``postprocessed`` over a corpus, and each unknown type's count as ``unknown:type``."""
    names = ("remapped_types", "dropped_entities", "tier_filled", "mentions_added")
    cells = F.concat(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"sums.{c}").cast("long").alias("n")) for c in names]), F.transform("sums.unknown_types", lambda t: F.struct(F.concat(F.lit("unknown:"), t).alias("stat"), F.lit(1).cast("long").alias("n"))))
    return processed.select(F.explode(cells).alias("c")).groupBy("c.stat").agg(F.sum("c.n").alias("n"))


def fixed_offsets(text: Column, entities: Column) -> Column:
    """Entities (entity_type, entity_string, start, end) whose slice is their string, or else moved to its first place; others go, and so do repeated ones."""
    body = F.coalesce(text, F.lit(""))
    size = lambda e: F.length(e["entity_string"])
    right = lambda e: F.coalesce((e["start"] >= 0) & (e["end"] - e["start"] == size(e)) & (F.substring(body, e["start"] + 1, e["end"] - e["start"]) == e["entity_string"]), F.lit(False))
    at = lambda e: F.position(e["entity_string"], body) - 1
    moved = lambda e: F.struct(e["entity_type"], e["entity_string"], at(e).alias("start"), (at(e) + size(e)).alias("end"))
    plain = lambda e: F.struct(e["entity_type"], e["entity_string"], e["start"].alias("start"), e["end"].alias("end"))
    held = F.filter(entities, lambda e: right(e) | F.coalesce((size(e) > 0) & F.contains(body, e["entity_string"]), F.lit(False)))
    return F.array_distinct(F.transform(held, lambda e: F.when(right(e), plain(e)).otherwise(moved(e))))
