"""Sources and sinks of annotated corpora: JSON arrays, JSON lines, wrapped records, catalogs in Markdown, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from spanlake import consts
from spanlake.operators import records, validation

AXES = "struct<domain:string,format:string,difficulty:string,length:string,density:string,code_switching:string,language:string,adjacency:string,co_occurrence_pattern:string>"
RECORD = f"record_id bigint, mode string, axes {AXES}, target_entity_type string, target_pattern_id string, behavioral_frame string, text string, entities array<{records.ENTITY}>, entity_count int, generation_status string"


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_array(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Files that each hold one JSON array of records, with the file name in ``_source_file``. A file is one task, as
    the format can't be split; convert large corpora to lines or Parquet once."""
    frame = spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return frame.withColumn("_source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def read_lines(spark: SparkSession, paths: str | list[str], schema: str = RECORD, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. ``tolerant`` drops lines that don't parse (a truncated tail), else they fail."""
    return spark.read.schema(_schema(schema)).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(paths)


def read_wrapped(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Files that hold an array of records, or an object with the array under ``records``."""
    whole = spark.read.text(paths, wholetext=True)
    item = _schema(schema)
    bare = F.from_json("value", ArrayType(item))
    wrapped = F.from_json("value", StructType([StructField("records", ArrayType(item))]))["records"]
    listed = F.when(F.substring(F.ltrim("value"), 1, 1) == "[", bare).otherwise(wrapped)
    return whole.select(F.explode(listed).alias("r")).select("r.*")


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """record_index and raw of each line that isn't blank, for the schema validator. Indices are unique and ascend within a file."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("record_index"), F.col("value").alias("raw"))


def split_examples(cell):
    """Examples of a cell: cut at commas outside brackets and double quotes, trimmed, without empty ones. One fold over the characters."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.array(F.lit("")).alias("parts"))

    def step(a, c):
        opens, closes, quote = c.isin("(", "[", "{"), c.isin(")", "]", "}"), c == '"'
        depth = F.when(opens & ~a["quoted"], a["depth"] + 1).when(closes & ~a["quoted"], F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        cut = (c == ",") & (a["depth"] == 0) & ~a["quoted"]
        grown = F.concat(F.slice(a["parts"], F.lit(1), F.size(a["parts"]) - 1), F.array(F.concat(F.element_at(a["parts"], -1), c)))
        return F.struct(depth.alias("depth"), F.when(quote, ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"), F.when(cut, F.concat(a["parts"], F.array(F.lit("")))).otherwise(grown).alias("parts"))

    chars = F.filter(F.split(cell, ""), lambda c: c != "")
    return F.filter(F.transform(F.aggregate(chars, start, step, lambda a: a["parts"]), lambda c: F.trim(c)), lambda p: p != "")


def _catalog_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, at, line, head (the section's title) and part (``head`` or ``sweep``) of the lines of a catalog's sections."""
    whole = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    head, sweep = F.rlike("line", F.lit(r"^## Entity [0-9]+: \w+")), F.contains("line", F.lit("### Cross-Cutting")) | F.contains("line", F.lit("Cross-Cutting Consistency Sweep"))
    upto = Window.partitionBy("file").orderBy("at")  # a catalog has a few thousand lines
    marked = lines.withColumn("head", F.last(F.when(head, F.col("line")), ignorenulls=True).over(upto))
    return marked.withColumn("part", F.last(F.when(head, "head").when(sweep, "sweep"), ignorenulls=True).over(upto)).filter("head is not null")


def _cells(lines: DataFrame) -> DataFrame:
    """The table rows among lines, with their cells c."""
    row = F.rlike(F.trim("line"), F.lit(r"^\|.*\|$"))
    return lines.filter(row).withColumn("c", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c)))


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Patterns of Markdown catalogs: entity_number, entity_type, entity_category, pattern_id, name, description, examples_raw, examples, language_hint, dimensions and declared.

    Sections start with ``## Entity <n>: <type>``; patterns are table rows whose first cell is a pattern id. The rows of
    a section's sweep table (dimension, status, pattern ids) give its patterns their dimensions where the status is
    positive; ``declared`` is the number of patterns that the section claims.
    """
    lines = _catalog_lines(spark, paths)
    rows = _cells(lines.filter("part = 'head'")).filter((F.size("c") >= 4) & F.rlike(F.get("c", F.lit(0)), F.lit(r"^[A-Z]{2,6}-[0-9]{3}$")))
    cell = lambda i: F.get("c", F.lit(i))
    positive = F.contains(cell(1), F.lit("✓")) | F.lower(cell(1)).isin("yes", "true")
    title = F.lower(cell(0)).startswith("cross-cutting") | F.lower(cell(0)).startswith("dimension")
    swept = _cells(lines.filter("part = 'sweep'")).filter((F.size("c") >= 3) & positive & ~title)
    swept = swept.select("file", "head", "at", cell(0).alias("dimension"), F.explode(F.regexp_extract_all(cell(2), F.lit("[A-Z]{2,6}-[0-9]{3}"), F.lit(0))).alias("pattern_id"))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "dimension"))), lambda x: x["dimension"]))
    swept = swept.groupBy("file", "head", "pattern_id").agg(listed.alias("dimensions"))
    claimed = F.regexp_extract("line", r"\*\*Total patterns for [^:]+:\s*([0-9]+)\*\*", 1)
    declared = lines.filter(claimed != "").groupBy("file", "head").agg(F.min_by(claimed, "at").cast("int").alias("declared"))
    number, kind = (F.regexp_extract("head", r"^## Entity ([0-9]+): (\w+)", k) for k in (1, 2))
    category = F.create_map(*[F.lit(x) for c, own in consts.CATEGORIES.items() for t in own for x in (t, c)])
    tokens = [(language, token) for language, own in consts.LANGUAGE_TOKENS.items() for token in own]
    out = rows.select("file", "head", "at", number.cast("int").alias("entity_number"), kind.alias("entity_type"), *[cell(i).alias(n) for i, n in enumerate(("pattern_id", "name", "description", "examples_raw"))], split_examples(cell(3)).alias("examples"))
    out = out.withColumn("entity_category", F.coalesce(F.try_element_at(category, F.col("entity_type")), F.lit("Unknown"))).withColumn("language_hint", validation.language_hint(F.concat_ws(" ", "name", "description"), tokens))
    out = out.join(swept, ["file", "head", "pattern_id"], "left").join(declared, ["file", "head"], "left")
    return out.select("entity_number", "entity_type", "entity_category", "pattern_id", "name", "description", "examples_raw", "examples", "language_hint", F.coalesce("dimensions", F.expr("cast(array() as array<string>)")).alias("dimensions"), "declared")


def write_corpus(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Records without their provenance column, as Parquet or JSON lines; ``mode`` append adds to a corpus."""
    frame.drop("_source_file").write.mode(mode).format(kind).save(path)


def write_split(frame: DataFrame, path: str) -> None:
    """Records by outcome in one pass: the folders ``outcome=clean`` and ``outcome=failed`` (status not ok, or blank text)."""
    clean = (F.col("generation_status") == "ok") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    frame.withColumn("outcome", F.when(F.coalesce(clean, F.lit(False)), "clean").otherwise("failed")).write.partitionBy("outcome").json(path)


def write_report(frame: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    frame.coalesce(1).write.mode("overwrite").json(path)


def write_sheets(frame: DataFrame, path: str, annotators: list[str], answers: list[str]) -> None:
    """The same rows for each annotator, with blank columns for the answers, as CSV folders ``annotator=<name>``."""
    rows = frame.withColumn("annotator", F.explode(F.array(*map(F.lit, annotators))))
    rows.select("*", *[F.lit("").alias(a) for a in answers]).write.partitionBy("annotator").option("header", True).csv(path)


def concatenate(frames: list[DataFrame], expected: int | None = None) -> DataFrame:
    """Runs one after the other; fails where their rows aren't as many as expected."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    if expected is not None and (n := whole.count()) != expected:
        raise ValueError(f"{n} records, not {expected}")
    return whole


def not_done(todo: DataFrame, done: DataFrame, key: str = "record_index") -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
