"""Files as a stream: a run that stops goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> StreamingQuery:
    """Apply a stateless ``work`` to each new JSON-lines file of ``source`` and append to Parquet at ``target``.

    All files there are handled, then the query ends; the next call takes only what came since. The file sink's log
    makes each row appear once, also after a lost executor or a killed run.
    """
    lines = spark.readStream.schema(StructType.fromDDL(schema)).option("maxFilesPerTrigger", files_per_batch).json(source)
    return work(lines).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_records(lines: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """First row of each key; state of keys older than the watermark is dropped, so it doesn't grow with the stream."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """n of each window and group; late rows count until the watermark passes."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
