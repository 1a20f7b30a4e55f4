"""Streams: the same operators over Structured Streaming, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..functions.scalars import redact
from ..operators.risk import as_text


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def class_counts(events: DataFrame, at: str, qis: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window, quasi-identifiers, n: class sizes by event time; state goes with the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), *[as_text(c).alias(c) for c in qis]).agg(F.count("*").alias("n"))


def pii_rates(texts: DataFrame, at: str, column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, rows, with_email, with_phone: how much personal data comes in."""
    t = F.col(column)
    return texts.withWatermark(at, late).groupBy(F.window(at, window).alias("window")).agg(F.count("*").alias("rows"), F.count_if(t.rlike(P.UNIVERSAL["EMAIL"])).alias("with_email"), F.count_if(t.rlike(P.UNIVERSAL["PHONE"])).alias("with_phone"))


def redacted(texts: DataFrame, column: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the redacted stream as Parquet, exactly once, until what is there is done."""
    out = texts.withColumn(column, redact(F.col(column)))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
