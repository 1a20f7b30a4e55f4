"""Running totals over a whole table without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import free_prefix


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  A temporary one serves where the session names none and all
    runs on one machine; on a cluster that is an error."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veilspark-")
    return place.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the session's checkpoint folder: two uses of it see the same ranges, also after
    an executor is lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value up to and with each row, in the given total order: totals within ranges of rows, plus
    those of the ranges before."""
    own = free_prefix(df)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.withColumn(own + "v", value).repartitionByRange(ranges, *order).withColumn(own + "range", F.spark_partition_id()))
    within = Window.partitionBy(own + "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn(own + "in", F.sum(own + "v").over(within))
    before = Window.orderBy(own + "range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    tops = ranged.groupBy(own + "range").agg(F.sum(own + "v").alias(own + "s"))
    tops = tops.select(own + "range", F.coalesce(F.sum(own + "s").over(before), F.lit(0)).alias(own + "before"))
    return rows.join(F.broadcast(tops), own + "range").withColumn(name, F.col(own + "in") + F.col(own + "before")).drop(own + "range", own + "v", own + "in", own + "before")
