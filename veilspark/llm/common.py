"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words, as a Java, RE2 and Python character class.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module_name: str) -> None:
    """Pickle functions of this module by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def process_cache(key, make: Callable):
    """One value for each key and Python process; worker processes are used again by later tasks."""
    import sys
    import types

    held = sys.modules.setdefault("_veilspark_process_cache", types.ModuleType("_veilspark_process_cache"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.  A temporary one serves where none is set and
    all runs on one machine; on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = process_cache("scratch", lambda: tempfile.mkdtemp(prefix="veilspark-"))
    return place.rstrip("/")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.  Unlike a cache it
    survives lost executors; the folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table of write_once that nothing reads any more."""
    spark = df.sparkSession
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/veilspark-" in f}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(place)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """The same function over batches; at its end the worker, which later tasks use again, gives memory back.  Unless it
    keeps them for its own kind, values of process_cache that earlier tasks left are dropped first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc
        import sys

        import pyarrow

        if not keeps:
            sys.modules.pop("_veilspark_process_cache", None)
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return run


#: Rows of a batch between the JVM and Python, at most: whole texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, whatever else the table has."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
