"""Readers by file type.  Every one can number the rows of a file (``_ord``), since reports depend on their order."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from . import delimited

ORDER = "_ord"


def clean_path(path: str) -> str:
    """Without quotes and escaped blanks, with the home folder."""
    path = path.strip().strip("'\"").replace("\\ ", " ")
    return os.path.expanduser(path) if path.startswith("~") else path


def read(spark: SparkSession, path: str, *, header: bool = True, ordered: bool = False, sheet: str | int = 0, bound: dict | None = None) -> DataFrame:
    """A table by its suffix: csv, tsv, txt, json, parquet, orc, xlsx, or the name of a view or of a variable in
    ``bound`` that is a DataFrame of Spark or pandas.

    Raises ValueError for other suffixes and FileNotFoundError if nothing is there."""
    path = clean_path(path)
    if bound and path in bound:
        given = bound[path]
        df = given if isinstance(given, DataFrame) else spark.createDataFrame(given)
        return with_order(df) if ordered and ORDER not in df.columns else df
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if not kind:
        if spark.catalog.tableExists(path):
            return spark.table(path)
        raise ValueError(f"neither a view nor a known file type: {path}")
    if kind not in READERS:
        raise ValueError(f"unknown file type {kind}; known are {', '.join(sorted(READERS))}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = READERS[kind](spark, path, header, sheet)
    if kind in (".csv", ".tsv", ".txt") and ORDER in df.columns:  # the scanner has numbered the rows
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != ORDER], ORDER) if ordered else df.drop(ORDER)
    return with_order(df) if ordered and ORDER not in df.columns else df


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def with_order(df: DataFrame) -> DataFrame:
    """df with _ord: 0, 1, ... in the order of files, by name, and of rows within them.

    Rows of a file know their split and their place in it, so splits are counted first and no row moves.  A table that is
    no file (a range, a list) is numbered in the order of its partitions."""
    own = free_prefix(df)
    rows = df.withColumn(own + "place", F.monotonically_increasing_id())
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias(own + "file"), F.col("_metadata.file_block_start").alias(own + "part"), F.monotonically_increasing_id().alias(own + "place"))
        keys = [own + "file", own + "part"]
    except AnalysisException:
        rows = rows.withColumn(own + "part", F.shiftright(own + "place", 33))
        keys = [own + "part"]
    # the rows of a split have consecutive places
    splits = rows.groupBy(*keys).agg(F.count("*").alias(own + "n"), F.min(own + "place").alias(own + "first"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.select(*keys, (F.coalesce(F.sum(own + "n").over(before), F.lit(0)) - F.col(own + "first")).alias(own + "shift"))
    rows = rows.join(starts, keys)
    return rows.withColumn(ORDER, F.col(own + "shift") + F.col(own + "place")).drop(*keys, own + "place", own + "shift")


def _csv(spark: SparkSession, path: str, header: bool, _sheet) -> DataFrame:
    """UTF-8, or Latin-1 where that fails; longer rows are cut, shorter ones filled with null.  Files with quoted line breaks, and
    reports (without a header), go through the scanner of :mod:`delimited`; the others through Spark's reader."""
    sep = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    text = spark.read.option("lineSep", "\n").text(path)
    bad, broken = text.agg(F.max(~F.is_valid_utf8("value")), F.max(F.col("value").contains('"') & F.regexp_replace("value", "\r$", "").rlike("(?s)" + delimited.opens(sep)))).first()
    encoding = "ISO-8859-1" if bad else "UTF-8"
    if not header:
        return delimited.grid(spark, path, sep, encoding)
    if broken:
        return delimited.typed(delimited.grid(spark, path, sep, encoding, header=True))
    return spark.read.options(sep=sep, header=True, mode="PERMISSIVE", inferSchema=True, enforceSchema=True, escape='"', encoding=encoding).csv(path)


def _json(spark: SparkSession, path: str, _header: bool, _sheet) -> DataFrame:
    """Records, a list of them, or one object of objects, whose keys become item_key."""
    text = spark.read.text(path, wholetext=True)
    first = text.select(F.substring(F.trim("value"), 1, 1).alias("c"), F.size(F.json_object_keys("value")).alias("n")).first()
    if first and first["c"] == "{":
        try:
            nested = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("item_key", "v"))
            if not nested.where(~F.trim("v").startswith("{")).limit(1).count() and nested.limit(1).count():
                keys = [r[0] for r in nested.select(F.explode(F.json_object_keys("v"))).distinct().orderBy(F.col("col")).collect()]
                return nested.select("item_key", *[F.get_json_object("v", f"$['{k}']").alias(k) for k in keys])
        except Exception as e:  # noqa: BLE001
            if "PARSE" not in str(e).upper():
                raise
    return spark.read.option("multiLine", first is not None and first["c"] == "[").json(path)


def _parquet(spark: SparkSession, path: str, _header: bool, _sheet) -> DataFrame:
    return spark.read.parquet(path)


def _orc(spark: SparkSession, path: str, _header: bool, _sheet) -> DataFrame:
    return spark.read.orc(path)


def _xlsx(spark: SparkSession, path: str, header: bool, sheet: str | int) -> DataFrame:
    """A sheet by name or number of one workbook or of a folder of them: _ord, then "0", "1", ... as text.  A workbook is opened by
    the task that has read it; none goes through the driver."""
    from . import workbook as book

    number = str(sheet)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = enumerate(book.rows_of(data.as_py(), number))
                while some := list(itertools.islice(found, 5000)):
                    at, cells = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([place] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["path", "at", "cells"])

    grid = books(spark, path).mapInArrow(rows, "path string, at long, cells array<string>")
    files = grid.groupBy("path").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("width"))
    cells = [F.get("cells", F.lit(i)).alias(str(i)) for i in range(files.agg(F.max("width")).first()[0] or 0)]
    if len(books(spark, path).inputFiles()) < 2:
        return grid.select(F.col("at").alias(ORDER), *cells)
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return grid.join(starts, "path").select((F.col("start") + F.col("at")).alias(ORDER), *cells)


def books(spark: SparkSession, path: str) -> DataFrame:
    """path, content: read by Spark, so any store will do."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sheets of a workbook, headerless, by name; a file of another type is one sheet."""
    if not path.lower().endswith((".xlsx", ".xlsm")):
        return {os.path.splitext(os.path.basename(path))[0]: read(spark, path)}
    from . import workbook as book

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for data in batch.column(1) for n in book.sheet_names(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["at", "name"])

    sheets = [r["name"] for r in books(spark, path).mapInArrow(names, "at int, name string").orderBy("at").collect()]
    return {name: _xlsx(spark, path, False, name) for name in dict.fromkeys(sheets)}


READERS = {".csv": _csv, ".tsv": _csv, ".txt": _csv, ".json": _json, ".parquet": _parquet, ".orc": _orc, ".xlsx": _xlsx, ".xlsm": _xlsx}


def header_row(df: DataFrame, order: str = ORDER, scan: int = 30) -> tuple[int, list[str]]:
    """The place of a grid's header and its names: the first row of ``scan`` with two cells or more and 40 percent of
    the columns filled, of which 70 percent are no numbers.  Repeated names get a number, blank ones their place."""
    columns = [c for c in df.columns if c != order]
    rows = df.orderBy(order).select(order, *[F.col(f"`{c}`").cast("string") for c in columns]).limit(scan).collect()
    for row in rows:
        cells = [(v or "").strip() for v in row[1:]]
        filled = [v for v in cells if v]
        words = sum(not re.fullmatch(r"-?[\d,]*\.?\d+", v) for v in filled)
        if len(filled) >= max(2, 0.4 * len(columns)) and words >= 0.7 * len(filled):
            return row[0], unique([v or f"Column{i + 1}" for i, v in enumerate(cells)])
    return 0, [f"Column{i + 1}" for i in range(len(columns))]


def unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}_{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def with_header(df: DataFrame, order: str = ORDER) -> DataFrame:
    """A grid below its header, with its names."""
    place, names = header_row(df, order)
    columns = [c for c in df.columns if c != order]
    return df.where(F.col(order) > place).select(order, *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
