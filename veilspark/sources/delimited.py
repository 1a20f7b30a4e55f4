"""A scanner of delimited text that keeps quoted line breaks and the order of rows, split by split.

A line alone doesn't say whether it begins inside quotes.  But it is a function from the state before it (outside or
inside a quoted cell) to the state after it, and such functions compose.  Every split is scanned from both states, the splits'
functions are composed in the order of files, and with that each line knows its record.  Only the few records that
span lines meet in a shuffle.
"""

from __future__ import annotations

import sys
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE = "_ord"
#: What stands between quotes.
INNER = re.compile('[^"]*+(?:""[^"]*+)*+')


@lru_cache
def _forms(sep: str) -> tuple[str, str]:
    """Patterns of lines that end inside quotes when begun outside and inside.  Quotes count at the start of a cell only, as
    in 5" pipes, and two of them within quotes are one.  Nothing is tried twice, so long lines are safe."""
    s = re.escape(sep)
    inner = r'[^"]*+(?:""[^"]*+)*+'
    rest = f'(?:[^"{s}][^{s}]*+)?+'
    cell = f'(?:"{inner}"{rest}|{rest})'
    return f'^(?:{cell}{s})*+"{inner}$', f'^{inner}(?:$|"{rest}{s}(?:{cell}{s})*+"{inner}$)'


def opens(sep: str) -> str:
    """A pattern of lines that break off inside quotes."""
    return _forms(sep)[0]


def cells_of(record: str, sep: str) -> list[str | None]:
    """The cells of a record: quotes undone, empty cells None unless quoted."""
    if '"' not in record:
        return [x or None for x in record.split(sep)]
    out, at, n = [], 0, len(record)
    while at <= n:
        if at < n and record[at] == '"':
            end = INNER.match(record, at + 1).end()
            value = record[at + 1 : end].replace('""', '"')
            stop = record.find(sep, end)
            stop = n if stop < 0 else stop
            out.append(value + record[end + 1 : stop])
        else:
            stop = record.find(sep, at)
            stop = n if stop < 0 else stop
            out.append(record[at:stop] or None)
        at = stop + len(sep)
    return out


def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """path, block (where the split begins), text, in the order of the scan."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), value.alias("text"))


def _scanned(rows: DataFrame, sep: str) -> DataFrame:
    """path, block, line (its number in the split), text, and for a split that begins outside (a) or inside (b) quotes: how
    many records have begun up to the line, whether the line begins outside, and whether it ends inside."""
    outside, inside = _forms(sep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_out, from_in = re.compile(outside, re.S), re.compile(inside, re.S)
        now, line, a, b, na, nb = None, 0, False, True, 0, 0  # a, b: inside before the line
        for batch in batches:
            paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            quotes = pc.match_substring(batch.column(2), '"').to_pylist()
            blank = pc.equal(pc.utf8_rtrim(batch.column(2), "\r"), "").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                if now != (paths[i], blocks[i]):
                    now, line, a, b, na, nb = (paths[i], blocks[i]), 0, False, True, 0, 0
                na, nb = na + (not a and not blank[i]), nb + (not b and not blank[i])
                before = not a, not b
                if quotes[i]:
                    text = batch.column(2)[i].as_py()
                    a, b = (bool((from_in if state else from_out).match(text)) for state in (a, b))
                for column, v in zip(out, (line, na, nb, *before, a, b)):
                    column.append(v)
                line += 1
            kinds = [pa.int64()] * 3 + [pa.bool_()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds)], batch.column(2)], names=["path", "block", "line", "na", "nb", "oa", "ob", "ea", "eb", "text"])

    return rows.mapInArrow(scan, "path string, block long, line long, na long, nb long, oa boolean, ob boolean, ea boolean, eb boolean, text string")


def records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """_ord (0, 1, ... over all files in the order of their names), record (without its line end).

    Line ends are \\n or \\r\\n; empty lines outside quotes are no records.  With a header the first record of each file
    is left out and doesn't count.  A quote that is never closed takes the rest of its file."""
    rows = _scanned(lines(spark, path, encoding), sep)
    blank = F.regexp_replace("text", "\r$", "") == ""
    splits = rows.groupBy("path", "block").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.max_by("ea", "line").alias("ea"), F.max_by("eb", "line").alias("eb"), F.min(F.when(~blank, F.col("line"))).alias("filled")
    )
    # The state before each split is that of the splits before it, one after the other: the last that ends alike from both
    # states settles it, and each later one that swaps them turns it.  A row for each split.
    turn = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("swaps", F.coalesce(F.sum((F.col("ea") & ~F.col("eb")).cast("int")).over(turn), F.lit(0)))
    settled = F.when(F.col("ea") == F.col("eb"), F.struct("block", F.col("ea").alias("state"), "swaps"))
    splits = splits.withColumn("settled", settled).withColumn("last", F.max("settled").over(turn))
    odd = (F.col("swaps") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce("last.state", F.lit(False)) != odd)
    splits = splits.withColumn("begun", F.when(F.col("inside"), F.col("nb")).otherwise(F.col("na")))
    top = F.col("block") == F.min("block").over(Window.partitionBy("path"))
    splits = splits.withColumn("head", F.when(top, F.col("filled")))
    whole = Window.orderBy("path", "block")
    heads = F.sum(F.col("head").isNotNull().cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)) if header else F.lit(0)
    start = F.coalesce(F.sum("begun").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "block", "inside", "head", (start - heads - 1).alias("start"))

    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    rows = rows.join(splits, ["path", "block"]).withColumn("outside", pick("oa", "ob")).where(~(F.col("outside") & blank))
    rows = rows.select("path", "block", "line", (F.col("start") + pick("na", "nb")).alias(PLACE), "outside", pick("ea", "eb").alias("open"), "text", F.coalesce(F.col("head") == F.col("line"), F.lit(False)).alias("head"))
    alone = F.col("outside") & ~F.col("open")
    single = rows.where(alone).select(PLACE, F.col("text").alias("record"), "head")
    joined = rows.where(~alone).groupBy("path", PLACE).agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("l"), F.bool_or("head").alias("head"))
    out = single.unionByName(joined.select(PLACE, F.array_join("l.text", "\n").alias("record"), "head"))
    out = out.where(~F.col("head")) if header else out
    return out.select(PLACE, F.regexp_replace("record", "\r$", "").alias("record"))


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """The cells of the first record of the first file; its lines are taken until quotes close."""
    files = sorted(spark.read.text(path).inputFiles())
    take, out = 4, None
    while files and out is None:
        rows = lines(spark, files[0], encoding).limit(take).collect()
        head, inside = "", False
        for r in rows:
            head, inside = (head + "\n" if inside else "") + r["text"], bool(re.match(_forms(sep)[1 if inside else 0], r["text"], re.S))
            if not inside and head.strip("\r"):
                out = head
                break
        if out is None and len(rows) < take:
            out = head
        take *= 16
    return [c or "" for c in cells_of((out or "").removesuffix("\r"), sep)]


def grid(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """_ord and the cells as text: under the names of the first file's header, or "0", "1" ... as wide as the widest
    record.  Longer rows are cut, shorter ones filled with null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([cells_of(r, sep) for r in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], names=[PLACE, "cells"])

    rows = records(spark, path, sep, encoding, header).mapInArrow(cut, f"{PLACE} long, cells array<string>")
    names = header_of(spark, path, sep, encoding) if header else [str(i) for i in range(rows.agg(F.max(F.size("cells"))).first()[0] or 0)]
    return rows.select(PLACE, *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)])


#: Types that a column of text may have, the first that fits all its values.
TYPES = (("int", r"[+-]?\d{1,10}"), ("bigint", r"[+-]?\d{1,19}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("date", r"\d{4}-\d{2}-\d{2}"), ("timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*"), ("boolean", r"(?i)true|false"))


def typed(df: DataFrame, keep: tuple[str, ...] = (PLACE,)) -> DataFrame:
    """df with its text columns as the narrowest type that all their values have; one aggregate over all rows."""
    columns = [c for c in df.columns if c not in keep]
    fit = lambda v, t, p: F.bool_and(F.when(v.isNotNull(), v.rlike(f"^(?:{p})$") & v.try_cast(t).isNotNull()))
    fits = [fit(F.col(f"`{c}`"), t, p).alias(f"c{i}_{t}") for i, c in enumerate(columns) for t, p in TYPES]
    row = df.agg(*fits).first() if columns else None
    kinds = [next((t for t, _ in TYPES if row[f"c{i}_{t}"]), "string") for i in range(len(columns))]
    return df.select(*keep, *[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(columns, kinds)])
