"""Which of many values occur in which of many texts, as substrings in any case.

Values of a checked size become one automaton that reads each text once.  Larger sets of any size go by an inverted join:
each value is named by its rarest five characters, texts give out just those of their five-character pieces that name a
value, and what meets is verified.  Both ways find the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of all values that an automaton takes; beyond them the join is used.
AUTOMATON_CHARS = 2_000_000
#: Characters of a piece; values must be at least as long.
PIECE = 5
#: Bits of the counts of pieces and of the map of names, 8 MB and 16 MB whatever the input.
COUNT_BITS, MAP_BITS = 20, 27
#: Cells that are too common to tell anything.
COMMON = ("true", "false", "none", "null", "1000", "2000")


def needles(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value, low: the distinct cells of raw that are longer than four characters without their outer blanks, and not
    among the common words; low is what is looked for."""
    columns = list(columns or raw.columns)
    cells = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    low = F.lower(F.trim("value"))
    return cells.where((F.length(F.trim("value")) >= PIECE) & ~low.isin(*COMMON)).distinct().withColumn("low", low)


def pieces(text: str) -> np.ndarray:
    """A 64-bit number for each five characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < PIECE:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - PIECE + 1, np.uint64)
    for k in range(PIECE):
        out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def contained(texts: DataFrame, key: str, text_column: str, raw: DataFrame, columns: Sequence[str] | None = None, *, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """key, column, value: each cell of raw (see :func:`needles`) that occurs in the text of a row, once a row.

    Null texts hold nothing, empty tables give nothing; equal rows and keys come back as often as they occur.  Letters are
    compared as Spark's ``lower`` gives them."""
    values = settled(needles(raw, columns))
    chars = values.agg(F.coalesce(F.sum(F.length("low")), F.lit(0))).first()[0]
    rows = texts.where(F.col(f"`{text_column}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"), F.lower(F.col(f"`{text_column}`")).alias("_low"))
    hits = _by_automaton(rows, values) if chars <= automaton_chars else _by_pieces(rows, values)
    found = hits.join(values, "low") if chars > automaton_chars else hits.join(F.broadcast(values), "low")  # its size has been checked
    return found.select(F.col("_key").alias(key), "column", "value")


def _by_automaton(rows: DataFrame, values: DataFrame) -> DataFrame:
    """_key, low."""
    words = [r["low"] for r in values.select("low").distinct().collect()]  # AUTOMATON_CHARS at most
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, word in enumerate(sent.value):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            at, low = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if sent.value else ()):
                own = {k for _, k in automaton.iter(text)}
                at += [i] * len(own)
                low += [sent.value[k] for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(low, pa.string())], names=["_key", "low"])

    return rows.mapInArrow(search, f"_key {rows.schema['_key'].dataType.simpleString()}, low string")


def _by_pieces(rows: DataFrame, values: DataFrame) -> DataFrame:
    """_key, low.  Rows are numbered once, since keys may repeat."""
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount((np.unique(pieces(text)) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total)) if len(text) >= PIECE else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in rows.select("_low").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # 2^20 rows at most
        counts[r["at"]] = r["n"]
    rare = rows.sparkSession.sparkContext.broadcast(counts)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for low in batch.column(0).to_pylist():
                own = pieces(low)
                names.append(int(own[rare.value[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].argmin()].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0)], names=["name", "low"])

    words = settled(values.select("low").distinct().mapInArrow(named, "name long, low string"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        at = np.flatnonzero(bits)
        for k in range(0, len(at), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 20)]), pa.array(bits[at[k : k + (1 << 20)]].astype(np.int64))], names=["at", "b"])

    there = np.zeros(1 << MAP_BITS >> 3, np.uint8)  # 16 MB
    for r in words.select("name").mapInArrow(mapped, "at long, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toLocalIterator():
        there[r["at"]] = r["b"]
    sent = rows.sparkSession.sparkContext.broadcast(there)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, names = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(pieces(text))
                at = own & np.uint64((1 << MAP_BITS) - 1)
                own = own[(sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                number.append(np.full(len(own), i))
                names.append(own.astype(np.int64))
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), pa.array(np.concatenate(names))], names=["_row", "name"])

    met = rows.select("_row", "_low").mapInArrow(given, "_row long, name long").join(words, "name").select("_row", "low")
    return met.join(rows, "_row").where(F.col("_low").contains(F.col("low"))).select("_key", "low")
