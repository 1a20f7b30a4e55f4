"""How far the sources of a language differ from each other, and by which terms each differs from its language.

Term counts of a (language, source) group become vectors over the language's kept terms, cut into blocks of terms and
compressed.  A group's blocks stay in the partition of their key; vectors of the other groups circulate: in each
round of a round-robin tournament every group meets one other, and a meeting counts for both directions.  Heaps
of the terms in which a group exceeds its language are kept block by block and merged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, ship, tidied, write_once

ship(__name__)

#: Letters A to Z in small, other ASCII as blanks: what is between blanks is a term.
TERM_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries of a task's tables of counts before they are handed on.
ENTRIES = 400_000
#: Terms of a block, about.
BLOCK_TERMS = 4096


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term; and for each group a row without a
    term.  Counts are summed in tasks before they are shuffled."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out():
            for (lang, source), own in terms.items():
                there = held[lang, source]
                for at in range(0, len(own) + 1, 50_000):
                    words = [None, *own][at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([own[w] if w else 0 for w in words], pa.int64()), pa.array([there[w] if w else 0 for w in words], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            terms.clear()
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = text.translate(TERM_BYTES).split()
                terms[lang, source].update(own)
                held[lang, source].update(set(own))
            if sum(map(len, terms.values())) >= ENTRIES:
                yield from out()
        yield from out()

    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("text"))
    counted = only(rows, "lang", "source", "text").mapInArrow(tidied(count), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int, scale: int) -> np.ndarray:
    """Smoothed shares in whole numbers: 1 + floor(scale * (count + 2) / (total + 2 * terms))."""
    if len(counts) and scale * (int(counts.max()) + 2) >= 2**63:
        return 1 + scale * (counts.astype(object) + 2) // (total + 2 * terms)
    return 1 + scale * (counts.astype(np.int64) + 2) // (total + 2 * terms)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def packed(counts: np.ndarray) -> bytes:
    """Counts in the smallest whole type that holds them, compressed; the first byte names the type."""
    import zlib

    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 256**w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}")


def opponent(slot: Column, turn: Column, seats: Column) -> Column:
    """Whom a slot meets in a round of a tournament with an even number of seats: slots whose sum is the round, modulo
    seats - 1, meet; the one that would meet itself meets the last seat."""
    odd = seats - 1
    other = F.pmod(turn - slot, odd)
    return F.when(slot == odd, F.pmod(turn * (seats / 2).cast("long"), odd)).when(other == slot, odd).otherwise(other)


def _meet(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """The parts of a pair's sum that a block gives."""
    last = (None, None)
    for batch in batches:
        lang, slot, at, terms, total, cells, other, own = (c.to_pylist() for c in batch.columns)
        values = []
        for i in range(batch.num_rows):
            if last[0] != (lang[i], slot[i], cells[i]):  # rows of a resident follow each other
                last = (lang[i], slot[i], cells[i]), shares(unpacked(cells[i]), total[i], terms[i], scale)
            values.append(int(apart(last[1], shares(unpacked(own[i]), other[i], terms[i], scale)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(values, pa.int64())], names=["lang", "slot", "at", "value"])


def _heaps(batches: Iterator[pa.RecordBatch], scale: int, top: int) -> Iterator[pa.RecordBatch]:
    """The ``top`` terms of each block in which a group exceeds its language."""
    import heapq

    for batch in batches:
        found = []
        for lang, source, terms, total, cells, words, whole, sums in zip(*(c.to_pylist() for c in batch.columns)):
            counts = unpacked(cells)
            p, q = shares(counts, total, terms, scale), shares(np.array(sums, np.int64), whole, terms, scale)
            over = np.flatnonzero((counts > 0) & (p > q))
            values = apart(p[over], q[over])
            best = heapq.nsmallest(top, ((-int(v), words[i].encode()) for v, i in zip(values, over)))
            found += [(lang, source, word.decode(), -value) for value, word in best]
        columns = zip(*found) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *,
    least_docs: int = 10, scale: int = 1_000_000_000, top: int = 10, rounds_at_once: int = 64, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Null text, lang and source count as empty.  Terms are runs of ASCII letters and other than ASCII characters, A-Z
    lower-cased; a language keeps those in at least ``least_docs`` of its documents (rows).  Part ``pair``: for each
    other source of the language the sum of f over all kept terms (0 if there are none); part ``term``: the ``top``
    kept terms with the largest f against the language among those that occur in the group more than their share.  Ranks by
    falling value, ties by item in UTF-8 order.  All arithmetic is exact.  An empty table gives an empty result, a
    language with one source has no pairs; repeated rows count as often as they occur; further columns are left out.

    A job runs ``rounds_at_once`` rounds, so what circulates at a time is that many times the compressed vectors at most.
    """
    spark = docs.sparkSession
    table = write_once(term_counts(docs, lang_col, source_col, text_col), "terms")
    kept = table.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = write_once(kept.where(F.col("docs") >= least_docs).select("lang", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole"))
    blocks = max(1, -(-(sizes.agg(F.max("terms")).first()[0] or 0) // block_terms))

    # the terms of a block in order, and their counts in the language
    own = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    lists = kept.groupBy("lang", own).agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("l"))
    lists = write_once(lists.select("lang", "block", F.col("l.term").alias("words"), F.col("l.n").alias("sums")), "blocks")
    places = lists.select("lang", "block", F.posexplode("words").alias("place", "term"))
    cells = table.join(places, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("cells"), F.sum("n").alias("n"))
    cells = write_once(cells.select("lang", "source", "block", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), "n"), "cells")

    # every group has a slot in its language's tournament and a row for each block, also without terms
    by_lang = Window.partitionBy("lang")
    groups = table.where(F.col("term").isNull()).select("lang", "source")
    groups = groups.select("lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("slot"), F.count("*").over(by_lang).alias("groups"))
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", "slot", (F.col("groups") + F.col("groups") % 2).alias("seats"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "whole")])
    each = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.join(cells.drop("n"), ["lang", "source", "block"], "left").join(lists.select("lang", "block", F.size("words").alias("width")), ["lang", "block"], "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, places, counts in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                dense = np.zeros(width or 0, np.uint64)
                if places:
                    dense[places] = counts
                out.append(packed(dense))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.binary())], names=[*batch.schema.names[:-3], "cells"])

    names = ["lang", "source", "slot", "seats", "total", "terms", "whole", "block"]
    schema = "lang string, source string, slot long, seats long, total long, terms long, whole long, block int, cells binary"
    residents = write_once(only(each, *names, "width", "places", "counts").mapInArrow(tidied(pack), schema), "vectors")

    # rounds: the visitor travels to the key of its host, chosen so that every slot is host about as often as visitor
    rounds = (residents.agg(F.max("seats")).first()[0] or 2) - 1
    home = residents.select("lang", "slot", "block", "terms", "total", "cells")
    sums = None
    for first in range(0, rounds, rounds_at_once):
        last = F.least(F.col("seats") - 2, F.lit(first + rounds_at_once - 1))
        turns = residents.where(F.col("seats") - 2 >= first).withColumn("turn", F.explode(F.sequence(F.lit(first).cast("long"), last)))
        turns = turns.withColumn("host", opponent(F.col("slot"), F.col("turn"), F.col("seats")))
        guests = turns.where((F.col("host") < F.col("slot")) == ((F.col("host") + F.col("slot")) % 2 == 0)).select("lang", F.col("host").alias("slot"), "block", F.col("slot").alias("at"), F.col("total").alias("other"), F.col("cells").alias("own"))
        met = home.join(guests, ["lang", "slot", "block"]).select("lang", "slot", "at", "terms", "total", "cells", "other", "own")
        met = only(met, *met.columns).mapInArrow(tidied(lambda batches: _meet(batches, scale)), "lang string, slot long, at long, value long")
        met = met.groupBy("lang", "slot", "at").agg(F.sum("value").alias("value"))
        if rounds > rounds_at_once:
            met = write_once(met, "meetings")
        sums = met if sums is None else sums.unionByName(met)
    both = sums.select("lang", F.explode(F.array(F.struct("slot", "at"), F.struct(F.col("at").alias("slot"), F.col("slot").alias("at")))).alias("e"), "value").select("lang", "e.slot", "e.at", "value")
    named = groups.select("lang", "slot", "source")
    pairs = both.join(named, ["lang", "slot"]).join(named.select("lang", F.col("slot").alias("at"), F.col("source").alias("item")), ["lang", "at"])

    whole = residents.join(lists, ["lang", "block"]).select("lang", "source", "terms", "total", "cells", "words", "whole", "sums")
    best = only(whole, *whole.columns).mapInArrow(tidied(lambda batches: _heaps(batches, scale, top)), "lang string, source string, item string, value long")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).select(*out)
    terms = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top).select(*out)
    return pairs.unionByName(terms)
