"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) maps to a wide vector: EXACT lanes of 64 bits from a cryptographic hash of the whole line,
and LIKE lanes of 32 bits, a signed count sketch of its word pairs.  A document's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo 2^64 or 2^32.  So the order of paragraphs doesn't matter, inserting or
deleting one is an addition or subtraction, and equal multisets have equal sums.  The sketch lanes of a
difference of two fingerprints estimate how many word pairs they don't share.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, ship, tidied

ship(__name__)

EXACT, LIKE = 8, 128


def vector(text: str | None):
    """(exact, like) lanes of a text: the sum over its lines.  The empty text has one line, None has none."""
    import numpy as np
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    exact = np.zeros(EXACT, "<u8")
    words: list[int] = []
    starts: list[int] = []
    for line in () if text is None else text.encode("utf-8", "surrogatepass").split(b"\n"):
        exact += np.frombuffer(hashlib.blake2b(line, digest_size=8 * EXACT).digest(), "<u8")
        starts.append(len(words))
        words += map(hash64, line.split())
    if not words:
        return exact, np.zeros(LIKE, "<u4")
    h = np.array(words, "u8")
    before = np.roll(h, 1)
    before[[s for s in starts if s < len(h)]] = 0  # a line's first word has none before it
    h = (h ^ (before * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    lane = (h >> np.uint64(57)).astype("i8")
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype("i8")
    both = np.bincount(lane * 2 + sign, minlength=2 * LIKE)
    return exact, (both[1::2] - both[::2]).astype("<i8").astype("<u4")


def text_of(fingerprint) -> str:
    return base64.b64encode(fingerprint[0].tobytes() + fingerprint[1].tobytes()).decode()


def of_text(fingerprint: str):
    import numpy as np

    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * EXACT], "<u8"), np.frombuffer(data[8 * EXACT :], "<u4")


def plus(fingerprint: str, text: str) -> str:
    """The fingerprint after the lines of text are inserted anywhere."""
    (a, b), (c, d) = of_text(fingerprint), vector(text)
    return text_of((a + c, b + d))


def minus(fingerprint: str, text: str) -> str:
    """The fingerprint after the lines of text are deleted."""
    (a, b), (c, d) = of_text(fingerprint), vector(text)
    return text_of((a - c, b - d))


def likeness(one, other) -> float:
    """1 for equal sums, about the share of common word pairs otherwise, 0 at least."""
    import numpy as np

    if (one[0] == other[0]).all():
        return 1.0
    a, b = one[1].astype("<i4").astype(float), other[1].astype("<i4").astype(float)
    apart = (one[1] - other[1]).astype("<i4").astype(float)
    return float(min(1.0, max(0.0, 1 - np.dot(apart, apart) / max(1.0, np.dot(a, a) + np.dot(b, b)))))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, for every row.  A null text is empty, a null id stays null; repeated rows give
    repeated results; an empty table gives no rows; further columns are left out."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([text_of(vector(t)) for t in texts])], names=[id_col, "n_chars", "fingerprint"])

    return only(docs, id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {id_type}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_two(text: str):
    """(start of the first line that an edit of the second half touches, vector of the lines before it, vector of the
    whole text): the second is the fingerprint after the touched lines are deleted."""
    start = text.rfind("\n", 0, len(text) - len(text) // 2) + 1
    before, rest = vector(text[: start - 1] if start else None), vector(text[start:])
    return start, before, (before[0] + rest[0], before[1] + rest[1])


def bounds_of(rows: DataFrame, parts: int) -> list[int]:
    """parts - 1 quantiles of the ids, in descending order; an id that many rows share comes several times."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("k", shares, F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"]
    return sorted(found or (), reverse=True)


def range_of(bounds: list[int], parts: int) -> Column:
    """The range of a row by its id k and hash h, in the order of the rows.  Rows of an id that is several bounds are
    spread over the ranges between them by their hash, and so are those without id over ``parts`` ranges of their own."""
    step = max(1, math.isqrt(len(bounds)))
    ends = F.lit([bounds[min(i + step, len(bounds)) - 1] for i in range(0, len(bounds), step)])

    def count(beyond) -> Column:
        """How many bounds are beyond k: whole chunks first, then within the next chunk."""
        whole = F.size(F.filter(ends, beyond)) * step
        return F.least(whole, F.lit(len(bounds))) + F.size(F.filter(F.slice(F.lit(bounds), whole + 1, F.lit(step)), beyond))

    spread = lambda n: F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * n), n - 1)
    above = count(lambda b: b > F.col("k")) if bounds else F.lit(0)
    upto = count(lambda b: b >= F.col("k")) if bounds else F.lit(0)
    known = above + spread(upto - above + 1)
    return F.when(F.col("k").isNull(), len(bounds) + 1 + spread(F.lit(parts))).otherwise(known).cast("int")


def edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, for every row: how
    the fingerprint follows an edit that replaces the text's second half by the beginning of the next document,
    in descending order of ids (after the last: the first).  The edited fingerprint is made by deleting the touched
    lines from the sum and inserting the new ones.

    Null texts are empty.  Rows with the same id follow each other by the hash of their text, then the text; rows
    without id come last.  A single row is its own next.  Further columns are left out; an empty table gives no rows.
    Ids are integers; others raise a TypeError.

    Ranges of ids come from quantiles that are found once; the range of a row follows from the row alone, so it is
    the same in every pass, whatever is shuffled again.  One shuffle brings neighbours together; within a range each
    row meets the next.  Only the first and last row of each range take another way: twice the partitions, at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers; {id_col} is {id_type}")
    rows = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    order = [F.col("p"), F.col("k").desc_nulls_last(), F.col("h"), F.col("t")]
    ranged = rows.withColumn("h", F.xxhash64("t")).withColumn("p", range_of(bounds_of(rows, parts), parts)).repartitionById(parts, F.pmod("p", F.lit(parts)))
    schema = f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def result(pairs) -> pa.RecordBatch:
        """pairs: (id, text, its parts, following text, vector of that)"""
        out = []
        for key, text, (start, before, own), following, other in pairs:
            new = edited(text, following)
            if new == text:
                changed = own
            else:
                tail = vector(new[start:])
                changed = before[0] + tail[0], before[1] + tail[1]
            out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), likeness(own, other)))
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = at = None
        for batch in batches:
            pairs, chars = [], 0
            for part, key, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                key, text = key.as_py(), text.as_py()
                own = in_two(text)
                if last and part == at:
                    pairs.append((*last, text, own[2]))
                    chars += len(text)
                last, at = (key, text, own), part
                if len(pairs) >= 1000 or chars > 8_000_000:
                    yield result(pairs)
                    pairs, chars = [], 0
            if pairs:
                yield result(pairs)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, following in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                yield result([(key, text.as_py(), in_two(text.as_py()), following.as_py(), vector(following.as_py()))])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[id_col].dataType)
    within = ranged.sortWithinPartitions(*order).select("p", "k", "t").mapInArrow(tidied(inner), schema)
    place = F.struct(F.col("k").isNull().alias("n"), F.bitwise_not("k").alias("k"), "h", "t")  # descending
    ends = ranged.groupBy("p").agg(F.min_by(F.struct("k", "t"), place).alias("head"), F.max_by(F.struct("k", "t"), place).alias("tail"))
    in_turn = Window.orderBy("p")  # a row for each range
    ends = ends.select("tail", F.coalesce(F.lead("head").over(in_turn), F.first("head").over(in_turn)).alias("head"))
    across = ends.select("tail.k", "tail.t", F.col("head.t").alias("f")).mapInArrow(tidied(outer), schema)
    return within.unionByName(across)
