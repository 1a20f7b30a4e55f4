"""Keys and dependencies among any number of columns, level by level.

Sketches of all candidates of a level are one aggregate without a shuffle of rows; only candidates that a sketch can't rule
out are proved, each by one grouping with partial counts.  No row is multiplied by the number of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative standard deviation of a sketch, and how far it may be off before a candidate is ruled out: seven of these.
RSD = 0.02
DOUBT = 7 * RSD
NULL = "<NULL>"


def canonical(column: str, kind: str) -> Column:
    """A value as text, such that equal values have equal texts and different ones different texts; null stays null."""
    v = F.col(f"`{column}`")
    if kind in ("float", "double"):
        return (v + 0.0).cast("string")  # one zero
    if kind == "timestamp":
        return F.unix_micros(v).cast("string")  # no hour is there twice
    if kind == "binary":
        return F.hex(v)
    if kind.startswith(("array", "struct")):
        return F.when(v.isNotNull(), F.to_json(F.struct(v)))
    return v.cast("string")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, distinct: exact counts of values that aren't null.  Cells meet as (column, value), counted in tasks first, in
    one shuffle for all columns."""
    columns, kinds = list(columns or df.columns), dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), canonical(c, kinds[c]).alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count("*").alias("m"))
    counts = values.groupBy("i").agg(F.count("*").alias("distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    return F.broadcast(names).join(counts, "i", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))  # a row for each column


def _text(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    kinds = dict(df.dtypes)
    return {c: F.coalesce(canonical(c, kinds[c]), F.lit(NULL)) for c in columns}


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, distinct, is_key for all pairs of columns, exactly: a pair reads its two columns and shuffles its distinct
    values."""
    total = df.agg(F.count("*").alias("n"))
    parts = []
    for a, b in combinations(columns, 2):
        own = df.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).distinct().agg(F.count("*").alias("distinct"))
        parts.append(own.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "distinct"))
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, distinct long, is_key boolean")
    return reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(total)).select("a", "b", "distinct", (F.col("distinct") == F.col("n")).alias("is_key"))  # one row


def _sketches(df: DataFrame, sets: Sequence[tuple[str, ...]], text: dict[str, Column], wide: int = 200) -> list[float]:
    """Estimates of the distinct values of each set of columns, ``wide`` sketches in an aggregate."""
    out: list[float] = []
    for at in range(0, len(sets), wide):
        row = df.agg(*[F.approx_count_distinct(text[s[0]] if len(s) == 1 else F.struct(*[text[c] for c in s]), RSD).alias(f"s{i}") for i, s in enumerate(sets[at : at + wide])]).first()
        out += list(row)
    return out


def minimal_keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 2, least_rows: int = 5) -> DataFrame:
    """key (array of columns, in the order of the table): sets of up to ``most`` columns whose values tell all rows apart while
    those of no smaller set in them do.  Null is a value of its own in a set, but a single column with nulls is no key.

    A set whose parts have too few values between them, or whose sketch falls short, is no key; what is left of a level is
    proved in one job that looks for two equal rows.  Supersets of keys aren't looked at.  A table of fewer than ``least_rows``
    rows has no keys that mean anything, and gives none."""
    columns = list(columns or df.columns)
    text = _text(df, columns)
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n = counts["n"]
    found: list[tuple[str, ...]] = []
    if n >= least_rows:
        estimate = dict(zip([(c,) for c in columns], _sketches(df, [(c,) for c in columns], text)))
        for size in range(1, most + 1):
            level = [s for s in combinations(columns, size) if not any(set(k) <= set(s) for k in found)]
            if size == 1:
                level = [s for s in level if counts[f"c{columns.index(s[0])}"] == n]
            else:
                parts = lambda s: [estimate.get(s[:-1], n), estimate[s[-1:]]]
                level = [s for s in level if parts(s)[0] * parts(s)[1] * (1 + DOUBT) ** 2 >= n]
                estimate |= dict(zip(level, _sketches(df, level, text)))
            left = [s for s in level if estimate[s] >= n * (1 - DOUBT)]
            found += _proved(df, left, text)
    return df.sparkSession.createDataFrame([(list(k),) for k in found], "key array<string>")


def _proved(df: DataFrame, sets: list[tuple[str, ...]], text: dict[str, Column], at_once: int = 16) -> list[tuple[str, ...]]:
    """The sets of which no two rows have equal values."""
    out: list[tuple[str, ...]] = []
    for at in range(0, len(sets), at_once):
        part = sets[at : at + at_once]
        twice = [df.select(*[text[c].alias(f"k{j}") for j, c in enumerate(s)]).groupBy(*[f"k{j}" for j in range(len(s))]).agg(F.count("*").alias("m")).where("m > 1").limit(1).select(F.lit(i).alias("i")) for i, s in enumerate(part)]
        no = {r["i"] for r in reduce(DataFrame.unionByName, twice).collect()}  # a row for each set at most
        out += [s for i, s in enumerate(part) if i not in no]
    return out


def dependencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """determinant, dependent, holds for ordered pairs of columns: whether each determinant value has one dependent
    value; null is a value.

    Sketches of columns and pairs rule most pairs out; a determinant's others are proved in one grouping by it, as least and
    greatest dependent value of each class."""
    columns = list(columns)
    text = _text(df, columns)
    pairs = list(combinations(columns, 2))
    counted = dict(zip([*[(c,) for c in columns], *pairs], _sketches(df, [*[(c,) for c in columns], *pairs], text)))
    both = lambda a, b: counted.get((a, b), counted.get((b, a)))
    parts, no = [], []
    for a in columns:
        likely = [b for b in columns if b != a and both(a, b) <= counted[a,] * (1 + DOUBT) + 1]
        no += [(a, b) for b in columns if b != a and b not in likely]
        if likely:
            classes = df.select(text[a].alias("a"), *[text[b].alias(f"b{i}") for i, b in enumerate(likely)]).groupBy("a").agg(*[(F.min(f"b{i}") == F.max(f"b{i}")).alias(f"h{i}") for i in range(len(likely))])
            row = classes.agg(*[F.coalesce(F.bool_and(f"h{i}"), F.lit(True)).alias(f"h{i}") for i in range(len(likely))])
            parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.col(f"h{i}").alias("holds")) for i, b in enumerate(likely)])).alias("x")).select("x.*"))
    parts.append(df.sparkSession.createDataFrame([(a, b, False) for a, b in no], "determinant string, dependent string, holds boolean"))
    return reduce(DataFrame.unionByName, parts)
