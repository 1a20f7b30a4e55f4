"""Links between tables and columns by the values they share."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def _values(sheets: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None, most: int | None) -> DataFrame:
    """sheet, column, v: distinct values as text; the least ``most`` of each column if given."""
    out = None
    for name, df in sheets.items():
        own = list((columns or {}).get(name, df.columns))
        cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in own]).unpivot([], own, "column", "v")
        cells = cells.where(F.col("v").isNotNull()).select(F.lit(name).alias("sheet"), "column", "v").distinct()
        out = cells if out is None else out.unionByName(cells)
    if most:
        from pyspark.sql import Window

        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("sheet", "column").orderBy("v"))).where(F.col("_k") <= most).drop("_k")
    return out


def similar_names(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    ta, tb = (set(re.split(r"[^a-z0-9]+", x)) - {"id", "key", "code", "no", ""} for x in (a, b))
    return a == b or a in b or b in a or bool(ta & tb)


def overlaps(sheets: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None, most: int | None = None) -> DataFrame:
    """sheet_a, column_a, sheet_b, column_b, common, size_a, size_b, percent of the smaller set, for columns of
    different sheets.

    Values meet once: each distinct value carries the list of columns that have it (at most as long as there are
    columns), so no value makes pairs of rows."""
    values = _values(sheets, columns, most)
    sizes = values.groupBy("sheet", "column").agg(F.count("*").alias("n"))
    homes = values.groupBy("v").agg(F.sort_array(F.collect_set(F.struct("sheet", "column"))).alias("h")).groupBy("h").agg(F.count("*").alias("m")).where(F.size("h") > 1)
    pairs = homes.select("m", F.explode(F.flatten(F.transform("h", lambda a: F.transform(F.filter("h", lambda b: b["sheet"] > a["sheet"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    common = pairs.groupBy(F.col("p.a.sheet").alias("sheet_a"), F.col("p.a.column").alias("column_a"), F.col("p.b.sheet").alias("sheet_b"), F.col("p.b.column").alias("column_b")).agg(F.sum("m").alias("common"))
    for side in "ab":
        common = common.join(F.broadcast(sizes.select(F.col("sheet").alias(f"sheet_{side}"), F.col("column").alias(f"column_{side}"), F.col("n").alias(f"size_{side}"))), [f"sheet_{side}", f"column_{side}"])  # a row a column
    return common.withColumn("percent", F.round(F.col("common") * 100.0 / F.least("size_a", "size_b"), 1))


def foreign_keys(sheets: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None, most: int | None = None) -> DataFrame:
    """Overlaps that make a link: a similar name and 20 percent, or 60 percent of three values or more."""
    names = {(a, b) for x, y in combinations(sheets, 2) for a in (columns or {}).get(x, sheets[x].columns) for b in (columns or {}).get(y, sheets[y].columns) if similar_names(a, b)}
    names |= {(b, a) for a, b in names}
    found = overlaps(sheets, columns, most)
    alike = F.concat_ws("\u0001", "column_a", "column_b").isin(*["\u0001".join(x) for x in sorted(names)]) if names else F.lit(False)
    return found.withColumn("alike", alike).where((F.col("alike") & (F.col("percent") >= 20)) | ((F.col("percent") >= 60) & (F.col("size_a") >= 3)))


def graph_links(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """source, target, overlap of pairs of id columns of one table that share more than 15 percent of their values, or whose names
    say that they are ends of a link (source and target, sender and receiver ...): these whatever they share, in the order that
    the names give."""
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "v").where(F.col("v").isNotNull()).distinct()
    sizes = {c: i for i, c in enumerate(columns)}
    homes = cells.groupBy("v").agg(F.sort_array(F.collect_set("column")).alias("h")).groupBy("h").agg(F.count("*").alias("m"))
    named = lambda a, b: bool(re.search(P.SOURCE_NAME, a) and re.search(P.TARGET_NAME, b))
    ends = [(b, a) if named(b, a) else (a, b) for a, b in combinations(columns, 2)]
    both = [F.array_contains("h", a) & F.array_contains("h", b) for a, b in ends]
    n = homes.agg(*[F.sum(F.when(F.array_contains("h", c), F.col("m")).otherwise(0)).alias(f"n{i}") for c, i in sizes.items()], *[F.sum(F.when(x, F.col("m")).otherwise(0)).alias(f"m{k}") for k, x in enumerate(both)])
    share = lambda k, a, b: F.try_divide(F.col(f"m{k}").cast("double"), F.least(F.col(f"n{sizes[a]}"), F.col(f"n{sizes[b]}")).cast("double"))
    pairs = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), share(k, a, b).alias("overlap"), F.lit(named(a, b)).alias("named")) for k, (a, b) in enumerate(ends)])
    return n.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("overlap").isNotNull() & (F.col("named") | (F.col("overlap") > 0.15))).drop("named")


def degrees(df: DataFrame, source: str, target: str) -> DataFrame:
    """node, out_degree, in_degree."""
    ends = df.select(F.explode(F.array(F.struct(F.col(source).cast("string").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).cast("string").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def merge_lookup(primary: DataFrame, lookup: DataFrame, left: str, right: str) -> DataFrame:
    """primary with the columns of a lookup sheet, by their link; rows without a partner stay."""
    more = lookup.dropDuplicates([right])
    clash = {c: f"{c}_lookup" for c in lookup.columns if c in primary.columns}
    more = more.withColumnsRenamed(clash)
    key = clash.get(right, right)
    return primary.join(more, primary[left].cast("string") == more[key].cast("string"), "left")
