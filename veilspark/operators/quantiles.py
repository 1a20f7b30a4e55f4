"""Exact quantiles without one task that holds all values.

A sketch brackets each quantile first, within a known share of the rows; then only what lies in the brackets is
gathered, as distinct values with counts, and the rows below are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch errs by one in so many rows at most, so a bracket holds about six times that share of the rows.
ACCURACY = 10_000


def quantiles(rows: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, n, q: the quantiles of the column v in each group, interpolated between neighbours; null values and NaN don't
    count.  Without ``by`` one row, with null quantiles if there are no values.  Brackets of groups are joined: Spark
    broadcasts them if they are few."""
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*by, F.col("v").cast("double").alias("v"))
    near = [min(1.0, max(0.0, p + d / ACCURACY)) for p in shares for d in (-3, 3)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", near, F.lit(ACCURACY)).alias("b"))
    held = rows.join(sketch, [*by]) if by else rows.crossJoin(F.broadcast(sketch))  # one row
    # beyond ACCURACY rows the neighbours of a quantile are nearer than a step of the sketch; fewer are gathered whole
    few = F.col("n") <= ACCURACY
    low = lambda i: F.when(few, float("-inf")).otherwise(F.col("b")[2 * i])
    high = lambda i: F.when(few, float("inf")).otherwise(F.col("b")[2 * i + 1])
    # the rows below a bracket collapse into one without a value
    cells = F.array(*[F.when(F.col("v") <= high(i), F.struct(F.lit(i).alias("i"), F.when(F.col("v") >= low(i), F.col("v")).alias("x"))) for i in range(len(shares))])
    cells = held.select(*by, "n", F.explode(cells).alias("c")).where(F.col("c").isNotNull()).select(*by, "n", "c.i", "c.x")
    counts = cells.groupBy(*by, "n", "i", "x").agg(F.count("*").alias("m"))
    lists = counts.groupBy(*by, "n", "i").agg(F.sort_array(F.collect_list(F.struct("x", "m"))).alias("l"))
    position = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("i") + 1)
    lists = lists.withColumns({"at": position, "under": F.floor(position), "over": F.ceil(position)})

    def step(s: Column, e: Column) -> Column:
        end = s["end"] + e["m"]
        pick = lambda name, k: F.when((F.col(k) >= s["end"]) & (F.col(k) < end), e["x"]).otherwise(s[name]).alias(name)
        return F.struct(end.alias("end"), pick("a", "under"), pick("b", "over"))

    none = F.lit(None).cast("double")
    ends = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("end"), none.alias("a"), none.alias("b")), step)
    between = F.when(F.col("under") == F.col("over"), F.col("s.a")).otherwise((F.col("over") - F.col("at")) * F.col("s.a") + (F.col("at") - F.col("under")) * F.col("s.b"))
    each = lists.withColumn("s", ends).select(*by, "n", "i", between.alias("x"))
    out = each.groupBy(*by, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("q"))
    if by:
        return out
    empty = F.array(*[none for _ in shares])
    total = sketch.select("n")
    return total.join(F.broadcast(out.select("q")), F.lit(True), "left").select("n", F.coalesce("q", empty).alias("q"))
