"""The aggregates behind charts: each returns a DataFrame that a renderer can draw as it is."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import policy
from .profile import is_numeric, missingness
from .quantiles import quantiles
from .running import running_total

#: Standard normal quantiles of the ladder, and the limit of what counts as close.
LADDER = ((0.01, -2.326), (0.05, -1.645), (0.10, -1.282), (0.25, -0.674), (0.50, 0.0), (0.75, 0.674), (0.90, 1.282), (0.95, 1.645), (0.99, 2.326))
CLOSE = 0.3


def dimensions_and_measures(df: DataFrame) -> tuple[list[str], list[str]]:
    measures = [c for c, t in df.dtypes if is_numeric(t) and not policy.is_key(c)]
    return [c for c in df.columns if c not in measures], measures


def numbers(df: DataFrame, column: str) -> DataFrame:
    v = F.col(f"`{column}`").cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """bin, low, high, n: equal widths from the least to the greatest value, the last bin closed."""
    bins = min(25, max(3, bins))
    rows = numbers(df, column)
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = rows.crossJoin(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(span)
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, std (population), skew (biased), least and greatest."""
    rows = numbers(df, column)
    row = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    middle = quantiles(rows, (0.5,)).select(F.col("q")[0].alias("median"))
    return row.crossJoin(F.broadcast(middle)).select("n", "mean", "median", "std", "skew", "least", "greatest")  # one row each


def box_plot(df: DataFrame, column: str, by: str | None = None, groups: int = 6) -> DataFrame:
    """group, n, q1, median, q3, whiskers and outliers; the most frequent groups if there are more."""
    v = F.col(f"`{column}`").cast("double")
    group = F.col(f"`{by}`").cast("string") if by else F.lit("all")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(group.alias("group"), v.alias("v"))
    often = rows.groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(groups).select(F.coalesce("group", F.lit("\0")).alias("g"))
    some = rows.withColumn("g", F.coalesce("group", F.lit("\0"))).join(F.broadcast(often), "g")  # as many rows as groups
    quarts = quantiles(some, (0.25, 0.5, 0.75), ["g"]).select(F.nullif("g", F.lit("\0")).alias("group"), "n", "q")
    quarts = quarts.select("group", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(low, high)
    fences = rows.join(F.broadcast(quarts), rows["group"].eqNullSafe(quarts["group"])).select(quarts["*"], "v").groupBy("group", "n", "q1", "median", "q3")  # as many rows as groups
    return fences.agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("outliers"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """a, b, r: Pearson, null as 0, two decimals; all pairs in one aggregate."""
    columns = list(columns or dimensions_and_measures(df)[1][:6])
    x = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns}
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(*[F.corr(x[columns[i]], x[columns[j]]).alias(f"r{i}_{j}") for i, j in pairs if i != j], F.count("*").alias("n"))

    def value(i: int, j: int):
        if i == j:
            return F.lit(1.0)
        r = F.col(f"r{min(i, j)}_{max(i, j)}")
        return F.round(F.when(F.isnan(r) | r.isNull(), 0.0).otherwise(r), 2)

    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(i, j).alias("r")) for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def categorical_bar(df: DataFrame, category: str, measure: str | None = None, how: str = "COUNT", top: int = 8) -> DataFrame:
    """category, value, percent and cumulative of the top values only."""
    made = {"COUNT": lambda m: F.count("*").cast("double"), "SUM": lambda m: F.sum(m), "AVG": lambda m: F.avg(m), "MEAN": lambda m: F.avg(m)}[how.upper()]
    value = made(F.col(f"`{measure}`").cast("double") if measure else None)
    best = df.where(F.col(f"`{category}`").isNotNull()).groupBy(F.col(f"`{category}`").cast("string").alias("category")).agg(value.alias("value")).orderBy(F.desc("value"), "category").limit(top)
    ranked = Window.orderBy(F.desc("value"), "category")  # top rows
    share = F.col("value") * 100.0 / F.sum("value").over(Window.partitionBy())
    return best.withColumn("percent", F.when(F.sum("value").over(Window.partitionBy()) != 0, share).otherwise(0.0)).withColumn("cumulative", F.sum("percent").over(ranked))


def time_trend(df: DataFrame, date: str, measure: str | None = None, how: str = "SUM", first: int = 15) -> DataFrame:
    value = F.count("*").cast("double") if not measure else (F.sum if how.upper() == "SUM" else F.avg)(F.col(f"`{measure}`").cast("double"))
    return df.where(F.col(f"`{date}`").isNotNull()).groupBy(F.col(f"`{date}`").alias("date")).agg(value.alias("value")).orderBy("date").limit(first)


def scatter_density(df: DataFrame, x: str, y: str, width: int = 30, height: int = 8) -> DataFrame:
    """gx, gy, n of a grid of counts."""
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(a.alias("x"), b.alias("y"))
    span = rows.agg(F.min("x").alias("x0"), (F.max("x") - F.min("x")).alias("xs"), F.min("y").alias("y0"), (F.max("y") - F.min("y")).alias("ys"))
    cell = lambda v, lo, s, n: F.when(F.col(s) > 0, F.floor((F.col(v) - F.col(lo)) / F.col(s) * (n - 1))).otherwise(0).cast("int")
    return rows.crossJoin(F.broadcast(span)).groupBy(cell("x", "x0", "xs", width).alias("gx"), cell("y", "y0", "ys", height).alias("gy")).agg(F.count("*").alias("n"))


def regional_density(df: DataFrame, region: str) -> DataFrame:
    counts = df.where(F.col(f"`{region}`").isNotNull()).groupBy(F.col(f"`{region}`").cast("string").alias("region")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "region")


def pareto(df: DataFrame, category: str, measure: str) -> DataFrame:
    """category, value, cumulative percent, vital: whether it is among the vital few (80 percent)."""
    sums = df.where(F.col(f"`{category}`").isNotNull()).groupBy(F.col(f"`{category}`").cast("string").alias("category")).agg(F.sum(F.col(f"`{measure}`").cast("double")).alias("value"))
    total = sums.agg(F.sum("value").alias("_total"))
    sums = running_total(sums, [F.desc("value"), F.col("category")], F.col("value"), "_upto").crossJoin(F.broadcast(total))  # one row
    cumulative = F.when(F.col("_total") != 0, F.col("_upto") * 100.0 / F.col("_total")).otherwise(0.0)
    sums = sums.withColumn("cumulative", cumulative).drop("_upto", "_total")
    return sums.withColumn("vital", F.col("cumulative") <= 80)


def quantile_ladder(df: DataFrame, column: str) -> DataFrame:
    """p, quantile, z, normal, delta, close: standardised quantiles against those of a normal distribution."""
    rows = numbers(df, column)
    row = rows.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).crossJoin(F.broadcast(quantiles(rows, [p for p, _ in LADDER]).select("q")))  # one row each
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.col("q")[i].alias("quantile"), F.lit(z).alias("normal")) for i, (p, z) in enumerate(LADDER)])
    out = row.select("mean", "std", F.explode(steps).alias("s")).select("s.*", F.when(F.col("std") > 0, (F.col("s.quantile") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("z"))
    return out.withColumn("delta", F.col("z") - F.col("normal")).withColumn("close", F.abs("delta") < CLOSE)


def crosstab(df: DataFrame, row: str, column: str, rows: int = 8, columns: int = 6) -> DataFrame:
    """row, column, n for the first values of both, in their order."""
    r, c = F.col(f"`{row}`").cast("string"), F.col(f"`{column}`").cast("string")
    first = lambda x, n: df.select(x.alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(n)
    frame = first(r, rows).withColumnRenamed("v", "row").crossJoin(F.broadcast(first(c, columns).withColumnRenamed("v", "column")))
    counts = df.groupBy(r.alias("row"), c.alias("column")).agg(F.count("*").alias("n"))
    return frame.join(counts, ["row", "column"], "left").fillna(0, ["n"])


__all__ = ["missingness"]
