"""Risk of re-identification: equivalence classes and what follows from their sizes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..functions import patterns as P
from ..functions.scalars import age_band, strip
from . import policy
from .running import running_total

NULL = "<NULL>"


def as_text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NULL))


def resolve_quasi_identifiers(df: DataFrame, given: Sequence[str] | None = None) -> list[str]:
    """Given columns that are there and aren't keys or metrics; else those found by name; else up to three columns
    of low cardinality.  The last takes one aggregate over all rows."""
    usable = [c for c in df.columns if not policy.is_key(c) and not policy.is_metric(c)]
    found = [c for c in given if c in usable] if given else policy.quasi_identifiers(df.columns)
    if found or not usable:
        return found
    counts = df.agg(F.count("*").alias("n"), *[F.countDistinct(as_text(c)).alias(f"c{i}") for i, c in enumerate(usable)]).first()
    most = min(100, max(2, counts["n"] // 2))
    return [c for i, c in enumerate(usable) if 2 <= counts[f"c{i}"] <= most][:3]


def classes(df: DataFrame, qis: Sequence[str], sensitive: str | None = None) -> DataFrame:
    """One row per equivalence class: the quasi-identifiers as text, n, and l (distinct sensitive values)."""
    more = [F.countDistinct(as_text(sensitive)).alias("l")] if sensitive else []
    return df.groupBy(*[as_text(c).alias(c) for c in qis]).agg(F.count("*").alias("n"), *more)


def class_sizes(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """df with the size of each row's class."""
    names = [f"{free_prefix(df)}{i}" for i in range(len(qis))]
    sizes = classes(df, qis).withColumnRenamed("n", "class_size").withColumnsRenamed(dict(zip(qis, names)))
    return df.join(sizes, [as_text(c) == F.col(n) for c, n in zip(qis, names)], "left").drop(*names)


def summary(df: DataFrame, qis: Sequence[str], sensitive: str | None = None, threshold: int = 3) -> DataFrame:
    """One row: records, classes, min_k, avg_k, median_k (the upper one), at_risk, risk_percent, risk_level and
    min_l.  Only sizes and how often they occur meet in the last step."""
    sizes = classes(df, qis, sensitive).groupBy("n").agg(F.count("*").alias("m"), *([F.min("l").alias("l")] if sensitive else []))
    in_turn = Window.orderBy("n")  # a row for each distinct class size
    sizes = sizes.withColumn("up_to", F.sum("m").over(in_turn)).withColumn("all", F.sum("m").over(Window.partitionBy()))
    at_risk = F.coalesce(F.sum(F.when(F.col("n") < threshold, F.col("n") * F.col("m"))), F.lit(0))
    row = sizes.agg(
        F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("records"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("classes"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_k"),
        F.round(F.sum(F.col("n") * F.col("m")) / F.sum("m"), 6).alias("avg_k"),
        F.min(F.when(F.col("up_to") > F.floor(F.col("all") / 2), F.col("n"))).alias("median_k"),
        at_risk.alias("at_risk"),
        *([F.min("l").alias("min_l")] if sensitive else []),
    )
    row = row.withColumn("risk_percent", F.round(F.when(F.col("records") > 0, F.col("at_risk") * 100.0 / F.col("records")).otherwise(0.0), 2))
    level = F.when((F.col("risk_percent") > 25) | (F.col("min_k") == 1), "CRITICAL").when((F.col("risk_percent") > 5) | (F.col("min_k") < threshold), "MODERATE").otherwise("LOW")
    return row.withColumn("risk_level", level)


def outlier_classes(df: DataFrame, qis: Sequence[str], threshold: int = 3, most: int = 3) -> DataFrame:
    return classes(df, qis).where(F.col("n") < threshold).orderBy("n", *qis).limit(most)


def l_diversity(df: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    return classes(df, qis, sensitive).agg(F.min("l").alias("min_l"))


def recommendations(qis: Sequence[str], at_risk: int) -> list[str]:
    if not at_risk:
        return ["No class is below the threshold."]
    out = []
    for c in qis:
        name = c.lower()
        if "age" in name or "birth" in name or "dob" in name:
            out.append(f"Bin {c} into ten-year ranges.")
        elif "zip" in name or "postal" in name or "city" in name:
            out.append(f"Coarsen {c} to its region.")
        elif "date" in name:
            out.append(f"Shorten {c} to year and month.")
    return [*out, f"Merge or suppress the classes of the {at_risk} rows at risk."]


def bin_column(c: Column, size: int = 10) -> Column:
    """A number's range low-high; null and NaN as <UNKNOWN>; other text as it is."""
    n = c.try_cast("double")
    low = F.floor(n / size) * size
    binned = F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string"))
    return F.when(c.isNull() | F.isnan(n), "<UNKNOWN>").when(n.isNull(), c.cast("string")).otherwise(binned)


def generalise(df: DataFrame, qis: Sequence[str] | None = None, k: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """df with its quasi-identifiers coarsened until every class has k rows or more.

    Ids become ID_00001 and so on: by ``order`` if given (numbered within ranges), else by a hash that keeps equal
    ids equal.  Ages and years are banded, postal codes cut to three characters, dates to the month, rare values
    of others become Other.  Classes still below k go into the largest class if they are few, else all of their
    quasi-identifiers become <GENERALIZED>.
    """
    out, own = df, free_prefix(df)
    surrogates = [c for c in df.columns if re.search(P.SURROGATE_NAMES, c.strip(), re.I)]
    if surrogates and order:
        out = running_total(out, [F.col(f"`{c}`") for c in order], F.lit(1).cast("long"), own + "number")
    for c in surrogates:
        number = F.col(own + "number") if order else F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(10**15))
        out = out.withColumn(c, F.format_string("ID_%05d", number))
    qis = [c for c in resolve_quasi_identifiers(out, qis) if not policy.is_key(c) and not policy.is_metric(c)]
    if not qis:
        return out
    for c in qis:
        name, value = c.lower(), F.col(f"`{c}`").cast("string")
        if "age" in name or "year" in name:
            out = out.withColumn(c, age_band(value))
        elif "zip" in name or "postal" in name:
            out = out.withColumn(c, F.coalesce(F.concat(F.substring(strip(value), 1, 3), F.lit("XX")), F.lit(NULL)))
        elif any(x in name for x in ("date", "dob", "birth")):
            out = out.withColumn(c, F.coalesce(F.when(F.length(strip(value)) >= 7, F.substring(strip(value), 1, 7)), F.lit(NULL)))
        else:
            counts = out.groupBy(value.alias(own + "v")).agg(F.count("*").alias(own + "n"))
            often = counts.agg(F.sum((F.col(own + "v").isNotNull() & (F.col(own + "n") >= k)).cast("int")).alias(own + "often"), F.count("*").alias(own + "all"))
            counts = counts.crossJoin(F.broadcast(often))  # one row
            out = out.join(counts, value.eqNullSafe(F.col(own + "v")), "left")
            mixed = (F.col(own + "often") > 0) & (F.col(own + "often") < F.col(own + "all"))
            rare = F.col(own + "v").isNull() | (F.col(own + "n") < k)
            out = out.withColumn(c, F.when(mixed & rare, F.lit("Other")).when(mixed, strip(value)).otherwise(value)).drop(own + "v", own + "n", own + "often", own + "all")
    out = out.withColumns({c: as_text(c) for c in qis})
    sizes = out.groupBy(*qis).agg(F.count("*").alias(own + "n"))
    plan = sizes.agg(
        F.coalesce(F.sum(F.when(F.col(own + "n") < k, F.col(own + "n"))), F.lit(0)).alias(own + "small"),
        F.max_by(F.struct(*qis), F.struct(F.when(F.col(own + "n") >= k, F.col(own + "n")).alias("n"), *qis)).alias(own + "into"),
        F.max(own + "n").alias(own + "most"),
    )
    merge = (F.col(own + "small") < k) & (F.col(own + "most") >= k)
    out = out.join(sizes, list(qis)).crossJoin(F.broadcast(plan))  # one row
    small = F.col(own + "n") < k
    out = out.withColumns({c: F.when(small & merge, F.col(f"{own}into.`{c}`")).when(small, F.lit("<GENERALIZED>")).otherwise(F.col(f"`{c}`")) for c in qis})
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
