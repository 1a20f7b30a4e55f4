"""Profiles of tables: one aggregate over all columns, then a tall result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import strip
from . import policy
from .keys import distinct_counts

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
BLANKS = "^\\s|\\s$|[  \\t\\r\\n]"


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def tall(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One wide row with c<i>_<field> turned into a row for each column."""
    parts = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[F.col(f"c{i}_{f}").alias(f) for f in fields]) for i, c in enumerate(columns)])
    return row.select(F.explode(parts).alias("x")).select("x.*")


def missingness(df: DataFrame) -> DataFrame:
    """column, nulls, valid_percent."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}_nulls") for i, c in enumerate(df.columns)])
    row = row.withColumns({f"c{i}_valid_percent": F.when(F.col("n") > 0, F.round((F.col("n") - F.col(f"c{i}_nulls")) * 100.0 / F.col("n"), 2)).otherwise(0.0) for i in range(len(df.columns))})
    return tall(row, df.columns, ["nulls", "valid_percent"]).drop("position")


def role(name: str, kind: str) -> Column:
    """The role of a column from the words of its name, its type and the columns nulls, ratio and mean_length."""
    words = set(re.split(r"\W+", name.lower().replace("_", " ")))
    ratio, nulls = F.col("ratio"), F.col("nulls")
    chain = F.when((ratio >= 0.98) & (nulls == 0), "PRIMARY_KEY")
    for found, own in (("QUASI_IDENTIFIER", P.QUASI_ROLE_WORDS), ("BUSINESS_KEY", P.KEY_ROLE_WORDS), ("DIRECT_IDENTIFIER", P.PERSON_ROLE_WORDS), ("QUASI_IDENTIFIER", P.UNIT_ROLE_WORDS)):
        if words & set(own):
            return chain.otherwise(found)
    if is_numeric(kind):
        return chain.otherwise("NUMERIC_MEASURE")
    return chain.when(F.col("mean_length") > 40, "FREE_TEXT_NARRATIVE").when(ratio < 0.20, "CATEGORICAL").otherwise("DESCRIPTIVE")


def profile(df: DataFrame) -> DataFrame:
    """column, type, nulls, null_percent, cardinality, ratio, role, flags for each column, from one aggregate over all
    rows and values, and a shuffle of (column, value) for the cardinalities."""
    fields, aggs = ["n", "nulls", "null_percent", "mean_length", "date_formats", "negatives", "currency", "blanks"], []
    for i, (c, kind) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        t = v.cast("string")
        text = kind == "string"
        no = F.lit(False)
        aggs += [
            F.count_if(v.isNull()).alias(f"c{i}_nulls"),
            F.avg(F.length(t)).alias(f"c{i}_mean_length"),
            F.array(*[F.max(F.when(strip(t).rlike(p), F.lit(name))) for name, p in P.DATE_FORMATS.items()] if text else [F.lit(None).cast("string")]).alias(f"c{i}_date_formats"),
            *[(F.coalesce(F.bool_or(t.rlike(p)), no) if text else no).alias(f"c{i}_{f}") for f, p in (("negatives", P.ACCOUNTING_NEGATIVE), ("currency", P.DIRTY_CURRENCY), ("blanks", BLANKS))],
        ]
    row = df.agg(F.count("*").alias("n"), *aggs)
    n = F.col("n")
    row = row.withColumns({f"c{i}_null_percent": F.when(n > 0, F.round(F.col(f"c{i}_nulls") * 100.0 / n, 1)).otherwise(0.0) for i in range(len(df.columns))} | {f"c{i}_n": n for i in range(len(df.columns))})
    out = tall(row, df.columns, fields).withColumn("date_formats", F.array_sort(F.array_compact("date_formats")))
    out = out.join(distinct_counts(df).withColumnRenamed("distinct", "cardinality"), "column")
    out = out.withColumn("ratio", F.when(n > 0, F.round(F.col("cardinality") / n, 4)).otherwise(0.0)).drop("n")
    roles, types = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, kind in df.dtypes:
        roles = F.when(F.col("column") == c, role(c, kind)).otherwise(roles)
        types = F.when(F.col("column") == c, F.lit(kind)).otherwise(types)
    return out.withColumns({"role": roles, "type": types}).drop("position")


def inventory(df: DataFrame, order: str) -> DataFrame:
    """column, role, type, null_percent, unique, samples (three first values by order, of all rows), tier."""
    base = profile(df)
    cells = df.select(F.col(f"`{order}`").alias("_at"), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot(["_at"], df.columns, "column", "v").where(F.col("v").isNotNull())
    first = F.row_number().over(Window.partitionBy("column").orderBy("_at", "v"))  # each task passes on three cells a column
    cells = cells.withColumn("_k", first).where("_k <= 3")
    samples = cells.groupBy("column").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("_at", "v"))), 1, 3), lambda s: s["v"]).alias("samples"))
    tiers = policy.tiers(df).select("column", "tier")
    return base.select("column", "role", "type", "null_percent", F.col("cardinality").alias("unique")).join(samples, "column", "left").join(F.broadcast(tiers), "column")


def sheet_role(name: str, columns: list[str], rows: int) -> str:
    low = name.lower()
    periods = sum(bool(re.search(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|^q[1-4]\b|\b(19|20)\d\d\b", c.strip().lower())) for c in columns)
    if (periods >= 3 or any(x in low for x in ("pivot", "summary", "crosstab"))) and rows < 100:
        return "PIVOT_TABLE"
    if any(x in low for x in ("dim", "lookup", "ref", "master", "code", "map")) and rows < 2000:
        return "LOOKUP_DIMENSION"
    if (rows <= 5 and len(columns) <= 2) or (any(x in low for x in ("meta", "info", "param", "readme", "header")) and rows <= 15):
        return "METADATA_BLOCK"
    return "TRANSACTION_LEDGER"


def subtotal_rows(df: DataFrame, order: str) -> DataFrame:
    """Rows whose first column says that they are totals."""
    first = next(c for c in df.columns if c != order)
    return df.where(F.col(f"`{first}`").cast("string").rlike(r"(?i)\b(total|subtotal|sub-total|grand total|summary|balance|all)\b"))


def snake_percent(columns: list[str]) -> float:
    return 100.0 * sum(bool(re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", c)) for c in columns) / max(1, len(columns))


def quality_diff(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows, columns and nulls before and after, the reduction of nulls, and a score of 0 to 100."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        nulls = sum((F.coalesce(F.count_if(F.col(f"`{c}`").isNull()), F.lit(0)) for c in df.columns), F.lit(0))
        return df.agg(F.count("*").alias(f"{name}_rows"), nulls.cast("long").alias(f"{name}_nulls")).withColumn(f"{name}_cols", F.lit(len(df.columns)))

    row = counts(raw, "raw").crossJoin(counts(clean, "clean"))  # one row each
    cells = F.greatest(F.col("clean_rows") * F.col("clean_cols"), F.lit(1))
    null_percent = F.col("clean_nulls") * 100.0 / cells
    score = 0.4 * F.greatest(F.lit(0.0), 100 - 2 * null_percent) + 0.3 * snake_percent(clean.columns) + F.when(F.col("clean_rows") > 0, 30).otherwise(0)
    reduction = F.when(F.col("raw_nulls") > 0, (F.col("raw_nulls") - F.col("clean_nulls")) * 100.0 / F.col("raw_nulls")).otherwise(F.when(F.col("clean_nulls") == 0, 100.0).otherwise(0.0))
    return row.withColumns({"rows_diff": F.col("clean_rows") - F.col("raw_rows"), "null_reduction": F.round(reduction, 2), "score": F.least(F.lit(100), F.greatest(F.lit(0), F.round(score).cast("int")))})


def column_shift(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """column, raw_nulls, clean_nulls, shift."""
    a = missingness(raw).select("column", F.col("nulls").alias("raw_nulls"))
    b = missingness(clean).select("column", F.col("nulls").alias("clean_nulls"))
    r, c = F.col("raw_nulls"), F.col("clean_nulls")
    shift = F.when(r.isNull(), "NEW").when(c.isNull(), "DROPPED").when(c < r, "IMPUTED").when(c > r, "EXPANDED").otherwise("UNCHANGED")
    return a.join(b, "column", "full").withColumn("shift", shift)


def retention_audit(raw: DataFrame, clean: DataFrame, ledger: bool = False, line_items: int = 0) -> DataFrame:
    """One row: rows before and after, retained (percent), money columns zeroed, passed, reason."""
    money = [c for c, t in raw.dtypes if is_numeric(t) and c in clean.columns and re.search("amount|price|total|revenue|sales|value|cost|balance|profit", c, re.I)]

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{name}_rows"), *[F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(f"{name}_{i}") for i, c in enumerate(money)])

    row = counts(raw, "raw").crossJoin(counts(clean, "clean"))  # one row each
    n, m = F.col("raw_rows"), F.col("clean_rows")
    if money:
        best = F.greatest(*[F.col(f"raw_{i}") for i in range(len(money))], F.lit(0.0))
        left = F.greatest(*[F.col(f"clean_{i}") for i in range(len(money))], F.lit(0.0))
        zeroed = (best > 100) & (left <= 0)
    else:
        zeroed = F.lit(False)
    if ledger:
        lost = (m < 0.4 * line_items) if line_items >= 5 else ((m < 0.08 * n) & (m < 15))
    else:
        lost = m < 0.7 * n
    reason = F.when(m == 0, "empty result").when(n <= 5, "").when(lost, "rows lost").when(zeroed, "sums zeroed").otherwise("")
    row = row.select("raw_rows", "clean_rows", F.round(F.when(n > 0, m * 100.0 / n).otherwise(100.0), 2).alias("retained"), zeroed.alias("zeroed"), reason.alias("reason"))
    return row.withColumn("passed", F.col("reason") == "")
