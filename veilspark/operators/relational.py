"""Projections, casts, fills, sorts and set operations that the other operators are made of, and tables that compare
states of a dataset."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..functions.scalars import strip
from . import ledger, profile

#: Names of the flattened ledger that become canonical ones.
RENAMES = {"item_code": "GL-Code", "Item_Code": "GL-Code", "Unit_Price": "Unit Price", "Item_Amount": "Item Amount"}
#: Canonical types; other columns are text.
INTEGERS, DOUBLES = ("Sequence",), ("Quantity", "Unit Price", "Item Amount", "invoice_total")


def canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})


def canonical_order(df: DataFrame, first: Sequence[str] = tuple(ledger.ORDER)) -> DataFrame:
    """The preferred columns that are there, then the rest."""
    return df.select(*[F.col(f"`{c}`") for c in [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]])


def typed(df: DataFrame) -> DataFrame:
    """Lenient casts to the canonical types: what isn't a number becomes 1000 for the sequence and 0 for the others,
    text is trimmed, null text is empty."""
    made = {}
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        if c in INTEGERS:
            made[c] = F.coalesce(strip(v).try_cast("double").try_cast("bigint"), F.lit(1000).cast("bigint"))
        elif c in DOUBLES:
            made[c] = F.coalesce(F.regexp_replace(strip(v), ",", "").try_cast("double"), F.lit(0.0))
        else:
            made[c] = F.coalesce(strip(v), F.lit(""))
    return df.withColumns(made)


def fill_defaults(df: DataFrame) -> DataFrame:
    """No nulls: 0 in numbers (1000 in the sequence), empty text elsewhere."""
    values = {c: 1000 if c in INTEGERS else 0 for c, t in df.dtypes if profile.is_numeric(t)}
    return df.fillna(values | {c: "" for c, t in df.dtypes if t == "string"}) if df.columns else df


def forward_fill(df: DataFrame, column: str, order: str) -> DataFrame:
    """Each null takes the last value before it, in two steps over ranges of rows."""
    at, v, filled = (free_prefix(df) + x for x in ("at", "v", "filled"))
    rows = df.select(F.col(f"`{order}`").alias(at), F.col(f"`{column}`").alias(v)).withColumn("_range", F.floor(F.col(at) / ledger.RANGE_ROWS))
    # the value goes with its place
    placed = ledger.last_places(rows, at, {filled: F.col(v).isNotNull()}, {filled: F.struct(at, v)})
    if set(df.columns) == {order, column}:
        return placed.select(*[(F.col(at) if c == order else F.col(f"{filled}.{v}")).alias(c) for c in df.columns])
    known = placed.select(at, F.col(f"{filled}.{v}").alias(v))
    return df.join(known, F.col(f"`{order}`") == F.col(at), "left").withColumn(column, F.col(v)).select(*[F.col(f"`{c}`") for c in df.columns])


def header_offset(df: DataFrame, order: str, scan: int = 25) -> int:
    """Rows above the header of a wide table: those with two cells or fewer, until one is 60 percent filled.  Zero for
    narrow tables and for ledger reports."""
    columns = [c for c in df.columns if c != order]
    if len(columns) < 8:
        return 0
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    line = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))
    offset = 0
    for r in df.orderBy(order).limit(scan).select(filled.alias("n"), line.alias("line")).collect():
        if re.search(r"doc\. no|grand total|gl code", r["line"]):
            return 0
        if r["n"] >= 0.6 * len(columns):
            break
        if r["n"] <= 2:
            offset += 1
    return offset


def sort_by_total(df: DataFrame, order: str) -> DataFrame:
    """By the first column with "total" in its name, the largest first; ties by ``order``."""
    total = next((c for c in df.columns if "total" in c.lower()), None)
    return df.orderBy(F.desc(total), order) if total else df.orderBy(order)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable random order: by the hash of a key with the seed."""
    return df.orderBy(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), key)


def halves(df: DataFrame, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(2)) == 0
    return df.where(first), df.where(~first)


def column_sets(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """column, change: ADDED, DROPPED or KEPT."""
    rows = [(c, "KEPT" if c in clean.columns else "DROPPED") for c in raw.columns] + [(c, "ADDED") for c in clean.columns if c not in raw.columns]
    return raw.sparkSession.createDataFrame(rows, "column string, change string")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct_rows, duplicate_rows."""
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias(free_prefix(df) + "n"))
    return counts.agg(F.coalesce(F.sum(free_prefix(df) + "n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def value_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value, in_a, in_b over all distinct values of a column in two tables."""
    x = a.select(F.col(f"`{column}`").alias("value")).distinct().withColumn("in_a", F.lit(True))
    y = b.select(F.col(f"`{column}`").alias("value")).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, x["value"].eqNullSafe(y["value"]), "full").select(F.coalesce(x["value"], y["value"]).alias("value"), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def three_way(raw: DataFrame, protected: DataFrame, clean: DataFrame) -> DataFrame:
    """state, rows, columns, nulls, masked_cells of the three states of a dataset, counted."""
    out = None
    for name, df in (("RAW", raw), ("PROTECTED", protected), ("CLEAN", clean)):
        texts = [c for c, t in df.dtypes if t == "string"]
        nulls = sum((F.coalesce(F.count_if(F.col(f"`{c}`").isNull()), F.lit(0)) for c in df.columns), F.lit(0))
        masked = sum((F.coalesce(F.count_if(F.col(f"`{c}`").rlike(r"<[A-Z_]+_\d+>")), F.lit(0)) for c in texts), F.lit(0))
        row = df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls"), masked.cast("long").alias("masked_cells")).select(F.lit(name).alias("state"), "rows", F.lit(len(df.columns)).alias("columns"), "nulls", "masked_cells")
        out = row if out is None else out.unionByName(row)
    return out


def kpi_cards(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """card, value: the figures of quality_diff as cards."""
    row = profile.quality_diff(raw, clean)
    names = ["raw_rows", "clean_rows", "rows_diff", "raw_nulls", "clean_nulls", "null_reduction", "score"]
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "card", "value")


def cartography(df: DataFrame) -> DataFrame:
    """column, kind (IDENTIFIER, MEASURE, TIME or DIMENSION, by name and type), loss_percent (nulls, counted)."""
    from . import policy

    kinds = dict(df.dtypes)

    def kind(c: str) -> str:
        if policy.is_key(c):
            return "IDENTIFIER"
        if kinds[c] in ("date", "timestamp", "timestamp_ntz") or re.search("date|time", c, re.I):
            return "TIME"
        return "MEASURE" if profile.is_numeric(kinds[c]) else "DIMENSION"

    named = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kind(c))])
    return profile.missingness(df).select("column", named[F.col("column")].alias("kind"), F.round(100 - F.col("valid_percent"), 2).alias("loss_percent"))
