"""Feature columns: quick ones by the type of a column, and ratios by its name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from . import policy
from .keys import distinct_counts
from .profile import is_numeric, tall
from .running import running_total

DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


def timestamp(c: Column, kind: str) -> Column:
    if kind in DATE_TYPES:
        return c.cast("timestamp")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MMM-yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])


def opportunities(df: DataFrame) -> DataFrame:
    """column, kind (temporal, numeric, text, categorical or null) and skewed, from one aggregate and the distinct counts."""
    fields, aggs = ["least", "greatest", "bytes", "spaced", "filled"], []
    for i, (c, t) in enumerate(df.dtypes):
        v, x = F.col(f"`{c}`"), F.col(f"`{c}`").cast("double") if is_numeric(t) else F.lit(None).cast("double")
        s = v.cast("string")
        aggs += [F.min(x).alias(f"c{i}_least"), F.max(x).alias(f"c{i}_greatest"), F.avg(F.octet_length(s)).alias(f"c{i}_bytes"), F.coalesce(F.bool_or(s.contains(" ")), F.lit(False)).alias(f"c{i}_spaced"), F.count(v).alias(f"c{i}_filled")]
    rows = tall(df.agg(*aggs), df.columns, fields).join(distinct_counts(df), "column")
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    t = types[F.col("column")]
    named = F.lower("column").rlike("date|time|timestamp|month|year")
    text = (F.col("bytes") > 15) | (F.col("spaced") & (F.col("distinct") == F.col("filled")))
    kind = F.when(t.isin(*DATE_TYPES) | ((t == "string") & named), "temporal").when(F.col("least").isNotNull(), "numeric").when(text, "text").when(F.col("distinct").between(2, 100), "categorical")
    skewed = (F.col("least") > 0) & (F.col("greatest") / (F.col("least") + 1e-5) > 100)
    return rows.select("column", kind.alias("kind"), F.coalesce(skewed, F.lit(False)).alias("skewed"))


def temporal(df: DataFrame, column: str, weekend: tuple[int, ...] = (5, 6, 7)) -> DataFrame:
    """ISO weekday, is_weekend (by default Friday to Sunday) and month."""
    at = timestamp(F.col(f"`{column}`"), dict(df.dtypes)[column])
    day = F.weekday(at) + 1
    return df.withColumns({f"{column}_weekday": day, f"{column}_is_weekend": day.isin(*weekend).cast("int"), f"{column}_month": F.month(at)})


def z_score(df: DataFrame, column: str) -> DataFrame:
    """By the sample's deviation; df as it is where that is 0 or undefined: the column is null then."""
    v = F.col(f"`{column}`").cast("double")
    mean, std = (free_prefix(df) + x for x in ("mean", "std"))
    row = df.agg(F.avg(v).alias(mean), F.stddev_samp(v).alias(std))
    return df.crossJoin(F.broadcast(row)).withColumn(f"{column}_zscore", F.when(F.col(std) > 0, (v - F.col(mean)) / F.col(std))).drop(mean, std)


def log1p(df: DataFrame, column: str) -> DataFrame:
    v = F.col(f"`{column}`").cast("double")
    return df.withColumn(f"{column}_log1p", F.when(v > -1, F.log1p(v)))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """How many rows have the value; null for null.  Counts are joined, so a frequent value is no single task."""
    v = F.col(f"`{column}`")
    own = free_prefix(df) + "v"
    counts = df.where(v.isNotNull()).groupBy(v.alias(own)).agg(F.count("*").alias(f"{column}_freq"))
    return df.join(counts, v == F.col(own), "left").drop(own)


def text_metrics(df: DataFrame, column: str) -> DataFrame:
    v = F.col(f"`{column}`")
    return df.withColumns({f"{column}_char_len": F.octet_length(v), f"{column}_word_count": F.when(v.isNotNull(), F.regexp_count(v, F.lit(r"\s+")) + 1)})


def quick(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features for every temporal and numeric column, three categorical and two text ones; with the new names."""
    kinds: dict[str, list[str]] = {}
    skewed = set()
    for r in opportunities(df).collect():  # a row for each column
        kinds.setdefault(r["kind"], []).append(r["column"])
        if r["skewed"]:
            skewed.add(r["column"])
    out = df
    for c in kinds.get("temporal", []):
        out = temporal(out, c)
    for c in kinds.get("numeric", []):
        if not policy.is_key(c):
            out = z_score(out, c)
            out = log1p(out, c) if c in skewed else out
    for c in kinds.get("categorical", [])[:3]:
        out = frequency(out, c)
    for c in kinds.get("text", [])[:2]:
        out = text_metrics(out, c)
    return out, [c for c in out.columns if c not in df.columns]


#: Name of a feature, patterns of the columns it needs, and how it is computed from them.
DOMAIN = (
    ("debt_to_income", ("debt", "income"), lambda a, b: F.try_divide(a, b)),
    ("loan_to_value", ("loan", "property_value|asset_value"), lambda a, b: F.try_divide(a, b)),
    ("profit_margin", ("profit", "revenue|sales"), lambda a, b: F.try_divide(a, b)),
    ("gross_margin", ("revenue|sales", "cost"), lambda a, b: F.try_divide(a - b, a)),
    ("discount_percent", ("discount", "price|amount"), lambda a, b: F.try_divide(a, b) * 100),
    ("click_through_rate", ("clicks", "impressions"), lambda a, b: F.try_divide(a, b)),
    ("return_on_ad_spend", ("revenue|sales", "ad_spend|spend"), lambda a, b: F.try_divide(a, b)),
    ("cost_per_acquisition", ("spend", "conversions|acquisitions"), lambda a, b: F.try_divide(a, b)),
    ("annual_recurring_revenue", ("mrr|monthly_revenue",), lambda a: a * 12),
    ("session_minutes", ("session_seconds|session_duration",), lambda a: a / 60),
    ("weight_density", ("weight", "volume"), lambda a, b: F.try_divide(a, b)),
    ("price_per_area", ("price", "area|sqft|sqm"), lambda a, b: F.try_divide(a, b)),
    ("revenue_per_available_room", ("room_revenue|revenue", "rooms|available_rooms"), lambda a, b: F.try_divide(a, b)),
    ("energy_intensity", ("energy|kwh", "area|output"), lambda a, b: F.try_divide(a, b)),
    ("total_compensation", ("salary", "bonus"), lambda a, b: a + b),
)


def domain_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Ratios whose columns are there, by name; with date latency, credit, age and blood-pressure bands."""
    numeric = [c for c, t in df.dtypes if is_numeric(t)]
    made: dict[str, Column] = {}
    for name, needs, formula in DOMAIN:
        found = [next((c for c in numeric if re.search(p, c, re.I)), None) for p in needs]
        if all(found) and len(set(found)) == len(found):
            made[name] = formula(*[F.col(f"`{c}`").cast("double") for c in found])
    dates = [c for c, t in df.dtypes if t in DATE_TYPES]
    if len(dates) >= 2:
        made["latency_days"] = F.datediff(F.col(f"`{dates[1]}`"), F.col(f"`{dates[0]}`"))
    for c in df.columns:
        v = F.col(f"`{c}`")
        if re.search("credit_score", c, re.I):
            made["credit_tier"] = F.when(v >= 750, "PRIME").when(v >= 650, "NEAR_PRIME").when(v.isNotNull(), "SUBPRIME")
        if re.search("cholesterol", c, re.I):
            made["cholesterol_tier"] = F.when(v < 200, "NORMAL").when(v < 240, "BORDERLINE").when(v.isNotNull(), "HIGH")
        if re.search(r"(^|_)age$", c, re.I):
            made["age_cohort"] = F.when(v < 18, "MINOR").when(v < 35, "YOUNG_ADULT").when(v < 60, "ADULT").when(v.isNotNull(), "SENIOR")
        if re.search("blood_pressure|(^|_)bp$", c, re.I):
            made["systolic"] = F.regexp_extract(v.cast("string"), r"(\d+)\s*/\s*(\d+)", 1).try_cast("int")
            made["diastolic"] = F.regexp_extract(v.cast("string"), r"(\d+)\s*/\s*(\d+)", 2).try_cast("int")
        for unit, feature in (("GB", "ram_gb"), ("mAh", "battery_mah"), ("Hz", "refresh_hz")):
            if re.search({"GB": "ram|memory", "mAh": "battery", "Hz": "refresh|display"}[unit], c, re.I) and dict(df.dtypes)[c] == "string":
                made[feature] = F.regexp_extract(v, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}", 1).try_cast("double")
    return df.withColumns(made), list(made)


def windowed_counts(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with line_index (place within key, from 1) and key_count.  Places come from ranges of rows, so a key that holds many rows is
    no single task; null keys are one key, ties of ``order`` are in any order."""
    own = free_prefix(df)
    run = running_total(df, [F.col(f"`{key}`"), F.col(f"`{order}`")], F.lit(1), own + "upto")
    sizes = run.groupBy(F.col(f"`{key}`").alias(own + "key")).agg(F.count("*").alias("key_count"), (F.min(own + "upto") - 1).alias(own + "before"))
    both = run.join(sizes, F.col(f"`{key}`").eqNullSafe(F.col(own + "key")))
    return both.withColumn("line_index", (F.col(own + "upto") - F.col(own + "before")).cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], "line_index", "key_count")
