"""Masking of whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..functions.scalars import entities, free_text_rules, normalise_bilingual, redact, redacted, shape, strip, structural_mask
from ..functions import patterns as P
from .contain import contained


def mask_table(df: DataFrame) -> DataFrame:
    """Every cell by the structural mask; all columns become text."""
    return df.select(*[structural_mask(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def normalise_table(df: DataFrame) -> DataFrame:
    return df.select(*[(normalise_bilingual(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


def pattern_summary(df: DataFrame, order: str) -> DataFrame:
    """category, example, masked: the first example, by ``order``, of each kind of cell."""
    columns = [c for c in df.columns if c != order]
    cells = df.select(F.col(f"`{order}`").alias("_at"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(["_at"], columns, "column", "cell")
    s = strip(F.col("cell"))
    kind = (
        F.when(s.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"), "DATE")
        .when(s.rlike(r"^[A-Za-z]+[-/_]\d+$"), "DOCUMENT_CODE")
        .when(s.rlike(r"^\d+-\d+$"), "ACCOUNT_CODE")
        .when(F.lower(s).isin(*P.STRUCTURE_WORDS), "LABEL")
        .when(F.regexp_replace(s, "[,$]", "").try_cast("double").isNotNull(), "NUMBER")
        .otherwise("TEXT")
    )
    cells = cells.where(F.col("cell").isNotNull() & (s != "")).select(kind.alias("category"), s.alias("cell"), F.struct("_at", "column").alias("at"))
    first = cells.groupBy("category").agg(F.min(F.struct("at", "cell")).alias("first")).select("category", F.col("first.cell").alias("example"))
    return first.select("category", "example", structural_mask(F.col("example")).alias("masked"))


def redact_column(df: DataFrame, column: str) -> DataFrame:
    """df with the column's text redacted and n_<kind>: how often each rule found something, in the order in which
    rules are applied."""
    held = free_prefix(df) + "redacted"
    counts = [f"n_{kind.lower()}" for kind, _, _ in free_text_rules()]
    out = df.withColumn(held, redacted(F.col(f"`{column}`")))
    return out.withColumns({n: F.col(f"{held}.{n}") for n in counts} | {column: F.col(f"{held}.text")}).drop(held)


def find_entities(df: DataFrame, column: str) -> DataFrame:
    """entity, n: names and places in the column's texts."""
    return df.select(F.explode(entities(F.col(f"`{column}`"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def preflight(df: DataFrame, column: str) -> DataFrame:
    """df with one flag for each kind of personal data that would keep the text from leaving."""
    t = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    flags = {
        "has_national_id": t.rlike(r"(?<!\d)[12]\d{9}(?!\d)"),
        "has_email": t.rlike(P.UNIVERSAL["EMAIL"]),
        "has_card": t.rlike(r"(?<!\d)(?:\d{4}[-\s]?){3}\d{4}(?!\d)"),
        "has_ssn": t.rlike(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    }
    out = df.withColumns(flags)
    blocked = F.col("has_national_id") | F.col("has_email") | F.col("has_card") | F.col("has_ssn")
    return out.withColumn("blocked", blocked)


def leaks(text: DataFrame, text_column: str, raw: DataFrame) -> DataFrame:
    """column, value: cells of raw, longer than four characters, that occur in the texts in any case; the least of each
    column.  Any number of cells and texts; see :func:`contain.contained`."""
    found = contained(text.select(F.lit(0).alias("k"), F.col(f"`{text_column}`").alias("t")), "k", "t", raw)
    return found.groupBy("column").agg(F.min("value").alias("value"))


__all__ = ["mask_table", "normalise_table", "pattern_summary", "redact_column", "find_entities", "preflight", "leaks", "redact", "shape"]
