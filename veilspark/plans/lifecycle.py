"""From a file to a protected, clean table with its certificate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import audit, features, insight, ledger, links, policy, profile, risk
from ..operators.vault import Vault
from ..sources import readers


@dataclass
class Workbook:
    """The sheets of a file with their profiles and links."""

    sheets: dict[str, DataFrame]
    roles: dict[str, str]
    rows: dict[str, int]
    primary: str
    profiles: dict[str, DataFrame]
    links: DataFrame | None


def profile_workbook(spark: SparkSession, path: str) -> Workbook:
    """Find headers, profile each sheet, name the primary one (most rows) and the keys between sheets."""
    sheets = readers.workbook(spark, path)
    sheets = {n: readers.with_header(df).drop(readers.ORDER) if readers.ORDER in df.columns else df for n, df in sheets.items()}
    rows = {n: df.count() for n, df in sheets.items()}
    roles = {n: profile.sheet_role(n, df.columns, rows[n]) for n, df in sheets.items()}
    found = links.foreign_keys(sheets) if len(sheets) > 1 else None
    return Workbook(sheets, roles, rows, max(rows, key=rows.get), {n: profile.profile(df) for n, df in sheets.items()}, found)


def protect(sheets: dict[str, DataFrame], origin: str = "Universal", target: str = "Universal") -> tuple[dict[str, DataFrame], Vault]:
    """Tokens for all sheets from one vault, so that keys still join."""
    vault = Vault.build(list(sheets.values()), policy.resolve(origin, target))
    return {n: vault.tokenise(df) for n, df in sheets.items()}, vault


def gate(df: DataFrame, mock: DataFrame, key: str, qis: Sequence[str] | None = None, sensitive: str | None = None, most: int | None = 6) -> DataFrame:
    """The suite of privacy tests over a table whose ``key`` numbers its rows from 0; distances take the first ``most``
    numbers and texts (None: all)."""
    qis = list(qis or risk.resolve_quasi_identifiers(df.drop(key)))
    sensitive = sensitive or policy.sensitive_column(df.columns)
    numeric = [c for c, t in df.dtypes if profile.is_numeric(t) and c != key and c in mock.columns][:most]
    categorical = [c for c, t in df.dtypes if t == "string" and c in mock.columns][:most]
    return audit.suite(df, mock, key, qis, sensitive, numeric, categorical)


def think(df: DataFrame, most: int | None = 8) -> dict[str, DataFrame]:
    """Everything the column analysers find, as lazy tables: each is one aggregate or a few.  Pairs and triples of
    columns are made of the first ``most`` columns (None: all), since their number grows with its square and cube."""
    shapes = insight.morphology(df)
    numeric = [c for c, t in df.dtypes if profile.is_numeric(t)]
    few = df.columns[:most]
    found = {"morphology": shapes, "contaminated": insight.contaminated(shapes), "entropy": insight.entropy(df, df.columns), "keys": insight.candidate_keys(df), "dependencies": insight.dependencies(df, few), "spatial": insight.spatial(df), "vectors": insight.vectors(df), "entities": insight.entity_tags(df), "statutory": insight.statutory(df.columns, shapes)}
    if numeric:
        found["outliers"] = insight.outliers(df, numeric)
        found["laws"] = insight.laws(df, numeric[:most])
    if len(few) > 1:
        found["composite_keys"] = insight.composite_keys(df, few)
    return found


def clean(df: DataFrame, order: str = readers.ORDER) -> tuple[DataFrame, list[str]]:
    """A ragged ledger flattened, any other table as it is; then quick features."""
    if order in df.columns and ledger.is_ragged(df, order).first()["ragged"]:
        df = ledger.flatten(df, order=order).drop(order)
    return features.quick(df)
