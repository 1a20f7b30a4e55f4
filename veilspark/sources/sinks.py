"""Writers: tables by file type, protected copies, certificates and scripts."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

from pyspark.sql import DataFrame

from .workbook import write_workbook

#: Rows of a sheet that the driver writes at most.
SHEET_ROWS = 1_048_575


def write(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """By suffix: csv and parquet, orc and json as Spark folders, xlsx as one file of SHEET_ROWS rows at most."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind in (".parquet", ".orc", ".json"):
        getattr(df.write.mode(mode), kind[1:])(path)
    elif kind == ".xlsx":
        write_sheets({"Sheet1": df}, path)
    else:
        raise ValueError(f"unknown file type {kind}")
    return path


def write_sheets(sheets: dict[str, DataFrame], path: str) -> str:
    """A workbook; a sheet with more rows than a workbook holds is refused, not cut."""
    tables = {}
    for name, df in sheets.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more than {SHEET_ROWS} rows: write it as parquet or csv")
        tables[name] = (df.columns, [tuple(r) for r in rows])
    write_workbook(path, tables)
    return path


def protected_path(path: str) -> str:
    stem, kind = os.path.splitext(path)
    return f"{stem}_anonymized{kind}"


def write_protected(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """Protected copies beside the source: all sheets in one workbook, or a file for each."""
    out = protected_path(path)
    if out.lower().endswith(".xlsx"):
        return [write_sheets(sheets, out)]
    stem, kind = os.path.splitext(out)
    return [write(df, out if len(sheets) == 1 else f"{stem}_{name}{kind}") for name, df in sheets.items()]


def certificate(results: DataFrame, statute: str, source: str, at: dt.datetime | None = None) -> str:
    """A Markdown certificate of a suite's rows, with a digest of what it says."""
    rows = [r.asDict() for r in results.orderBy("tier", "test").collect()]  # a row for each test
    at = (at or dt.datetime.now(dt.timezone.utc)).isoformat(timespec="seconds")
    digest = hashlib.sha256(json.dumps([source, statute, at, rows], default=str, sort_keys=True).encode()).hexdigest()
    lines = [f"# Compliance certificate\n\n- Source: {source}\n- Statute: {statute}\n- Time: {at}\n- Session: `{digest}`\n", "| tier | test | value | target | result |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r['tier']} | {r['test']} | {r['value']:.4g} | {r['target']:.4g} | {'pass' if r['passed'] else 'FAIL'} |" for r in rows]
    allowed = all(r["passed"] for r in rows if r["tier"] == 1)
    return "\n".join([*lines, "", f"Egress {'allowed' if allowed else 'BLOCKED'}."])


def append_block(path: str, code: str, note: str = "") -> str:
    """Add a block to a pipeline script (.py) or notebook (.ipynb), which is made if it isn't there."""
    if path.endswith(".ipynb"):
        book = {"cells": [], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}
        if os.path.exists(path):
            with open(path) as f:
                book = json.load(f)
        book["cells"].append({"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": code.splitlines(keepends=True), "id": f"block-{len(book['cells'])}"})
        with open(path, "w") as f:
            json.dump(book, f, indent=1)
        return path
    with open(path, "a") as f:
        f.write(f"\n# {note or 'block'}\n{code.rstrip()}\n")
    return path
