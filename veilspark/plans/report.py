"""Texts from results: briefings, prompts, recipes and generated tests.  All inputs are tables of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P
from ..operators.insight import FEATURE_OF_ROLE
from ..operators.ledger import Layout


def table(df: DataFrame, most: int = 50) -> str:
    """A Markdown table of the first rows."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def briefing(name: str, profiles: DataFrame, morphology: DataFrame | None = None) -> str:
    parts = [f"# Engineering briefing: {name}", table(profiles.select("column", "type", "role", "null_percent", "cardinality"))]
    if morphology is not None:
        advice = [f"- {r['column']}: {FEATURE_OF_ROLE[r['role']]}" for r in morphology.select("column", "role").collect() if r["role"] in FEATURE_OF_ROLE]
        parts += ["## Features", "\n".join(advice)]
    return "\n\n".join(parts)


def master_prompt(name: str, profiles: DataFrame, mock: DataFrame, statute: str, goal: str) -> str:
    """A prompt with schema, risks and mock rows only: no cell of the source is in it."""
    sections = {
        "Role": "You write PySpark transformations.",
        "Goal": goal,
        "Statute": statute,
        "Schema": table(profiles.select("column", "type", "role", "null_percent")),
        "Mock rows": table(mock),
        "Rules": "- No files, network or processes.\n- Keep every row unless told otherwise.\n- Keep tokens of the form <TAG_1> as they are.",
        "Result": "A DataFrame named `df_clean`.",
        "Checks": "- Sums of money columns stay.\n- Key columns stay unique.",
    }
    return f"# {name}\n\n" + "\n\n".join(f"## {k}\n{v}" for k, v in sections.items())


def repair_prompt(code: str, error: str, advice: str) -> str:
    return f"The code failed.\n\n```python\n{code.strip()}\n```\n\nError: {error}\n\n{advice}\n\nReturn the whole corrected code."


def enrich_prompt(code: str, columns: list[str], features: list[str]) -> str:
    """Asks for further columns on top of code that works."""
    wanted = "\n".join(f"- {f}" for f in features)
    return f"Add these columns to the result of the code; keep all rows and the columns {', '.join(columns)}.\n\n{wanted}\n\n```python\n{code.strip()}\n```\n\nReturn the whole code."


def synthesis(name: str, rows: int, found: dict[str, DataFrame]) -> str:
    """What the column analysers found, as a page for those who decide; ``found`` is what ``lifecycle.think`` returns.
    Tables of a row per column or pair are read, nothing else."""
    shapes = found["morphology"].select("column", "role").collect()
    kinds = {k: [r.column for r in shapes if k in r.role] for k in ("TEMPORAL", "NUMERIC", "CATEGORICAL", "IDENTIFIER", "NARRATIVE")}
    lines = [f"# {name}", f"{rows:,} rows, {len(shapes)} columns.", "## Shape"]
    lines += [f"- {k.lower()}: {', '.join(own)}" for k, own in kinds.items() if own]
    keys = [r.column for r in found["keys"].where("is_key").collect()]
    pairs = [f"{r.a} + {r.b}" for r in found["composite_keys"].where("is_key").collect()] if "composite_keys" in found and not keys else []
    lines += ["## Keys", f"- {', '.join(keys or pairs) or 'none found'}"]
    if "dependencies" in found:
        held = [f"- {r.determinant} determines {r.dependent}" for r in found["dependencies"].where("holds").collect() if r.determinant not in keys]
        lines += ["## Dependencies", *held] if held else []
    if "laws" in found:
        held = [f"- {r.law}: {', '.join(str(x) for x in (r.a, r.b, r.c) if x)} ({r.share:.0%} of rows)" for r in found["laws"].where("holds").collect()]
        lines += ["## Laws", *held] if held else []
    mixed = [r.column for r in found["contaminated"].where("contaminated").collect()]
    skewed = [r.column for r in found["outliers"].where("skewed").collect()] if "outliers" in found else []
    lines += ["## Risks", *[f"- {c}: numbers mixed with text" for c in mixed], *[f"- {c}: heavily skewed" for c in skewed]] if mixed or skewed else []
    return "\n\n".join(lines)


def questions(found: dict[str, DataFrame]) -> list[str]:
    """What to ask the data's owner before anything is changed."""
    keys = [r.column for r in found["keys"].where("is_key").collect()]
    asked = [] if keys else ["No column identifies a row: which columns together should?"]
    asked += [f"Should the cells of {r.column} that aren't numbers become empty, or do they mean something?" for r in found["contaminated"].where("contaminated").collect()]
    if "outliers" in found:
        asked += [f"{r.outliers} values of {r.column} lie far outside the rest: errors, or the cases that matter?" for r in found["outliers"].where("outliers > 0").collect()]
    asked += [f"{r.column} holds free text: may it leave as it is?" for r in found["morphology"].where("role = 'FREE_TEXT_NARRATIVE'").collect()]
    return asked


def to_file(spark: SparkSession, text: str, path: str) -> str:
    """Write a text to a file of any file system that Spark knows; returns the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def edit_prompt(code: str, wish: str) -> str:
    return f"Change this code: {wish}\n\n```python\n{code.strip()}\n```\n\nReturn the whole code."


def ledger_recipe(layout: Layout) -> str:
    """PySpark that flattens reports of this layout."""
    return f"from veilspark.operators import ledger\n\nlayout = ledger.{layout!r}\ndf_clean = ledger.clean(df, layout)\n"


def power_query(layout: Layout, path: str = "C:\\report.xlsx") -> str:
    """The same steps as M code: noise goes, masters are filled down until a section ends, wrapped texts join their
    line, and columns get types."""
    column = lambda i: f"Column{i + 1}"
    words = lambda own: "{" + ", ".join(f'"{w}"' for w in own) + "}"
    masters = {"doc_no": layout.doc, "doc_date": layout.date, "customer_code": layout.code, "customer_name": layout.name, "invoice_total": layout.total}
    masters = {n: i for n, i in masters.items() if i is not None}
    items = {"Sequence": layout.seq, "GL-Code": layout.item, "Quantity": layout.qty, "UOM": layout.uom, "Unit Price": layout.price, "Item Amount": layout.amount}
    items = {n: i for n, i in items.items() if i is not None}
    types = {n: "type number" for n in ("Quantity", "Unit Price", "Item Amount", "invoice_total") if n in items or n in masters}
    types |= {"Sequence": "Int64.Type"} if "Sequence" in items else {}
    types |= {"doc_date": "type date"} if "doc_date" in masters else {}
    steps = [
        ("Source", f'Excel.Workbook(File.Contents("{path}"), null, true){{0}}[Data]'),
        ("Indexed", 'Table.AddIndexColumn(Source, "Row", 0, 1)'),
        ("Lined", 'Table.AddColumn(Indexed, "Line", each Text.Lower(Text.Combine(List.Transform(List.RemoveNulls(Record.ToList(Record.RemoveFields(_, {"Row"}))), Text.From), " ")))'),
        ("Marked", f'Table.AddColumn(Lined, "IsMaster", each Text.Contains(Text.From([{column(layout.doc)}] ?? ""), "-") and List.AnyTrue(List.Transform({words(layout.prefixes)}, (p) => Text.StartsWith(Text.Upper(Text.From([{column(layout.doc)}] ?? "")), p))))'),
        ("Ended", f'Table.AddColumn(Marked, "IsEnd", each not [IsMaster] and List.AnyTrue(List.Transform({words(P.LEDGER_RESET)}, (w) => Text.Contains([Line], w))))'),
        ("Sectioned", 'Table.FillDown(Table.AddColumn(Ended, "Section", each if [IsMaster] or [IsEnd] then [Row] else null), {"Section"})'),
        ("Quiet", f'Table.SelectRows(Sectioned, each [IsMaster] or [IsEnd] or not List.AnyTrue(List.Transform({words(P.LEDGER_NOISE)}, (w) => Text.Contains([Line], w))))'),
    ]
    last = "Quiet"
    for n, i in masters.items():
        empty = '"\u0000"'  # the end of a section stops the filling
        steps.append((f"With_{n}", f'Table.AddColumn({last}, "{n}", each if [IsMaster] then [{column(i)}] else if [IsEnd] then {empty} else null)'))
        last = f"With_{n}"
    numbers = " or ".join(f"[{column(i)}] <> null" for n, i in items.items() if n != "GL-Code" and n != "UOM") or "false"
    steps += [
        ("Filled", f"Table.FillDown({last}, {words(masters)})"),
        ("Inside", f'Table.SelectRows(Filled, each not [IsMaster] and not [IsEnd] and [doc_no] <> null and [doc_no] <> "\u0000" and [{column(layout.desc)}] <> null)'),
        ("Starts", f'Table.FillDown(Table.AddColumn(Inside, "Start", each if {numbers} then [Row] else null), {{"Start"}})'),
        ("Grouped", 'Table.Group(Starts, {"Start"}, {' + ", ".join([f'{{"Full_Description", each Text.Combine(List.Transform([{column(layout.desc)}], Text.From), " ")}}', *(f'{{"{n}", each List.First([{n}])}}' for n in masters), *(f'{{"{n}", each List.First([{column(i)}])}}' for n, i in items.items())]) + "})"),
        ("Typed", "Table.TransformColumnTypes(Grouped, {" + ", ".join(f'{{"{n}", {t}}}' for n, t in types.items()) + "})"),
    ]
    return "let\n    " + ",\n    ".join(f"{n} = {x}" for n, x in steps) + "\nin\n    Typed"


def test_module(name: str, columns: list[str], rows: int, keys: list[str]) -> str:
    """A pytest module that holds a clean table to its schema."""
    lines = ["import pytest", "from pyspark.sql import SparkSession", "", "", "@pytest.fixture(scope='module')", "def df():", f"    return SparkSession.builder.getOrCreate().table({name!r})", ""]
    checks = {"columns": f"assert df.columns == {columns!r}", "rows": f"assert df.count() >= {rows}"}
    checks |= {f"key_{k}": f"assert df.select({k!r}).distinct().count() == df.count()" for k in keys}
    for k, body in checks.items():
        lines += ["", f"def test_{k}(df):", f"    {body}", ""]
    return "\n".join(lines)


def chart_script(kind: str, **arguments) -> str:
    given = ", ".join(f"{k}={v!r}" for k, v in arguments.items())
    return f"from veilspark.operators import charts\n\ncharts.{kind}(df, {given}).show()\n"


def bars(rows: list[tuple[str, float]], width: int = 40) -> str:
    """A bar chart in text."""
    top = max((abs(v) for _, v in rows), default=0) or 1
    long = max((len(k) for k, _ in rows), default=0)
    return "\n".join(f"{k:<{long}} {'█' * round(width * abs(v) / top)} {v:g}" for k, v in rows)
