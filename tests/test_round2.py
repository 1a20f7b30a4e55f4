"""Large and small vaults, layouts by values, clashing names, hostile code by other names, statutes."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.names import free_prefix
from veilspark.functions.scalars import double_of, strip
from veilspark.operators import audit, ledger, mask, policy, vault
from veilspark.operators.vault import Vault
from veilspark.plans import sandbox

NAMES = ("_raw", "_token", "_text", "_new", "_found", "_v_raw", "_v_token", "_v_0", "_v_one", "_v_other", "_v_new", "_v_redacted", "raw", "to", "tag")


def people(spark):
    r = random.Random(1)
    rows = [(f"Ann {r.randrange(40)}", f" p{i % 30}@mail.com", f"call 212-555-01{i % 60:02d} or p{i % 30}@mail.com, p{i % 30}@mail.com.au", float(i)) for i in range(300)]
    rows += [(None, None, None, None), ("", " ", "", 1.0), ("Ann 1", "p1@mail.com", "nothing here", 2.0)]
    return spark.createDataFrame(rows, "customer_name string, email string, memo string, amount double").repartition(4)


@pytest.mark.parametrize(("values", "chars", "in_map"), [(20_000, 1_000, 5), (0, 1_000, 5), (20_000, 3, 5)])
def test_small_and_large_vaults_agree(spark, monkeypatch, values, chars, in_map):
    df = people(spark)
    small = Vault.build([df])
    want = sorted(map(str, small.tokenise(df).collect()))
    monkeypatch.setattr(vault, "SMALL_VALUES", values)
    monkeypatch.setattr(vault, "SMALL_CHARS", chars)
    monkeypatch.setattr(vault, "MAP_VALUES", in_map)
    other = Vault.build([df])
    assert (other.small is None) == (values == 0 or chars == 3)
    safe = other.tokenise(df)
    assert sorted(map(str, safe.collect())) == want
    assert sorted(map(str, other.table.collect())) == sorted(map(str, small.table.collect()))
    again = other.restore(safe).select("memo", "amount")
    assert sorted(map(str, again.collect())) == sorted(map(str, df.select("memo", "amount").collect()))
    other.flush()
    assert sorted(map(str, other.tokenise(df).collect())) == want


@pytest.mark.parametrize("values", [20_000, 0])
def test_vaults_and_redaction_mind_no_column_of_the_caller(spark, monkeypatch, values):
    monkeypatch.setattr(vault, "SMALL_VALUES", values)
    df = people(spark)
    more = df.select("*", *[F.lit(7).alias(n) for n in NAMES])
    v = Vault.build([df])
    out = v.tokenise(more)
    assert out.columns == more.columns and out.where(" or ".join(f"{n} <> 7" for n in NAMES)).count() == 0
    assert sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, v.tokenise(df).collect()))
    assert v.restore(out).columns == more.columns
    red = mask.redact_column(more, "memo")
    assert red.where("n_email > 0").count() and set(more.columns) <= set(red.columns)
    assert free_prefix(more) not in [n[: len(free_prefix(more))] for n in more.columns]


def test_layout_by_values_alone(spark):
    rows = [(f"INV-{i:04d}", f"2024-01-{i % 28 + 1:02d}", f"a longer description {i}", "PCS", str(i), f"{i}.50", f"{i * 10}.00") for i in range(1, 30)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_ord long, a string, b string, c string, d string, e string, f string, g string").repartition(3)
    out = ledger.sniff(df)
    assert (out.doc, out.date, out.desc, out.uom, out.qty, out.price, out.amount, out.total) == (0, 1, 2, 3, 4, 5, 6, 6) and out.prefixes == ["INV-"]
    blank = ledger.sniff(df.where("false"))
    assert (blank.doc, blank.date, blank.qty, blank.prefixes) == (0, None, None, [])
    assert ledger.sniff(df.select("_ord")) == ledger.Layout()


def test_labels_last_band_and_halves(spark):
    rows = [("Voucher", None, "x"), ("Amount", "Invoice No", "Net Amount"), ("Line", "Units", "Total"), ("Qty", "Line Total", "unit")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_ord long, a string, b string, c string")
    out = ledger.sniff(df)  # the last row with a master's word; totals in the right half only; the last row with a line's word
    assert (out.doc, out.total, out.qty, out.amount, out.uom) == (1, 2, 0, None, 2) or (out.doc, out.total, out.qty, out.amount) == (1, 2, 0, 1)


HOSTILE = (
    "import os as o; o.system('id')", "from os import *", "import importlib\nimportlib.import_module('socket')", "import builtins\nbuiltins.eval('1')", "import io\nio.open('f', 'w')",
    "import ctypes", "from time import sleep; sleep(100)", "import time as t\nt.sleep(n)", "spark.sparkContext._jvm.java.lang.Runtime", "e = eval\ne('1')", "f = open\ng = f\ng('x')",
    "from os import system as s\ns('id')", "import os\np = os\np.popen('id')", "globals()['__builtins__']", "x = df._jdf", "().__class__.__mro__", "import pickle", "import time\ntime.sleep(secs=5)",
)


@pytest.mark.parametrize("code", HOSTILE)
def test_hostile_code_by_other_names(code):
    assert sandbox.findings(code)


@pytest.mark.parametrize("code", ["import os.path\nn = os.path.join('a', 'b')", "import time\ntime.sleep(0.5)", "from pyspark.sql.functions import *", "opened = evaluate(df)", "system = df.select('environ')", "df.system.kill"])
def test_harmless_code(code):
    assert sandbox.findings(code) == []


def test_statutes(spark):
    assert policy.statutes("United States")[0].endswith("(HIPAA Safe Harbor)") and policy.primary_statute("US").endswith("CCPA/CPRA")
    assert policy.resolve("US", "US").statute == policy.primary_statute("US")
    assert all("Not Sure (Auto-Detect)" in policy.statutes(c) for c in ("Poland", "Saudi Arabia", "UK", "Nowhere"))


def test_lenient_numbers_and_white_space(spark):
    texts = ["1", " 2.5 ", "-3e2", "+.5", "abc", "", None, "1x", "NaN", "-Infinity", "widget 1", "٣", " x　\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", double_of(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b"), strip(F.col("t")).alias("s")).collect():
        assert str(r.a) == str(r.b) and r.s == (r.t and r.t.strip())


def test_linkability_by_the_columns_that_mocks_have(spark):
    real = spark.createDataFrame([(i, str(i % 5), str(i % 7)) for i in range(400)], "k long, a string, b string")
    mock = spark.createDataFrame([("1", "2"), ("9", "2"), (None, "3"), ("4", None), (None, None), (None, "x")], "a string, b string")
    r = audit.linkability(real, mock, "k", ["a", "b"]).first()
    assert r.value == 0.0 and r.passed
    few = real.where("k < 3")
    member = {x.k for x in few.where(audit.half(F.col("k"), 42)).collect()}
    hits = lambda keys: sum(any((a is None or a == str(k % 5)) and (b is None or b == str(k % 7)) for k in keys) for a, b in [("1", "1"), ("2", "2"), (None, "0"), ("7", None)]) / 4
    got = audit.linkability(few, spark.createDataFrame([("1", "1"), ("2", "2"), (None, "0"), ("7", None)], "a string, b string"), "k", ["a", "b"]).first().value
    assert got == round(max(0.0, hits(member) - hits({0, 1, 2} - member)), 3)


CLASH = ("_v", "_n", "_often", "_all", "_small", "_into", "_most", "_q0", "_mean", "_std", "_range", "_in", "_s", "_before", "_place", "_part", "_start", "_from", "_filled", "_ord2", "_v_n", "_v_v", "_v_0", "_v_at", "_v_place")


def test_relational_operators_mind_no_column_of_the_caller(spark):
    from veilspark.operators import features, relational, risk
    from veilspark.operators.running import running_total
    from veilspark.sources.readers import with_order

    rows = [(i, f"c{i % 4}" if i != 3 else "rare", 20 + i, None if i % 3 else f"x{i}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "client_id int, city string, age int, gap string, amount double").coalesce(2)
    more = df.select("*", *[F.lit("own").alias(n) for n in CLASH])
    every = {
        "sizes": lambda d: risk.class_sizes(d, ["city"]),
        "generalise": lambda d: risk.generalise(d, ["city", "age"], 5, ["amount"]),
        "hashed": lambda d: risk.generalise(d, ["city", "age"], 5),
        "frequency": lambda d: features.frequency(d, "city"),
        "z": lambda d: features.z_score(d, "amount"),
        "total": lambda d: running_total(d, [F.col("client_id")], F.col("amount"), "upto"),
        "fill": lambda d: relational.forward_fill(d, "gap", "client_id"),
        "order": with_order,
    }
    for name, run in every.items():
        plain, out = run(df), run(more)
        assert out.where(" or ".join(f"`{n}` <> 'own'" for n in CLASH)).count() == 0 and set(out.columns) == set(plain.columns) | set(CLASH), name
        assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect())), name
    ids = [r.client_id for r in every["generalise"](df).orderBy("amount" if False else "client_id").collect()]
    assert ids == [f"ID_{i:05d}" for i in range(1, 41)]
    assert [r.upto for r in every["total"](df).orderBy("client_id").collect()] == [i * (i + 1) / 2 for i in range(40)]


def test_texts_from_what_was_found(spark, tmp_path):
    import pandas as pd

    from veilspark.plans import lifecycle, report
    from veilspark.sources import readers

    df = spark.createDataFrame([(i, f"r{i % 3}", f"long words about case number {i}", float(i % 7), float(i % 7) * 2, 1e6 if i == 5 else 1.0) for i in range(40)], "id int, region string, note string, a double, b double, spread double")
    found = lifecycle.think(df)
    page = report.synthesis("cases", 40, found)
    assert "40 rows, 6 columns" in page and "## Keys" in page and "id" in page.split("## Keys")[1]
    asked = report.questions(found)
    assert any("spread" in q for q in asked)
    assert "- margin" in report.enrich_prompt("x = 1", ["a"], ["margin"]) and "x = 1" in report.enrich_prompt("x = 1", ["a"], ["margin"])
    path = report.to_file(spark, page, f"file://{tmp_path}/page.md")
    assert (tmp_path / "page.md").read_text() == page and path.endswith("page.md")
    code = report.power_query(ledger.Layout(doc=0, date=1, desc=3, seq=0, qty=4, price=5, amount=6, total=6, prefixes=["INV-"]))
    for step in ("Table.FillDown", "Table.Group", "Table.TransformColumnTypes", '"grand total"', '"page "', '"INV-"', "Text.Combine"):
        assert step in code
    names = [line.strip().split(" = ")[0] for line in code.splitlines()[1:-2]]
    assert len(names) == len(set(names)) and code.rstrip().endswith("Typed") and code.count("(") == code.count(")") and code.count("{") == code.count("}")
    bound = {"frame": df, "local": pd.DataFrame({"x": [1, 2]})}
    assert readers.read(spark, "frame", bound=bound) is df and readers.read(spark, "local", bound=bound, ordered=True).columns == ["x", "_ord"]
    (tmp_path / "grid.csv").write_text("Doc. No,Doc. Date,,Total\nSeq,,Description,Amount\nINV-001,2024-01-02,,10\n1,,bolt,10\n")
    grid = ledger.report(spark, f"{tmp_path}/grid.csv")
    assert ledger.sniff(grid).desc == 2 and ledger.flatten(grid).first().Full_Description == "bolt"
