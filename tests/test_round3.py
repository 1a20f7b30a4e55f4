"""Neighbours, containment, keys, spectra and profiles against plain Python."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.operators import audit, contain, insight, keys, links, mask, neighbours, profile, spectrum

SF = "/root/testdata/sf0.001"


# --- neighbours


def brute_two(rows, others, numeric, spans):
    """Two smallest distances of each row (key, numbers, categories)."""
    out = {}
    for key, xs, ts in rows:
        d = sorted((sum(abs((a or 0.0) - (b or 0.0)) / s for a, b, s in zip(xs, ys, spans)) + sum(a != b for a, b in zip(ts, us))) / max(1, len(spans) + len(ts)) for _, ys, us in others)
        out.setdefault(key, []).append((d[0] if d else None, d[1] if len(d) > 1 else None))
    return out


@pytest.mark.parametrize("seed,n,m,size,other", [(1, 1, 1, 400, 700), (2, 3, 0, 300, 500), (3, 0, 3, 300, 300), (4, 2, 3, 300, 400), (5, 2, 1, 50, 2), (6, 1, 1, 30, 1)])
def test_pruned_neighbours_are_exact(spark, monkeypatch, seed, n, m, size, other):
    """Numbers, categories, ties, repeats, nulls and values that the sample never saw; small samples, so trees are rough."""
    monkeypatch.setattr(neighbours, "BOUND_SAMPLE", 40)
    monkeypatch.setattr(neighbours, "LEAF_SAMPLE", 2)
    r = random.Random(seed)
    cell = lambda: None if r.random() < 0.05 else r.choice([0.0, 0.0, round(r.gauss(0, 3), 1), float(r.randrange(1000)) if r.random() < 0.02 else 1.0])
    word = lambda: r.choice([None, "a", "b", "c", "c", "c", f"rare{r.randrange(50)}"])
    make = lambda k: [(i % (k - 1 or 1), [cell() for _ in range(n)], [word() for _ in range(m)]) for i in range(k)]
    rows, others = make(size), make(other)
    names, kinds = [f"x{i}" for i in range(n)], [f"c{i}" for i in range(m)]
    schema = ", ".join(["k long", *[f"{c} double" for c in names], *[f"{c} string" for c in kinds]])
    table = lambda part: spark.createDataFrame([(k, *xs, *ts) for k, xs, ts in part], schema).repartition(3)
    spans = [7.5, 2.0, 1.0][:n]
    fill = lambda part: [(k, xs, [t or "<NULL>" for t in ts]) for k, xs, ts in part]
    want = brute_two(fill(rows), fill(others), n, spans)
    got = {}
    for x in neighbours.closest(table(rows), "k", table(others), names, kinds, spans).collect():
        got.setdefault(x.k, []).append((x.d1, x.d2))
    assert set(got) == set(want)
    order = lambda part: sorted(tuple(-1.0 if v is None else v for v in p) for p in part)
    for k in want:
        for a, b in zip(order(got[k]), order(want[k]), strict=True):
            assert a == pytest.approx(b, abs=1e-12)


def test_neighbours_without_others_or_columns(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k long, x double")
    assert [tuple(r) for r in neighbours.closest(rows, "k", rows.limit(0), ["x"], [], [1.0]).orderBy("k").collect()] == [(1, None, None), (2, None, None)]
    assert [tuple(r) for r in neighbours.closest(rows, "k", rows, [], [], []).orderBy("k").collect()] == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert [tuple(r) for r in neighbours.closest(rows, "k", rows, ["x"], [], [2.0]).orderBy("k").collect()] == [(1, 0.0, 1.0), (2, 0.0, 1.0)]
    assert neighbours.closest(rows.limit(0), "k", rows, ["x"], [], [1.0]).collect() == []


def test_work_grows_less_than_pairs(spark):
    """Eight times the rows: far less than 64 times the distances; and no cross join."""
    measured = []
    for n in (1000, 8000):
        real = spark.range(n).select("id", (F.rand(1) * 100).alias("x"), (F.rand(2) * 9).alias("y"), (F.col("id") % 5).cast("string").alias("c"))
        mock = spark.range(n).select("id", (F.rand(3) * 100).alias("x"), (F.rand(4) * 9).alias("y"), (F.col("id") % 5).cast("string").alias("c"))
        out = neighbours.closest(real, "id", mock, ["x", "y"], ["c"], [100.0, 9.0], measured=True)
        measured.append(out.agg(F.sum("n")).first()[0])
    assert measured[1] < 0.15 * 8000**2 and measured[1] < 30 * measured[0]
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_halves_are_fair_and_repeatable(spark):
    rows = spark.range(4000).select("id", *[audit.half(F.col("id"), s).cast("int").alias(f"h{s}") for s in (42, 43)])
    a, b, both = rows.agg(F.avg("h42"), F.avg("h43"), F.avg((F.col("h42") == F.col("h43")).cast("int"))).first()
    assert abs(a - 0.5) < 0.04 and abs(b - 0.5) < 0.04 and abs(both - 0.5) < 0.04


# --- containment


@pytest.mark.parametrize("chars", [0, 1 << 30])
def test_containment_both_ways(spark, chars):
    """An automaton and the inverted join find what plain Python finds: hot and rare values, nested ones, other letters."""
    r = random.Random(4)
    words = ["alpha", "Beta gamma", "delta-9", "ähnlich", "ΑΒΓΔΕ", "aaaaa", "aaaaaaa", "日本語テキスト", "gamma delta", "true", "1000", "abcd", "  padded  ", "quo\"te,s"]
    values = words + [f"Person {i:05d}" for i in range(300)]
    texts = [None, "", "abcd", "aaaaaaaaaa"] + [" ".join(r.choice([*words, "filler", "x" * 3, f"PERSON {r.randrange(400):05d}"]) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    raw = spark.createDataFrame([(v, f"col{v}" if i % 3 else None) for i, v in enumerate(values)], "a string, b string")
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "k long, t string").repartition(3)
    want = sorted((i // 2, c, v) for i, t in enumerate(texts) if t is not None for c, own in (("a", values), ("b", [f"col{v}" for i, v in enumerate(values) if i % 3])) for v in set(own) if len(v.strip()) > 4 and v.strip().lower() not in contain.COMMON and v.strip().lower() in t.lower())
    got = sorted(tuple(x) for x in contain.contained(df, "k", "t", raw, automaton_chars=chars).collect())
    assert got == want and len(want) > 500
    assert contain.contained(df.limit(0), "k", "t", raw, automaton_chars=chars).collect() == [] == contain.contained(df, "k", "t", raw.limit(0), automaton_chars=chars).collect()


def test_leaks_take_any_number_of_cells(spark):
    raw = spark.range(30_000).select(F.format_string("Customer %06d", "id").alias("name"))
    text = spark.createDataFrame([("we met CUSTOMER 029999 and customer 000123",)], "t string")
    assert [tuple(r) for r in mask.leaks(text, "t", raw).collect()] == [("name", "Customer 000123")]


# --- keys


def brute_keys(rows, columns, most):
    found = []
    for size in range(1, most + 1):
        for s in itertools.combinations(range(len(columns)), size):
            if any(set(k) <= set(s) for k in found) or (size == 1 and any(r[s[0]] is None for r in rows)):
                continue
            if len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return {tuple(columns[i] for i in k) for k in found}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keys_and_dependencies(spark, seed):
    r, n = random.Random(seed), 400
    rows = [(i // 20, i % 20, r.randrange(5), None if r.random() < 0.1 else r.randrange(400), r.choice("xyz"), i if seed == 2 else r.randrange(30), float(i // 20) * 0.5, r.random() if seed == 3 else 0.0) for i in range(n)]
    columns = ["a", "b", "c", "d", "e", "f", "g", "h"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f int, g double, h double").repartition(3)
    assert {tuple(x.key) for x in keys.minimal_keys(df, columns, 3).collect()} == brute_keys(rows, columns, 3)
    text = lambda v: "<NULL>" if v is None else str(v)
    want = {(columns[i], columns[j]): len({text(x[i]) for x in rows}) == len({(text(x[i]), text(x[j])) for x in rows}) for i in range(8) for j in range(8) if i != j}
    assert {(x.determinant, x.dependent): x.holds for x in keys.dependencies(df, columns).collect()} == want
    assert want["a", "g"] and want["g", "a"] and not want["c", "a"]
    counts = {x.column: x.distinct for x in keys.distinct_counts(df).collect()}
    assert counts == {c: len({x[i] for x in rows if x[i] is not None}) for i, c in enumerate(columns)}
    pairs = {(x.a, x.b): (x.distinct, x.is_key) for x in keys.pair_counts(df, columns).collect()}
    assert len(pairs) == 28  # all pairs, not those of the first six columns
    assert all(pairs[columns[i], columns[j]][0] == len({(x[i], x[j]) for x in rows}) for i in range(8) for j in range(i + 1, 8))
    plan = keys.distinct_counts(df)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_keys_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a int, b double")
    assert keys.minimal_keys(empty).collect() == [] and {r.distinct for r in keys.distinct_counts(empty).collect()} == {0}
    same = spark.createDataFrame([(1, 0.0), (1, -0.0), (1, float("nan")), (1, float("nan")), (1, None)], "a int, b double")
    assert {r.column: r.distinct for r in keys.distinct_counts(same).collect()} == {"a": 1, "b": 2}
    assert keys.minimal_keys(same).collect() == []
    wide = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, i), bytes([i % 2]), [i, i], "r") for i in range(6)], "t timestamp, y binary, l array<int>, `o d.d` string")
    assert {tuple(r.key) for r in keys.minimal_keys(wide).collect()} == {("t",), ("l",)}


# --- spectra and steps


@pytest.mark.parametrize("n", [2, 3, 32, 33, 100, 257])
def test_powers_are_those_of_a_transform(spark, n):
    r = np.random.default_rng(n)
    v = {s: np.sin(2 * np.pi * np.arange(n) * k / n) + r.normal(size=n) + 5 for s, k in (("a", 3), ("b", n // 5))}
    rows = [(s, int(t), float(x)) for s in v for t, x in enumerate(v[s])]
    random.Random(n).shuffle(rows)
    out = {}
    for x in spectrum.powers(spark.createDataFrame(rows, "series string, t long, v double").repartition(3)).collect():
        assert x.n == n
        out.setdefault(x.series, {})[x.k] = x.power
    for s in v:
        want = np.abs(np.fft.rfft(v[s] - v[s].mean()))[1:]
        assert sorted(out[s]) == list(range(1, n // 2 + 1))
        assert np.allclose([out[s][k] for k in sorted(out[s])], want, atol=1e-9 * n)


def test_long_and_short_series_have_one_period(spark):
    rows = [(s, t, float(np.sin(2 * np.pi * t / p) + 0.1 * ((t * 7919) % 13))) for s, p, n in (("week", 7, 300), ("ten", 10, 200), ("few", 5, 20)) for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t long, v double").withColumn("at", F.timestamp_seconds("t"))
    one, other = ({r.series: (r.n, r.period) for r in insight.dominant_period(df, "at", "v", "s", short).collect()} for short in (0, 4096))
    assert set(one) == set(other) == {"week", "ten"} and one["ten"] == (200, pytest.approx(10.0))
    assert all(one[k] == pytest.approx(other[k]) for k in one)
    flat = spark.createDataFrame([(t, float((t * 7919) % 101 > 50)) for t in range(64)], "t long, v double").withColumn("at", F.timestamp_seconds("t"))
    assert insight.dominant_period(flat, "at", "v").first() == insight.dominant_period(flat, "at", "v", short=0).first()


@pytest.mark.parametrize("seed", [1, 2])
def test_cadence_of_any_times(spark, seed):
    """Also when a third of all rows has one time, and across the ends of ranges."""
    r = random.Random(seed)
    rows = [(s, r.choice([0, 5, 5, 60, 3600, 10**6]) + 10 * k) for s in ("x", "y") for k in range(60)] + [("x", 77)] * 50 + [("z", 1)] * 3
    df = spark.createDataFrame([(s, t) for s, t in rows] + [("x", None)], "s string, t long").select("s", F.timestamp_seconds("t").alias("at")).repartition(4)
    out = {c.series: c for c in insight.cadence(df, "at", "s").collect()}
    assert set(out) == {"x", "y"}
    for s in out:
        t = sorted(x for k, x in rows if k == s)
        steps = np.diff(t)
        assert out[s].n == len(t) and out[s].median_seconds == np.median(steps) and out[s].share == pytest.approx(float((steps == np.median(steps)).mean()))


# --- profiles, names and families


def test_profiles_by_whole_words_and_forms(spark):
    rows = [("2024/1/5", "(SAR 1,000.00)", "₽5", "a b", 1), ("15/08/2025", "3-", "CAD 4", "c d", 2), ("August 15, 2025", "-5", "5", "e", 1), ("2024-01-05 10:20", "1", "x", "f", 1)] * 10
    out = {r.column: r for r in profile.profile(spark.createDataFrame(rows, "package string, usage string, message string, person_name string, age_band int")).collect()}
    assert out["package"].date_formats == sorted(["YYYY-MM-DD (ISO)", "DD/MM/YYYY or MM/DD/YYYY", "Month DD, YYYY (e.g. August 15, 2025)", "Timestamp ISO-8601"])
    assert out["usage"].negatives and not out["message"].negatives and out["message"].currency and out["usage"].currency and not out["package"].currency
    assert out["person_name"].blanks and not out["message"].blanks
    assert {c: r.role for c, r in out.items()} == {"package": "CATEGORICAL", "usage": "CATEGORICAL", "message": "CATEGORICAL", "person_name": "DIRECT_IDENTIFIER", "age_band": "QUASI_IDENTIFIER"}


def test_families_of_tables():
    assert insight.architecture(["loan", "interest", "borrower"]) == "FINANCE" and insight.architecture(["arr"]) == "SAAS" and insight.architecture(["carrier_name"]) == "LOGISTICS"
    assert insight.architecture(["x_mrn"]) == "HEALTH" and insight.architecture(["arrow"]) == "CLEAN_TABULAR" and insight.architecture(["a"], ragged=True) == "RAGGED_LEDGER"


def test_columns_found_by_name(spark):
    df = spark.createDataFrame([("c1", "new", dt.date(2024, 1, 1)), ("c1", "new", dt.date(2024, 1, 1)), ("c2", "done", None)], "case_id string, `الحالة` string, day date")
    row = insight.process_model(df).first()
    assert tuple(row) == ("case_id", "الحالة", "day", 2, 1)
    assert insight.process_model(df.select("case_id")).collect() == []
    ends = spark.createDataFrame([("a", "z"), ("b", "y")], "`to` string, source_id string")
    assert [tuple(r) for r in links.graph_links(ends, ["to", "source_id"]).collect()] == [("source_id", "to", 0.0)]


def test_ragged_columns(spark):
    rows = [(i, f"INV-{i}", "10", None) for i in range(50)] + [(50, None, None, "a wrapped line of text"), (51, None, "only", None)]
    out = {r.column: r for r in insight.ragged_columns(spark.createDataFrame(rows, "_ord long, a string, b string, c string"), "_ord").collect()}
    assert (out["c"].ragged, out["a"].ragged, out["b"].ragged) == (True, False, False) and out["c"].solo == out["b"].solo == 1


def test_words_are_marked_fixed():
    assert len(P.METADATA_WORDS) == 14 and len(P.FOOTER_WORDS) == 15


# --- mocks


def test_quantiles_follow_the_exponential_mechanism():
    """Frequencies of draws against exp(-epsilon * d / 2), and what one row more can change."""
    import math
    from collections import Counter

    from veilspark.operators import synth

    counts, epsilon, share = [3, 0, 4, 1, 0, 2], 0.7, 0.5

    def weights(counts):
        below, out = 0, []
        for n in counts:
            rank = share * sum(counts)
            out.append(math.exp(-epsilon * max(below - rank, rank - below - n, 0.0) / 2))
            below += n
        return [w / sum(out) for w in out]

    rng = random.Random(11)
    drawn = Counter(synth.quantile(counts, share, epsilon, rng) for _ in range(40_000))
    want = weights(counts)
    assert sum((drawn[i] - 40_000 * w) ** 2 / (40_000 * w) for i, w in enumerate(want)) < 25  # chi squared, 5 degrees
    for i in range(6):  # a row moves from one candidate to another: no draw becomes more than e^epsilon times as likely
        for j in range(6):
            if counts[i] and i != j:
                other = [n - (k == i) + (k == j) for k, n in enumerate(counts)]
                assert all(max(a / b, b / a) <= math.exp(epsilon) + 1e-9 for a, b in zip(want, weights(other)))


def test_places_of_numbers(spark):
    from veilspark.operators import synth

    r = random.Random(3)
    xs = [0.0, 0.0005, -0.0005, 1.0, -1.0, 0.001, 9.9, 10.0, 1e18, -1e18, 1e30] + [r.choice([-1, 1]) * 10 ** r.uniform(-4, 17) for _ in range(500)]
    got = [x.p for x in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", synth.place(F.col("x")).alias("p")).orderBy("i").collect()]
    for x, p in zip(xs, got):
        near = [k for k in range(max(0, p - 1), min(len(synth.CANDIDATES), p + 2))]
        if 1e-3 <= abs(x) < 9.9e15:
            assert min(abs(synth.CANDIDATES[k] - x) for k in near) <= 0.1001 * abs(x) and (synth.CANDIDATES[p] > 0) == (x > 0), x
        elif abs(x) < 1e-3:
            assert synth.CANDIDATES[p] == 0.0


def test_mocks_within_a_budget(spark):
    from veilspark.operators import synth

    n = 20_000
    df = spark.range(n).select(
        (F.col("id") % 100 + 50).alias("amount"), (F.col("id") * 0.01).alias("ratio"), F.format_string("$%d.50", F.col("id") % 90 + 10).alias("price"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("half"),
        F.when(F.col("id") % 3 == 0, "Y").otherwise("n").alias("active"), F.concat(F.lit("secret "), F.col("id").cast("string")).alias("note"), F.lit(None).cast("string").alias("none"), (-F.col("id") % 7 - 1).alias("loss"),
    )
    budget = synth.Budget(4.0, len(df.columns))
    out = synth.mock(df, 3000, 4.0, 5, budget=budget)
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 3000
    assert sum(budget.spent.values()) == pytest.approx(4.0) and len(budget.spent) == len(df.columns)
    with pytest.raises(ValueError):
        budget.share("amount", 1)
    row = out.agg(F.percentile("amount", 0.5), F.min("amount"), F.avg(F.col("half").isNull().cast("int")), F.count("none"), F.avg(F.col("price").startswith("$").cast("int")), F.max("loss")).first()
    assert 60 < row[0] < 140 and row[1] >= 0 and 0.4 < row[2] < 0.6 and row[3] < 100 and row[4] == 1.0
    assert {r[0] for r in out.select("active").where("active is not null").distinct().collect()} == {"Y", "N"}
    assert not out.where("note like 'secret%'").count()
    assert sorted(map(str, out.collect())) == sorted(map(str, synth.mock(df.repartition(7), 3000, 4.0, 5).repartition(3).collect()))
    few = synth.mock(df.limit(3), 5, 1.0, 1)  # a form that few rows have isn't told
    assert few.count() == 5 and not few.where("price like '$%'").count()
    assert len(synth.TEMPLATES) >= 60


# --- counts, workbooks, sandbox


def test_places_within_hot_and_null_keys(spark):
    from veilspark.operators import features

    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "b", None, "c"]), i, 1) for i in range(500)]
    out = features.windowed_counts(spark.createDataFrame(rows, "k string, o int, line int").repartition(5), "k", "o").collect()
    for k in ("hot", "b", "c", None):
        own = sorted(o for key, o, _ in rows if key == k)
        got = {x.o: (x.line_index, x.key_count) for x in out if x.k == k}
        assert got == {o: (i + 1, len(own)) for i, o in enumerate(own)}


def test_folders_of_workbooks(spark, tmp_path):
    from veilspark.sources import readers, workbook

    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    for name, first in (("b", 100), ("a", 0)):
        workbook.write_workbook(str(folder / f"{name}.xlsx"), {"One": (["x", "y"], [(first + i, f"v{i}") for i in range(7 if name == "a" else 3)]), "Two": (["z"], [(1,)])})
    rows = readers.read(spark, str(folder), ordered=True).orderBy("_ord").collect()
    assert [r._ord for r in rows] == list(range(12)) and [r["0"] for r in rows] == ["x", *map(str, range(7)), "x", "100", "101", "102"]
    one = readers.workbook(spark, str(folder / "a.xlsx"))
    assert list(one) == ["One", "Two"] and [r["0"] for r in one["Two"].orderBy("_ord").collect()] == ["z", "1"]


BEHIND_DOORS = (
    "import pandas as pd\npd.io.common.os.system('id')", "from pandas.io import common\ncommon.os.system('id')", "print.__self__.eval('1')", "import re\nre.enum.sys.modules['os'].system('id')",
    "import os\nos.execv('/bin/sh', [])", "import os\nos.rename('a', 'b')", "import asyncio", "import pandas as pd\npd.read_csv('http://x.y/z')", "import os\nd = [os]\nd[0].system('id')",
    "import os\ndef f(o):\n    return o.system('id')\nf(os)", "import pandas as pd\nu = 'ht' + 'tp://x'\npd.read_csv(u)", "'{0.__class__}'.format(1)", "df.query('@pd.io.common')", "from os import rename",
    "import pandas as pd\npd.read_pickle('x')", "import numpy as np\nnp.sys.modules", "import os as o\nx = o.path\no.remove('a')", "from subprocess import *",
)


@pytest.mark.parametrize("code", BEHIND_DOORS)
def test_code_that_looks_for_doors(code):
    from veilspark.plans import sandbox

    assert sandbox.findings(code)


@pytest.mark.parametrize("code", ["import polars as pl\ndf = df.with_columns(pl.col('x') * 2)", "import datetime\nd = datetime.date(2026, 1, 1)", "import re\np = re.compile(r'\\d+')", "executed = False\nif __name__ == '__main__':\n    executed = True", "df.query('a > 1')", "x = 'see https://example.com'", "df.to_csv('out.csv')", "import os\np = os.path.join('a', 'b')"])
def test_code_that_does_no_harm(code):
    from veilspark.plans import sandbox

    assert sandbox.findings(code) == []


def test_plain_code_runs_in_a_child(spark, monkeypatch):
    import os
    import time

    import pandas as pd

    from veilspark.plans import sandbox

    frame = pd.DataFrame({"a": [1, 2, None], "b": ["x", "y", "z"]})
    monkeypatch.setenv("SECRET_OF_PARENT", "s")
    out = sandbox.execute(spark, "def clean_it(d):\n    return d.dropna()\nn = len(df)\ns = [1, {'k': 2.5}]\nm = bool(re.search('y', df['b'][1]))\nc = copy.deepcopy([1])", {"df": frame})
    assert out["result"]["b"].tolist() == ["x", "y"] and (out["n"], out["s"], out["m"], out["c"]) == (3, [1, {"k": 2.5}], True, [1]) and frame["a"].isna().sum() == 1
    assert sandbox.harvest(spark, out, {"df": frame}).count() == 2
    with pytest.raises(KeyError, match="amout"):
        sandbox.execute(spark, "df['amout']", {"df": frame})
    with pytest.raises((MemoryError, RuntimeError)):
        sandbox.execute(spark, "x = 'a' * (1 << 33)", {})
    began, before = time.time(), set(os.listdir("/proc"))
    with pytest.raises(TimeoutError):
        sandbox.execute(spark, "while True:\n    pass", {}, timeout=0.5)
    assert time.time() - began < 30 and before
    with pytest.raises(TimeoutError):  # code on frames of Spark: its thread ends, too
        sandbox.execute(spark, "i = 0\nwhile True:\n    i += 1", {"df": spark.range(1)}, timeout=0.5)
    time.sleep(0.5)
    import threading

    assert not [t for t in threading.enumerate() if t.daemon and t.name.endswith("(run)") and t.is_alive()]


def test_firewall_over_a_table(spark):
    rows = spark.createDataFrame([("import socket",), ("x = 1",), (None,), ("  ",), ("eval('1')",)], "code string")
    assert audit.firewall(spark, rows).first().value == pytest.approx(200 / 3, abs=1e-5) and audit.firewall(spark).first().passed
    assert audit.firewall(spark, rows.limit(0)).first().passed
