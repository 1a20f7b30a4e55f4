"""The operators on small tables written by hand, with the results that their definitions give."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from veilspark.functions import scalars
from veilspark.operators import audit, charts, features, insight, ledger, links, mask, policy, profile, relational, risk, synth
from veilspark.operators.vault import Vault, infer_pattern
from veilspark.plans import lifecycle, report, sandbox
from veilspark.sources import readers, sinks
from veilspark.streaming import monitors


def one(df):
    return df.first().asDict()


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    rows = []
    for i in range(20):
        first = i < 10
        rows.append((i, 30 if first else 40, "F" if first else "M", "HR" if first else "IT", 1000.0 + 100 * (i % 10), f"p{i}@firm.example.net"))
    return spark.createDataFrame(rows, "row int, age int, gender string, department string, salary double, email string")


# Policy


def test_tiers_of_columns():
    p = policy.resolve()
    assert {policy.tier_of(c, p) for c in ("customer_name", "iqama_id", "email_address", "phone_no")} == {policy.ENCRYPT}
    assert {policy.tier_of(c, p) for c in ("birth_date", "notes")} == {policy.MASK}
    assert {policy.tier_of(c, p) for c in ("order_count", "total_revenue", "status")} == {policy.SAFE}
    assert policy.tier_of("district", policy.resolve("x", "Saudi Arabia")) == policy.MASK


def test_policies_by_jurisdiction():
    assert policy.regime_of("KSA") == "SAUDI ARABIA" and policy.regime_of("pl") == "POLAND" and policy.regime_of("HIPAA") == "UNITED STATES" and policy.regime_of("UK") == "UNITED KINGDOM"
    us = policy.resolve("Poland", "United States")
    assert "US_SSN" in us.patterns and "EMAIL" in us.patterns and "PESEL" not in us.patterns and "card_number" in us.direct
    assert policy.statutes("Mars")[-1].startswith("Not Sure") and "GDPR" in policy.primary_statute("EU")


def test_quasi_identifiers_by_name():
    names = ["Patient_Age", "Gender", "Zip_Code", "Visit_Date", "Blood_Pressure", "Condition"]
    assert policy.quasi_identifiers(names) == names[:4]
    assert policy.sensitive_column(names) == "Condition"
    assert policy.quasi_identifiers(["country"]) == [] and policy.quasi_identifiers(["country"], strict_names=False) == ["country"]
    assert policy.is_key("order_id") and not policy.is_key("zip_code") and policy.is_metric("unit_price")


# Scalars


def test_scalars(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "Ab-9é"), ("0000000000000000", "x"), ("1234567812345670", ""), ("123", None), (None, "Z")], "card string, t string")
    assert [r[0] for r in df.select(scalars.luhn_valid(F.col("card"))).collect()] == [True, True, True, False, False]
    assert [r[0] for r in df.select(scalars.shape(F.col("t"))).collect()] == ["Xx-9x", "x", "", None, "X"]
    cells = spark.createDataFrame([("Date",), (" : ",), ("IV-11319",), ("500-000",), ("2024-01-31",), ("1,250.50",), ("Widget 5",), (None,), ("",)], "c string")
    got = [r[0] for r in cells.select(scalars.structural_mask(F.col("c"))).collect()]
    assert got == ["Date", " : ", "XX-99999", "999-999", "9999-99-99", "9,999.00", "Xxxxxx 9", None, ""]
    assert spark.createDataFrame([("‏١٥٠٫٠٠ ",)], "c string").select(scalars.normalise_bilingual(F.col("c"))).first()[0] == "150.00"
    numbers = spark.createDataFrame([("$1,200.5",), ("(30)",), ("SAR 7",), ("x",)], "c string")
    assert [r[0] for r in numbers.select(scalars.number_of(F.col("c"))).collect()] == [1200.5, -30.0, 7.0, None]


def test_sql_functions(spark):
    scalars.register(spark)
    row = spark.sql("SELECT veil_luhn('4111111111111111') a, veil_shape('Ab1') b, veil_age_band(34) c, veil_redact('mail a@b.com') d, veil_age_band(NULL) e, veil_normalise(' ٣ ') f").first()
    assert tuple(row) == (True, "Xx9", "30-39", "mail <EMAIL_REDACTED>", "Unknown", "3")


def test_free_text(spark):
    text = "Dr. Sara Haddad of Green Valley Hospital, mail sara@clinic.org, phone 555-123-4567, lives at 12 Long Street. brother Ahmed came."
    df = mask.redact_column(spark.createDataFrame([(text,), (None,)], "t string"), "t")
    out = df.first()
    for raw in ("Haddad", "Green Valley", "sara@", "555-123", "Long Street", "Ahmed"):
        assert raw not in out.t
    assert out.n_email == 1 and out.n_phone == 1 and sum(v for k, v in out.asDict().items() if k.startswith("n_")) >= 5
    flags = mask.preflight(spark.createDataFrame([("id 1234567890",), ("a@b.com",), ("4111 1111 1111 1111",), ("clean <EMAIL_1>",)], "t string"), "t").collect()
    assert [r.blocked for r in flags] == [True, True, True, False]
    leak = mask.leaks(spark.createDataFrame([("we saw JOHN SMITH today",)], "t string"), "t", spark.createDataFrame([("John Smith", "abc")], "name string, code string"))
    assert [(r.column, r.value) for r in leak.collect()] == [("name", "John Smith")]


# Vault


def test_tokens_and_back(spark):
    df = spark.createDataFrame([("Ann Lee", "ann@x.org", "north", 1.5, "call ann@x.org"), ("Bob Ray", "bob@x.org", "south", 2.0, "card 4111 1111 1111 1111 and 1234 5678 1234 5678"), ("Ann Lee", None, "north", 3.0, None)], "customer_name string, email string, region string, sales double, memo_text string")
    vault = Vault.build([df])
    safe = vault.tokenise(df)
    rows = safe.orderBy("sales").collect()
    assert [r.customer_name for r in rows] == ["<NAME_1>", "<NAME_2>", "<NAME_1>"] and rows[0].email == "<EMAIL_1>" and rows[2].email is None
    assert rows[0].memo_text == "call <EMAIL_1>" and "1234 5678" in rows[1].memo_text and "4111" not in rows[1].memo_text
    assert {tuple(r) for r in vault.restore(safe).collect()} == {tuple(r) for r in df.collect()}
    sums = vault.restore(safe.groupBy("customer_name").agg(F.sum("sales").alias("s")))
    assert {r.customer_name: r.s for r in sums.collect()} == {"Ann Lee": 4.5, "Bob Ray": 2.0}


def test_shared_vault_keeps_joins(spark):
    tx = spark.createDataFrame([("t1", "c1", 1.0), ("t2", "c2", 2.0), ("t3", "c1", 3.0)], "tx string, customer_ref string, amount double")
    dim = spark.createDataFrame([("c1", "Ann"), ("c2", "Bob"), ("c3", "Cy")], "customer_ref string, customer_name string")
    vault = Vault.build([tx, dim])
    a, b = vault.tokenise(tx), vault.tokenise(dim)
    assert a.join(b, "customer_ref").count() == 3 and {r.n for r in vault.stats().collect()}
    back = vault.restore(a.join(b, "customer_ref"))
    assert {(r.tx, r.customer_name) for r in back.collect()} == {("t1", "Ann"), ("t2", "Bob"), ("t3", "Ann")}


def test_taught_patterns(spark):
    df = spark.createDataFrame([("Account: 500-000",), ("Account: 600-000",), ("Seq: 1000",), ("none",)], "meta string")
    vault = Vault.build([df], taught={"gl_code": infer_pattern("500-000", "GL_Code"), "seq": infer_pattern("1000", "Seq")})
    safe = {r.meta for r in vault.tokenise(df).collect()}
    assert safe == {"Account: <GL_CODE_1>", "Account: <GL_CODE_2>", "Seq: <SEQ_1>", "none"}
    assert {r.meta for r in vault.restore(vault.tokenise(df)).collect()} == {r.meta for r in df.collect()}
    assert infer_pattern("IV-11319", "doc") == (r"\b[A-Za-z]{2}\-\d{5}\b", "DOC") and infer_pattern("", "") == (r"\S+", "CUSTOM")


def test_first_seen_order(spark):
    df = spark.createDataFrame([(0, "Zed"), (1, "Ann"), (2, "Zed")], "n int, user_name string")
    vault = Vault.build([df], order="n")
    assert {r.raw: r.seq for r in vault.table.collect()} == {"Zed": 1, "Ann": 2}


# Risk


def test_classes(spark):
    low = spark.createDataFrame([(30, "F", "a"), (30, "F", "b"), (40, "M", "a"), (40, "M", "b")], "age int, gender string, condition string")
    s = one(risk.summary(low, ["age", "gender"], "condition", threshold=2))
    assert (s["min_k"], s["at_risk"], s["risk_level"], s["min_l"], s["median_k"]) == (2, 0, "LOW", 2, 2)
    high = spark.createDataFrame([(30, "F"), (30, "F"), (30, "F"), (99, "M")], "age int, gender string")
    s = one(risk.summary(high, ["age", "gender"]))
    assert (s["min_k"], s["at_risk"], s["risk_level"], s["risk_percent"]) == (1, 1, "CRITICAL", 25.0)
    assert one(risk.summary(high.where("false"), ["age"]))["records"] == 0
    bins = spark.createDataFrame([("22",), ("30",), ("37",), (None,), ("x",)], "v string").select(risk.bin_column(F.col("v")).alias("b"))
    assert [r.b for r in bins.collect()] == ["20-29", "30-39", "30-39", "<UNKNOWN>", "x"]


def test_generalise(spark):
    df = spark.createDataFrame([(f"X{i}", 20 + i, "F" if i % 2 else "M", 1000 + i) for i in range(25)], "id string, age int, gender string, salary int")
    out = risk.generalise(df, ["age", "gender"], 5, order=["salary"])
    assert one(risk.summary(out, ["age", "gender"], threshold=5))["min_k"] >= 5
    assert {r.id for r in out.collect()} == {f"ID_{i + 1:05d}" for i in range(25)} and out.agg(F.sum("salary")).first()[0] == sum(1000 + i for i in range(25))
    keys = spark.createDataFrame([(i, i, i % 3, i, "2024-01-01") for i in range(5)], "Order_id int, customer_id int, product_id int, quantity int, date string")
    assert risk.generalise(keys).select("Order_id", "customer_id", "product_id", "quantity").collect() == keys.select("Order_id", "customer_id", "product_id", "quantity").collect()
    assert risk.resolve_quasi_identifiers(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "order_id int, colour string")) == ["colour"]


# Audit


def test_suite_on_a_balanced_population(spark, people):
    mock = spark.createDataFrame([(33, "X", "Ops", 1500.0), (44, "Y", "Law", 1700.0)], "age int, gender string, department string, salary double")
    out = by(audit.suite(people, mock, "row", ["age", "gender"], "salary", ["age", "salary"], ["gender", "department"]), "test")
    assert len(out) == 11
    for t in ("canary", "pii_scan", "singling_out", "l_diversity", "t_closeness", "nmi", "firewall", "reconciliation"):
        assert t == "pii_scan" or out[t]["passed"], (t, out[t])
    assert out["canary"]["value"] == 0 and out["reconciliation"]["value"] == 100
    scores = one(audit.scores(audit.suite(people.drop("email"), mock, "row", ["age", "gender"], "salary", ["age", "salary"], ["gender", "department"])))
    assert scores["tier_1"] == 100 and scores["egress_allowed"]


def test_mocks_of_any_size_are_measured_whole(spark):
    real = [(i, (i * 37 % 1100) * 1.0 if i % 50 else None, "abcd"[i % 4]) for i in range(1100)]
    mock = [(10_000 + i, (i * 53 % 1300) * 0.9 + 0.3, "abcde"[i % 5]) for i in range(1300)]
    real_df = spark.createDataFrame(real, "k long, x double, c string").repartition(3)
    mock_df = spark.createDataFrame(mock, "mock_id long, x double, c string").repartition(2)
    xs = [x for _, x, _ in real if x is not None]
    d = {(k, j): (abs((x or 0.0) - y) / (max(xs) - min(xs)) + (c != e)) / 2 for k, x, c in real for j, y, e in mock}
    out = {r.mock_id: (r.d1, r.d2) for r in audit.nearest(real_df, mock_df, ["x"], ["c"]).collect()}
    assert len(out) == 1300
    for j, _, _ in mock[::13]:
        assert out[j] == pytest.approx(sorted(d[k, j] for k, _, _ in real)[:2])
    far = {r.k: r.d1 for r in audit.closest(real_df, "k", mock_df, ["x"], ["c"], [max(xs) - min(xs)]).collect()}
    assert len(far) == 1100 and all(far[k] == pytest.approx(min(d[k, j] for j, _, _ in mock)) for k, _, _ in real[::11])
    assert one(audit.gower(real_df, mock_df, ["x"], ["c"]).agg(F.count("*").alias("n"), F.sum("distance").alias("s"))) == pytest.approx({"n": 1100 * 1300, "s": sum(d.values())})
    assert one(audit.membership(real_df, mock_df, "k", ["x"], ["c"]))["target"] == 0.55
    single = one(audit.nearest(real_df.where("k = 1"), mock_df.limit(1), ["x"], ["c"]))
    assert single["d1"] == single["d2"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_attacks_have_a_mock_row_for_each_customer(spark):
    from veilspark.plans.queries import QUERIES, whole_mock

    assert whole_mock(spark, "/root/testdata/sf0.01").count() == QUERIES["gower_nn"](spark, "/root/testdata/sf0.01").count() == 1500


def test_single_metrics(spark):
    alone = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c")], "age int, gender string")
    m = one(audit.singling_out(alone, ["age", "gender"]))
    assert not m["passed"] and m["value"] == 20.0
    same = spark.createDataFrame([(1, "flu")] * 3 + [(2, "flu")] * 3, "age int, condition string")
    assert one(audit.l_diversity(same, ["age"], "condition"))["value"] == 1 and not one(audit.l_diversity(same, ["age"], "condition"))["passed"]
    tied = spark.createDataFrame([(i % 2, i % 2) for i in range(20)], "q int, s int")
    assert audit.nmi(tied, "q", "s").first().nmi == pytest.approx(1.0)
    masked = spark.createDataFrame([("<NAME_1>", "<PHONE_1>", "9,999.00"), ("XXX", "999-999-9999", "9,999.00")], "name string, phone string, amount string")
    assert one(audit.pii_scan(masked))["value"] == 0
    scored = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False)], "x double, m boolean")
    assert audit.auc(scored, "x", "m").first().auc == pytest.approx(0.125)
    fixed = audit.remedy(spark.createDataFrame([("ab"[i % 2], float(i % 2)) for i in range(20)], "colour string, condition double"), "condition")
    assert {r.colour for r in fixed.collect()} == {"<GENERALIZED>"}


# Profiles


def test_profile(spark):
    df = spark.createDataFrame([("t1", "2024-01-01", "(1,000.00)", "a"), ("t2", "31/12/2023", "$5.00", "a "), ("t3", "2024-01-03", " 7", None), ("t4", None, "3-", "b")], "tx_id string, date_str string, balance string, category string")
    p = by(profile.profile(df), "column")
    assert p["tx_id"]["role"] == "PRIMARY_KEY" and p["category"]["nulls"] == 1 and p["category"]["null_percent"] == 25.0
    assert p["balance"]["negatives"] and p["balance"]["currency"] and p["balance"]["blanks"] and len(p["date_str"]["date_formats"]) == 2
    assert by(profile.missingness(df), "column")["date_str"]["valid_percent"] == 75.0
    assert profile.sheet_role("Monthly_Pivot", ["Department", "jan", "feb", "mar"], 4) == "PIVOT_TABLE"
    assert profile.sheet_role("Dim_Customer", ["dept_code", "dept_name", "cost_center"], 3) == "LOOKUP_DIMENSION"
    assert profile.sheet_role("About", ["Report Name", "Date"], 1) == "METADATA_BLOCK"
    grid = spark.createDataFrame([(0, "Sales"), (1, "Grand Total"), (2, "Ops")], "n int, Department string")
    assert [r.n for r in profile.subtotal_rows(grid, "n").collect()] == [1]


def test_before_and_after(spark):
    raw = spark.createDataFrame([("a", 1, None), ("b", None, "x"), ("c", 3, None), ("d", 4, "y")], "`Patient Name ` string, Age int, `Phone Number` string")
    clean = spark.createDataFrame([("b", 2, "x"), ("d", 4, "y")], "patient_name string, age int, phone_number string")
    q = one(profile.quality_diff(raw, clean))
    assert (q["rows_diff"], q["null_reduction"]) == (-2, 100.0) and q["score"] >= 90
    shift = by(profile.column_shift(spark.createDataFrame([(1, None, 3)], "id int, name string, age int"), spark.createDataFrame([(1, "x", 3, 0.1)], "id int, name string, age int, age_zscore double")), "column")
    assert shift["name"]["shift"] == "IMPUTED" and shift["age_zscore"]["shift"] == "NEW" and shift["id"]["shift"] == "UNCHANGED"
    df = spark.range(100).select("id", (F.col("id") + 1.0).alias("amount"))
    assert one(profile.retention_audit(df, df.where("id < 95")))["passed"] and not one(profile.retention_audit(df, df.where("id < 50")))["passed"]
    assert one(profile.retention_audit(df, df.withColumn("amount", F.lit(0.0))))["reason"] == "sums zeroed"
    assert one(profile.retention_audit(df, df.where("false")))["reason"] == "empty result"


def test_relational_parts(spark, monkeypatch):
    monkeypatch.setattr(ledger, "RANGE_ROWS", 2)
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, None), (4, "b"), (5, None)], "n long, v string").repartition(3)
    assert {r.n: r.v for r in relational.forward_fill(df, "v", "n").collect()} == {0: None, 1: "a", 2: "a", 3: "a", 4: "b", 5: "b"}
    raw = spark.createDataFrame([("7", "1,5", " x ", None)], "Sequence string, Unit_Price string, Item_Code string, extra string")
    out = relational.canonical_order(relational.typed(relational.canonical_names(raw)))
    assert out.columns == ["Sequence", "GL-Code", "Unit Price", "extra"] and tuple(out.first()) == (7, "x", 15.0, "")
    assert one(relational.fill_defaults(spark.createDataFrame([(None, None)], "Sequence long, a string"))) == {"Sequence": 1000, "a": ""}
    wide = spark.createDataFrame([(0, "Title", *[None] * 7), (1, *"abcdefgh"), (2, *"12345678")], ", ".join(["_ord long", *[f"c{i} string" for i in range(8)]]))
    assert relational.header_offset(wide, "_ord") == 1
    assert [r.n for r in relational.sort_by_total(spark.createDataFrame([(0, 1), (1, 5), (2, 5)], "n int, grand_total int"), "n").collect()] == [1, 2, 0]
    a, b = relational.halves(spark.range(100), "id")
    assert a.count() + b.count() == 100 and a.intersect(b).count() == 0 and 30 < a.count() < 70
    assert relational.shuffled(spark.range(50), "id").collect() == relational.shuffled(spark.range(50), "id").collect() != spark.range(50).collect()
    assert {r.column: r.change for r in relational.column_sets(df, df.withColumn("w", F.lit(1)).drop("v")).collect()} == {"n": "KEPT", "v": "DROPPED", "w": "ADDED"}


# Column intelligence


def test_entropy(spark):
    df = spark.createDataFrame([("x", f"v{i}", None) for i in range(100)], "a string, b string, c string")
    e = {k: v["entropy"] for k, v in by(insight.entropy(df, ["a", "b", "c"]), "column").items()}
    assert e["a"] == 0 and e["b"] >= 0.95 and e["c"] == 0


def test_morphology(spark):
    rows = [(f"{i:08x}-1111-2222-3333-444455556666", f"2024-01-{i + 10}", f"A{i}/B{i}", f"$ {i * 10}.50", f"This is a long sentence number {i} with many words", f"3{i:013d}3", f"{i + 1}-0{i % 9 + 1}-1445", None) for i in range(10)]
    m = by(insight.morphology(spark.createDataFrame(rows, "uuid_col string, date_col string, composite_col string, currency_col string, narrative_col string, vat string, hijri string, nothing string")), "column")
    roles = {c: r["role"] for c, r in m.items()}
    assert roles == {"uuid_col": "PRIMARY_IDENTIFIER", "date_col": "TEMPORAL", "composite_col": "COMPOSITE_KEY", "currency_col": "CONTINUOUS_NUMERIC", "narrative_col": "FREE_TEXT_NARRATIVE", "vat": "PRIMARY_IDENTIFIER", "hijri": "TEMPORAL_HIJRI", "nothing": "ALL_NULL"}
    assert m["vat"]["regional_id"] == "ZATCA_VAT_ID"


def test_keys_laws_and_outliers(spark):
    rows = [(i, ["Riyadh", "Jeddah", "Krakow"][i % 3], ["Central", "West", "Lesser"][i % 3], ["SA", "SA", "PL"][i % 3]) for i in range(10)]
    df = spark.createDataFrame(rows, "order_id int, city string, state string, country string")
    assert [r.column for r in insight.candidate_keys(df).where("is_key").collect()] == ["order_id"]
    deps = {(r.determinant, r.dependent) for r in insight.dependencies(df, ["city", "state", "country"]).where("holds").collect()}
    assert ("state", "country") in deps and ("country", "state") not in deps
    money = spark.createDataFrame([(i + 1, 2.5 * (i + 1), 2.5 * (i + 1) ** 2, 0.375 * (i + 1) ** 2) for i in range(12)], "quantity int, unit_price double, item_amount double, vat double")
    found = {(r.law, r.a, r.b) for r in insight.laws(money, money.columns).where("holds").collect()}
    assert ("PRODUCT", "quantity", "unit_price") in found and ("TAX", "item_amount", "vat") in found
    skewed = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 3, 3, 4, 4, 5, 500)], "v double")
    o = one(insight.outliers(skewed, ["v"]))
    assert o["skewed"] and o["outliers"] == 1
    assert one(insight.merge_beliefs(spark.createDataFrame([("c", "T", 0.6), ("c", "T", 0.5)], "`column` string, belief string, confidence double")))["confidence"] == pytest.approx(0.8)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_candidate_keys_of_a_table_that_grows(spark):
    from veilspark.plans.queries import QUERIES

    out = by(QUERIES["candidate_keys_orders"](spark, "/root/testdata/sf0.001"), "column")
    assert out["o_orderkey"] == {"column": "o_orderkey", "distinct": 1500, "is_key": True} and not out["o_custkey"]["is_key"]


def test_inventory_samples_columns_that_are_filled_late(spark):
    rows = [(i, f"v{i}" if i >= 60 else None, "x" if i in (3, 70, 90) else None) for i in range(100)]
    out = by(profile.inventory(spark.createDataFrame(rows, "row int, late string, few string").repartition(4), "row"), "column")
    assert out["late"]["samples"] == ["v60", "v61", "v62"] and out["few"]["samples"] == ["x", "x", "x"] and out["row"]["samples"] == ["0", "1", "2"]


def test_beliefs_near_one_are_told_apart(spark):
    rows = spark.range(3000).selectExpr("'c' AS `column`", "IF(id < 2000, 'A', 'B') AS belief", "0.05D AS confidence")
    merged = insight.merge_beliefs(rows)
    assert {r.confidence for r in merged.collect()} == {1.0} and one(insight.dominant(merged))["belief"] == "A"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_belief_merge_counts_every_customer(spark):
    from veilspark.plans.queries import QUERIES

    doubt = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect():
        doubt[r.c_mktsegment] = doubt.get(r.c_mktsegment, 0.0) + math.log(1 - r.c_nationkey % 5 / 100)
    assert {r.column: r.log_doubt for r in QUERIES["belief_merge"](spark, "/root/testdata/sf0.001").collect()} == pytest.approx(doubt, abs=1e-5)


def test_places_times_states_vectors_graphs(spark):
    geo = spark.createDataFrame([(24.7, 46.6), (21.5, 39.2), (50.0, 19.9)], "lat double, lon double")
    assert {r.kind for r in insight.spatial(geo).collect()} == {"LATITUDE", "LONGITUDE"}
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(70)], "reading_date timestamp, v double")
    c = one(insight.cadence(times, "reading_date"))
    assert c["uniform"] and c["median_seconds"] == 86400 and c["n"] == 70
    assert insight.dominant_period(times, "reading_date", "v").first().period == pytest.approx(7, abs=0.3)
    wide = spark.createDataFrame([tuple(float(i) for i in range(16))], ", ".join(f"emb_dim_{i} double" for i in range(16)))
    assert [(r.column, r.kind) for r in insight.vectors(wide).collect()] == [("emb_dim", "COLUMNS")]
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "sender_id string, recipient_id string")
    assert links.graph_links(edges, ["sender_id", "recipient_id"]).count() == 1
    assert by(links.degrees(edges, "sender_id", "recipient_id"), "node")["n1"] == {"node": "n1", "out_degree": 1, "in_degree": 1}
    assert one(insight.concurrency(edges.withColumn("t", F.lit(1)).withColumn("c", F.lit(1)), "c", "t")) == {"groups": 1, "rows": 20}
    assert insight.architecture(["patient_id", "diagnosis"]) == "HEALTH" and insight.architecture(["a", "b"]) == "CLEAN_TABULAR"


def test_foreign_keys(spark):
    tx = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c3"), (4, "c9")], "order_id int, cust_id string")
    dim = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c3", "C"), ("c4", "D")], "cust_id string, cust_name string")
    found = links.foreign_keys({"tx": tx, "dim": dim}).collect()
    assert [(r.column_a, r.column_b, r.percent) for r in found] == [("cust_id", "cust_id", 75.0)]
    assert links.merge_lookup(tx, dim, "cust_id", "cust_id").where("cust_name is null").count() == 1


def test_boundaries(spark):
    rows = [(0, "Report: sales", None, None, None), (1, "Filter: all", None, None, None), (2, "Item", "Qty", "Price", "Sum")]
    rows += [(3 + i, f"Thing {i}", "1", "2.5", "2.5") for i in range(10)] + [(13, "Total", None, None, "25")]
    b = one(insight.boundaries(spark.createDataFrame(rows, "_ord long, a string, b string, c string, d string"), "_ord"))
    assert (b["header"], b["footer"], b["metadata_rows"]) == (2, 13, 2)


# Ledgers


GRID = [
    ("Doc. No", "Doc. Date", "Cust Code", "Cust Name", None, None, "Total"),
    ("Seq", None, "GL Code", "Description", "Qty", "Unit Price", "Amount"),
    ("IV-00001", "2024-01-05", "C001", "Alpha Trading", None, None, "1,500.00"),
    ("1000", None, "500-000", "Steel bolt", "10", "100.00", "1,000.00"),
    (None, None, None, "zinc plated", None, None, None),
    ("2000", None, "500-001", "Steel nut", "5", "100.00", "500.00"),
    ("Page 2 of 3", None, None, None, None, None, None),
    (None, None, None, "stray words", None, None, None),
    ("IV-00002", "2024-01-06", "C002", "Beta Stores", None, None, "300.00"),
    ("1000", None, "500-002", "Washer", "3", "100.00", "300.00"),
    ("Grand Total", None, None, None, None, None, "1,800.00"),
    ("1000", None, None, "after the end", "1", "1", "1"),
]


@pytest.mark.parametrize("range_rows", [100_000, 3])
def test_ragged_ledger(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ledger, "RANGE_ROWS", range_rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(GRID)], "_ord long, a string, b string, c string, d string, e string, f string, g string").repartition(4)
    assert one(ledger.is_ragged(df))["ragged"]
    layout = ledger.sniff(df)
    assert (layout.doc, layout.date, layout.code, layout.name, layout.total, layout.seq, layout.item, layout.desc, layout.qty, layout.price, layout.amount) == (0, 1, 2, 3, 6, 0, 2, 3, 4, 5, 6)
    out = [r.asDict() for r in ledger.clean(df).collect()]
    assert [r["Full_Description"] for r in out] == ["Steel bolt zinc plated", "Steel nut", "Washer"]
    assert [r["invoice_total"] for r in out] == [1500.0, 1500.0, 300.0] and out[0]["GL-Code"] == "500-000" and out[0]["customer_name"] == "Alpha Trading" and out[2]["doc_date"] == "2024-01-06"
    assert list(out[0]) == ledger.ORDER and not any(v is None for r in out for v in r.values())
    tidy = spark.createDataFrame([(0, 1, "x", 2.0), (1, 2, "y", 3.0), (2, 3, "z", 4.0)], "_ord long, order_no int, customer string, amount double")
    assert not one(ledger.is_ragged(tidy.withColumn("order_no", F.col("order_no").cast("string"))))["ragged"]
    filled = ledger.fallback(spark.createDataFrame([(0, "a", None), (1, None, "x"), (2, None, None), (3, "b", None)], "_ord long, p string, q string"))
    assert sorted(tuple(r) for r in filled.collect()) == [(0, "a", ""), (1, "a", "x"), (3, "b", "x")]


# Features and charts


def test_features(spark):
    df = spark.createDataFrame([(f"2024-01-0{i + 1}", 10.0**i, "gold" if i % 2 else "free", f"some longer feedback text {i}") for i in range(5)], "order_date string, amount double, customer_tier string, feedback string")
    out, names = features.quick(df)
    assert {"order_date_weekday", "amount_zscore", "amount_log1p", "customer_tier_freq", "feedback_char_len"} <= set(names)
    row = out.orderBy("order_date").first()
    assert row.order_date_weekday == 1 and row.customer_tier_freq == 3 and row.feedback_word_count == 5
    made, names = features.domain_features(spark.createDataFrame([(50.0, 200.0, "8 GB", "120/80")], "profit double, revenue double, ram string, bp string"))
    assert one(made)["profit_margin"] == 0.25 and one(made)["ram_gb"] == 8.0 and one(made)["systolic"] == 120


def test_charts(spark):
    df = spark.createDataFrame([(i, "NSE"[i % 3], float(i), i % 2) for i in range(10)], "order_id int, region string, sales double, quantity int")
    assert sum(r.n for r in charts.histogram(df, "sales").collect()) == 10 and charts.histogram(df, "sales", 2).count() == 3
    assert one(charts.box_plot(df, "sales"))["median"] == 4.5
    assert by(charts.correlations(df.withColumn("twice", F.col("sales") * 2), ["sales", "twice"]).where("a <> b"), "a")["sales"]["r"] == 1.0
    assert charts.categorical_bar(df, "region").first().category == "N"
    assert charts.pareto(df, "region", "sales").agg(F.max("cumulative")).first()[0] == pytest.approx(100)
    assert charts.crosstab(df, "region", "quantity").count() == 6 and charts.quantile_ladder(df, "sales").count() == 9
    assert charts.scatter_density(df, "sales", "quantity").agg(F.sum("n")).first()[0] == 10 and charts.dimensions_and_measures(df) == (["order_id", "region"], ["sales", "quantity"])
    assert charts.histogram(df.where("false"), "sales").agg(F.sum("n")).first()[0] == 0


# Mocks


def test_mock(spark):
    df = spark.createDataFrame([(100.0 + i, 0.1 * i, 30 + i, "$5.50", "Ann", True) for i in range(5)], "revenue double, profit_margin double, patient_age int, price_usd string, first_name string, ok boolean")
    rows = synth.mock(df, 5, seed=1).collect()
    assert len(rows) == 5 and all(r.revenue >= 0 and r.patient_age >= 18 and r.price_usd.startswith("$") and r.first_name != "Ann" for r in rows)
    assert rows == synth.mock(df, 5, seed=1).collect() and synth.mock(df.where("false"), 5).count() == 0
    assert synth.mock(spark.createDataFrame([(None, None)], "a double, b string"), 3).count() == 3


# Sandbox


def test_hostile_and_harmless_code(spark):
    assert all(sandbox.findings(c) for c in sandbox.HOSTILE)
    for code in ("x = df.dropna()", "import re\nimport os.path", "import time\ntime.sleep(0.1)", ""):
        assert sandbox.audit(code)
    with pytest.raises(sandbox.CodeRejected):
        sandbox.audit("import os\nos.environ")
    with pytest.raises(SyntaxError):
        sandbox.audit("def")
    df = spark.range(5)
    names = sandbox.execute(spark, "df_clean = df.where('id > 1')", {"df": df})
    assert sandbox.harvest(spark, names, {"df": df}).count() == 3
    names = sandbox.execute(spark, "def clean_it(d):\n    return d.limit(1)", {"df": df})
    assert sandbox.harvest(spark, names, {"df": df}).count() == 1
    with pytest.raises(TimeoutError):
        sandbox.execute(spark, "while True:\n    time_is_up.wait(0.05)", {"time_is_up": __import__("threading").Event()}, timeout=0.3)
    memory = sandbox.FailureMemory()
    try:
        sandbox.execute(spark, "df['amout']", {"df": df})
    except Exception as e:  # noqa: BLE001
        memory.record("df['amout']", e)
    assert "amount" in sandbox.autopsy(memory.last, ["amount"])
    snaps = sandbox.Snapshots(2)
    for n in (1, 2, 3):
        snaps.take("df", df.limit(n))
    assert [snaps.rollback("df").count() for _ in range(2)] == [3, 2] and snaps.rollback("df") is None
    assert sandbox.code_blocks("text\n```python\nx = 1\n```\n") == ["x = 1"] and sandbox.code_blocks("no code here") == []
    assert sandbox.dialect("df.iloc[0]") == "pandas" and sandbox.dialect("df.withColumn('a', F.col('b'))") == "spark"


# Sources, sinks, lifecycle, reports, streams


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y,extra\n3\n")
    assert [tuple(r) for r in readers.read(spark, f"{tmp_path}/a.csv", ordered=True).select("id", "name", "_ord").orderBy("_ord").collect()] == [(1, "x", 0), (2, "y", 1), (3, None, 2)]
    (tmp_path / "b.tsv").write_bytes("id\tname\n1\tcafé\n".encode("latin-1"))
    assert readers.read(spark, f"{tmp_path}/b.tsv").first().name == "café"
    (tmp_path / "c.json").write_text('{"k1": {"a": "1"}, "k2": {"a": "2", "b": "z"}}')
    assert {(r.item_key, r.a, r.b) for r in readers.read(spark, f"{tmp_path}/c.json").collect()} == {("k1", "1", None), ("k2", "2", "z")}
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read(spark, f"{tmp_path}/d.json").count() == 2
    with pytest.raises(ValueError):
        readers.read(spark, f"{tmp_path}/x.foo")
    with pytest.raises(FileNotFoundError):
        readers.read(spark, f"{tmp_path}/x.csv")
    spark.range(3).createOrReplaceTempView("some_view")
    assert readers.read(spark, "some_view").count() == 3 and readers.clean_path("'a\\ b'") == "a b"
    big = readers.with_order(spark.range(1000, numPartitions=7))
    assert big.where("id <> _ord").count() == 0


def test_workbooks(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    tx = spark.createDataFrame([(f"t{i}", f"c{i % 3}", 1.5 * i) for i in range(10)], "tx_id string, cust_id string, amount double")
    dim = spark.createDataFrame([(f"c{i}", f"Name {i}") for i in range(5)], "cust_id string, customer_name string")
    sinks.write_sheets({"Transactions": tx, "Dim_Customer": dim}, path)
    raw = readers.workbook(spark, path)
    assert list(raw) == ["Transactions", "Dim_Customer"] and raw["Dim_Customer"].count() == 6 and readers.header_row(raw["Transactions"])[1] == ["tx_id", "cust_id", "amount"]
    book = lifecycle.profile_workbook(spark, path)
    assert book.primary == "Transactions" and book.roles["Dim_Customer"] == "LOOKUP_DIMENSION" and book.rows == {"Transactions": 10, "Dim_Customer": 5}
    assert ("cust_id", "cust_id") in {(r.column_a, r.column_b) for r in book.links.collect()}
    safe, vault = lifecycle.protect(book.sheets)
    assert sinks.write_protected(safe, path) == [f"{tmp_path}/book_anonymized.xlsx"] and os.path.exists(f"{tmp_path}/book_anonymized.xlsx")
    assert vault.restore(safe["Dim_Customer"]).select("customer_name").collect() == book.sheets["Dim_Customer"].select("customer_name").collect()
    assert readers.unique(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_texts(spark, people, tmp_path):
    found = lifecycle.think(people)
    assert "age" in report.briefing("people", profile.profile(people), found["morphology"])
    prompt = report.master_prompt("people", profile.profile(people), synth.mock(people, 3), "GDPR", "Clean it.")
    assert "p1@firm" not in prompt and "## Mock rows" in prompt
    compile(report.test_module("t", ["a"], 1, ["a"]), "x", "exec")
    compile(report.ledger_recipe(ledger.Layout()), "x", "exec")
    assert report.power_query(ledger.Layout(date=1)).startswith("let") and "█" in report.bars([("a", 2), ("b", 1)])
    sinks.append_block(f"{tmp_path}/p.ipynb", "x = 1")
    sinks.append_block(f"{tmp_path}/p.py", "x = 1")
    rows = spark.createDataFrame([("nmi", 0.01, 0.05, True, "", 2, 10)], audit.METRIC + ", tier int, weight int")
    assert "Egress allowed" in sinks.certificate(rows, "GDPR", "x")
    cleaned, names = lifecycle.clean(people)
    assert names and cleaned.count() == 20


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, i % 3), "a@b.com" if i % 2 else "x", "F") for i in range(12)], "at timestamp, t string, g string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    src = monitors.stream(spark, f"{tmp_path}/in", rows.schema)
    q = monitors.pii_rates(src, "at", "t").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").agg(F.sum("with_email"), F.sum("rows")).first()[:] == (6, 12)
    q = monitors.class_counts(src, "at", ["g"]).writeStream.format("memory").queryName("sizes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sizes").first().n == 12
    monitors.redacted(src, "t", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("t like '%@%'").count() == 0


def test_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
