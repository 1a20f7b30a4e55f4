"""Mock rows that follow a table's shape under a budget of differential privacy, with seeds."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import is_numeric

#: Words in a column's name, in the order in which they are tried, and the texts of mock rows: {n} is the row's number from 1, a tuple is
#: gone through in turn.  The words are fixed values, the texts made up.
TEMPLATES = (
    (("account_number", "acc_no", "account_id"), "ACCT-{n:06d}"),
    (("card_type", "card_brand"), ("Brand A", "Brand B", "Brand C")),
    (("credit_card", "card_num", "card_no", "pan"), "0000-0000-0000-{n:04d}"),
    (("tx_type", "transaction_type"), ("DEBIT", "CREDIT", "TRANSFER", "REFUND")),
    (("currency", "curr"), ("USD", "EUR", "GBP", "SAR", "AED")),
    (("iban",), "XX00MOCK{n:012d}"),
    (("credit_rating", "rating_grade"), ("AAA", "AA", "A", "BBB")),
    (("pesel", "saudi_id", "iqama", "ssn", "national_id", "tax_id"), "MOCK-ID-{n:010d}"),
    (("mrn", "patient_id", "subject_id"), "MRN-{n:06d}"),
    (("diagnosis", "icd", "condition"), ("Z00.0 (General examination)", "J00 (Common cold)", "M54.5 (Low back pain)")),
    (("cpt", "procedure"), ("Visit, short", "Visit, long", "Blood count")),
    (("medication", "drug", "prescription", "rx"), ("Substance A 10 mg", "Substance B 20 mg", "Substance C 5 mg")),
    (("blood_pressure", "bp"), ("115/75", "120/80", "125/85")),
    (("blood_type",), ("O+", "A+", "B+", "AB-")),
    (("admission_type",), ("EMERGENCY", "ELECTIVE", "URGENT")),
    (("ward", "specialty", "clinic"), ("Ward 1", "Ward 2", "Ward 3")),
    (("sku",), "SKU-{n:05d}"),
    (("product_name", "item_name"), ("Desk lamp", "Water bottle", "Note book", "Cable")),
    (("category", "department"), ("Category A", "Category B", "Category C")),
    (("carrier", "shipping_method"), ("Carrier A", "Carrier B", "Carrier C")),
    (("tracking", "waybill"), "TRK-{n:08d}"),
    (("order_id", "order_no"), "ORD-{n:06d}"),
    (("user_id", "customer_id"), "usr_{n:05d}"),
    (("plan", "tier", "subscription"), ("Free", "Standard", "Large")),
    (("ip_address",), "192.0.2.{k}"),
    (("mac",), "02:00:00:00:00:{k:02x}"),
    (("http_method",), ("GET", "POST", "PUT", "DELETE")),
    (("browser",), ("Browser A", "Browser B", "Browser C")),
    (("platform", "os_name"), ("System A", "System B", "System C")),
    (("event", "action"), ("page_view", "button_click", "checkout")),
    (("vin",), "MOCKVIN{n:010d}"),
    (("plate", "license_plate"), "ABC-{n:04d}"),
    (("container", "container_id"), "MOCU-{n:06d}"),
    (("origin", "departure_port"), ("Port A", "Port B", "Port C")),
    (("destination", "arrival_port"), ("Port D", "Port E", "Port F")),
    (("employee_id", "staff_id"), "EMP-{n:05d}"),
    (("job_title", "role", "position", "occupation"), ("Engineer", "Analyst", "Manager", "Clerk")),
    (("employment_type", "contract_type"), ("Full-Time", "Part-Time", "Contractor")),
    (("education", "degree"), ("Bachelor", "Master", "Doctor")),
    (("device_id", "sensor_id", "sensor"), "SENSOR-{n:04d}"),
    (("machine_model", "equipment_id"), "Model-{n:03d}"),
    (("error_code", "fault_code"), "ERR_{n:03d}"),
    (("property_type", "property"), ("Flat", "House", "Office")),
    (("room_type", "room"), ("Single", "Double", "Suite")),
    (("booking_channel", "source"), ("Channel A", "Channel B", "Channel C")),
    (("student_id", "student"), "STU-{n:05d}"),
    (("course_code", "course"), ("CS-101", "MATH-102", "HIST-103")),
    (("grade",), ("A", "B", "C", "D")),
    (("term", "semester"), ("Spring", "Summer", "Autumn")),
    (("campaign",), "Campaign {n}"),
    (("channel", "ad_network"), ("Search", "Social", "Video")),
    (("lead_status", "stage"), ("NEW", "QUALIFIED", "WON")),
    (("invoice", "doc"), "INV-{n:06d}"),
    (("email",), "user{n}@mail.invalid"),
    (("name", "customer", "patient", "client", "person", "contact"), "Given{n} Family{n}"),
    (("phone", "mobile", "cell"), "+1-555-01{k:02d}"),
    (("address", "street"), "{n} Example Street"),
    (("city", "town"), ("City A", "City B", "City C")),
    (("country", "nation"), ("Country A", "Country B", "Country C")),
    (("zip", "postal", "zipcode"), "0{n:04d}"),
    (("url", "website", "link"), "https://mock.invalid/{n}"),
    (("uuid", "guid"), "00000000-0000-4000-8000-{n:012d}"),
    (("gender", "sex"), ("X",)),
    (("desc", "note", "comment", "memo"), "Sample text {n}"),
    (("status", "state"), ("ACTIVE", "PENDING", "COMPLETED")),
)
#: Currencies in a column's name, and what stands before a number then.
MONEY = (("usd", "$"), ("eur", "€"), ("gbp", "£"), ("sar", "SAR "), ("aed", "AED "))
#: Chance with which a form of text that one row alone has may be told.
DELTA = 1e-6
NUMBER = r"(-?[\d,]+(?:\.\d+)?)"
#: Powers of ten and steps of the grid of numbers; numbers between its ends' negatives and its least are 0.
LEAST_POWER, MOST_POWER, STEPS = -3, 15, 90


def grid() -> list[float]:
    """The candidates for quantiles: 0 and two digits of every size, of either sign.  They don't depend on the data."""
    up = [round(m / 10 * 10.0**e, 12) for e in range(LEAST_POWER, MOST_POWER + 1) for m in range(10, 100)]
    return [-x for x in reversed(up)] + [0.0, *up]


def place(x: Column) -> Column:
    """How many candidates are not above x, less one, from x alone: that of its sign, power and two digits."""
    size = F.abs(x)
    power = F.least(F.greatest(F.floor(F.log10(size)), F.lit(LEAST_POWER)), F.lit(MOST_POWER))
    # rounding may put a number beside its step, by one candidate at most
    step = F.least(F.greatest(F.floor(size / F.pow(F.lit(10.0), power - 1) + 1e-9), F.lit(10)), F.lit(99)) - 10
    at = (power - LEAST_POWER) * STEPS + step
    middle = (MOST_POWER - LEAST_POWER + 1) * STEPS
    small = size < 10.0**LEAST_POWER
    return F.when(small, middle).when(x > 0, middle + 1 + at).otherwise(middle - 1 - at).cast("int")


@dataclass
class Budget:
    """Epsilon is dealt out evenly to columns, and within a column to its questions; what was spent is kept."""

    epsilon: float
    columns: int
    spent: dict[str, float] = field(default_factory=dict)

    def share(self, column: str, questions: int) -> float:
        """The part of one of a column's questions; more than the whole is an error."""
        part = self.epsilon / max(1, self.columns) / questions
        self.spent[column] = self.spent.get(column, 0.0) + part
        if sum(self.spent.values()) > self.epsilon * (1 + 1e-9):
            raise ValueError("the budget is spent")
        return part


def laplace(rng: random.Random, scale: float) -> float:
    u = rng.random() - 0.5
    return -scale * math.copysign(math.log(1 - 2 * abs(u)), u)


def quantile(counts: list[int], share: float, epsilon: float, rng: random.Random) -> int:
    """The exponential mechanism: a candidate's place, drawn with weight exp(-epsilon * d / 2), where d is how far the rows below
    and at it are from the rank asked for.  One row more or less changes d by one at most."""
    total = sum(counts)
    best, at, below = -math.inf, 0, 0
    for i, n in enumerate(counts):
        rank = share * total
        off = max(below - rank, rank - (below + n), 0.0)
        below += n
        u = rng.random() or 1e-300
        score = -epsilon * off / 2 - math.log(-math.log(u) or 1e-300)  # with Gumbel noise the largest is such a draw
        if score > best:
            best, at = score, i
    return at


def uniform(seed: int, column: str) -> Column:
    """A number between 0 and 1 for each id, whatever the partitions."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(column)), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def mock(df: DataFrame, n: int = 5, epsilon: float = 1.0, seed: int = 0, delta: float = DELTA, budget: Budget | None = None) -> DataFrame:
    """n rows with the columns of df, made on the executors.

    What is asked of the table is (epsilon, delta)-differentially private by rows, in all columns together: shares of nulls, of
    negative numbers and of flags by Laplace noise on counts; the quartiles of numbers by the exponential mechanism over candidates
    that don't depend on the data; the commonest form of texts with a number in them (``$ 1,000.00``) by noisy counts above a
    threshold that a form of one row passes with chance delta.  Tables are neighbours if one row differs; names and types of columns
    and the number of rows are taken as known.  A ``budget`` keeps account.  Numbers are Laplace noise around the middle quartile, as wide as the outer ones are
    apart, within the signs of the source; texts come from templates by name; no cell is copied.  No rows for an empty table."""
    rng, spark = random.Random(seed), df.sparkSession
    budget = budget or Budget(epsilon, len(df.columns))
    numbers = {c: F.col(f"`{c}`").cast("double") for c, t in df.dtypes if is_numeric(t)}
    texts = [c for c, t in df.dtypes if t == "string"]
    within = {c: F.regexp_replace(F.regexp_extract(F.col(f"`{c}`"), NUMBER, 1), ",", "").try_cast("double") for c in texts}
    aggs = [F.count("*").alias("rows")]
    for i, (c, _) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in texts:
            aggs.append(F.count_if(F.lower(v).isin("y", "n", "yes", "no", "true", "false")).alias(f"y{i}"))
    s = df.agg(*aggs).first()
    if not s["rows"]:
        return spark.createDataFrame([], df.schema)
    counted = _counts(df, numbers | within)
    forms = _forms(df, texts, epsilon / max(1, len(df.columns)) / 7, delta, seed) if texts else {}
    columns = []
    for i, (c, t) in enumerate(df.dtypes):
        asked = 5 if c in numbers else 7 if c in texts else 1
        part = epsilon / max(1, len(df.columns)) / asked  # what a count's noise can make is told from what is there: by eight times its width
        noisy = lambda count: count + laplace(rng, 1 / budget.share(c, asked))  # noqa: B023, E731
        rows = s["rows"]
        nulls = noisy(rows - s[f"n{i}"])
        missing = min(1.0, nulls / rows) if nulls > max(0.05 * rows, 8 / part) else 0.0
        made = None
        if c in numbers or c in texts:
            held = counted.get(c, {})
            cells = [held.get(k, 0) for k in range(len(CANDIDATES))]
            middle = len(CANDIDATES) // 2
            negative = noisy(sum(cells[:middle])) > max(0.005 * rows, 8 / part)
            first = 0 if negative else middle
            q = [CANDIDATES[first + quantile(cells[first:], p, budget.share(c, asked), rng)] for p in (0.25, 0.5, 0.75)]
            if c in numbers:
                made = _number(c, t, q, negative, seed)
            else:
                flags = noisy(s[f"y{i}"]) > max(0.95 * rows * (1 - missing), 8 / part)
                budget.share(c, asked)  # of the commonest form
                made = _text(c, q, negative, flags, forms.get(c), seed)
        made = _other(t) if made is None else made
        gone = uniform(seed, f"{c} null") < missing
        columns.append(F.when(~gone, made).cast(t).alias(c))
    return spark.range(n).select(*columns)


def _counts(df: DataFrame, numbers: dict[str, Column]) -> dict[str, dict[int, int]]:
    """Rows at each candidate, by column: as many lines as there are candidates, at most."""
    if not numbers:
        return {}
    names = list(numbers)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(numbers.values())])
    rows = df.select(F.explode(cells).alias("e")).select("e.*").where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("i", place(F.col("x")).alias("at")).agg(F.count("*").alias("n"))
    out: dict[str, dict[int, int]] = {}
    for r in rows.collect():
        out.setdefault(names[r["i"]], {})[r["at"]] = r["n"]
    return out


def _forms(df: DataFrame, texts: list[str], epsilon: float, delta: float, seed: int) -> dict[str, str]:
    """The commonest form of each column's texts that hold one number, by noisy counts above the threshold."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_replace(F.col(f"`{c}`"), NUMBER, "\u0001").alias("form")) for i, c in enumerate(texts)])
    rows = df.select(F.explode(cells).alias("e")).select("e.*").where(F.col("form").contains("\u0001") & (F.length("form") <= 20)).groupBy("i", "form").agg(F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64("i", "form", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53) - 0.5
    wide = 2 / epsilon  # another row changes the counts of two forms
    noisy = F.col("n") - F.signum(u) * F.log(1 - 2 * F.abs(u)) * wide
    top = rows.withColumn("n", noisy).where(F.col("n") > 1 + math.log(1 / (2 * delta)) * wide).groupBy("i").agg(F.max(F.struct("n", "form")).alias("top"))
    return {texts[r["i"]]: r["top"]["form"] for r in top.collect()}  # a line for each column


def _noise(c: str, seed: int, scale: float) -> Column:
    u = uniform(seed, c) - 0.5
    return -F.signum(u) * F.log(1 - 2 * F.abs(u)) * scale


def _number(c: str, t: str, q: list[float], negative: bool, seed: int) -> Column:
    low, k = c.lower(), F.col("id")
    scale = max(0.5, q[2] - q[0])
    if "int" in t:
        if "id" in low.split("_") or low.endswith(("key", "_no", "_num")) or low == "id":
            return 1001 + k
        if "year" in low:
            return 2024 + k % 3
        if "age" in low.split("_"):
            return F.greatest(F.lit(18), F.least(F.lit(95), F.round(F.lit(q[1]) + _noise(c, seed, 5.0) + 2 * (k % 5))))
        v = F.round(F.lit(q[1]) + _noise(c, seed, scale) + (k % 5 - 2) * (scale / 2))
        v = v if negative else F.greatest(F.lit(0.0), v)
        most = {"tinyint": 7, "smallint": 15, "int": 31}.get(t, 53)
        return F.greatest(F.lit(-(2.0**most)), F.least(F.lit(2.0**most - 1), v))
    v = F.round(F.lit(q[1]) + _noise(c, seed, scale) + (k % 5 - 2) * (scale / 3), 2)
    v = v if negative else F.greatest(F.lit(0.01), v)
    return v.try_cast(t) if t.startswith("decimal") else v


def _text(c: str, q: list[float], negative: bool, flags: bool, form: str | None, seed: int) -> Column:
    k = F.col("id")
    if flags:
        return F.when(k % 2 == 0, "Y").otherwise("N")
    if form and form.count("\u0001") == 1 and not any(ch.isalpha() for ch in form.replace("\u0001", "").replace("SAR", "").replace("USD", "").replace("EUR", "")):
        v = F.lit(q[1]) + _noise(c, seed, max(0.5, q[2] - q[0])) + (k % 5 - 2) * (max(0.5, q[2] - q[0]) / 3)
        v = v if negative else F.greatest(F.lit(0.01), v)
        before, after = form.split("\u0001")
        return F.concat(F.lit(before), F.format_number(v, 2), F.lit(after))
    low = c.lower()
    money = next((mark for name, mark in MONEY if name in low.split("_")), None)
    if money:
        return F.concat(F.lit(money), F.format_number(10.0 + k, 2))
    for words, value in TEMPLATES:
        if any(w in low for w in words):
            return _templated(value)
    if any(w in low for w in ("date", "time", "created", "updated")):
        return F.date_add(F.lit("2024-01-01").cast("date"), ((k % 300) * 7).cast("int")).cast("string")
    return F.concat(F.lit(f"SAMPLE_{c.upper()}_"), (k + 1).cast("string"))


def _templated(value: str | tuple[str, ...]) -> Column:
    """A template with {n} or {k} (n among 99) and a width, or values in turn."""
    import re

    if isinstance(value, tuple):
        return F.element_at(F.array(*[F.lit(x) for x in value]), (F.col("id") % len(value) + 1).cast("int"))
    parts = []
    for text, name, form in re.findall(r"([^{]*)(?:\{([nk])(?::(\w+))?\})?", value):
        number = F.col("id") + 1 if name == "n" else F.col("id") % 99 + 1
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.format_string(f"%{form or 'd'}", number))
    return F.concat(*parts)


def _other(t: str) -> Column:
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("id") % 300) * 7).cast("int"))
    if t == "boolean":
        return F.col("id") % 2 == 0
    return day if t in ("date", "timestamp", "timestamp_ntz") else F.lit(None)


CANDIDATES = grid()


def ledger_mock(df: DataFrame, order: str = "_ord") -> DataFrame:
    """Four rows of a report's shape: header, line, wrapped text, line."""
    from .ledger import sniff

    layout, columns = sniff(df, order), [c for c in df.columns if c != order]
    rows = []
    for kind in ("header", "line", "wrap", "line"):
        row: dict[int | None, str] = {layout.desc: "Sample description"}
        if kind == "header":
            row = {layout.doc: "INV-99999", layout.date: "2024-01-01", layout.code: "C-999", layout.name: "Sample customer", layout.total: "9,999.00"}
        elif kind == "line":
            row |= {layout.seq if layout.seq is not None else 0: "1000", layout.qty: "9", layout.uom: "CTN", layout.price: "99.00", layout.amount: "999.00"}
        rows.append((len(rows), *[row.get(i) for i in range(len(columns))]))
    return df.sparkSession.createDataFrame(rows, ", ".join([f"`{order}` long", *[f"`{c}` string" for c in columns]]))
