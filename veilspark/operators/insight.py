"""What columns are and how they hang together: roles, keys, dependencies, laws, places, times, states, graphs."""

from __future__ import annotations


import re
from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import number_of, strip
from .keys import dependencies, distinct_counts, pair_counts  # noqa: F401
from .profile import is_numeric, tall
from . import spectrum
from .quantiles import quantiles
from .running import settled

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)$"
DATE = r"^\d{2,4}[-/.]\d{1,2}[-/.]\d{2,4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$"
HIJRI_MONTHS = "محرم|صفر|ربيع الأول|ربيع الثاني|جمادى الأولى|جمادى الآخرة|رجب|شعبان|رمضان|شوال|ذو القعدة|ذو الحجة"
HIJRI = rf"^\d{{1,2}}[-/.]\d{{1,2}}[-/.]1[34]\d{{2}}(?:\s*هـ)?$|^1[34]\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(?:\s*هـ)?$|(?:{HIJRI_MONTHS}).*(?<!\d)1[34]\d{{2}}(?!\d)|1[34]\d{{2}}\s*هـ"
COMPOSITE = r"(?U)^[\w.]+\s*[/|x_\-]\s*[\w.]+$"
CURRENCY = P.CURRENCY + r"|^\(\s*[\d,.]+\s*\)$"
REGIONAL = (("ZATCA_VAT_ID", r"^3\d{13}3$"), ("SAUDI_CR", r"^[1247]\d{9}$"), ("SAUDI_NID", r"^[12]\d{9}$"))
METADATA, FOOTER = ("|".join(re.escape(w) for w in words) for words in (P.METADATA_WORDS, P.FOOTER_WORDS))
SURROGATE = r"<[A-Z_]+_\d+>|XXX|\*\*\*|^(?:9,999\.00|999+|123456789|000+)$"


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, entropy: Shannon bits over log2 of the values, 0 to 1.  Values are counted in one shuffle for all
    columns."""
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    counts = cells.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("m"))
    sums = counts.groupBy("column").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.log2(F.col("m").cast("double"))).alias("x"))
    bits = F.log2(F.col("n").cast("double")) - F.col("x") / F.col("n")
    out = sums.select("column", F.when(F.col("n") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), bits / F.log2(F.col("n").cast("double"))))).otherwise(0.0).alias("entropy"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(out, "column", "left").fillna(0.0, ["entropy"])


def morphology(df: DataFrame) -> DataFrame:
    """column, role and the shares that decide it; one aggregate over all rows."""
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    tests = {"hijri": HIJRI, "date": DATE, "uuid": UUID, "ip": IPV4, "composite": COMPOSITE, "currency": CURRENCY, "blanks": r"\s", **{k.lower(): p for k, p in REGIONAL}}
    aggs, fields = [], ["n", "length", "numeric", *tests]
    for i, (c, _) in enumerate(df.dtypes):
        s = strip(F.col(f"`{c}`").cast("string"))
        aggs += [F.count(s).alias(f"c{i}_n"), F.coalesce(F.avg(F.length(s)), F.lit(0.0)).alias(f"c{i}_length")]
        aggs += [F.coalesce(F.avg(F.when(s.isNotNull(), number_of(s).isNotNull().cast("int"))), F.lit(0.0)).alias(f"c{i}_numeric")]
        aggs += [share(s.rlike(p)).alias(f"c{i}_{k}") for k, p in tests.items()]
    stripped = df.select(*[strip(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    rows = tall(df.agg(*aggs), df.columns, fields).join(distinct_counts(stripped), "column").withColumn("cardinality", F.when(F.col("n") > 0, F.col("distinct") / F.col("n")).otherwise(0.0))
    regional = F.lit(None).cast("string")
    for k, _ in reversed(REGIONAL):
        regional = F.when(F.col(k.lower()) > 0.60, k).otherwise(regional)
    role = (
        F.when(F.col("n") == 0, "ALL_NULL")
        .when(F.col("hijri") > 0.40, "TEMPORAL_HIJRI")
        .when(F.col("date") > 0.45, "TEMPORAL")
        .when((F.col("uuid") > 0.45) | (F.col("ip") > 0.45) | F.col("regional_id").isNotNull(), "PRIMARY_IDENTIFIER")
        .when((F.col("length") > 30) & (F.col("blanks") > 0.5), "FREE_TEXT_NARRATIVE")
        .when((F.col("composite") > 0.40) & (F.col("currency") <= 0.20), "COMPOSITE_KEY")
        .when((F.col("cardinality") > 0.95) & (F.col("n") >= 5) & (F.col("numeric") <= 0.8), "PRIMARY_IDENTIFIER")
        .when((F.col("numeric") > 0.8) & (F.col("cardinality") > 0.25), "CONTINUOUS_NUMERIC")
        .when(F.col("numeric") > 0.8, "DISCRETE_NUMERIC")
        .otherwise("CATEGORICAL_DIMENSION")
    )
    return rows.withColumn("regional_id", regional).withColumn("role", role)


def contaminated(profiles: DataFrame) -> DataFrame:
    """From morphology: columns that are mostly numbers, and composite ones."""
    return profiles.select("column", F.col("numeric").between(0.650001, 0.989999).alias("contaminated"), ((F.col("composite") > 0.40) & (F.col("currency") <= 0.20)).alias("composite"))


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, skew (adjusted), skewed, q1, q3, outliers beyond 1.5 times the range between quartiles; n of 8 or
    more."""
    names = list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in names]))
    cells = df.select(cells.alias("x")).select("x.*")
    quarts = quantiles(cells, (0.25, 0.75), ["column"])
    ranges = quarts.select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    far = 1.5 * (F.col("q3") - F.col("q1"))
    beyond = F.count_if((F.col("v") < F.col("q1") - far) | (F.col("v") > F.col("q3") + far))
    rows = cells.join(F.broadcast(ranges), "column").groupBy("column", "q1", "q3").agg(F.count("v").alias("n"), F.skewness("v").alias("g"), beyond.alias("outliers"))  # a row a column
    n = F.col("n").cast("double")
    adjusted = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    out = rows.where(F.col("n") >= 8).select("column", "n", adjusted.alias("skew"), "q1", "q3", "outliers")
    return out.withColumn("skewed", F.abs("skew") > 1.5)


def candidate_keys(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, distinct, is_key: no nulls, all values distinct, five rows or more."""
    columns = list(columns or df.columns)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"c{i}_filled"), F.avg(F.length(F.col(f"`{c}`").cast("string"))).alias(f"c{i}_length")]
    row = df.agg(*aggs)
    row = row.withColumns({f"c{i}_rows": F.col("rows") for i in range(len(columns))})
    out = tall(row, columns, ["rows", "filled", "length"]).join(distinct_counts(df, columns), "column")
    key = (F.col("rows") >= 5) & (F.col("filled") == F.col("rows")) & (F.col("distinct") == F.col("rows")) & (F.col("length") <= 60)
    return out.select("column", "distinct", key.alias("is_key"))


def composite_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, distinct, is_key for all pairs of columns; see :func:`keys.minimal_keys` for sets of any size without counts."""
    return pair_counts(df, columns)


def laws(df: DataFrame, columns: Sequence[str], tolerance: float = 0.02, share: float = 0.85) -> DataFrame:
    """law, a, b, c, factor, share, holds: b = factor * a for tax factors, a * b = c and a + b = c, over rows in which
    the columns are positive.  All pairs and triples are one aggregate, split where it would be too wide."""
    x = {c: number_of(F.col(f"`{c}`").cast("string")) if not is_numeric(dict(df.dtypes)[c]) else F.col(f"`{c}`").cast("double") for c in columns}
    tests = [("TAX", a, b, None, f) for a, b in permutations(columns, 2) for f in (1.15, 0.15, 1.05)]
    for a, b in combinations(columns, 2):
        tests += [(law, a, b, c, None) for c in columns if c not in (a, b) for law in ("PRODUCT", "SUM")]
    out = None
    for start in range(0, len(tests), 150):
        some = tests[start : start + 150]
        aggs = []
        for i, (law, a, b, c, f) in enumerate(some):
            made, goal = {"TAX": lambda: (x[a] * f, x[b]), "PRODUCT": lambda: (x[a] * x[b], x[c]), "SUM": lambda: (x[a] + x[b], x[c])}[law]()
            positive = (x[a] > 0) & (x[b] > 0) & ((x[c] > 0) if c else F.lit(True))
            aggs.append(F.avg(F.when(positive, (F.abs(made - goal) / (F.abs(goal) + 1e-9) < tolerance).cast("int"))).alias(f"t{i}"))
        cells = F.array(*[F.struct(F.lit(law).alias("law"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).cast("string").alias("c"), F.lit(f).cast("double").alias("factor"), F.coalesce(F.col(f"t{i}"), F.lit(0.0)).alias("share")) for i, (law, a, b, c, f) in enumerate(some)])
        part = df.agg(*aggs).select(F.explode(cells).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("holds", F.col("share") > share)


def spatial(df: DataFrame) -> DataFrame:
    """column, kind (PAIR, LATITUDE, LONGITUDE), share."""
    aggs, kinds = [], []
    for i, (c, t) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        if t == "string":
            kinds.append((c, "PAIR", 0.40))
            aggs.append(F.avg(v.rlike(r"^\s*\(?-?\d{1,2}(\.\d+)?\s*[,;]\s*-?\d{1,3}(\.\d+)?\)?\s*$").cast("int")).alias(f"k{len(kinds) - 1}"))
        for kind, name, most in (("LATITUDE", r"^lat|latitude", 90), ("LONGITUDE", r"^(lon|lng)|longitude", 180)):
            if re.search(name, c, re.I) and is_numeric(t):
                kinds.append((c, kind, 0.95))
                aggs.append(F.avg(v.between(-most, most).cast("int")).alias(f"k{len(kinds) - 1}"))
    if not kinds:
        return df.sparkSession.createDataFrame([], "column string, kind string, share double")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"k{i}").alias("share"), F.lit(least).alias("least")) for i, (c, k, least) in enumerate(kinds)])
    return df.agg(*aggs).select(F.explode(cells).alias("x")).select("x.*").where(F.col("share") > F.col("least")).drop("least")


def cadence(df: DataFrame, date: str, by: str | None = None) -> DataFrame:
    """series, n, median_seconds between consecutive times, share of steps equal to it, uniform (over 70 percent), for series of
    ten times or more.  ``by`` keeps series apart; null times and series don't count."""
    at = F.unix_micros(F.col(f"`{date}`").cast("timestamp"))
    counts = settled(spectrum.steps(df.where(F.col(f"`{date}`").isNotNull()).select((F.col(f"`{by}`") if by else F.lit(0)).alias("s"), at.alias("t"))))
    out = counts.join(spectrum.middle(counts), "s").groupBy("s", "median", "steps").agg(F.coalesce(F.sum(F.when(F.col("step") == F.col("median"), F.col("m"))), F.lit(0)).alias("same"))
    out = out.select(F.col("s").alias("series"), (F.col("steps") + 1).alias("n"), (F.col("median") / 1e6).alias("median_seconds"), (F.col("same") / F.col("steps")).alias("share"))
    return out.where(F.col("n") >= 10).withColumn("uniform", F.col("share") > 0.7)


def dominant_period(df: DataFrame, date: str, value: str, by: str | None = None, short: int = spectrum.SHORT) -> DataFrame:
    """series, n, period: the strongest cycle, in steps, of series of 32 values or more, null unless its peak stands out.  Equal
    times are ordered by value.  Series of more than ``short`` values are spread over all tasks."""
    series = F.col(f"`{by}`").cast("string") if by else F.lit("all")
    rows = df.where(F.col(f"`{date}`").isNotNull() & F.col(f"`{value}`").isNotNull()).select(series.alias("series"), F.unix_micros(F.col(f"`{date}`").cast("timestamp")).alias("t"), F.col(f"`{value}`").cast("double").alias("v"))
    return spectrum.dominant_period(rows.where(F.col("series").isNotNull()), short)


def process_states(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col(f"`{state}`").isNotNull()).groupBy(F.col(f"`{state}`").alias("state")).agg(F.count("*").alias("n"))


def process_columns(df: DataFrame, roles: dict[str, str] | None = None, entropies: dict[str, float] | None = None) -> tuple[str | None, str | None, str | None]:
    """(case, activity, timestamp): the first column each that fits.  A timestamp has such a type, or the role TEMPORAL; a case is
    found by its name, an activity by its name or as a category of entropy below 0.8.  ``roles`` and ``entropies`` come from
    :func:`morphology` and :func:`entropy`; without them names and types decide alone."""
    case = activity = at = None
    roles, entropies = roles or {}, entropies or {}
    for c, kind in df.dtypes:
        if at is None and (kind in ("date", "timestamp", "timestamp_ntz") or roles.get(c, "").startswith("TEMPORAL")):
            at = c
        elif case is None and re.search(P.CASE_NAME, c):
            case = c
        elif activity is None and (re.search(P.ACTIVITY_NAME, c) or any(w in c.lower() for w in P.ACTIVITY_WORDS) or (roles.get(c) in ("CATEGORICAL_DIMENSION", "COMPOSITE_KEY") and entropies.get(c, 1.0) < 0.8)):
            activity = c
    return case, activity, at


def process_model(df: DataFrame, roles: dict[str, str] | None = None, entropies: dict[str, float] | None = None) -> DataFrame:
    """case, activity, timestamp (names of columns), states, concurrent: how many states there are, and how many pairs of a case
    and a time have more than one row (null unless both were found).  No row without an activity."""
    case, activity, at = process_columns(df, roles, entropies)
    text = "case string, activity string, timestamp string, states long, concurrent long"
    if activity is None:
        return df.sparkSession.createDataFrame([], text)
    states = process_states(df, activity).agg(F.count("*").alias("states"))
    groups = concurrency(df, case, at).select(F.col("groups").alias("concurrent")) if case and at else df.sparkSession.range(1).select(F.lit(None).cast("long").alias("concurrent"))
    named = [F.lit(v).cast("string").alias(k) for k, v in (("case", case), ("activity", activity), ("timestamp", at))]
    return states.crossJoin(groups).select(*named, "states", "concurrent")  # one row each


def concurrency(df: DataFrame, case: str, at: str) -> DataFrame:
    """One row: groups of one case and time with more than one row, and how many rows they hold."""
    counts = df.groupBy(F.col(f"`{case}`"), F.col(f"`{at}`")).agg(F.count("*").alias("n")).where("n > 1")
    return counts.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def vectors(df: DataFrame) -> DataFrame:
    """column, kind: arrays of numbers, texts that hold vectors of eight numbers or more, and families of numbered
    columns."""
    found = [(c, "ARRAY") for c, t in df.dtypes if re.fullmatch(r"array<(float|double|int|bigint)>", t)]
    family: dict[str, list[str]] = {}
    for c, t in df.dtypes:
        if (m := re.fullmatch(r"(.*?(?:emb|vec|dim|feature|latent)\w*?)_?(\d+)", c, re.I)) and is_numeric(t):
            family.setdefault(m[1], []).append(c)
    found += [(stem, "COLUMNS") for stem, own in family.items() if len(own) >= 4]
    texts = [c for c, t in df.dtypes if t == "string"]
    if texts:
        row = df.agg(*[F.coalesce(F.avg(F.col(f"`{c}`").rlike(r"^\s*\[\s*(-?\d+(\.\d+)?([eE][-+]?\d+)?\s*,\s*){7,}").cast("int")), F.lit(0.0)).alias(f"t{i}") for i, c in enumerate(texts)]).first()
        found += [(c, "TEXT") for i, c in enumerate(texts) if row[f"t{i}"] > 0.5]
    return df.sparkSession.createDataFrame(found, "column string, kind string")


def embedding_profile(df: DataFrame, column: str) -> DataFrame:
    v = F.col(f"`{column}`")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.where(v.isNotNull()).groupBy(F.size(v).alias("dimensions")).agg(F.count("*").alias("n"), F.avg(norm).alias("mean_norm"))


def surrogates(df: DataFrame) -> DataFrame:
    """column, masked: whether a column holds tokens, masks or dummy numbers."""
    texts = [c for c, t in df.dtypes if t == "string"]
    row = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").rlike(SURROGATE)), F.lit(False)).alias(f"c{i}_masked") for i, c in enumerate(texts)])
    return tall(row, texts, ["masked"]).drop("position")


def behaviour(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, urgent: rows with words of urgency, English or Arabic."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").rlike(rf"(?iU)\b({'|'.join(P.URGENT)})\b")).alias(f"c{i}_urgent") for i, c in enumerate(columns)])
    return tall(row, list(columns), ["urgent"]).drop("position")


def boundaries(df: DataFrame, order: str, scan: int = 50) -> DataFrame:
    """One row about a grid: header row, rows of metadata before it, footer row, greatest density."""
    columns = [c for c in df.columns if c != order]
    line = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))
    density = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    words = sum((F.coalesce(~F.regexp_replace(strip(F.col(f"`{c}`").cast("string")), r"\.", "").rlike(r"^\d+$"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    rows = df.select(F.col(order).alias("at"), line.alias("line"), density.alias("d"), words.alias("w"))
    most = rows.agg(F.max("d").alias("most"), F.max("at").alias("end"))
    rows = rows.crossJoin(F.broadcast(most))  # one row
    meta = F.col("line").rlike(METADATA) | (F.col("d") < 0.4 * F.col("most"))
    header = ~F.col("line").rlike(METADATA) & (F.col("d") >= 0.7 * F.col("most")) & (F.col("w") > 0.5 * F.col("d"))
    out = rows.agg(F.min(F.when(header & (F.col("at") < scan), F.col("at"))).alias("h"), F.max(F.when(F.col("line").rlike(FOOTER) & (F.col("at") > F.col("end") - scan), F.col("at"))).alias("footer"), F.max("most").alias("density"))
    head = rows.where((F.col("at") < scan) & meta).crossJoin(F.broadcast(out.select("h"))).where(F.col("at") < F.coalesce("h", F.lit(scan))).agg(F.count("*").alias("metadata_rows"))
    return out.crossJoin(head).select(F.coalesce("h", F.lit(0)).alias("header"), "footer", "density", "metadata_rows")


def ragged_columns(df: DataFrame, order: str) -> DataFrame:
    """column, solo, mean_length, ragged: rows of which it is the only filled cell, and whether it holds text that wraps: such
    rows are more than 0.8 percent of all, and its values more than 8 characters long on average."""
    columns = [c for c in df.columns if c != order]
    cell = lambda c: F.col(f"`{c}`").cast("string")
    filled = sum((cell(c).isNotNull().cast("int") for c in columns), F.lit(0))
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count_if((F.col("_filled") == 1) & F.col(f"c{i}").isNotNull()).alias(f"c{i}_solo"), F.avg(F.length(f"c{i}")).alias(f"c{i}_mean_length")]
    row = df.select(filled.alias("_filled"), *[cell(c).alias(f"c{i}") for i, c in enumerate(columns)]).agg(*aggs)
    row = row.withColumns({f"c{i}_ragged": F.coalesce((F.col(f"c{i}_solo") > 0.008 * F.col("n")) & (F.col(f"c{i}_mean_length") > 8), F.lit(False)) for i in range(len(columns))})
    return tall(row, columns, ["solo", "mean_length", "ragged"]).drop("position")


def merge_beliefs(beliefs: DataFrame) -> DataFrame:
    """column, belief, confidence, log_doubt: noisy-or of all confidences of a belief, and the log of 1 less it, which
    still differs where the confidences are rounded to 1."""
    none = F.sum(F.ln(1 - F.least(F.col("confidence"), F.lit(0.999999))))
    return beliefs.groupBy("column", "belief").agg((1 - F.exp(none)).alias("confidence"), none.alias("log_doubt"))


def dominant(beliefs: DataFrame) -> DataFrame:
    """column, belief, confidence: the belief with the least doubt, by its log if the beliefs were merged."""
    sure = -F.col("log_doubt") if "log_doubt" in beliefs.columns else F.col("confidence")
    return beliefs.groupBy("column").agg(F.max_by("belief", F.struct(sure.alias("sure"), "belief")).alias("belief"), F.max("confidence").alias("confidence"))


def friction(anomalies: int, contaminations: int, ragged: int, header: int, footer: bool) -> int:
    return anomalies + contaminations + ragged + 2 * (header > 5) + int(footer)


def statutory(columns: Sequence[str], profiles: DataFrame) -> DataFrame:
    """column, rule from names, regional ids and cardinalities of morphology; a warning where three categorical
    columns together may single people out."""
    warned = profiles.agg(F.count_if((F.col("role") == "CATEGORICAL_DIMENSION") & F.col("cardinality").between(0.05, 0.5)).alias("k"))
    name = F.lower("column")
    rule = F.when(F.col("regional_id").isNotNull(), F.concat(F.lit("REGIONAL_ID:"), "regional_id")).when(name.rlike("ssn|mrn|patient|diagnos"), "HEALTH").when(name.rlike("iban|account|card|tax|vat"), "FINANCIAL").when(name.rlike("email|phone|address|name"), "PERSONAL")
    return profiles.crossJoin(F.broadcast(warned)).select("column", rule.alias("rule"), (F.col("k") >= 3).alias("quasi_identifier_warning"))


FEATURE_OF_ROLE = {
    "TEMPORAL": "weekday, month, weekend and lag features",
    "TEMPORAL_HIJRI": "convert to the Gregorian calendar, then calendar features",
    "CONTINUOUS_NUMERIC": "z-score and, if skewed, logarithm",
    "DISCRETE_NUMERIC": "bins or one-hot",
    "CATEGORICAL_DIMENSION": "frequency encoding",
    "FREE_TEXT_NARRATIVE": "length and word counts",
    "COMPOSITE_KEY": "split into its parts",
    "PRIMARY_IDENTIFIER": "keep out of models; use as a join key",
}

def architecture(columns: Sequence[str], ragged: bool = False) -> str:
    """RAGGED_LEDGER; HEALTH if a clinical word is in a name; else the first family of which one word is a name, a part of one
    beside an underscore, or in one if it has four letters or more; else CLEAN_TABULAR."""
    if ragged:
        return "RAGGED_LEDGER"
    names = [c.lower() for c in columns]
    if any(w in c for w in P.CLINICAL_WORDS for c in names):
        return "HEALTH"
    fits = lambda w, c: w == c or f"_{w}" in c or f"{w}_" in c or (len(w) >= 4 and w in c)
    return next((family for family, words in P.FAMILY_WORDS if any(fits(w, c) for w in words for c in names)), "CLEAN_TABULAR")


def entity_tags(df: DataFrame) -> DataFrame:
    """column, tag (PK, FK, PII, TIME, MEAS, DIM) and level (HEADER or DETAIL) by name and distinct counts."""
    from . import policy

    keys = candidate_keys(df)
    pii = [c for c in df.columns if policy.tier_of(c, policy.resolve()) == policy.ENCRYPT]
    kinds = dict(df.dtypes)
    measures = [c for c in df.columns if is_numeric(kinds[c]) and not policy.is_key(c)]
    times = [c for c in df.columns if kinds[c] in ("date", "timestamp", "timestamp_ntz") or re.search("date|time", c, re.I)]
    foreign = [c for c in df.columns if policy.is_key(c)]
    c = F.col("column")
    tag = F.when(F.col("is_key") & c.isin(foreign), "PK").when(c.isin(foreign), "FK").when(c.isin(times), "TIME").when(c.isin(pii), "PII").when(c.isin(measures), "MEAS").otherwise("DIM")
    detail = F.lower("column").rlike("line|item|qty|quantity|price|discount|sku")
    return keys.select("column", tag.alias("tag"), F.when(detail, "DETAIL").otherwise("HEADER").alias("level"))


