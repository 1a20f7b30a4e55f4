"""Privacy metrics: what a protected table still gives away, test by test, and the scorecard over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import luhn_valid
from . import policy, risk
from .neighbours import closest
from .risk import as_text
from .running import running_total

#: Weights of the tests in their tier's score.
TIER_1 = {"canary": 25, "pii_scan": 25, "singling_out": 25, "l_diversity": 25}
TIER_2 = {"t_closeness": 15, "linkability": 15, "nndr": 15, "membership": 15, "nmi": 10, "firewall": 15, "reconciliation": 15}
METRIC = "test string, value double, target double, passed boolean, note string"
CANARIES = ("CANARY_ALPHA_9901", "canary.leak@probe.invalid", "+1 (555) 019-9901", "4111 1111 1111 1111", "CANARY-ZZ-77")


def metric(df: DataFrame, test: str, value: Column, target: Column, passed: Column, note: str = "") -> DataFrame:
    return df.select(F.lit(test).alias("test"), value.cast("double").alias("value"), target.cast("double").alias("target"), passed.alias("passed"), F.lit(note).alias("note"))


def fixed(spark, test: str, value: float, target: float, note: str) -> DataFrame:
    """The passing result of an input that is too small for a test."""
    return spark.createDataFrame([(test, value, target, True, note)], METRIC)


# Tier 1


def pii_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """kind, n: personal data in the text of all rows.  Surrogates, masks and reserved example numbers and domains
    don't count."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    text = F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns])

    def found(pattern: str, fair) -> Column:
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fair)).cast("long")

    digits = lambda x: F.regexp_replace(x, r"\D", "")
    dull = lambda x: digits(x).rlike("^(9+|0+)$") | x.contains("XX")
    kinds = {
        "email": found(P.UNIVERSAL["EMAIL"], lambda x: ~F.lower(x).rlike(r"(example\.(com|org|net)|mock|test|dummy|\.invalid)")),
        "phone": found(r"(?<![\d<])(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?![\d>])", lambda x: ~dull(x) & ~x.contains("555-01")),
        "card": found(r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{3,4}(?!\d)", lambda x: ~dull(x) & luhn_valid(x)),
        "iban": found(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", lambda x: ~dull(x)),
        "ssn": found(r"(?<![\d<-])\d{3}-\d{2}-\d{4}(?![\d>-])", lambda x: ~dull(x)),
    }
    sums = df.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in kinds.items()])
    return sums.unpivot([], list(kinds), "kind", "n")


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    total = pii_counts(df, columns).agg(F.sum("n").alias("n"))
    return metric(total, "pii_scan", F.col("n"), F.lit(0), F.col("n") == 0)


def singling_out(df: DataFrame, qis: Sequence[str], target_k: int | None = None) -> DataFrame:
    """Share of rows that are alone in their class, in percent; passes if there is none and the least k suffices."""
    s = risk.summary(df, qis, threshold=2)
    n = F.col("records")
    target = F.lit(target_k) if target_k else F.when(n >= 20, 5).otherwise(F.greatest(F.lit(2), F.least(F.lit(5), F.floor(n / 2))))
    value = F.when(n > 0, F.col("at_risk") * 100.0 / n).otherwise(0.0)
    return metric(s, "singling_out", value, F.lit(0), (F.col("at_risk") == 0) & (F.col("min_k") >= target))


def l_diversity(df: DataFrame, qis: Sequence[str], sensitive: str | None) -> DataFrame:
    if not sensitive:
        return fixed(df.sparkSession, "l_diversity", 2, 2, "no sensitive column")
    return metric(risk.l_diversity(df, qis, sensitive), "l_diversity", F.coalesce("min_l", F.lit(2)), F.lit(2), F.coalesce(F.col("min_l") >= 2, F.lit(True)))


def canary(df: DataFrame, order: str, canaries: Sequence[str] = CANARIES) -> DataFrame:
    """Canaries are put into text cells, the table is tokenised and masked, and what can still be found is counted, in
    percent of those put in.  ``order`` numbers the rows from 0."""
    from ..functions.scalars import structural_mask
    from .vault import Vault

    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return fixed(df.sparkSession, "canary", 0, 0, "no text column")
    n = df.count()
    put, placed = df, []
    for i, word in enumerate(canaries[: max(1, min(len(canaries), n))]):
        c = texts[i % len(texts)]
        put = put.withColumn(c, F.when(F.col(order) == (7 * i) % max(1, n), F.lit(word)).otherwise(F.col(f"`{c}`")))
        placed.append(word)
    vault = Vault.build([put])
    safe = vault.tokenise(put).select(*[structural_mask(F.col(f"`{c}`")).alias(c) for c in texts])
    cell = F.concat_ws("\u0001", *[F.col(f"`{c}`") for c in texts])
    left = safe.agg(*[F.coalesce(F.max(cell.contains(w).cast("int")), F.lit(0)).alias(f"w{i}") for i, w in enumerate(placed)])
    value = sum((F.col(f"w{i}") for i in range(len(placed))), F.lit(0)) * 100.0 / len(placed)
    return metric(left, "canary", value, F.lit(0), value == 0)


# Tier 2


def t_closeness_numeric(df: DataFrame, qis: Sequence[str], sensitive: str, points: int = 50) -> DataFrame:
    """Quasi-identifiers and distance: for each class of two values or more, the mean distance of its distribution
    function from the table's, at evenly spaced points.  One aggregate holds a counter for each point, so rows are
    not multiplied."""
    v = F.col(f"`{sensitive}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*[as_text(c).alias(c) for c in qis], v.alias("_v"))
    span = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rows = rows.crossJoin(F.broadcast(span))  # one row
    at = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(i / (points - 1)) for i in range(points)]
    below = [F.sum((F.col("_v") < x).cast("long")).alias(f"b{i}") for i, x in enumerate(at)]
    groups = rows.groupBy(*qis).agg(F.count("*").alias("_n"), *below)
    whole = groups.agg(F.sum("_n").alias("_all"), *[F.sum(f"b{i}").alias(f"all{i}") for i in range(points)])
    far = sum((F.abs(F.col(f"b{i}") / F.col("_n") - F.col(f"all{i}") / F.col("_all")) for i in range(points)), F.lit(0.0)) / points
    return groups.where(F.col("_n") >= 2).crossJoin(F.broadcast(whole)).select(*qis, F.col("_n").alias("n"), far.alias("distance"))


def t_closeness_categorical(df: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    """Quasi-identifiers and distance: half the sum of differences between a class's shares and the table's."""
    counts = df.groupBy(*[as_text(c).alias(c) for c in qis], as_text(sensitive).alias("_s")).agg(F.count("*").alias("_m"))
    whole = counts.groupBy("_s").agg(F.sum("_m").alias("_every"))
    total = whole.agg(F.sum("_every").alias("_total"))
    groups = counts.groupBy(*qis).agg(F.sum("_m").alias("_n"))
    shares = counts.join(groups, list(qis)).join(whole, "_s").crossJoin(F.broadcast(total))
    p, q = F.col("_m") / F.col("_n"), F.col("_every") / F.col("_total")
    # values that a class doesn't have differ by their share in the table: 1 less the shares of those it has
    far = 0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))
    return shares.where(F.col("_n") >= 2).groupBy(*qis).agg(F.first("_n").alias("n"), far.alias("distance"))


def t_closeness(df: DataFrame, qis: Sequence[str], sensitive: str | None, limit: float = 0.15) -> DataFrame:
    if not sensitive:
        return fixed(df.sparkSession, "t_closeness", 0.05, limit, "no sensitive column")
    numeric = dict(df.dtypes)[sensitive] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")
    groups = (t_closeness_numeric if numeric else t_closeness_categorical)(df, qis, sensitive)
    top = groups.agg(F.round(F.coalesce(F.max("distance"), F.lit(0.0)), 3).alias("t"))
    return metric(top, "t_closeness", F.col("t"), F.lit(limit), F.col("t") <= limit)


def nmi(df: DataFrame, qi: str, sensitive: str) -> DataFrame:
    """qi, nmi: normalised mutual information, 2 I / (H + H), in bits."""
    joint = df.groupBy(as_text(qi).alias("q"), as_text(sensitive).alias("s")).agg(F.count("*").alias("m"))

    def entropy(counts: DataFrame, name: str) -> DataFrame:
        sums = counts.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.log2(F.col("m").cast("double"))).alias("x"))
        return sums.select((F.log2(F.col("n").cast("double")) - F.col("x") / F.col("n")).alias(name))

    q = entropy(joint.groupBy("q").agg(F.sum("m").alias("m")), "hq")
    s = entropy(joint.groupBy("s").agg(F.sum("m").alias("m")), "hs")
    both = entropy(joint, "hqs").crossJoin(q).crossJoin(s)  # one row each
    value = F.when(F.col("hq") + F.col("hs") > 0, 2 * (F.col("hq") + F.col("hs") - F.col("hqs")) / (F.col("hq") + F.col("hs"))).otherwise(0.0)
    return both.select(F.lit(qi).alias("qi"), F.greatest(F.lit(0.0), value).alias("nmi"))


def nmi_test(df: DataFrame, qis: Sequence[str], sensitive: str | None, limit: float = 0.05) -> DataFrame:
    if not sensitive or not qis:
        return fixed(df.sparkSession, "nmi", 0.0, limit, "no sensitive column or quasi-identifier")
    each = [nmi(df, q, sensitive) for q in qis]
    union = each[0]
    for x in each[1:]:
        union = union.unionByName(x)
    top = union.agg(F.max("nmi").alias("v"))
    return metric(top, "nmi", F.col("v"), F.lit(limit), F.col("v") < limit)


def widths(real: DataFrame, numeric: Sequence[str]) -> list[float]:
    """The range of each number in the real table; 1 if it has none."""
    if not numeric:
        return []
    row = real.agg(*[(F.max(F.col(f"`{c}`").cast("double")) - F.min(F.col(f"`{c}`").cast("double"))).alias(f"w{i}") for i, c in enumerate(numeric)]).first()
    return [float(w or 1.0) for w in row]


def numbered(mock: DataFrame) -> DataFrame:
    return mock if "mock_id" in mock.columns else mock.withColumn("mock_id", F.monotonically_increasing_id())


def zero(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))


def gower(real: DataFrame, mock: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: int = 500) -> DataFrame:
    """mock_id, distance of each mock row to each real one.  Mocks of ``most`` rows at the most are broadcast, which is
    checked; larger ones are joined partition by partition.  Numbers differ by their share of the real range (null as
    0), texts by 0 or 1."""
    spans = widths(real, numeric)
    small = mock.limit(most + 1).count() <= most
    mock = numbered(mock).select("mock_id", *[F.col(f"`{c}`").alias(f"m_{c}") for c in [*numeric, *categorical]])
    pairs = real.crossJoin(F.broadcast(mock) if small else mock)
    terms = [F.abs(zero(c) - zero(f"m_{c}")) / w for c, w in zip(numeric, spans)]
    terms += [(as_text(c) != as_text(f"m_{c}")).cast("double") for c in categorical]
    return pairs.withColumn("distance", sum(terms, F.lit(0.0)) / max(1, len(terms)))


def nearest(real: DataFrame, mock: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """mock_id, d1, d2: distances to the two nearest real rows; d1 twice if there is one only."""
    out = closest(numbered(mock), "mock_id", real, numeric, categorical, widths(real, numeric))
    return out.select("mock_id", "d1", F.coalesce("d2", "d1").alias("d2"))


def nndr(real: DataFrame, mock: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Mean ratio of the nearest to the second nearest real row; 1 if both are 0."""
    near = nearest(real, mock, numeric, categorical)
    row = near.agg(F.avg(F.when(F.col("d2") > 0, F.col("d1") / F.col("d2")).otherwise(1.0)).alias("r"), F.min("d1").alias("d"))
    return metric(row, "nndr", F.round("r", 6), F.lit(0.25), (F.col("r") >= 0.25) & (F.col("d") > 1e-5))


def auc(scores: DataFrame, score: str, member: str) -> DataFrame:
    """auc by rank sums: ties count half.  Ranks come from counts per distinct score, not from pairs."""
    counts = scores.groupBy(F.col(score).alias("x")).agg(F.sum(F.col(member).cast("long")).alias("m"), F.sum((~F.col(member)).cast("long")).alias("o"))
    run = running_total(counts, [F.col("x")], F.col("o"), "upto").withColumn("before", F.col("upto") - F.col("o"))
    row = run.agg(F.sum(F.col("m") * (F.col("before") + F.col("o") / 2)).alias("u"), F.sum("m").alias("m"), F.sum("o").alias("o"))
    return row.select(F.when((F.col("m") > 0) & (F.col("o") > 0), F.col("u") / (F.col("m") * F.col("o"))).otherwise(0.5).alias("auc"))


def half(key: Column, seed: int) -> Column:
    """A fair, repeatable split of rows by their key: whether a digest of seed and key is even."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 32, 1).isin(*"02468ace")


def membership(real: DataFrame, mock: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], seeds: Sequence[int] = (42, 43, 44)) -> DataFrame:
    """Attack by distance to the closest mock row: folded AUC between two halves of the table, mean over seeds."""
    far = closest(real, key, mock, numeric, categorical, widths(real, numeric)).select(F.col(f"`{key}`").alias("k"), F.col("d1").alias("d"))
    union = None
    for seed in seeds:
        one = auc(far.withColumn("member", half(F.col("k"), seed)), "d", "member")
        union = one if union is None else union.unionByName(one)
    n = real.agg(F.count("*").alias("n"))
    row = union.agg(F.avg(0.5 + F.abs(F.col("auc") - 0.5)).alias("v")).crossJoin(n)
    target = F.when(F.col("n") >= 200, 0.55).when(F.col("n") >= 100, 0.60).when(F.col("n") >= 50, 0.65).otherwise(0.75)
    return metric(row, "membership", F.round("v", 6), target, F.col("v") <= target)


def linkability(real: DataFrame, mock: DataFrame, key: str, aux: Sequence[str], seed: int = 42) -> DataFrame:
    """How much more often mock rows match one half of the table than the other in all auxiliary columns that
    they have."""
    mock = mock.groupBy(*[F.col(f"`{c}`").cast("string").alias(f"m{i}") for i, c in enumerate(aux)]).agg(F.count("*").alias("w"))
    filled = F.array(*[F.col(f"m{i}").isNotNull() for i in range(len(aux))])
    shapes = [r.s for r in mock.select(filled.alias("s")).distinct().collect()]  # 2^columns at most
    total = mock.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))

    def rate(part: DataFrame, name: str) -> DataFrame:
        """Mock rows by the columns that they have: each kind meets the distinct values of these columns."""
        hits = None
        for shape in shapes:
            own = mock.where(filled == F.array(*[F.lit(x) for x in shape])).select("w", *[f"m{i}" for i, x in enumerate(shape) if x])
            some = part.select(*[F.col(f"`{c}`").cast("string").alias(f"m{i}") for i, (c, x) in enumerate(zip(aux, shape)) if x])
            met = own.join(some.distinct(), [f"m{i}" for i, x in enumerate(shape) if x], "left_semi") if any(shape) else own.crossJoin(some.limit(1).select())
            met = met.select("w")
            hits = met if hits is None else hits.unionByName(met)
        hits = hits.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("h")) if hits is not None else total.select(F.lit(0).alias("h"))
        return hits.crossJoin(total).select((F.col("h") / F.greatest(F.col("n"), F.lit(1))).alias(name))

    member = half(F.col(f"`{key}`"), seed)
    row = rate(real.where(member), "a").crossJoin(rate(real.where(~member), "b"))
    value = F.round(F.greatest(F.lit(0.0), F.col("a") - F.col("b")), 3)
    return metric(row, "linkability", value, F.lit(0.05), value < 0.05)


def reconciliation(df: DataFrame, key: str) -> DataFrame:
    """Cells that come back from tokenising and restoring, in percent; trailing zeros and blanks don't matter."""
    from .vault import Vault

    vault = Vault.build([df])
    back = vault.restore(vault.tokenise(df, keep=(key,)))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    columns = [c for c in df.columns if c != key]
    both = df.select(F.col(f"`{key}`"), *[plain(F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(columns)]).join(
        back.select(F.col(f"`{key}`"), *[plain(F.col(f"`{c}`")).alias(f"b{i}") for i, c in enumerate(columns)]), key
    )
    same = sum((F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")).cast("long") for i in range(len(columns))), F.lit(0))
    row = both.agg(F.sum(same).alias("s"), F.count("*").alias("n"))
    value = F.when(F.col("n") > 0, F.col("s") * 100.0 / (F.col("n") * len(columns))).otherwise(100.0)
    return metric(row, "reconciliation", value, F.lit(100), value == 100.0)


def firewall(spark, snippets: DataFrame | None = None, column: str = "code") -> DataFrame:
    """Hostile snippets that the code audit turns away, in percent: those of a table, or six known ones.  Null and empty code isn't
    hostile; a table without code passes."""
    from ..plans.sandbox import HOSTILE, audit_table

    rows = spark.createDataFrame([(x,) for x in HOSTILE], "code string") if snippets is None else snippets.select(F.col(f"`{column}`").alias("code"))
    row = audit_table(rows.where(F.trim("code") != ""), "code").agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("caught"))
    value = F.when(F.col("n") > 0, F.col("caught") * 100.0 / F.col("n")).otherwise(100.0)
    return metric(row, "firewall", F.round(value, 6), F.lit(100.0), value == 100.0)


def suite(df: DataFrame, mock: DataFrame, key: str, qis: Sequence[str], sensitive: str | None, numeric: Sequence[str], categorical: Sequence[str], auxiliary: int | None = None) -> DataFrame:
    """test, value, target, passed, note, tier, weight: all eleven tests over a table whose integer ``key`` numbers its
    rows from 0.  An attacker of the linkability test knows the first ``auxiliary`` quasi-identifiers, all without one."""
    spark = df.sparkSession
    tests = [canary(df, key), pii_scan(df), singling_out(df, qis), l_diversity(df, qis, sensitive), t_closeness(df, qis, sensitive), linkability(df, mock, key, [*qis][:auxiliary]), nndr(df, mock, numeric, categorical), membership(df, mock, key, numeric, categorical), nmi_test(df, qis, sensitive), firewall(spark), reconciliation(df, key)]
    out = tests[0]
    for t in tests[1:]:
        out = out.unionByName(t)
    weights = spark.createDataFrame([(k, 1, w) for k, w in TIER_1.items()] + [(k, 2, w) for k, w in TIER_2.items()], "test string, tier int, weight int")
    return out.join(F.broadcast(weights), "test")


def scores(results: DataFrame) -> DataFrame:
    """tier_1, tier_2, composite (their mean) and egress_allowed (tier 1 passes) from a suite's rows."""
    earned = F.when(F.col("passed"), F.col("weight")).otherwise(0)
    row = results.agg(*[F.coalesce(F.sum(F.when(F.col("tier") == t, earned)), F.lit(0)).alias(f"tier_{t}") for t in (1, 2)], F.min(F.when(F.col("tier") == 1, F.col("passed"))).alias("egress_allowed"))
    return row.withColumn("composite", (F.col("tier_1") + F.col("tier_2")) / 2)


def remedy(df: DataFrame, sensitive: str | None = None, k: int = 5, limit: float = 0.05) -> DataFrame:
    """Generalise every column of low cardinality that is no key or metric; where one still tells the sensitive
    column, it is blanked."""
    usable = [c for c in df.columns if c != sensitive and not policy.is_key(c) and not policy.is_metric(c)]
    counts = df.agg(F.count("*").alias("n"), *[F.countDistinct(as_text(c)).alias(f"c{i}") for i, c in enumerate(usable)]).first()
    most = min(500, max(2, counts["n"] // 2))
    qis = [c for i, c in enumerate(usable) if 2 <= counts[f"c{i}"] <= most]
    if not qis:
        return df
    out = risk.generalise(df, qis, k)
    if sensitive:
        told = {q for q in qis if nmi(out, q, sensitive).first()["nmi"] >= limit}
        out = out.withColumns({q: F.lit("<GENERALIZED>") for q in told})
    return out
