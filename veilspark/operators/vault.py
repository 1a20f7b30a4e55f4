"""The token vault: identifiers become <TAG_n>, and back.

The vault is a DataFrame (raw, tag, seq, token) over distinct values; tables are tokenised by joining it.  Values
are numbered within a tag in the order of the values, which doesn't depend on row order or partitions; with an
``order`` column, in first-seen order.  Numbers come from counts per range of values and ranks within a range, so
no tag's values meet in one task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from ..functions import patterns as P
from ..functions.scalars import has_digits, luhn_valid, strip
from . import policy as rules
from .running import settled

TOKEN = r"<[A-Z_]+_\d+>"
#: A vault of at most so many values, none longer than so many characters, is numbered by the driver and broadcast.
SMALL_VALUES, SMALL_CHARS = 20_000, 1_000
#: Values that text is searched for by a map in the plan, at most; beyond that by an Arrow-batched function.
MAP_VALUES = 1_000


def _digits(parts: list[str]) -> str:
    """One digit more or less will do."""
    return rf"\d{{{max(1, len(parts[0]) - 1)},{len(parts[0]) + 1}}}"


def _code(parts: list[str]) -> str:
    head = rf"[A-Za-z]{{{len(parts[0])}}}" + re.escape(parts[1]) if parts[0].isalpha() else rf"\d{{{len(parts[0])}}}{parts[1]}"
    return head + rf"\d{{{len(parts[2])}}}"


#: By the shape of an example, runs of digits as 9 and of letters as a: the pattern of its kind, and the tag if a word in the field's name is
#: telling.  Other shapes are taken letter by letter.
SHAPES = {"9": (_digits, ("SEQ", "NUM", "ID"), "SEQ"), "9-9": (_code, ("GL",), "GL_CODE"), "a-9": (_code, (), ""), "a/9": (_code, (), ""), "a_9": (_code, (), "")}
LETTERS = ((str.isupper, "[A-Z]"), (str.islower, "[a-z]"), (str.isdigit, r"\d"), (str.isspace, r"\s"))


def infer_pattern(example: str, field: str = "") -> tuple[str, str]:
    """(pattern, tag) of values that look like the example."""
    text, name = example.strip(), re.sub(r"[^A-Za-z0-9]", "_", field).strip("_").upper()[:12] or "CUSTOM"
    if not text:
        return r"\S+", name
    runs = [(kind, "".join(run)) for kind, run in groupby(text, lambda c: "9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c)]
    build, telling, tag = SHAPES.get("".join(kind for kind, _ in runs), (None, (), ""))
    if build is None:
        return rf"\b{''.join(next((p for test, p in LETTERS if test(c)), re.escape(c)) for c in text)}\b", name
    return rf"\b{build([run for _, run in runs])}\b", tag if any(w in name for w in telling) else name


def text_columns(df: DataFrame, policy: rules.Policy) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and rules.tier_of(c, policy) != rules.ENCRYPT]


def secret_columns(df: DataFrame, policy: rules.Policy) -> list[str]:
    return [c for c in df.columns if rules.tier_of(c, policy) == rules.ENCRYPT]


#: What every match of a universal pattern has: so many digits, and a character.
HINTS = {"EMAIL": (0, "@"), "PHONE": (10, ""), "IBAN": (2, ""), "CREDIT_CARD": (16, ""), "IP_ADDRESS": (4, ".")}


def matches(text: Column, name: str, pattern: str) -> Column:
    """All matches of a pattern; card numbers only with a right Luhn sum.  Texts without what a universal pattern needs
    aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.filter(found, luhn_valid) if name == "CREDIT_CARD" else found
    if P.UNIVERSAL.get(name) != pattern:
        return found
    digits, mark = HINTS[name]
    hint = text.isNull() | text.contains(mark)
    return F.when(hint & has_digits(text, digits) if digits else hint, found).otherwise(F.array().cast("array<string>"))


class Vault:
    """Tokens of the values of some tables, under one policy.  ``table`` has a row per distinct value (raw, tag, seq,
    token); it is made at its first use.  A small vault, by a check of its size, is broadcast; a large one is joined by
    shuffles."""

    def __init__(self, values: DataFrame | None, policy: rules.Policy, taught: dict[str, tuple[str, str]], ordered: bool = False, spark=None):
        self.values, self.policy, self.taught, self.ordered = values, policy, taught, ordered
        self.spark = spark or values.sparkSession

    @functools.cached_property
    def small(self) -> list[tuple] | None:
        """The rows of a small vault, else None."""
        if self.values is None:
            self.findable = set()
            return []
        fits = F.lit(False)
        for pattern in (*self.policy.patterns.values(), *(p for p, _ in self.taught.values())):
            fits = fits | F.col("raw").rlike(pattern)
        found = self.values.select(F.substring("raw", 1, SMALL_CHARS + 1).alias("raw"), "tag", "first", fits.alias("fits")).limit(SMALL_VALUES + 1).collect()
        if len(found) > SMALL_VALUES or any(len(r.raw) > SMALL_CHARS for r in found):
            return None
        numbers: dict[str, int] = {}
        rows = []
        for r in sorted(found, key=lambda r: (tuple(r.first) if self.ordered else (), r.raw.encode())):
            seq = numbers[r.tag] = numbers.get(r.tag, 0) + 1
            rows.append((r.raw, r.tag, seq, f"<{r.tag}_{seq}>"))
        # what a pattern can find in other text
        self.findable = {r.raw for r in found if r.fits}
        return rows

    @functools.cached_property
    def table(self) -> DataFrame:
        if self.small is not None:
            return self.spark.createDataFrame(self.small, "raw string, tag string, seq long, token string").coalesce(1)
        keys = [F.col("first"), F.col("raw")] if self.ordered else [F.col("raw")]
        # kept in memory for the session, as every table and column meets it; lost parts are made again
        return numbered(self.values, "tag", keys).cache()

    def look(self, raw: str, token: str) -> DataFrame:
        """The table under these names, broadcast if small."""
        table = self.table.select(F.col("raw").alias(raw), F.col("token").alias(token))
        return table if self.small is None else F.broadcast(table)

    @classmethod
    def build(cls, tables: Sequence[DataFrame], policy: rules.Policy | None = None, *, taught: dict[str, tuple[str, str]] | None = None, order: str | None = None) -> "Vault":
        """Values of secret columns, and matches of the policy's and taught patterns in other text.  The first
        column, then pattern, that has a value gives it its tag; all rows are looked at."""
        policy, taught = policy or rules.resolve(), taught or {}
        found = None
        for t, df in enumerate(tables):
            place = F.col(f"`{order}`").cast("long") if order else F.lit(0).cast("long")
            parts = [(strip(F.col(f"`{c}`").cast("string")), rules.tag_of(c)) for c in secret_columns(df, policy)]
            pieces = [F.array(F.struct(v.alias("raw"), F.lit(tag).alias("tag"), F.lit(i).alias("rank"))) for i, (v, tag) in enumerate(parts)]
            for i, (_, text, name, pattern, tag) in enumerate(cls._patterns(df, policy, taught)):
                found_here = F.coalesce(matches(text, name, pattern), F.array().cast("array<string>"))
                pieces.append(F.transform(found_here, _hit(tag, 1000 + i)))
            if not pieces:
                continue
            rows = df.select(place.alias("at"), F.explode(F.concat(*pieces)).alias("x")).select(F.lit(t).alias("table"), "at", "x.*").where(F.col("raw") != "")
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return cls(None, policy, taught, spark=tables[0].sparkSession)
        first = F.struct("table", "rank", "at")
        values = found.groupBy("raw").agg(F.min_by("tag", first).alias("tag"), F.min(F.struct("table", "at", "rank")).alias("first"))
        return cls(values, policy, taught, bool(order))

    def flush(self) -> None:
        """Forget the tokens' table; a later use makes it again."""
        if "table" in self.__dict__ and self.small is None:
            self.table.unpersist()
        for name in ("table", "small"):
            self.__dict__.pop(name, None)

    @staticmethod
    def _patterns(df: DataFrame, policy: rules.Policy, taught: dict[str, tuple[str, str]]):
        """(column, text to search, name, pattern, tag).  The policy's patterns look at the whole text; each taught
        one at what those taught before it have left."""
        for c in text_columns(df, policy):
            text = F.col(f"`{c}`")
            for name, pattern in policy.patterns.items():
                yield c, text, name, pattern, name.split("_")[0]
            for field, (pattern, tag) in taught.items():
                if field == c or field not in df.columns:
                    yield c, text, field, pattern, tag
                    text = F.regexp_replace(text, pattern, "\u0001")

    def stats(self) -> DataFrame:
        return self.table.groupBy("tag").agg(F.count("*").alias("n"))

    def tokenise(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """df with tokens: whole cells of secret columns, matches within other text.  Other columns, and ``keep``, stay.

        Whole cells are joined with the vault.  Matches within text are replaced row by row under a small vault; under
        a large one distinct texts with a match meet it exploded, and their new forms are joined back."""
        out, prefix = df, free_prefix(df)
        for c in secret_columns(df, self.policy):
            if c in keep:
                continue
            raw, token = prefix + "raw", prefix + "token"
            value = F.col(f"`{c}`").cast("string")
            out = out.join(self.look(raw, token), strip(value) == F.col(raw), "left").withColumn(c, F.coalesce(token, value)).drop(raw, token)
        patterns: dict[str, list[Column]] = {}
        for c, text, name, pattern, _ in self._patterns(df, self.policy, self.taught):
            patterns.setdefault(c, []).append(matches(text, name, pattern))
        found = {c: F.array_distinct(F.concat(*own)) for c, own in patterns.items() if c not in keep}
        return self._replaced(out, found, False).select(*[F.col(f"`{c}`") for c in df.columns])

    def restore(self, df: DataFrame) -> DataFrame:
        """df with the vault's tokens turned back, whole cells and within text."""
        found = {c: F.array_distinct(F.regexp_extract_all(F.col(f"`{c}`"), F.lit(TOKEN), F.lit(0))) for c, t in df.dtypes if t == "string"}
        return self._replaced(df, found, True).select(*[F.col(f"`{c}`") for c in df.columns])

    def _replaced(self, df: DataFrame, found: dict[str, Column], back: bool) -> DataFrame:
        """df with the strings found in these columns replaced as the vault says."""
        if not found:
            return df
        if self.small is None:
            table = self.table.select(*[F.col(x).alias(y) for x, y in zip(("token", "raw") if back else ("raw", "token"), ("raw", "to"))])
            for c, own in found.items():
                df = replaced(df, c, own, table)
            return df
        known = {r[3]: r[0] for r in self.small} if back else {r[0]: r[3] for r in self.small if r[0] in self.findable}
        if not known:
            return df
        # what is found gets columns of its own, so that patterns run once
        prefix = free_prefix(df)
        held = {c: f"{prefix}{i}" for i, c in enumerate(found)}
        df = df.withColumns({held[c]: own for c, own in found.items()})
        exchanged = by_map(known) if len(known) <= MAP_VALUES else self._by_batches(known)
        for c, name in held.items():
            df = df.withColumn(c, exchanged(F.col(f"`{c}`"), F.col(name), F.size(name) > 0))
        return df.drop(*held.values())

    def _by_batches(self, known: dict[str, str]):
        sent = self.spark.sparkContext.broadcast(known)  # its size is checked

        @F.pandas_udf("string")
        def exchanged(texts: pd.Series, lists: pd.Series) -> pd.Series:
            known, out = sent.value, []
            for text, own in zip(texts, lists):
                if text is not None:
                    # the longest first, then the greatest, as sorted pairs of (-length, string) come
                    for f in sorted(own, key=lambda f: (-len(f), f.encode())):
                        to = known.get(f if f in known else f.strip())
                        if to is not None:
                            text = text.replace(f, to)
                out.append(text)
            return pd.Series(out, dtype=object)

        # texts without a match don't go to Python
        return lambda text, found, some: F.when(some, exchanged(F.when(some, text), F.when(some, found))).otherwise(text)


def by_map(known: dict[str, str]):
    """text with the found strings replaced as a map says, the longest first."""
    table = F.map_from_arrays(F.lit([*known]), F.lit([*known.values()]))

    def exchanged(text: Column, found: Column, some: Column) -> Column:
        in_turn = F.sort_array(F.transform(found, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f"))))
        new = F.aggregate(in_turn, text, lambda t, p: F.replace(t, p["f"], F.coalesce(F.element_at(table, p["f"]), F.element_at(table, strip(p["f"])), p["f"])))
        return F.when(some, new).otherwise(text)

    return exchanged


def _hit(tag: str, rank: int):
    return lambda m: F.struct(strip(m).alias("raw"), F.lit(tag).alias("tag"), F.lit(rank).alias("rank"))


def numbered(values: DataFrame, by: str, keys: list[Column]) -> DataFrame:
    """values with seq (1, 2, ... within ``by`` in the order of keys) and token.  Two steps: ranks within ranges of
    keys, then the sizes of the ranges before."""
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(values.repartitionByRange(ranges, F.col(by), *keys).withColumn("_range", F.spark_partition_id()))
    ranked = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range", by).orderBy(*keys)))
    sizes = ranged.groupBy("_range", by).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(F.broadcast(before.drop("_n")), ["_range", by])  # a row per range and tag
    seq = (F.col("_in") + F.col("_before")).cast("long")
    return out.select("raw", by, seq.alias("seq"), F.concat(F.lit("<"), F.col(by), F.lit("_"), seq.cast("string"), F.lit(">")).alias("token"))


def replaced(df: DataFrame, column: str, found: Column, table: DataFrame) -> DataFrame:
    """df with the found strings of a column replaced as the table (raw, to) says, the longest first.

    Equal texts have equal results: distinct ones are worked out once and joined back by two hashes.  Rows without a
    match have keys of their own, so that they spread."""
    prefix = free_prefix(df, table)
    text, some = F.col(f"`{column}`"), F.size(found) > 0
    one, other = prefix + "one", prefix + "other"
    hashes = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    texts = df.where(some).select(hashes[0].alias("one"), hashes[1].alias("other"), text.alias("text"), found.alias("found")).dropDuplicates(["one", "other"])
    known = texts.select("one", "other", "text", F.explode("found").alias("f")).join(table, strip(F.col("f")) == F.col("raw"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.length("f")).alias("n"), F.col("f").alias("f"), "to")))
    new = known.groupBy("one", "other").agg(F.first("text").alias("text"), pairs.alias("pairs"))
    new = new.select(F.col("one").alias(one + "_"), F.col("other").alias(other + "_"), F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(t, p["f"], p["to"])).alias(prefix + "new"))
    alone = F.xxhash64(F.monotonically_increasing_id())
    rows = df.withColumns({one: F.when(some, hashes[0]).otherwise(alone), other: F.when(some, hashes[1])})
    out = rows.join(new, (F.col(one) == F.col(one + "_")) & (F.col(other) == F.col(other + "_")), "left")
    return out.withColumn(column, F.coalesce(F.col(prefix + "new"), text)).select(*[F.col(f"`{c}`") for c in df.columns])


def restore_text(text: str, tokens: dict[str, str]) -> str:
    return re.sub(TOKEN, lambda m: tokens.get(m[0], m[0]), text)
