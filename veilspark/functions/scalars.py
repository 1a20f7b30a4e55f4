"""Scalar functions as Column expressions, also registered for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P

#: Eastern Arabic digits and decimal mark with what replaces them.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩٫"
LATIN_DIGITS = "0123456789."


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes spaces only."""
    return F.btrim(c, F.lit(WHITE))


def double_of(c: Column) -> Column:
    """The number that a text is, else null.  What doesn't begin like a number isn't cast: a failed cast costs much."""
    return F.when(c.rlike(r"^\s*[+-]?(?:[0-9.]|(?i:inf|nan))"), c.try_cast("double"))


def luhn_valid(c: Column) -> Column:
    """13 to 19 digits, whatever stands between them, with a right Luhn sum; false for null."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


#: Marks of direction, of joining and of byte order.
MARKS = "[​-‏‪-‮⁦-⁩﻿؜]"


def normalise_bilingual(c: Column) -> Column:
    """Latin digits for Arabic ones, without marks of direction, byte order and thousands."""
    plain = strip(F.regexp_replace(c, MARKS, ""))
    return F.translate(F.replace(plain, F.lit("٬"), F.lit("")), ARABIC_DIGITS, LATIN_DIGITS)


def shape(c: Column) -> Column:
    """Upper-case letters as X, lower-case ones as x, digits as 9; the rest stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "9")


def structural_mask(c: Column) -> Column:
    """A report's cell without its values: labels stay, dates and codes keep their form, numbers become 9,999.00."""
    s = strip(c)
    number = double_of(strip(F.regexp_replace(s, r"[,$]|SAR|PLN", "")))
    nines = F.regexp_replace(s, r"\d", "9")
    return (
        F.when(c.isNull() | (s == "") | F.lower(s).isin(*P.STRUCTURE_WORDS), c)
        .when(s.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}(?:\s+\d{2}:\d{2}:\d{2})?$"), nines)
        .when(s.rlike(r"^[A-Za-z]+[-/_]\d+$"), F.regexp_replace(nines, "[A-Za-z]", "X"))
        .when(s.rlike(r"^\d+-\d+$"), nines)
        .when(number.isNotNull(), F.lit("9,999.00"))
        .otherwise(shape(s))
    )


def free_text_rules() -> list[tuple[str, str, str]]:
    """(kind, pattern, replacement), applied one after the other."""
    one = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    titles, relations, organisations, roads, particles = map(one, (P.TITLES, P.RELATIONS, P.ORGANISATIONS, P.ROADS, P.PARTICLES))
    word = rf"{P.NAME_HEAD}[\w'-]+"
    named = rf"{word}(?:\s+(?:{particles})?{word})*"
    return [
        ("EMAIL", P.UNIVERSAL["EMAIL"], "<EMAIL_REDACTED>"),
        ("PHONE", P.UNIVERSAL["PHONE"], "<PHONE_REDACTED>"),
        ("ORG", rf"(?U)\b({word}(?:\s+{word})*\s+(?:{organisations}))\b", "<ORGANIZATION_REDACTED>"),
        ("PERSON", rf"(?U)\b({titles})\s+({named})", "$1 <PERSON_REDACTED>"),
        ("RELATION", rf"(?iU)\b({relations})\s+(?:of\s+|named\s+)?({named})", "$1 <PERSON_REDACTED>"),
        ("COMPOUND", rf"(?iU)\b({P.NAME_HEAD}[a-zء-ي]+\s+(?:{particles}){word})\b", "<PERSON_REDACTED>"),
        ("LOCATION", rf"(?iU)\b(\d+\s+{word}(?:\s+{word})*\s+(?:{roads})|P\.?O\.?\s*Box\s*\d+)\b", "<ADDRESS_REDACTED>"),
    ]


def bound(value: Column, use) -> Column:
    """use(x) with x bound to the value, which is worked out a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def apart(value: Column) -> Column:
    """The same value, worked out beside the generated code: very long expressions make methods that the JVM doesn't
    compile, which is slower by far."""
    return F.element_at(F.transform(F.array(F.lit(0)), lambda _: value), 1)


def digits_in(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, LATIN_DIGITS[:10], ""))


def has_digits(c: Column, n: int) -> Column:
    """Whether there are n digits; they are only counted where there is one."""
    return c.rlike("[0-9]") & (digits_in(c) >= n)


def any_of(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def rule_hints(c: Column) -> dict[str, Column]:
    """For each kind of free text a cheap test that every text with a match passes.  Letters that only fold to s and k
    pass the tests of words in any case."""
    low = F.lower(c)
    folds = any_of(c, "\u017f\u212a")
    return {
        "EMAIL": c.contains("@"),
        "PHONE": has_digits(c, 10),
        "ORG": any_of(c, P.ORGANISATIONS),
        "PERSON": any_of(c, P.TITLES),
        "RELATION": folds | any_of(low, P.RELATIONS),
        "COMPOUND": any_of(low, P.PARTICLES),
        "LOCATION": c.rlike(r"(?U)\d"),
    }


def redacted(c: Column) -> Column:
    """struct(text, n_<kind> ...): the text with mail addresses, phones, organisations, persons and addresses taken out,
    and how often each rule found something; rules are applied one after the other.

    Every match of a rule leaves one mark more than there was, so marks are counted, and patterns run once."""
    rules, hints = free_text_rules(), rule_hints(c)
    out = F.struct(c.alias("text"), *[hints[kind].alias(kind) for kind, _, _ in rules])

    def marks(text: Column, mark: str) -> Column:
        return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark)))) / len(mark)).cast("long")

    def applied(kind: str, pattern: str, to: str, fields: list[str]):
        mark, own = to.split("$1 ")[-1], f"n_{kind.lower()}"

        def with_text(x: Column, text: Column, n: Column) -> Column:
            return F.struct(text.alias("text"), *[x[f].alias(f) for f in fields], n.alias(own))

        def use(x: Column) -> Column:
            new = bound(F.regexp_replace(x["text"], pattern, to), lambda t: with_text(x, t, marks(t, mark) - marks(x["text"], mark)))
            return F.when(x[kind], new).otherwise(with_text(x, x["text"], F.lit(0).cast("long")))

        return use

    fields = [kind for kind, _, _ in rules]
    for kind, pattern, to in rules:
        out = bound(out, applied(kind, pattern, to, list(fields)))
        fields.append(f"n_{kind.lower()}")
    return out


def redact(c: Column) -> Column:
    """Text with mail addresses, phones, organisations, persons and addresses taken out."""
    return redacted(c)["text"]


def entities(c: Column) -> Column:
    """Names and places in a text: persons with a title or relation, organisations, addresses; distinct."""
    rules, hints = {k: p for k, p, _ in free_text_rules()}, rule_hints(c)
    none = F.array().cast("array<string>")
    found = [F.when(c.isNull() | hints[k], F.regexp_extract_all(c, F.lit(rules[k]), F.lit(g))).otherwise(none) for k, g in (("PERSON", 2), ("RELATION", 2), ("ORG", 1), ("LOCATION", 1))]
    return F.array_distinct(F.concat(*found))


def age_band(c: Column) -> Column:
    n = c.try_cast("double")
    low = (F.floor(n / 10) * 10).cast("string")
    return F.when(n.isNull() | F.isnan(n), "Unknown").when(n < 18, "<18").when(n >= 75, "75+").otherwise(F.concat(low, F.lit("-"), (F.floor(n / 10) * 10 + 9).cast("string")))


def number_of(c: Column) -> Column:
    """Lenient number: currency marks, commas and blanks are cleared, (x) is -x; null if it isn't one."""
    plain = F.regexp_replace(F.regexp_replace(c, P.CURRENCY + r"|,|\s", ""), r"^\((.*)\)$", "-$1")
    return double_of(plain)


def register(spark: SparkSession) -> None:
    """veil_luhn, veil_shape, veil_redact, veil_age_band and veil_normalise for SQL: temporary SQL functions, which
    the optimiser inlines, so no row leaves the JVM."""
    raw = lambda text: 'r"' + text + '"'
    redacted = "x"
    for _, pattern, to in free_text_rules():
        redacted = f"regexp_replace({redacted}, {raw(pattern)}, {raw(to)})"
    digits = r"regexp_replace(coalesce(x, ''), r'\D', '')"
    shaped = r"regexp_replace(regexp_replace(regexp_replace(x, r'\p{Lu}', 'X'), r'\p{Ll}', 'x'), r'\p{Nd}', '9')"
    low = "cast(floor(x / 10) * 10 as bigint)"
    bodies = {
        "veil_luhn(x STRING) RETURNS BOOLEAN": f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits})",
        "veil_shape(x STRING) RETURNS STRING": shaped,
        "veil_redact(x STRING) RETURNS STRING": redacted,
        "veil_age_band(x DOUBLE) RETURNS STRING": f"CASE WHEN x IS NULL OR isnan(x) THEN 'Unknown' WHEN x < 18 THEN '<18' WHEN x >= 75 THEN '75+' ELSE concat({low}, '-', {low} + 9) END",
        "veil_normalise(x STRING) RETURNS STRING": f"translate(replace(btrim(regexp_replace(x, '{MARKS}', ''), '{WHITE}'), '\u066c', ''), '{ARABIC_DIGITS}', '{LATIN_DIGITS}')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
