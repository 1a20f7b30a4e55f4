"""Personal data: format-preserving pseudonyms by a keyed Feistel network, in DataFrame expressions only.

Candidates are found by one pattern; each is validated by its kind (Luhn sum, remainder of 97, octets, groups, calendar, number ranges).
A validated value is split into two numbers a < P and b < Q, and rounds of a += F(b) mod P, b += F(a) mod Q with
a keyed hash permute the kind's own domain: the result has the same format and is valid again, equal values stay
equal in all documents, different values stay different.  E-mail addresses and secrets have no such domain; they
get keyed digests.  A text is cut at its candidates and put together again within its row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from .quality import once

ROUNDS = 10
#: Characters of a bank account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(rf"(?:{'|'.join(countries.split())})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
GROUP = "[0-9A-Fa-f]{1,4}"
SOME_GROUPS = f"(?:{GROUP}(?::{GROUP}){{0,5}})?"
#: Kinds and their patterns, in the order in which they claim a match.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9/+_-]{8,}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?=[0-9A-Fa-f:]*\d){SOME_GROUPS}::{SOME_GROUPS})(?![A-Za-z0-9:]|\.\d)",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "date": r"(?<![\d/.-])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\d/-])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}])\+[1-9](?:[ .()-]{0,2}\d){7,14}(?!\d)|(?<![\p{L}\p{N}_.-])[2-9]\d\d[2-9]\d{6}(?![\p{L}\p{N}_]|[.-]\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
}
PATTERN = "|".join(KINDS.values())
#: No candidate is without one of these.
HINT = "[0-9@=:]|AKIA"
#: Days from 1900-01-01 to 2099-12-31, as a product.
DATE_P, DATE_Q = 17, 4297
#: dd/MM/ of the days over 12 of a year of 365 days.
DAY_FIRST = "".join(f"{d:02d}/{m:02d}/" for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(13, n + 1))
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d\d\.": "dd.MM.yyyy", r"^\d\d/": "MM/dd/yyyy"}


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def feistel(a: Column, b: Column, p: Column, q: Column, kind: str, key: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs with 0 <= a < p, 0 <= b < q."""

    def keyed(r: Column, x: Column, m: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, p, q, x), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % m

    def turn(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, (s["a"] + keyed(r, s["b"], p)) % p).otherwise(s["a"])
        b = F.when(r % 2 == 1, (s["b"] + keyed(r, s["a"], q)) % q).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(d: Column, kind: str, key: str) -> Column:
    """Digits to as many digits."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    power = lambda n: F.pow(F.lit(10), n).cast("bigint")
    mixed = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1, v)), power(u), power(v), kind, key)
    return once(mixed, lambda m: F.concat(F.lpad(m["a"].cast("string"), u, F.lit("0")), F.lpad(m["b"].cast("string"), v, F.lit("0"))))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, one by one, by others."""

    def step(s: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one not doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)


def hidden_card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, the last makes the Luhn sum right again."""

    def whole(d: Column) -> Column:
        body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        last = lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))
        return F.when(luhn_sum(d) % 10 == 0, refill(m, once(body, last)))

    return once(digits_of(m), whole)


def hidden_phone(m: Column, key: str) -> Column:
    """Numbers of ten digits or more by :func:`long_phone`, with or without marks between the digits, so that all ways to write
    one stay linked; shorter ones, which begin with a plus, keep two digits and have the others permuted."""
    short = lambda d: refill(m, F.concat(F.substr(d, F.lit(1), F.lit(2)), permuted_digits(F.substr(d, F.lit(3), F.length(d)), "short phone", key)))
    return once(digits_of(m), lambda d: F.when((F.length(d) > 10) | ~m.startswith("+"), long_phone(m, key)).otherwise(short(d)))


def long_phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted, the country's stay.  Areas and exchanges that can be dialled (200 to 999)
    become such ones, others become others: numbers stay valid or invalid, and none are mixed up."""

    def whole(d: Column) -> Column:
        kept = F.length(d) - 10
        area = number(F.substr(d, kept + 1, F.lit(3)))
        rest = number(F.substr(d, kept + 4, F.lit(7)))
        first, second = F.when(area >= 200, 200).otherwise(0), F.when(rest >= 2_000_000, 2_000_000).otherwise(0)
        p, q = F.when(area >= 200, 800).otherwise(200), F.when(rest >= 2_000_000, 8_000_000).otherwise(2_000_000)
        mixed = feistel(area - first, rest - second, p, q, "phone", key)
        padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return once(mixed, lambda s: refill(m, F.concat(F.substr(d, F.lit(1), kept), padded(s["a"] + first, 3), padded(s["b"] + second, 7))))

    return once(digits_of(m), whole)


def hidden_ip(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("bigint")
    mixed = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), "ip", key)
    high = lambda x: F.floor(x / 256).cast("string")
    low = lambda x: (x % 256).cast("string")
    return once(mixed, lambda s: F.concat_ws(".", high(s["a"]), low(s["a"]), high(s["b"]), low(s["b"])))


def hidden_ipv6(m: Column, key: str) -> Column:
    """An address to another, in whole: eight groups of four digits.  All ways to write one stay linked; null if there are
    too many groups."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    ends = F.split(F.lower(m), "::", 2)
    left, right = groups(F.get(ends, F.lit(0))), groups(F.get(ends, F.lit(1)))
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.when(~m.contains("::"), groups(F.lower(m))).when(gap >= 1, F.concat(left, F.array_repeat(F.lit("0"), gap), right))
    word = lambda g, i: F.conv(F.concat(F.lpad(F.get(g, F.lit(2 * i)), 4, "0"), F.lpad(F.get(g, F.lit(2 * i + 1)), 4, "0")), 16, 10).cast("bigint")

    def turn(s: Column, r: Column) -> Column:
        def mask(x: Column, y: Column, i: int) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("ipv6"), r, x, y, F.lit(i)), 256)
            return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

        first = r % 2 == 0
        out = [F.when(first, s[f"w{i}"].bitwiseXOR(mask(s["w2"], s["w3"], i))).otherwise(s[f"w{i}"]).alias(f"w{i}") for i in (0, 1)]
        out += [F.when(first, s[f"w{i}"]).otherwise(s[f"w{i}"].bitwiseXOR(mask(s["w0"], s["w1"], i))).alias(f"w{i}") for i in (2, 3)]
        return F.struct(*out)

    def hidden(g: Column) -> Column:
        mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(*[word(g, i).alias(f"w{i}") for i in range(4)]), turn)
        half = lambda s, i, k: F.substr(F.lpad(F.lower(F.hex(s[f"w{i}"])), 8, "0"), F.lit(k), F.lit(4))
        return once(mixed, lambda s: F.concat_ws(":", *[half(s, i, k) for i in range(4) for k in (1, 5)]))

    return F.when(F.size(whole) == 8, once(whole, hidden))


def mod_97(text: Column) -> Column:
    """The remainder of a text of digits and capitals, which count as 10 to 35."""

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def hidden_iban(m: Column, key: str) -> Column:
    """The digits of the account are permuted, country and letters stay, and the check digits are made right again; null where
    they were wrong."""
    four = lambda d, k, n: F.substr(d, F.lit(k), F.lit(n))

    def whole(d: Column) -> Column:
        country, account = four(d, 1, 2), F.substr(d, F.lit(5), F.length(d))
        sound = (mod_97(F.concat(account, four(d, 1, 4))) == 1) & four(d, 3, 2).between("02", "98")
        body = lambda new: F.concat(country, F.lpad((98 - mod_97(F.concat(refill(account, new), country, F.lit("00")))).cast("string"), 2, "0"), refill(F.substr(m, F.lit(5), F.length(m)), new))
        return F.when(sound, once(permuted_digits(digits_of(account), "iban", key), body))

    return once(F.replace(m, F.lit(" "), F.lit("")), whole)


def hidden_ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = F.split_part(m, F.lit("-"), F.lit(1)).cast("bigint")
    rest = (F.split_part(m, F.lit("-"), F.lit(2)).cast("bigint") - 1) * 9999 + F.split_part(m, F.lit("-"), F.lit(3)).cast("bigint") - 1
    mixed = feistel(F.when(area > 666, area - 2).otherwise(area - 1), rest, F.lit(898), F.lit(99 * 9999), "ssn", key)
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return once(mixed, lambda s: F.concat_ws("-", padded(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1), 3), padded(F.floor(s["b"] / 9999) + 1, 2), padded(s["b"] % 9999 + 1, 4)))


def day_as(form: str):
    return lambda s: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * DATE_Q + s["b"]).cast("int")), form)


def day_first(m: Column, key: str) -> Column:
    """A dd/MM/yyyy with a day over 12 to another such one, so that none becomes what a MM/dd/yyyy can become: places
    in a year of 365 days by years, and the 49 days of 29/02 among themselves."""
    at = F.instr(F.lit(DAY_FIRST), F.substr(m, F.lit(1), F.lit(6)))
    year = number(F.substr(m, F.lit(7), F.lit(4)))
    usual = feistel(F.floor((at - 1) / 6), year - 1900, F.lit(len(DAY_FIRST) // 6), F.lit(200), "day first", key)
    leap = F.floor((year - 1904) / 4)
    leap = feistel(F.floor(leap / 7), leap % 7, F.lit(7), F.lit(7), "leap day", key)
    usual = once(usual, lambda s: F.concat(F.substr(F.lit(DAY_FIRST), (s["a"] * 6 + 1).cast("int"), F.lit(6)), (s["b"] + 1900).cast("string")))
    leap = once(leap, lambda s: F.concat(F.lit("29/02/"), (1904 + 4 * (s["a"] * 7 + s["b"])).cast("string")))
    return F.when(at > 0, usual).when(m.startswith("29/02/") & (year > 1900) & (year % 4 == 0), leap)


def hidden_date(m: Column, key: str) -> Column:
    """A day of the years 1900 to 2099 to another, in the format it has; null if there is no such day.  What is no
    MM/dd/yyyy is tried as dd/MM/yyyy."""
    out = F.lit(None).cast("string")
    for shape, form in DATE_FORMATS.items():
        day = F.datediff(F.try_to_date(m, form), F.lit("1900-01-01").cast("date"))
        mixed = feistel(F.floor(day / DATE_Q), day % DATE_Q, F.lit(DATE_P), F.lit(DATE_Q), "date", key)
        new = once(mixed, day_as(form))
        new = F.when(day.isNotNull(), new)
        out = F.when(m.rlike(shape), F.coalesce(new, day_first(m, key)) if form.startswith("MM") else new).otherwise(out)
    return out


def hidden_email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 20), F.lit("@mail.invalid"))


def hidden_secret(m: Column, key: str) -> Column:
    """The name in front stays; the value becomes as many characters of a keyed digest."""
    name = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(m, r"^([^=:]*[=:]\s*[\x22']?)", 1))

    def whole(name: Column) -> Column:
        value = F.substr(m, F.length(name) + 1, F.length(m))
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
        digest = F.when(name == "AKIA", F.upper(digest)).otherwise(digest)
        return F.concat(name, F.rpad(digest, F.length(value), digest))

    return once(name, whole)


HIDE = {"email": hidden_email, "secret": hidden_secret, "ip": hidden_ip, "ipv6": hidden_ipv6, "iban": hidden_iban, "date": hidden_date, "ssn": hidden_ssn, "phone": hidden_phone, "card": hidden_card}


def pseudonym(match: Column, key: str) -> Column:
    """struct(kind, text) of one match; kind is null and the text unchanged if it doesn't validate."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(match.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(kind)

    def hidden(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, hide in HIDE.items():
            new = F.when(kind == name, hide(match, key)).otherwise(new)
        return once(new, lambda x: F.struct(F.when(x.isNotNull(), kind).alias("kind"), F.coalesce(x, match).alias("text")))

    return once(kind, hidden)


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", counts: bool = True) -> DataFrame:
    """All columns of docs with the text pseudonymised and, with counts, a column n_<kind> for each kind.

    A null text stays null and an empty one empty, both with zero counts; rows, their order within a partition and
    repeated rows are kept; an empty table stays empty.  Columns of docs that have a count's name are replaced by it;
    all others stay as they are.
    """
    text, new = F.col(f"`{text_col}`"), free_prefix(docs) + "new"
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(new, F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: pseudonym(m, key)))
    gaps = F.split(text, PATTERN, -1)
    whole = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(F.col(new), i)["text"], F.lit(""))))), "")
    rows = rows.withColumn(text_col, F.when(F.size(new) > 0, whole).otherwise(text))
    if counts:
        rows = rows.withColumns({f"n_{k}": F.size(F.filter(new, is_kind(k))).cast("long") for k in KINDS})
    return rows.drop(new)
