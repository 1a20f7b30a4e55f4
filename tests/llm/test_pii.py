"""All documents of the smallest scale, and made-up values, against plain Python pseudonyms."""

import hashlib
import ipaddress
import random
import re

import regex
from test_models import feistel, hidden, refill

from veilspark.llm import pii, queries

SF = "/root/testdata/sf0.001"
#: The operator's patterns as a Python library reads them.
KINDS = {k: regex.compile(p) for k, p in pii.KINDS.items()}
PATTERN = regex.compile(pii.PATTERN)


def digits(d, kind, key):
    u = len(d) // 2
    a, b = feistel(int(d[:u]) if u else 0, int(d[u:]), 10**u, 10 ** (len(d) - u), kind, key)
    return (f"{a:0{u}d}" if u else "") + f"{b:0{len(d) - u}d}"


def mod_97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def pseudonym(m, key):
    """kind and new text of a match, (None, m) if it isn't valid."""
    kind = next(k for k in KINDS if KINDS[k].fullmatch(m))
    d = re.sub(r"\D", "", m)
    if kind == "email":
        return kind, "u" + hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:20] + "@mail.invalid"
    if kind == "secret":
        name = "AKIA" if m.startswith("AKIA") else re.match(r"^([^=:]*[=:]\s*[\x22']?)", m)[1]
        value = m[len(name) :]
        digest = hashlib.sha256(f"{key}|secret|{value}".encode()).hexdigest()
        digest = digest.upper() if name == "AKIA" else digest
        return kind, name + (digest * (len(value) // 64 + 1))[: len(value)]
    if kind == "card" and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10:
        return None, m
    if kind == "phone" and len(d) <= 10 and m.startswith("+"):
        return kind, refill(m, d[:2] + digits(d[2:], "short phone", key))
    if kind == "iban":
        flat = m.replace(" ", "")
        if mod_97(flat[4:] + flat[:4]) != 1 or not "02" <= flat[2:4] <= "98":
            return None, m
        new = digits(re.sub(r"\D", "", flat[4:]), "iban", key)
        return kind, flat[:2] + f"{98 - mod_97(refill(flat[4:], new) + flat[:2] + '00'):02d}" + refill(m[4:], new)
    if kind == "ipv6":
        try:
            n = int(ipaddress.IPv6Address(m))
        except ValueError:
            return None, m
        w = [n >> 96, n >> 64 & 0xFFFFFFFF, n >> 32 & 0xFFFFFFFF, n & 0xFFFFFFFF]
        for r in range(pii.ROUNDS):
            mask = lambda x, y, i: int(hashlib.sha256(f"{key}|ipv6|{r}|{x}|{y}|{i}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
            w = [w[0] ^ mask(w[2], w[3], 0), w[1] ^ mask(w[2], w[3], 1), w[2], w[3]] if r % 2 == 0 else [w[0], w[1], w[2] ^ mask(w[0], w[1], 2), w[3] ^ mask(w[0], w[1], 3)]
        return kind, ipaddress.IPv6Address(w[0] << 96 | w[1] << 64 | w[2] << 32 | w[3]).exploded
    if kind == "date":
        return None, None  # formats are looked at by their own tests
    return kind, hidden(kind, m, key)


def brute(text, key):
    """The text with its pseudonyms and the counts of kinds; dates are left as <date>."""
    counts, out, at = dict.fromkeys(KINDS, 0), "", 0
    for m in PATTERN.finditer(text or ""):
        kind, new = pseudonym(m[0], key)
        out += text[at : m.start()] + ("<date>" if new is None else new)
        at = m.end()
        if kind:
            counts[kind] += 1
    return out + (text or "")[at:], counts


DATE = regex.compile(KINDS["date"].pattern)


def test_op9_over_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in queries.QUERIES["op9_pii"](spark, SF).collect()}
    assert set(out) == set(texts)
    seen = dict.fromkeys(KINDS, 0)
    for k, text in texts.items():
        want, counts = brute(text, queries.PII_KEY)
        if text is None:
            assert out[k].text is None
            continue
        # where a date was is as long as before and a date
        rest, pos = out[k].text, 0
        for i, piece in enumerate(want.split("<date>")):
            if i:
                assert DATE.match(rest, pos, pos + 10)
                pos += 10
            assert rest.startswith(piece, pos), (k, piece)
            pos += len(piece)
        assert pos == len(rest)
        for kind, n in counts.items():
            seen[kind] += n
            assert kind == "date" or out[k][f"n_{kind}"] == n
    assert sum(seen.values()) > 20


def iban(r, country, length):
    body = "".join(r.choice("0123456789") for _ in range(length - 4))
    body = "WEST" + body[4:] if country == "GB" else body
    return f"{country}{98 - mod_97(body + country + '00'):02d}{body}"


def test_accounts_addresses_and_phones(spark):
    r, values = random.Random(9), []
    for _ in range(15):
        for country, n in (("DE", 22), ("GB", 22), ("NO", 15), ("SA", 24), ("MT", 31)):
            x = iban(r, country, n)
            values += [x, " ".join(x[i : i + 4] for i in range(0, n, 4)), x[:3] + str((int(x[3]) + 1) % 10) + x[4:]]
        n = r.getrandbits(128)
        values += [ipaddress.IPv6Address(n).exploded, str(ipaddress.IPv6Address(n)), str(ipaddress.IPv6Address(n >> 64 << 64 | 1)), f"fe80::{r.getrandbits(16):x}:1"]
        values += [f"{r.randrange(2, 10)}12{r.randrange(2, 10)}{r.randrange(10**6):06d}", f"+49 {r.randrange(10**9):09d}", f"+45 12 34 {r.randrange(100):02d} 78", f"+1{r.randrange(10**10):010d}"]
    values += ["::1", "a::b", "1:2:3:4:5:6:7::8", "12:30:45", "::", "std::vector", "1::2::3", "1234567890", "0123456789"]
    docs = spark.createDataFrame([(i, f"x {v}, y") for i, v in enumerate(values)], "doc_id long, text string")
    out = {x.doc_id: x for x in pii.pseudonymise(docs, "k").collect()}
    for i, v in enumerate(values):
        want, counts = brute(f"x {v}, y", "k")
        assert out[i].text == want and {k: out[i][f"n_{k}"] for k in KINDS} == counts, v
    valid = [v.replace(" ", "") for v in values if KINDS["iban"].fullmatch(v)]
    new = [out[i].text[2:-3].replace(" ", "") for i, v in enumerate(values) if KINDS["iban"].fullmatch(v)]
    for a, b in zip(valid, new):
        assert (mod_97(b[4:] + b[:4]) == 1) == (mod_97(a[4:] + a[:4]) == 1) and a[:2] == b[:2]
    # one number, written in several ways, stays one
    ways = ["212-555-0100", "(212) 555-0100", "2125550100", "+1 212 555 0100", "+12125550100"]
    same = pii.pseudonymise(spark.createDataFrame([*enumerate(ways)], "doc_id long, text string"), "k").collect()
    assert len({re.sub(r"\D", "", x.text)[-10:] for x in same}) == 1 and not {x.text for x in same} & set(ways)
