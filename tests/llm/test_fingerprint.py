"""Fingerprints against an implementation of their own, under all ways of dealing rows."""

import base64
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import fingerprint

M64, M32 = 1 << 64, 1 << 32


def lanes(text):
    """Plain integers: 8 sums of 64-bit digests of lines, 128 signed counts of word pairs."""
    exact, like = [0] * 8, [0] * 128
    for line in text.encode().split(b"\n"):
        digest = hashlib.blake2b(line, digest_size=64).digest()
        exact = [(e + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % M64 for i, e in enumerate(exact)]
        before = 0
        for w in line.split():
            own = xxhash.xxh64_intdigest(w)
            h = (own ^ before * 0x9E3779B97F4A7C15 % M64) * 0xD6E8FEB86659FD93 % M64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % M64
            like[h >> 57] += 1 if h >> 40 & 1 else -1
            before = own
    return exact, like


def string_of(text):
    exact, like = lanes(text)
    return base64.b64encode(b"".join(e.to_bytes(8, "little") for e in exact) + b"".join((x % M32).to_bytes(4, "little") for x in like)).decode()


def likeness(a, b):
    (e, x), (f, y) = lanes(a), lanes(b)
    if e == f:
        return 1.0
    return min(1.0, max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(x, y)) / max(1, sum(p * p for p in x) + sum(q * q for q in y))))


def texts(n, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(9))) for _ in range(r.randrange(7))]
        out.append("\n".join(lines))
    out[:8] = [None, "", "\n", "é漢🙂\n\n x\t y", "one", "a\nb", "a\nb", "z " * 30_000 + "\nend"]
    return out


def expected(rows):
    """(id, text) in descending order of ids, nulls last, then by hash of the text."""
    h = lambda t: (v := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (v >> 63 << 64)
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), h(x[1]), x[1].encode()))
    out = []
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        out.append((str(k), len(t), hashlib.sha256(new.encode()).hexdigest(), string_of(t), string_of(new), round(likeness(t, new), 9), round(likeness(t, following), 9)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    own = [(i * 3 - 50, t) for i, t in enumerate(texts(120))]
    return own + [(7, t) for t in texts(60, 5)] + [(None, t) for t in texts(40, 6)] + [(40, "same"), (40, "same")]  # a hot id, no ids, repeats


@pytest.mark.parametrize(("reuse", "adaptive", "parts"), [("true", "true", 4), ("false", "true", 8), ("false", "false", 1), ("true", "false", 37)])
def test_edits_are_those_of_brute_force_however_rows_are_dealt(spark, rows, reuse, adaptive, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, (reuse, adaptive, str(parts))):
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, k string, p int, fingerprint string").repartition(5)
        assert result(fingerprint.edits(docs)) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_single_rows_empty_tables_and_other_ids(spark):
    schema = "doc_id int, text string"
    one = fingerprint.edits(spark.createDataFrame([(1, "a b c d")], schema))
    assert result(one) == expected([(1, "a b c d")]) and one.schema["doc_id"].dataType.simpleString() == "int"
    assert fingerprint.edits(spark.createDataFrame([], schema)).collect() == []
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(TypeError):
        fingerprint.edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    got = fingerprint.fingerprints(spark.createDataFrame([(None, None, "c"), (1, "x\ny", "c"), (1, "x\ny", "c")], "doc_id long, text string, n_chars string")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint) for r in got) == [("1", 3, string_of("x\ny"))] * 2 + [("None", 0, string_of(""))]


def test_ranges_follow_the_order_of_rows(spark):
    r = random.Random(1)
    keys = [r.choice([5, 9, r.randrange(-100, 100)]) for _ in range(3000)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("h", F.xxhash64(F.monotonically_increasing_id()))
    bounds = fingerprint.bounds_of(rows, 16)
    got = rows.withColumn("p", fingerprint.range_of(bounds, 16)).collect()
    ordered = sorted(got, key=lambda x: (-x.k, x.h))
    assert [x.p for x in ordered] == sorted(x.p for x in ordered) and {x.p for x in got} <= set(range(16))
    assert max(sum(x.p == p for x in got) for p in range(16)) < 3000 / 16 * 2  # a third of all rows has one id
