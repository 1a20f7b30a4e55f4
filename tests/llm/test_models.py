"""Toxicity's loss and scores, the Feistel permutations and permuted vocabularies, each against a plain version."""

import datetime as dt
import hashlib
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import bpe, packing, pii, token_counts, toxicity

JSON = public_tokenizers.path("byte_bpe_50k.json")


def plain_loss(w, b, bags, leak, decay):
    total = 0.0
    for y, bag, times in bags:
        none = 1 - leak
        for sentence, n in zip(bag, times):
            none *= (1 - 1 / (1 + math.exp(-(b + sum(w[f] for f in sentence))))) ** n
        total -= math.log(1 - none if y else none)
    return total / len(bags) + decay * sum(x * x for x in w) / (2 * len(w))


def some_bags(seed, n=40, features=6):
    r = random.Random(seed)
    return [(r.randrange(2), [sorted(r.sample(range(features), r.randint(1, 3))) for _ in range(k)], [r.randint(1, 3) for _ in range(k)]) for k in (r.randint(1, 4) for _ in range(n))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_noisy_or_loss_and_gradient_are_those_of_brute_force(seed):
    bags, r = some_bags(seed), random.Random(seed)
    w, b = np.array([r.uniform(-1, 1) for _ in range(6)]), -0.4
    loss, grad = toxicity.loss_and_gradient(w, b, toxicity.laid_out(bags), 0.05, 0.01)
    assert loss == pytest.approx(plain_loss(w, b, bags, 0.05, 0.01), rel=1e-9)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        ends = [plain_loss(w + s * step[:6], b + s * step[6], bags, 0.05, 0.01) for s in (1, -1)]
        assert grad[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_training_reaches_a_minimum_of_the_plain_loss():
    bags = some_bags(7)
    model = toxicity.trained(list("abcdef"), bags, 0.5, frozenset(), steps=3000)
    w, leak = np.array([model.weights[c] for c in "abcdef"]), 0.1 / 1
    best = plain_loss(w, model.bias, bags, leak, 1e-3)
    r = random.Random(0)
    for _ in range(200):
        near = w + np.array([r.gauss(0, 0.1) for _ in range(6)])
        assert plain_loss(near, model.bias + r.gauss(0, 0.1), bags, leak, 1e-3) > best - 1e-4


def test_scores_and_spans_are_those_of_brute_force(spark):
    weights = {"=zorg": 3.0, "^blar": 1.5, "=mild": 0.2}
    model = toxicity.Model(weights, -1.0, 0.03, frozenset({"zorg", "blar", "mild"}))
    texts = ["", None, "plain words here.", "A ZORG! and blarg. mild? zorg zorg blarg", "blargs and blarney.\nnothing\nmild mild.", "İ zorg. É blarg", "zorg. " * 50]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        none, spans, at = 1 - 0.03, [], 0
        for part in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or ""):
            words = set(re.findall(r"[^\W\d_]+", part.lower()))
            found = {f"={w}" for w in words} | {f"^{w[:4]}" for w in words if len(w) > 4}
            hit = [weights[f] for f in found if f in weights]
            if hit:
                p = 1 / (1 + math.exp(1.0 - sum(hit)))
                none *= 1 - p
                if p >= 0.5:
                    spans.append((at, at + len(part), round(p, 9)))
            at += len(part)
        assert got[i].score == pytest.approx(1 - none, abs=1e-9)
        assert [(s.start, s.end, round(s.probability, 9)) for s in got[i].spans] == spans


def feistel(a, b, p, q, kind, key):
    """Ten rounds of the keyed sums in plain integers."""
    for r in range(10):
        m, x = (p, b) if r % 2 == 0 else (q, a)
        f = int(hashlib.sha256(f"{key}|{kind}|{r}|{p}|{q}|{x}".encode()).hexdigest()[:15], 16) % m
        a, b = ((a + f) % p, b) if r % 2 == 0 else (a, (b + f) % q)
    return a, b


def refill(text, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def hidden(kind, text, key):
    """What becomes of a valid value."""
    d = re.sub(r"\D", "", text)
    if kind == "card":
        body, u = d[:-1], len(d[:-1]) // 2
        v = len(body) - u
        a, b = feistel(int(body[:u]), int(body[u:]), 10**u, 10**v, "card", key)
        new = f"{a:0{u}d}{b:0{v}d}"
        total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(new))))
        return refill(text, new + str(-total % 10))
    if kind == "phone":
        area, rest = int(d[-10:-7]), int(d[-7:])
        i, j = 200 * (area >= 200), 2_000_000 * (rest >= 2_000_000)
        a, b = feistel(area - i, rest - j, 800 if i else 200, 8_000_000 if j else 2_000_000, "phone", key)
        return refill(text, f"{d[:-10]}{a + i:03d}{b + j:07d}")
    if kind == "ip":
        w, x, y, z = map(int, text.split("."))
        a, b = feistel(w * 256 + x, y * 256 + z, 65536, 65536, "ip", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        a, b = feistel(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
        return f"{a + 2 if a >= 665 else a + 1:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    day = (dt.date.fromisoformat(text) - dt.date(1900, 1, 1)).days
    a, b = feistel(day // 4297, day % 4297, 17, 4297, "date", key)
    return str(dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b))


def luhn_card(r, n):
    body = [r.randrange(10) for _ in range(n - 1)]
    total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def test_pseudonyms_are_those_of_a_plain_feistel_network(spark):
    r, rows = random.Random(5), []
    for _ in range(25):
        rows.append(("card", luhn_card(r, r.choice([13, 15, 16, 19]))))
        rows.append(("phone", r.choice(["{}-{}-{}", "({}) {}-{}", "+1 {} {} {}", "+44 {}.{}.{}"]).format(f"{r.randrange(1000):03d}", f"{r.randrange(1000):03d}", f"{r.randrange(10000):04d}")))
        rows.append(("ip", ".".join(str(r.randrange(256)) for _ in range(4))))
        rows.append(("ssn", f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"))
        rows.append(("date", str(dt.date(1900, 1, 1) + dt.timedelta(r.randrange(17 * 4297)))))
    docs = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for x in pii.pseudonymise(docs, "secret").collect():
        kind, text = rows[x.doc_id]
        assert x.text == f"x {hidden(kind, text, 'secret')} y" and x[f"n_{kind}"] == 1, (kind, text)


def test_phones_that_can_be_dialled_stay_such(spark):
    texts = ["212-555-0100", "112-555-0100", "212-155-0100", "012-055-0100"]
    out = [x.text for x in pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert [(t[0] >= "2", t[4] >= "2") for t in out] == [(t[0] >= "2", t[4] >= "2") for t in texts] and not set(out) & set(texts)


def test_permuted_ids_follow_the_library(spark, tmp_path):
    file = json.load(open(JSON))
    vocab = file["model"]["vocab"]
    names = [t for t, i in sorted(vocab.items(), key=lambda x: x[1]) if len(t) > 1]
    ids = [vocab[t] for t in names]
    random.Random(1).shuffle(ids)
    vocab |= dict(zip(names, ids))
    path = str(tmp_path / "permuted.json")
    json.dump(file, open(path, "w"))
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(20)
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    got = {}
    for p in packing.pack(docs, path).collect():
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert {k: [i for _, x in sorted(v) for i in x] for k, v in got.items()} == {k: [*v, 1] for k, v in want.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == {k: len(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        bpe.encode(docs, path)
