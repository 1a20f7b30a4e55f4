"""The toxicity query over its whole table against a training of its own, in plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest

from veilspark.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(text):
    return {f for w in WORD.findall(text.lower()) for f in ("=" + w, *("^" + w[:n] for n in (4, 5, 6) if len(w) > n))}


def chosen(bags):
    """Features of which few enough are chance finds, the most telling first."""
    share = sum(y for y, _ in bags) / len(bags)
    toxic, clean = Counter(), Counter()
    for y, text in bags:
        (toxic if y else clean).update(features(text))
    kinds = Counter((toxic[f] + clean[f], toxic[f]) for f in {*toxic, *clean})
    least = {}
    for k in {k for k, _ in kinds}:
        own = {a: n for (size, a), n in kinds.items() if size == k}
        for a in sorted(own, reverse=True):
            if a <= k * share:
                break
            tail = sum(math.comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(a, k + 1)) if k <= 100 else math.exp(-a * math.log(a / (k * share)) - (k - a and (k - a) * math.log((k - a) / (k * (1 - share)))))
            if sum(own.values()) * tail <= toxicity.FALSE_SHARE * sum(n for b, n in own.items() if b >= a):
                least[k] = a
    gain = {}
    for f in toxic:
        a, c = toxic[f], clean[f]
        if a >= least.get(a + c, math.inf):
            gain[f] = a * math.log(a / ((a + c) * share)) + (c * math.log(c / ((a + c) * (1 - share))) if c else 0.0)
    return sorted(gain, key=lambda f: (-gain[f], f))[: toxicity.FEATURES], share


def instances(text, weights):
    """The features of each sentence that has one."""
    found = (sorted(f for f in features(s) if f in weights) for s in SENTENCE.findall(text))
    return [x for x in found if x]


def trained(bags, names, steps=400, decay=1e-3):
    """Noisy-or of logistic sentences, by plain sums over sentences."""
    rows = [(y, instances(text, set(names))) for y, text in bags]
    none = [y for y, s in rows if not s]
    leak = (sum(none) + 0.1) / (len(none) + 1)
    rows = [(y, s) for y, s in rows if s]
    w, b = dict.fromkeys(names, 0.5), -1.0
    m, v = dict.fromkeys([*names, None], 0.0), dict.fromkeys([*names, None], 0.0)
    for t in range(1, steps + 1):
        grad = {n: decay * w[n] / len(names) for n in names} | {None: 0.0}
        for y, sentences in rows:
            p = [1 / (1 + math.exp(-(b + sum(w[f] for f in s)))) for s in sentences]
            off = (1 - leak) * math.prod(1 - x for x in p)
            pull = -off / max(1 - off, 1e-9) if y else 1.0
            for s, x in zip(sentences, p):
                for f in [*s, None]:
                    grad[f] += pull * x / len(rows)
        for n, g in grad.items():
            m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
            step = 0.05 * (m[n] / (1 - 0.9**t)) / (math.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
            if n is None:
                b -= step
            else:
                w[n] -= step
    return w, b, min(leak, 0.999)


def test_op1_against_a_plain_training(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in texts}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    bags = [(labels[k], texts[k]) for k in texts if k in labels and not held[k]]
    names, share = chosen(bags)
    w, b, leak = trained(bags, names) if names else ({}, 0.0, share)
    out = queries.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(out) == len(texts) and {r.doc_id for r in out} == set(texts)
    for r in out:
        off = 1 - leak
        for s in instances(texts[r.doc_id], w):
            off *= 1 - 1 / (1 + math.exp(-(b + sum(w[f] for f in s))))
        assert r.held_out == held[r.doc_id] and r.score == pytest.approx(1 - off, abs=1e-6) and r.predicted == (r.score >= 0.5)
