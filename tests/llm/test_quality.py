"""The estimate behind the quality rules, against brute force and planted accuracies."""

import math
import random
from collections import Counter

import pytest

from veilspark.llm import quality
from veilspark.llm.quality import ABSTAIN, BAD, GOOD


def planted(seed, n=6000, rules=7, junk=0.2):
    """Votes of noisy rules: (truth, votes), with each rule's own shares."""
    r = random.Random(seed)
    shares = [({BAD: 0.02 + 0.02 * j, ABSTAIN: 0.3, GOOD: 0.68 - 0.02 * j}, {BAD: 0.85 - 0.06 * j, ABSTAIN: 0.1, GOOD: 0.05 + 0.06 * j}) for j in range(rules)]
    rows = []
    for _ in range(n):
        bad = r.random() < junk
        rows.append((bad, tuple(r.choices(list(s[bad]), list(s[bad].values()))[0] for s in shares)))
    return rows, shares


def test_estimate_recovers_planted_accuracies():
    rows, shares = planted(1)
    belief, table, good = quality.estimate(Counter(v for _, v in rows))
    assert good == pytest.approx(0.8, abs=0.02)
    for own, (of_good, of_bad) in zip(table, shares):
        for v in (BAD, ABSTAIN, GOOD):
            assert own[v][0] == pytest.approx(of_good[v], abs=0.03) and own[v][1] == pytest.approx(of_bad[v], abs=0.06)
    assert sum((belief[v] < 0.5) == bad for bad, v in rows) / len(rows) > 0.97
    kept = [v for _, v in rows if belief[v] >= 0.5 and BAD in v]
    dropped = [v for _, v in rows if belief[v] < 0.5]
    assert len({v for v in kept}) > 10 and min(v.count(BAD) for v in dropped) >= 1
    # all-must-pass would drop many more sound documents than the posterior does
    sound = [v for bad, v in rows if not bad]
    assert sum(belief[v] < 0.5 for v in sound) * 10 < sum(BAD in v for v in sound)


def brute_em(rows, rounds=200):
    """Expectation-maximisation document by document, without patterns or logarithms."""
    post = [0.9 if sum(x == -1 for x in v) < 2 else 1 - 0.9 for v in rows]
    prior_good, prior_bad = {-1: 0.5, 0: 4.5, 1: 5.0}, {-1: 3.0, 0: 4.0, 1: 3.0}
    for _ in range(rounds):
        share = (math.fsum(post) + 9) / (len(rows) + 10)
        like = []
        for j in range(len(rows[0])):
            g = {x: prior_good[x] + math.fsum(p for v, p in zip(rows, post) if v[j] == x) for x in (-1, 0, 1)}
            b = {x: prior_bad[x] + math.fsum(1 - p for v, p in zip(rows, post) if v[j] == x) for x in (-1, 0, 1)}
            like.append({x: (g[x] / math.fsum(g.values()), b[x] / math.fsum(b.values())) for x in g})
        new = []
        for v in rows:
            one, other = share, 1 - share
            for x, t in zip(v, like):
                one, other = one * t[x][0], other * t[x][1]
            new.append(one / (one + other))
        if max(abs(a - b) for a, b in zip(new, post)) < 1e-9:
            break
        post = new
    return post


@pytest.mark.parametrize("seed", [2, 3])
def test_estimate_is_that_of_brute_force(seed):
    rows = [v for _, v in planted(seed, n=400, rules=5)[0]]
    belief = quality.estimate(Counter(rows))[0]
    for v, want in zip(rows, brute_em(rows)):
        assert belief[v] == pytest.approx(want, abs=1e-6)
    assert quality.estimate({}) == ({}, [], 1.0)


def text(i, extra="", sentence=10):
    r = random.Random(i)
    w = ["".join(r.choice("abcdefghij") for _ in range(r.choice([4, 5, 5, 6]))) for _ in range(150)]
    return " ".join(" ".join(w[k : k + sentence]) + "." for k in range(0, 150, sentence)) + extra


def test_posterior_forgives_one_bad_vote_and_adds_up_several(spark):
    rows = []
    for i in range(600):
        kind = "plain"
        own = text(i)
        if i % 20 == 1:  # a sound text that fails one rule
            kind, own = "lines", text(i, "\nsame line here\nother line\nsame line here\nother line\nlast one")
        elif i % 20 == 2:
            kind, own = "case", text(i).title()
        elif i % 10 == 3:  # junk: several rules vote bad, none beyond doubt
            kind, own = "junk", " ".join(w + ("#&" if k % 3 == 0 else "") for k, w in enumerate(text(i).replace(".", "").split()))
        rows.append((i, own, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, _, kind in rows:
        r = got[i]
        assert not r.base_failed and 0 <= r.quality <= 1 and r.kept == (r.quality >= 0.5)
        if kind in ("lines", "case"):
            assert 1 <= r.bad_votes <= 2 and r.kept, kind
        if kind == "junk":
            assert r.bad_votes >= 3 and not r.kept
        if kind == "plain":
            assert r.kept
