"""Whitening, divergence and language model against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import divergence, lm, queries, whitening

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- whitening


def check_whitening(out, vectors, components=8):
    """out: rows by (id, component); vectors: (id, entries) of the usable rows."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    means = np.array([s / n for s in sums])
    v = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    assert len(out) == n * len(order)
    by_row = defaultdict(dict)
    for r in out:
        by_row[r.vec_id][r.component] = r
    for c, k in enumerate(order, 1):
        want = (x - means) @ axes[:, k] / math.sqrt(values[k])
        got = np.array([by_row[i][c].whitened for i, _ in vectors])
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-6
        assert by_row[vectors[0][0]][c].explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    for (i, _), row in zip(vectors, x.tolist()):
        r = by_row[i][1]
        assert r.n == n and int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(row, sums)) and r.identity_error < 1e-9
    assert len({r.identity_error for r in out}) == 1


def test_op11(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, SF).collect(), vectors)


@pytest.mark.parametrize("width", [1, 3, 5, 100])
def test_whitening_tiles(spark, width):
    """Tiles of any width, also one that doesn't divide the dimensions, give the covariance."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(700, 7)) @ rng.normal(size=(7, 7))
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    fitted = whitening.fit_list(df)
    n, sums = whitening.sums_by_dimension(fitted)
    whole = np.floor(1024 * x) + 100_000
    assert n == 700 and sums == tuple(int(s) for s in whole.sum(axis=0))
    assert np.allclose(whitening.covariance(fitted, n, sums, width), np.cov(whole.T, bias=True), rtol=1e-12, atol=1e-6)


def test_whitening_odd_rows(spark):
    """Null, empty, ragged and non-finite vectors are dropped; repeated rows and null ids count; other columns clash."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "n") for r in [*good, *bad]], "vec_id long, embedding array<double>, n int, x string")
    check_whitening(whitening.whiten(df).collect(), good, 3)
    twice = spark.createDataFrame([*good, (None, good[0][1]), good[3]], "vec_id long, embedding array<double>")
    out = whitening.whiten(twice).collect()
    assert Counter(r.vec_id for r in out) == Counter({i: 3 for i in range(20)}) + Counter({None: 3, 3: 3}) and out[0].n == 22
    assert whitening.whiten(df.where("vec_id >= 100 and vec_id <> 105")).collect() == []
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in alone] == [(0.0, 0.0, 0, 0.0)] * 3
    far = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(10)], "vec_id long, embedding array<double>")
    held = [(i, [2.0**32 * (-1) ** i, float(i)]) for i in range(10)]
    check = {r.vec_id: int(r.deviation) for r in whitening.whiten(far).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in held]
    sums = [sum(c) for c in zip(*x)]
    assert check == {i: sum((10 * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}


# --- divergence


def brute_audit(docs, least=10, scale=10**9, top=10):
    """docs: (lang, source, text)."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, own = lang or "", source or "", TERMS.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(own)
        held[lang].update(set(own))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + scale * (c[t] + 2) // total for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(rows, 1)}
    return out


def rows_of(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_op12(spark):
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = rows_of(queries.QUERIES["op12_divergence"](spark, SF))
    assert len(out) == len(set(out)) and set(out) == brute_audit(docs)


@pytest.mark.parametrize("sources,at_once,block", [(1, 64, 4096), (2, 64, 4096), (5, 1, 4), (6, 2, 3), (9, 3, 4096)])
def test_tournaments(spark, sources, at_once, block):
    """Odd and even numbers of groups, rounds in several jobs, several blocks: each pair meets once, in both directions."""
    rng = np.random.default_rng(sources)
    words = ["Ab", "b", "É", "été", "x1y", "foo-bar", "ZZ", "日本", "k"]
    docs = [(lang, f"s{rng.integers(sources)}", " ".join(rng.choice(words, 6))) for lang in ("a", "b", None) for _ in range(40)]
    docs += [("a", f"s{k}", None) for k in range(sources)] + [("lonely", None, ""), ("empty", "x", ""), ("empty", "y", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, value int")
    out = rows_of(divergence.audit(df, least_docs=3, top=2, rounds_at_once=at_once, block_terms=block))
    assert len(out) == len(set(out)) and set(out) == brute_audit(docs, 3, top=2)


def test_audit_edges(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert rows_of(divergence.audit(empty)) == []
    long = [("l", "a", "word " * 50_000 + "tail")] * 10 + [("l", "b", "other word\x7fa")] * 10
    out = rows_of(divergence.audit(spark.createDataFrame(long, "lang string, source string, text string")))
    assert set(out) == brute_audit(long)
    assert divergence.unpacked(divergence.packed(np.array([0, 2**40, 3], np.uint64))).tolist() == [0, 2**40, 3]
    huge = np.array([10**12, 5])
    assert divergence.shares(huge, 10**12 + 5, 2, 10**9).tolist() == [1 + 10**9 * (c + 2) // (10**12 + 9) for c in huge.tolist()]


# --- language model


def tokens_of(text):
    return [*WORDS.findall((text or "").translate(LOWER)), "\n"]


def brute_scores(docs, order=2):
    """held_out, n_tokens, n_known, N, base and score with exact sets in place of the filter."""
    step = lambda c: sum(s <= c for s in lm.STEPS[:120].tolist())
    low, high = [0, *lm.STEPS.tolist()], [0, *(lm.STEPS[1:] - 1).tolist()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    grams = [Counter() for _ in range(order + 1)]
    for k, text in docs.items():
        if not held[k]:
            own = [None] * (order - 1) + tokens_of(text)
            for n in range(1, order + 1):
                for i in range(order - 1, len(own)):
                    grams[n][tuple(own[i - n + 1 : i + 1])] += 1
                if n < order:
                    grams[n][(None,) * n] += 1
    words = {g: c for g, c in grams[1].items() if g != (None,)}
    total, v = sum(words.values()), len(words)
    m = [0, 1.0]
    for n in range(2, order + 1):
        histogram = Counter(step(c) for c in grams[n - 1].values())
        m.append(lm._mass([histogram[i] for i in range(max(histogram) + 1)], sum(c == 1 for c in grams[n].values())))
    out = {}
    for k, text in docs.items():
        own, score = [None] * (order - 1) + tokens_of(text), 0.0
        for i in range(order - 1, len(own)):
            p = (low[step(grams[1][(own[i],)])] + 1) / (total + v + 1)
            for n in range(2, order + 1):
                g = tuple(own[i - n + 1 : i + 1])
                h = high[step(grams[n - 1][g[:-1]])]
                p = (min(low[step(grams[n][g])], h) + m[n] * p) / (h + m[n])
            score += math.log10(p)
        mine = tokens_of(text)
        base = sum(math.log10((words.get((w,), 0) + 1) / (total + v + 1)) for w in mine)
        out[k] = (held[k], len(mine), sum((w,) in words for w in mine), total, base, score)
    return out


def test_op13(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_scores(texts)
    out = queries.QUERIES["op13_lm"](spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(list(texts))
    gaps = []
    for r in out:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gaps.append((r.score - score) / n)
        assert r.score < 0
    # false positives of the filter add to a count, be it an n-gram's or its history's
    assert min(gaps) > -0.05 and max(gaps) < 0.2 and abs(sum(gaps) / len(gaps)) < 0.02
    own = [r for r in out if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_both_ways(spark, order):
    """A broadcast filter and one that stays dealt out give the same scores, words that aren't frequent included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: r for r in lm.score(docs, order=order, broadcast_bytes=size).collect()} for size in (1 << 30, 0))
    want = brute_scores({r.doc_id: r.text for r in docs.collect()}, order)
    for k, r in one.items():
        assert r.score == pytest.approx(other[k].score, abs=1e-9) and r.base_score == pytest.approx(other[k].base_score, abs=1e-9)
        assert abs(r.score - want[k][5]) / r.n_tokens < 0.2


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3)  # nearly every word is rare
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_scores({r.doc_id: r.text for r in docs.collect()})
    for r in lm.score(docs).collect():
        assert r.n_known == want[r.doc_id][2] and r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_filter():
    """No n-gram is missed or gets too small a count; few that aren't there are found."""
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 2**63, 20_000).astype(np.uint64), np.maximum(1, (1 / rng.random(20_000) ** 1.5)).astype(np.int64)
    bits = lm.build(keys, counts)
    table = lm.Filter.of(1, 1, [(1, 0, bits.tobytes())], bits.nbytes)
    levels = table.levels(keys, 1)
    want = np.searchsorted(lm.STEPS, counts, side="right")
    assert (levels >= want).all() and (levels > want).mean() < 0.02
    assert (table.levels(rng.integers(0, 2**63, 50_000).astype(np.uint64), 1) > 0).mean() < 0.02
    assert abs(len(bits) * 64 / want.sum() - lm.ENTRY_BITS) < 0.1


def test_probabilities_sum_to_one_at_most():
    """Over all words and one that is unknown, after any history, with exact counts."""
    import random

    random.seed(3)
    docs = {k: " ".join(random.choice("abcdefg") for _ in range(random.randrange(0, 30))) for k in range(40)}
    base = brute_scores(docs)
    assert base
    texts = {k: t for k, t in docs.items()}
    words = [*"abcdefg", "\n", "unknown"]
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    pairs, single = Counter(), Counter()
    for k in train:
        own = ["^", *tokens_of(texts[k])]
        pairs.update(zip(own, own[1:]))
        single.update(own)
    total, v = sum(n for w, n in single.items() if w != "^"), len(single) - 1
    low, high = [0, *lm.STEPS.tolist()], [0, *(lm.STEPS[1:] - 1).tolist()]
    step = lambda c: int(np.searchsorted(lm.STEPS, c, side="right"))
    for h in ["^", *"abcdefg"]:
        up = high[step(single[h])]
        p = sum((min(low[step(pairs[h, w])], up) + 2.5 * (low[step(single[w])] + 1) / (total + v + 1)) / (up + 2.5) for w in words)
        assert p <= 1 + 1e-12


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (2, " \t\n"), (3, "A a b \x0b c"), (4, "x" * 100_000), (5, "w " * 50_000)] + [(k, "a b c") for k in range(10, 40)]
    df = spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, n int, score string")
    out = lm.score(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.n_tokens for r in by[1]] == [1, 1] and by[2][0].n_tokens == 1 and by[3][0].n_tokens == 4 and by[5][0].n_tokens == 50_001
    assert by[None][0].held_out is None and by[None][0].n_tokens == 3
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm.score(df.limit(0)).collect() == []
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2)
    alone = lm.score(df.where("doc_id = 3").selectExpr(f"{held}L AS doc_id", "text")).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0 and alone[0].score == 0.0 and alone[0].base_score == 0.0


def test_tokens():
    t = lm.Tokens.of(pa.array([" A b\tA\n", None, "", "c\x0bÉ x"]))
    assert [t.words[i] for i in t.word] == ["a", "b", "a", "\n", "\n", "\n", "c", "É x", "\n"]
    assert t.doc.tolist() == [0, 0, 0, 0, 1, 2, 3, 3, 3]
