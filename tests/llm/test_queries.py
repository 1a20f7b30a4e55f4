"""Each registered query over its whole tables at the smallest scale, against plain Python."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from test_fingerprint import expected, result
from test_operators import brute
from tokenizers import Tokenizer

from veilspark.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    out = rows(spark, "op1_toxicity")
    assert Counter(r.doc_id for r in out) == Counter(list(texts))
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
        none = 1 - model.leak
        for _, _, p in model.sentences(texts[r.doc_id] or ""):
            none *= 1 - p
        assert r.score == pytest.approx(1 - none, abs=1e-9)
        for s in r.spans:
            assert s.probability >= 0.5 and 0 <= s.start < s.end <= len(texts[r.doc_id])


def test_op2(spark, texts):
    library = Tokenizer.from_file(JSON)
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for p in rows(spark, "op2_packing"):
        by_document[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_document) == set(texts)
    for k, own in by_document.items():
        ids, at = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(own, key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(n for own in by_sequence.values() for _, n in own)
    assert used / (2048 * len(by_sequence)) > 0.97


def test_op3(spark, texts):
    out = rows(spark, "op3_sharding")
    assert Counter(r.doc_id for r in out) == Counter(list(texts)) and all(r.shard.endswith(".parquet") and r.shard_bytes > 0 for r in out)
    assert len({(r.shard, r.shard_bytes, r.level) for r in out}) == len({r.shard for r in out})


def test_op4(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, "op4_bpe"):
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op5(spark):
    chats = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    hard = r"\### Assistant: </turn> ok"
    chats[-7] = [(0, "user", hard), (1, "assistant", hard)]
    out = {r.conv_id: r for r in rows(spark, "op5_chat")}
    assert set(out) == set(chats)
    for k, own in chats.items():
        own = sorted(own)
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learned = "".join(text for _, role, text in own if role == "assistant")
        assert (out[k].n_turns, out[k].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (out[k].loss_chars, out[k].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert out[k].formatted_chars > sum(len(t) for _, _, t in own)


def test_op6(spark, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op6_jaccard")} == brute(texts, 4, 85)


def test_op7(spark, texts):
    library = Tokenizer.from_file(JSON)
    for r in rows(spark, "op7_token_counts"):
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def measures(t):
    """The measures and votes of a text, in plain Python."""
    import regex

    w = WORDS.findall(t)
    n, c = len(w), sum(map(len, w))
    windows = Counter(zip(w, w[1:], w[2:]))
    again = len({j for i in range(n - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    m = {"symbols": sum(x in "#*$%&|<>" for x in t), "dup": len(lines) - len(set(lines)), "again": again, "upper": len(regex.findall(r"\p{Lu}", t)), "caps": len(regex.findall(r"\p{Lu}{2,}", t))}
    m |= {"shouts": t.count("!"), "runs": len(re.findall(r"[#*$%&|<>]+", t)), "letters": len(regex.findall(r"\p{L}", t)), "doubled": sum(a == b for a, b in zip(w, w[1:])), "stops": len(re.findall(r"[.?;:](?=[ \t\n\x0b\f\r]|$)", t))}

    def vote(bad, good=False):
        return 0 if n == 0 else -1 if bad else 1 if good else 0

    votes = (
        vote(m["upper"] * 12 > c, m["upper"] * 25 <= c), vote(m["caps"] * 20 > n, m["caps"] * 100 <= n), vote(m["shouts"] * 20 > n), vote(m["symbols"] * 20 > n, m["symbols"] * 200 <= n),
        vote(m["runs"] * 25 > n), vote(m["letters"] * 100 < c * 90, m["letters"] * 100 >= c * 94), vote(m["dup"] * 5 > len(lines), m["dup"] == 0 and len(lines) > 2), vote(again * 20 > n, again * 100 <= n),
        vote(m["doubled"] * 50 > n, m["doubled"] * 200 <= n), vote(c * 10 < n * 42 or c > n * 7, c * 10 >= n * 46 and c <= n * 6), vote(m["stops"] * 40 < n or m["stops"] * 5 > n, m["stops"] * 25 >= n and m["stops"] * 7 <= n),
    )
    return (n, c, m["symbols"], m["dup"], again), votes


def test_op8(spark, texts):
    from test_quality import brute_em

    want = {k: measures(t or "") for k, t in texts.items()}
    failed = {k: m[0] < 50 or 100 * m[4] > 50 * m[0] for k, (m, _) in want.items()}
    order = [k for k in texts if not failed[k]]
    quality = dict(zip(order, brute_em([want[k][1] for k in order])))
    out = rows(spark, "op8_quality")
    assert Counter(r.doc_id for r in out) == Counter(list(texts))
    for r in out:
        m, votes = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.bad_votes) == (*m, failed[r.doc_id], votes.count(-1))
        assert r.quality == pytest.approx(quality.get(r.doc_id, 0.0), abs=1e-6) and r.kept == (quality.get(r.doc_id, 0.0) >= 0.5)


def test_op9(spark, texts):
    out = {r.doc_id: r for r in rows(spark, "op9_pii")}
    assert set(out) == set(texts)
    changed = 0
    for k, t in texts.items():
        new, n = out[k].text, sum(out[k][c] for c in out[k].asDict() if c.startswith("n_"))
        if t is None or not re.search("[0-9@=:]|AKIA", t):
            assert new == t and n == 0
        if n:
            changed += new != t
            assert not set(re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+", t)) & set(re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+", new))
    assert changed


def test_op10(spark, texts):
    assert result(queries.QUERIES["op10_fingerprints"](spark, SF)) == expected([*texts.items()])
