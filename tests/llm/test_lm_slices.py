"""The language model whose filter stays dealt out: units, slices and words, against a broadcast filter and exact sets."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import lm

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("order,unit,partitions", [(1, 2_000, 3), (2, 2_000, 7), (2, 1, 2), (3, 30_000, 1)])
def test_many_units_and_slices(spark, monkeypatch, order, unit, partitions):
    """Units that end within blocks, partitions and batches; repeated rows, null ids and null texts."""
    monkeypatch.setattr(lm, "UNIT_BYTES", unit)
    monkeypatch.setattr(lm, "SLICE_BYTES", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (3, None), (4, ""), (5, " \t "), (6, "é" * 30_000), (7, "w " * 3_000), (7, "w " * 3_000)], "doc_id long, text string")
    docs = docs.union(odd).repartition(partitions)
    dealt, sent = (rows_of(lm.score(docs, order=order, broadcast_bytes=size)) for size in (0, 1 << 30))
    assert dealt == sent and sum(dealt.values()) == docs.count()


def test_words_are_not_joined_row_by_row(spark):
    """Exact counts of words come with the answers of the slices: no row for each word of each document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lm.score(docs, broadcast_bytes=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = lambda text: lm.Tokens.of(pa.array([text]))
    train = Counter()
    for k, text in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            t = words(text)
            train.update(t.words[i] for i in t.word)
    total, v = sum(train.values()), len(train)
    for r in out.collect():
        t = words(texts[r.doc_id])
        own = [train[t.words[i]] for i in t.word]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c > 0 for c in own), total)
        assert r.base_score == pytest.approx(np.log10((np.array(own) + 1) / (total + v + 1)).sum(), rel=1e-9)


def test_no_rows_or_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, broadcast_bytes=0).collect() == []
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm.score(spark.createDataFrame([(held, "a b")], none.schema), broadcast_bytes=0).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    blank = lm.score(spark.createDataFrame([(held + 1, None)] * 3, none.schema), broadcast_bytes=0).collect()
    assert [(r.n_tokens, r.n_known) for r in blank] == [(1, 1)] * 3


def test_hashes_of_words():
    words = ["", "a", "aa", "12345678", "123456789", "1234567812345678", "é" * 50, "x" * 8, "x" * 16, "\0", "\0\0"]
    whole = lm.word_hashes(pa.array(words, pa.large_string()))
    assert len(set(whole.tolist())) == len(words)
    assert lm.word_hashes(pa.array(words, pa.large_string())[3:7]).tolist() == whole[3:7].tolist()
    assert len(lm.word_hashes(pa.array([], pa.large_string()))) == 0
    x = np.array([0, 1, 255, 256, 70_000, 2**40])
    for n in range(len(x) + 1):
        assert lm._widened(lm._narrow(x[:n])).tolist() == x[:n].tolist()
    keys = np.array([0, 1, 2**48 - 1], np.uint64)
    assert lm._long(lm._short(keys).tobytes()).tolist() == keys.tolist()
