"""Columns of the caller whose names are those that operators use inside: results stay, columns stay."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import bpe, chat, fingerprint, jaccard, packing, pii, quality, token_counts, toxicity

NAMES = (
    "_v_new _v_key _v_gone_id _v_gone_key _v_measures _v_measures_l _v_posterior _v_case __v_new _new _key _gone_id _gone_key _quality _quality_measures "
    "_posterior _vote_case _y _text k t h p m id key node n bits bucket packet shard score spans quality kept component_id start length ids kind feature y bag a b c"
).split()
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = toxicity.Model({"=zorg": 4.0}, -1.0, 0.1, frozenset({"zorg"}))


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "zorg zorg. call 212-555-0100"), (-3, "zorg " * 60), (-3, "zorg " * 60)], "doc_id long, text string")
    return docs.unionByName(odd).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).cache()


OPERATORS = {
    "toxicity": lambda d: toxicity.score(d, MODEL),
    "fit": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))),
    "packing": lambda d: packing.pack(d, JSON).select("doc_id", "start", "length", "doc_tokens"),
    "bpe": lambda d: bpe.round_trip(d, RANKS),
    "jaccard": jaccard.near_duplicates,
    "token_counts": lambda d: token_counts.token_counts(d, JSON),
    "quality": quality.judge,
    "fingerprint": fingerprint.edits,
    "fingerprints": fingerprint.fingerprints,
    "pii": lambda d: pii.pseudonymise(d, "k").select("doc_id", "text", "n_phone"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_mind_no_further_columns(name, plain, clashing):
    run = OPERATORS[name]
    assert sorted(map(str, run(clashing).collect())) == sorted(map(str, run(plain).collect()))


STAGES = {
    "quality": quality.keep_good,
    "toxicity": lambda d: toxicity.keep_clean(d, MODEL),
    "jaccard": jaccard.keep_one,
    "pii": lambda d: pii.pseudonymise(d, "k", counts=False),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(name, plain, clashing):
    out = STAGES[name](clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    assert sorted(str(r[:2]) for r in map(tuple, rows)) == sorted(str(tuple(r)) for r in STAGES[name](plain).collect())
    assert STAGES[name](clashing.where("false")).collect() == []


def test_pipeline_stages_keep_further_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.lit(n) for n in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() and docs.columns[-len(NAMES) :] == list(NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_chats_mind_no_further_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    more = turns.select("*", *[F.lit(n).alias(n) for n in (*NAMES, "ts", "ps", "js", "part", "mask", "formatted")])
    assert sorted(map(str, chat.read_back(chat.format_chats(more)).collect())) == sorted(map(str, chat.read_back(chat.format_chats(turns)).collect()))
