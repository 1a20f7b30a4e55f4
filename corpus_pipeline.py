"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import jaccard, packing, pii, quality, toxicity
from veilspark.llm.common import read, write_once

#: The example's key; a user brings a secret one.
KEY = "example-key"


#: All stages take a null text as empty, and whole texts of any length; equal rows and ties are decided alike; an empty table
#: gives an empty one; further columns of docs are kept by all but the last.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those without words, and those whose posterior is below a half.  Equal texts stay or
    go together."""
    return quality.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labels of documents that are still there.  A null or empty text has
    the score of a text without toxic words; without any label all documents stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id: five words to a shingle, similarity of 0.8 or more.  Documents
    without words are linked with nothing and stay, each."""
    return jaccard.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms, no document goes; n_chars follows the text if there is such a column.  A null text
    stays null, and an n_chars with it."""
    hidden = pii.pseudonymise(docs, KEY, counts=False)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 2048 tokens.  A null or empty text is its end token alone; equal rows
    have pieces each; no further column is returned."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Expectation-maximisation, a trained classifier and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
