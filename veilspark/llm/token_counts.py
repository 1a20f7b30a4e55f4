"""Token counts with a whole-token shortcut.

Which vocabulary strings are one token by themselves is proved offline, once a vocabulary; a pre-token among
them counts 1 without any merging.  Only the rest is merged, with a bounded table of recent results.  One pass
over the scan, no shuffle: rows never meet, so hot sources and groups of copies change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, ship, tidied
from .vocab import Codec, VocabFile, whole_tokens

ship(__name__)

#: Entries of a worker's table of merged pre-tokens before it starts anew (some 60 MB).
CACHE_ENTRIES = 400_000


def token_counts(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), for every row.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated results; an empty table gives
    an empty result; further columns of the input are left out; a null id stays null.
    """
    spark = docs.sparkSession
    vocab = VocabFile.load(vocab_path)
    proved = whole_tokens(vocab)
    sent = spark.sparkContext.broadcast((vocab.plain(), proved))  # bounded by the vocabulary file
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, whole = sent.value
        codec = Codec.of(VocabFile(*plain))
        known: dict[str, int] = {}

        def merged(word: str) -> int:
            n = known.get(word)
            if n is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                n = known[word] = len(codec.piece(word.encode()))
            return n

        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                if codec.odd(text):
                    n_tokens.append(len(codec.library.encode(text, add_special_tokens=False).ids))
                    continue
                words = codec.split(text)
                rest = [w for w in words if w not in whole]
                n_tokens.append(len(words) - len(rest) + sum(map(merged, rest)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return only(docs, id_col, text_col).mapInArrow(tidied(count, True), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
