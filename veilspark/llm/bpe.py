"""Byte-level BPE over a corpus by a global shuffle of distinct words.

1. Every scan task splits its texts into pre-tokens, in blocks of bounded size.  A block keeps its documents as
   numbers of its distinct words in text order (the positions), and sends each distinct word once, with the
   block's and the word's number.  Words travel in packets: one for each block and bucket of word hashes.
2. A bucket's owner encodes each distinct word once, whichever blocks ask for it, and answers each packet.  A
   frequent word comes once a block, not once an occurrence.
3. The answers meet the block's documents again (one partition, sorted, streamed), which are put together by
   position.

Decoding joins ids with the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship, tidied
from .vocab import Codec, VocabFile, ranks_are_merges

ship(__name__)

#: Characters of text in a block, besides its last document, and distinct words at which a block ends.
BLOCK_CHARS = 16_000_000
BLOCK_WORDS = 400_000
#: Buckets of word hashes, at least.
BUCKETS = 512
#: Sorts a block's documents behind the answers, whose number is that of their bucket.
LAST = 2**31 - 1


class Numbered(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encode(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, for every row.

    A null text is empty and has no ids.  Repeated rows, and rows with the same or no id, are encoded each.
    Further columns are left out; an empty table gives no rows.  A .json vocabulary whose ranks aren't its merges is
    a ValueError; special strings are plain text.
    """

    def maker(_):
        import numpy as np

        def lists_of(lists: list) -> list[pa.Array]:
            offsets = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.empty(0, "<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]

        return lists_of

    return encoded(docs, vocab_path, id_col, text_col, maker, {"ids": "array<int>"})


def encoded(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, maker: Callable, columns: dict[str, str]) -> DataFrame:
    """doc_id and the given columns (name: type) of every row, where each text's ids come together: maker(codec), called
    once a task, gives a function from lists of ids to Arrow arrays."""
    vocab = VocabFile.load(vocab_path)
    if vocab.kind == "json" and not ranks_are_merges(vocab):
        raise ValueError("the ids of this vocabulary aren't in the order of its merges")
    sent = docs.sparkSession.sparkContext.broadcast(vocab.plain())  # bounded by the file
    id_type = docs.schema[id_col].dataType.simpleString()
    source = only(docs, id_col, text_col)
    buckets = max(BUCKETS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches: Iterator[pa.RecordBatch], numbers: bool):
        """(block, {word: number}, [(id, numbers)]) again and again, the same for each run over a split.  A block's
        name also holds a stamp of its words: were splits dealt otherwise in another run, the block would find
        no answers and fail, not mix up words."""
        import zlib

        import numpy as np
        from pyspark import TaskContext

        codec = Codec.of(VocabFile(*sent.value))
        block, words, rows, chars = TaskContext.get().partitionId() << 20, Numbered(), [], 0

        def name() -> int:
            import itertools

            return block << 24 | zlib.crc32("".join(itertools.islice(words, 1000)).encode() + b"%d" % len(words)) & 0xFFFFFF

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                pieces = map(words.__getitem__, codec.split(text))
                rows.append((key.as_py(), np.fromiter(pieces, dtype="<u4")) if numbers else all(n >= 0 for n in pieces))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(words) >= BLOCK_WORDS:
                    yield name(), words, rows
                    block, words, rows, chars = block + 1, Numbered(), [], 0
        if rows:
            yield name(), words, rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block, words, _ in blocks(batches, False):
            coded = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) for w in coded), "u4", len(coded)) % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            packets = []
            for numbers in np.split(order, starts[1:]):
                numbers = sorted(numbers.tolist(), key=coded.__getitem__)  # neighbours alike: they compress better
                own = [coded[n] for n in numbers]
                packets.append(squeeze(np.array([len(numbers), *numbers, *map(len, own)], "<u4").tobytes() + b"".join(own)))
            for i in range(0, len(packets), 200):
                some = packets[i : i + 200]
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 200].astype("i4"), pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(some, pa.binary())], names=["bucket", "block", "packet"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        squeeze, open_ = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        codec, now, known = Codec.of(VocabFile(*sent.value)), None, {}
        for batch in batches:
            out = []
            for bucket, packet in zip(batch.column(0).to_pylist(), batch.column(2)):
                if bucket != now or len(known) > BLOCK_WORDS:
                    now, known = bucket, {}
                raw = open_(packet.as_py())
                n = int.from_bytes(raw[:4], "little")
                numbers, sizes = np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u4", n, 4 + 4 * n)
                ends = (4 + 8 * n + np.cumsum(sizes)).tolist()
                ids, start = [], 4 + 8 * n
                for end in ends:
                    word, start = raw[start:end], end
                    if word not in known:
                        known[word] = codec.piece(word)
                    ids.append(known[word])
                flat = np.array([i for x in ids for i in x], "<u4")
                out.append(squeeze(np.array([n], "<u4").tobytes() + planes(numbers) + planes(np.array([*map(len, ids)], "<u4")) + planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "number", "data"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as numbers; they sort behind the answers of their block.  Compressed: a number has 10 bits
        of news or so."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        kind = pa.from_numpy_dtype("int32")
        for block, _, rows in blocks(batches, True):
            for i in range(0, len(rows), 500):
                some = rows[i : i + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int64()), pa.array([LAST] * len(some), kind), pa.array([squeeze(planes(x)) for _, x in some], pa.binary()), pa.array([k for k, _ in some], batch_type)],
                    names=["block", "number", "data", id_col],
                )

    def planes(numbers) -> bytes:
        """The four bytes of each number apart, low ones first: the high ones are mostly zero."""
        import numpy as np

        return np.ascontiguousarray(np.ascontiguousarray(numbers).view("u1").reshape(len(numbers), 4).T).tobytes()

    def whole(raw: bytes):
        import numpy as np

        return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, len(raw) // 4).T).reshape(-1).view("<u4")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        finish = maker(Codec.of(VocabFile(*sent.value)))
        now, table = None, {}

        def batch_of(keys: list, lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, batch_type), *finish(lists)], names=[id_col, *columns])

        for batch in batches:
            keys, lists, size = [], [], 0
            for block, number, data, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if block != now:
                    now, table = block, {}
                raw = open_(data.as_py())
                if number != LAST:
                    n = int.from_bytes(raw[:4], "little")
                    numbers, sizes = whole(raw[4 : 4 + 4 * n]).tolist(), whole(raw[4 + 4 * n : 4 + 8 * n])
                    ids, ends = whole(raw[4 + 8 * n :]).tobytes(), (4 * np.cumsum(sizes)).tolist()
                    table.update(zip(numbers, (ids[a:b] for a, b in zip([0, *ends], ends))))
                    continue
                keys.append(key.as_py())
                lists.append(np.frombuffer(b"".join(map(table.__getitem__, whole(raw).tolist())), "<i4"))
                size += len(lists[-1])
                if size > 1_000_000:
                    yield batch_of(keys, lists)
                    keys, lists, size = [], [], 0
            if keys:
                yield batch_of(keys, lists)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema[id_col].dataType)
    asked = source.mapInArrow(tidied(ask, True), "bucket int, block long, packet binary").repartition("bucket").sortWithinPartitions("bucket")
    answered = asked.mapInArrow(tidied(answer, True), "block long, number int, data binary").withColumn(id_col, F.lit(None).cast(id_type))
    kept = source.mapInArrow(tidied(keep, True), f"block long, number int, data binary, `{id_col}` {id_type}")
    # The kept documents come first: the number of a union's task is then that of the split, as in the other pass.
    return kept.unionByName(answered).repartition("block").sortWithinPartitions("block", "number").mapInArrow(tidied(gather, True), f"`{id_col}` {id_type}, " + ", ".join(f"{n} {t}" for n, t in columns.items()))


def decode(coded: DataFrame, vocab_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data binary: the bytes of each row's ids, joined with the token-byte table.  Null ids are none;
    an id outside the vocabulary fails."""
    sent = coded.sparkSession.sparkContext.broadcast(VocabFile.load(vocab_path).plain())
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codec.of(VocabFile(*sent.value)).token_bytes()
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "data"])

    return only(coded, id_col, ids_col).mapInArrow(tidied(run, True), f"`{id_col}` {id_type}, data binary")


def round_trip(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode by the token-byte table, and digest both where
    a text's ids come together, so that neither leaves its worker.  Rows as for encode."""

    def maker(codec: Codec):
        table = codec.token_bytes()
        names = [str(i).encode() for i in range(len(table))]

        def digests(lists: list) -> list[pa.Array]:
            counts, of_ids, of_text = [], [], []
            for ids in lists:
                ids = ids.tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

        return digests

    return encoded(docs, vocab_path, id_col, text_col, maker, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
