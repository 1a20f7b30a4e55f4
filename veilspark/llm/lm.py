"""An n-gram language model in a log-frequency Bloom filter.

A count is quantised to the number of thresholds that it reaches (1, 2, 3, 4, 6, 8 ... growing by a quarter);
an n-gram enters the filter once for each of them, so frequent ones cost more and are found by repeated
probes.  A slice of the filter is built where its n-grams meet, sized by what it has to hold: 14 bits an entry, whatever
the corpus.  A small filter is broadcast.  Otherwise it stays dealt out, and n-grams travel once: a block of documents
sends each slice its distinct n-grams with their counts, the slice sums them, fills its part of the filter, asks it and
answers with a byte for each n-gram, in the order in which they came.  Both ways give the same scores.

Probabilities: P1(w) = (c(w) + 1) / (N + V + 1), with one share for words never seen; for longer n-grams
P(w | h) = (c(hw) + m P(w | shorter h)) / (c(h) + m).  Counts of hw are rounded down and those of h up, so that a history
gives away at most what it has; m follows from the corpus (the mass that must be left for n-grams seen once).  A false
positive of the filter (about one probe in 200) is cut by the counts of the n-gram's own parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, only, process_cache, ship, tidied, write_once

ship(__name__)

#: Training rows are those whose crc32(id as text) mod FOLDS isn't HELD_OUT.
FOLDS, HELD_OUT = 7, 2
#: Bits of the filter for an entry, and bits set for one, all in a word of 64.
ENTRY_BITS, PROBES = 14, 5
#: A filter of this size at most is broadcast: each Python worker of an executor holds it.
BROADCAST_BYTES = 32 << 20
#: Text of a unit, whose distinct n-grams travel together, and text for each slice of a filter that isn't broadcast.
UNIT_BYTES, SLICE_BYTES = 6 << 20, 16 << 20
#: What a document counts for besides its text.
ROW_BYTES = 16
#: An n-gram is named by a number of so many bytes: a clash is far less likely than a false find.
KEY_BYTES = 6
#: Words that are at least one in FREQUENT of all tokens have their exact counts broadcast: no more than FREQUENT words, of
#: FREQUENT times the mean length of a token together.
FREQUENT = 200_000
#: n-grams that a task gathers before it hands them on.
GATHERED = 4_000_000
#: The end of a text, as a word that no text holds.
END = "\n"
#: What stands before a text, likewise.
START = "\n\n"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64((1 << 8 * KEY_BYTES) - 1)


def thresholds() -> np.ndarray:
    """1, 2, 3, 4, 6, 8, 10, 13 ...: each the next whole number, or a quarter more."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, np.int64)


STEPS = thresholds()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in a reproducible disorder."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter, among ``words`` of them, and the bits in it for each key at a level."""
    h = mixed(keys + _ODD * np.array([level + 1], np.uint64))
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(30)) * words) >> np.uint64(34), bits


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slice of the filter that holds these n-grams; at least one word."""
    levels = np.searchsorted(STEPS, counts, side="right")
    words = max(1, -(-int(levels.sum()) * ENTRY_BITS // 64))
    out = np.zeros(words, np.uint64)
    for level in range(int(levels.max(initial=0))):
        at, bits = _places(keys[levels > level], level, np.uint64(words))
        np.bitwise_or.at(out, at, bits)
    return out


def probe(keys: np.ndarray, table: np.ndarray, starts: np.ndarray, words: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The level of each key: probes go on as long as the filter says yes."""
    found = np.zeros(len(keys), np.int32)
    live = np.arange(len(keys))
    level = 0
    while len(live):
        own = slices[live]
        at, bits = _places(keys[live], level, words[own])
        live = live[(table[starts[own] + at.astype(np.int64)] & bits) == bits]
        level += 1
        found[live] = level
    return found


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64 bits for each word: mixed from its length and its pieces of eight bytes with their places."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-size // 8))
    first = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    kept = np.minimum(np.repeat(size, pieces) - 8 * nth, 8)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    piece = eight[np.repeat(offsets[:-1] - offsets[0], pieces) + 8 * nth] & masks[kept]
    return mixed(np.add.reduceat(mixed(piece + _ODD * (nth + 1).astype(np.uint64)), first) + size.astype(np.uint64))


@dataclass
class Grams:
    """The distinct n-grams of one length in a batch of texts: their keys, and which of them ends at each token.  Of
    longer ones also the n-gram before the last word (the number behind the last one: a start) and that without the first."""

    keys: np.ndarray
    of: np.ndarray
    history: np.ndarray | None = None
    shorter: np.ndarray | None = None
    #: Tokens in the order of their n-grams, and where each n-gram begins there.
    order: np.ndarray | None = None
    begins: np.ndarray | None = None

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of a whole number for each token, the sum for each n-gram."""
        if self.order is None:
            return np.bincount(self.of, weights=x, minlength=len(self.keys)).astype(np.int64)
        return np.add.reduceat(x[self.order], self.begins)


@dataclass
class Tokens:
    """The tokens of a batch of texts: distinct words, and for each token its document and its word."""

    vocabulary: pa.LargeStringArray
    word: np.ndarray
    doc: np.ndarray
    n_docs: int

    @cached_property
    def words(self) -> list[str]:
        return self.vocabulary.to_pylist()

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        """Words between ASCII blanks, A-Z lower-cased, then an end for each text; a null text is empty."""
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        coded = flat.dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy()
        if (blank := words.index("").as_py()) >= 0:  # blanks at an end of a text
            kept = word != blank
            word, doc = word[kept], doc[kept]
        n = len(lists)
        ends = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
        out, own = np.full(len(word) + n, len(words), np.int64), np.repeat(np.arange(n), np.diff(ends, prepend=-1))
        out[np.arange(len(word)) + doc] = word
        return cls(pa.concat_arrays([words, pa.array([END], pa.large_string())]), out, own, n)

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.doc) else np.zeros(0, bool)

    def distinct(self, order: int) -> list[Grams]:
        """For each length the n-grams, in an order that follows from the texts."""
        one = word_hashes(self.vocabulary)
        out = [Grams(mixed(one) & _KEY, self.word)]
        for length in range(2, order + 1):
            last = out[-1]
            n = len(last.keys)
            before = np.where(self.first, n, np.concatenate([[n], last.of[:-1]])) if len(last.of) else last.of
            code = before * len(one) + self.word
            by = np.argsort(code)
            code = code[by]
            new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(new) - 1
            some = by[new]  # a token of each
            keys = _longer(np.append(last.keys, start(length - 1))[before[some]], one[self.word[some]])
            out.append(Grams(keys, of, before[some], last.of[some], by, np.flatnonzero(new)))
        return out

    def grams(self, order: int) -> list[np.ndarray]:
        """For each length the n-gram that ends at each token; before a text stand starts."""
        return [g.keys[g.of] for g in self.distinct(order)]

def _longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * _ODD + word) & _KEY


def start(length: int) -> np.uint64:
    """The history before a text, as an n-gram of starts."""
    return mixed(np.array([length], np.uint64) + np.uint64(0x53544152545F))[0] & _KEY


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((mixed(keys + np.uint64(77)) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _fold() -> Column:
    return F.crc32(F.col("id").cast("string")) % FOLDS


def _training(texts: DataFrame) -> DataFrame:
    """Rows with a null id are learned from."""
    return texts.where(F.coalesce(_fold() != HELD_OUT, F.lit(True)))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: exact counts of the tokens of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens.of(batch.column(0))
            n = np.bincount(tokens.word, minlength=len(tokens.words))
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.words, pa.string()).take(pa.array(kept)), pa.array(n[kept], pa.int64())], names=["word", "n"])

    return only(docs, text_col).mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def filter_slices(docs: DataFrame, order: int, slices: int, text_col: str = "text") -> DataFrame:
    """length, slice, bits, and of the n-grams behind it: n_grams, singles (those seen once), histogram (how many
    reach each quantised count).  Tasks count n-grams first and hand on a packet for each slice."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        texts = 0

        def out():
            for length in range(order):
                grams = np.concatenate([*held[length], np.zeros(0, np.uint64)])
                if length + 1 < order:  # starts are histories, too
                    grams = np.concatenate([grams, np.full(texts, start(length + 1))])
                keys, counts = np.unique(grams, return_counts=True)
                own = slice_of(keys, slices)
                cuts = np.searchsorted(np.sort(own), np.arange(slices + 1))
                by = np.argsort(own, kind="stable")
                parts = [(k, by[cuts[k] : cuts[k + 1]]) for k in range(slices) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([length + 1] * len(parts), pa.int32()), pa.array([k for k, _ in parts], pa.int32()),
                        pa.array([keys[p].tobytes() for _, p in parts], pa.binary()), pa.array([counts[p].astype("<u4").tobytes() for _, p in parts], pa.binary()),
                    ],
                    names=["length", "slice", "keys", "counts"],
                )
                held[length].clear()

        for batch in batches:
            tokens = Tokens.of(batch.column(0))
            texts += tokens.n_docs
            for kept, grams in zip(held, tokens.grams(order)):
                kept.append(grams)
            if sum(map(len, held[0])) >= GATHERED:
                yield from out()
                texts = 0
        yield from out()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = None
        now, waiting = None, []

        def merge():
            nonlocal keys, counts
            both, n = np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting])
            by = np.argsort(both, kind="stable")
            both, n = both[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            keys, counts = both[first], np.add.reduceat(n, first)
            waiting[:] = [(keys, counts)]

        def out():
            merge()
            levels = np.searchsorted(STEPS, counts, side="right")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([build(keys, counts).tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()),
                    pa.array([int((counts == 1).sum())], pa.int64()), pa.array([np.bincount(levels).tolist()], pa.list_(pa.int64())),
                ],
                names=["length", "slice", "bits", "n_grams", "singles", "histogram"],
            )
            waiting.clear()

        for batch in batches:
            for length, own, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (length, own) != now and waiting:
                    yield from out()
                now = (length, own)
                waiting.append((np.frombuffer(k, np.uint64), np.frombuffer(c, "<u4").astype(np.int64)))
            if sum(len(k) for k, _ in waiting[1:]) > GATHERED:
                merge()
        if waiting:
            yield from out()

    packets = only(docs, text_col).mapInArrow(tidied(gather), "length int, slice int, keys binary, counts binary")
    met = packets.repartition("length", "slice").sortWithinPartitions("length", "slice")
    return met.mapInArrow(tidied(put), "length int, slice int, bits binary, n_grams long, singles long, histogram array<long>")


@dataclass
class Filter:
    """Slices of the filter by length of n-gram, all or some of them."""

    order: int
    slices: int
    table: np.ndarray
    starts: np.ndarray  # of length x slice
    words: np.ndarray

    @classmethod
    def of(cls, order: int, slices: int, rows, size: int) -> Filter:
        """Of rows (length, slice, bits) with ``size`` bytes of bits.  Slices without n-grams share an empty word."""
        table, starts, words, at = np.zeros(1 + size // 8, np.uint64), np.zeros(order * slices, np.int64), np.ones(order * slices, np.uint64), 1
        for length, own, bits in rows:
            part = np.frombuffer(bits, np.uint64)
            starts[(length - 1) * slices + own], words[(length - 1) * slices + own] = at, len(part)
            table[at : at + len(part)] = part
            at += len(part)
        return cls(order, slices, table, starts, words)

    def levels(self, keys: np.ndarray, length: int) -> np.ndarray:
        return probe(keys, self.table, self.starts, self.words, (length - 1) * self.slices + slice_of(keys, self.slices))


@dataclass(frozen=True)
class Model:
    """What the scores need besides the filter: order, N, V, and m for each length of n-gram; and the exact counts of
    frequent words."""

    order: int
    slices: int
    tokens: int
    vocabulary: int
    m: tuple[float, ...]
    frequent: dict[str, int] = field(default_factory=dict)

    def log_probabilities(self, tokens: Tokens, levels: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        """log10 of the probability of each token."""
        low = np.concatenate([[0], STEPS])
        high = np.concatenate([[0], STEPS[1:] - 1, STEPS[-1:]])
        grams = tokens.grams(self.order)
        first = np.concatenate([[True], tokens.doc[1:] != tokens.doc[:-1]]) if len(tokens.doc) else np.zeros(0, bool)
        p, history, last = None, None, None
        for length in range(1, self.order + 1):
            keys, back = np.unique(grams[length - 1], return_inverse=True)
            level = levels(keys, length)[back]
            if length == 1:
                p = (low[level] + 1.0) / (self.tokens + self.vocabulary + 1.0)
            else:
                level = np.minimum(np.minimum(level, last), history)  # no n-gram is more frequent than its parts
                m = self.m[length - 1]
                p = (np.minimum(low[level], high[history]) + m * p) / (high[history] + m)
            if length < self.order:
                start_level = levels(np.array([start(length)], np.uint64), length)[0]
                history = np.where(first, start_level, np.concatenate([[start_level], level[:-1]])) if len(level) else level
                last = level
        return np.log10(p)


def _mass(histogram: np.ndarray, singles: int) -> float:
    """m such that histories leave, all together, as much mass for what they haven't seen as n-grams seen once
    have: the sum of c(h) * m / (c(h) + m) is ``singles``."""
    c, w = STEPS[: len(histogram) - 1].astype(float), np.asarray(histogram[1:], float)
    if not len(c) or (w * c).sum() <= 0:
        return 1.0
    low, high = 1e-3, 1e9
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if (w * c * mid / (c + mid)).sum() < singles else (low, mid)
    return low


def _masses(slices: DataFrame, order: int) -> tuple[float, ...]:
    """m for each length, of slices with singles and histogram."""
    # a line for each length and quantised count: some 200 at most
    singles = {r["length"]: r["singles"] for r in slices.groupBy("length").agg(F.sum("singles").alias("singles")).collect()}
    cells = slices.select("length", F.posexplode("histogram").alias("level", "n")).groupBy("length", "level").agg(F.sum("n").alias("n")).collect()
    histograms = {k: np.zeros(len(STEPS) + 1) for k in range(1, order + 1)}
    for r in cells:
        histograms[r["length"]][r["level"]] = r["n"]
    return (1.0, *(_mass(histograms[k - 1], singles.get(k, 0)) for k in range(2, order + 1)))


def fit(docs: DataFrame, order: int = 2, text_col: str = "text", counts: DataFrame | None = None, slices: int | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all rows of docs, its slices (a written table), and the exact counts of words (a written table)."""
    spark = docs.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = counts if counts is not None else write_once(word_counts(docs, text_col), "words")
    slices_table = write_once(filter_slices(docs, order, slices, text_col), "filter")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = whole["n"] or 0, whole["v"]
    m = _masses(slices_table, order)
    frequent = {r["word"]: r["n"] for r in counts.where(F.col("n") * FREQUENT >= tokens).collect()} if tokens else {}
    return Model(order, slices, tokens, vocabulary, m, frequent), slices_table, counts


def _scored(batch: pa.RecordBatch, model: Model, levels: Callable, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each text, and a row for each of its words that isn't frequent."""
    tokens = Tokens.of(batch.column(batch.schema.names.index("text")))
    n = tokens.n_docs
    known = np.array([model.frequent.get(w, -1) for w in tokens.words], np.int64)
    log = np.log10((np.maximum(known, 0) + 1) / (model.tokens + model.vocabulary + 1))
    often = known[tokens.word] > 0
    base = np.bincount(tokens.doc[often], weights=log[tokens.word[often]], minlength=n).astype(float)  # of nothing it gives whole numbers
    n_known = np.bincount(tokens.doc[often], minlength=n)
    score = np.bincount(tokens.doc, weights=model.log_probabilities(tokens, levels), minlength=n).astype(float)
    ids = batch.column(batch.schema.names.index("id"))
    nulls = lambda kind, size: pa.nulls(size, kind)
    names = ["key", "word", "n", "id", "n_tokens", "n_known", "base_score", "score"]
    yield pa.RecordBatch.from_arrays(
        [keys, nulls(pa.string(), n), nulls(pa.int64(), n), ids, pa.array(np.bincount(tokens.doc, minlength=n)), pa.array(n_known), pa.array(base), pa.array(score)],
        names=names,
    )
    pairs, times = np.unique(tokens.doc[~often] * len(tokens.words) + tokens.word[~often], return_counts=True)
    for at in range(0, len(pairs), 50_000):
        part = pairs[at : at + 50_000]
        words = pa.array(tokens.words, pa.string()).take(pa.array(part % len(tokens.words)))
        own = keys.take(pa.array(part // len(tokens.words)))
        size = len(part)
        yield pa.RecordBatch.from_arrays(
            [own, words, pa.array(times[at : at + 50_000]), nulls(ids.type, size), nulls(pa.int64(), size), nulls(pa.int64(), size), nulls(pa.float64(), size), nulls(pa.float64(), size)],
            names=names,
        )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.Array]]:
    """Batches with a number each, and a key for each of their rows."""
    task, at = TaskContext.get().partitionId() << 40, 0
    for number, batch in enumerate(batches):
        yield task + number, batch, pa.array(range(task + at, task + at + batch.num_rows), pa.int64())
        at += batch.num_rows


def _by_broadcast(docs: DataFrame, model: Model, slices: DataFrame, size: int, schema: str) -> DataFrame:
    # BROADCAST_BYTES at most, as score() has checked; the driver takes a partition of slices at a time
    whole = Filter.of(model.order, model.slices, slices.select("length", "slice", "bits").toLocalIterator(), size)
    sent = docs.sparkSession.sparkContext.broadcast((model, whole))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value
        for _, batch, keys in _numbered(batches):
            yield from _scored(batch, model, table.levels, keys)

    return docs.mapInArrow(tidied(score, True), schema)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; that number comes first."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    """Keys as rows of KEY_BYTES bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _long(keys: bytes) -> np.ndarray:
    out = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _dealt(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the order of their slices, and where slices begin and end there."""
    own = slice_of(keys, slices)
    return np.argsort(own.astype(np.uint16) if slices < 1 << 16 else own, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(own, minlength=slices))])


def _units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Runs of rows of one block: the place of the first, texts, and which of them are learned from."""
    held, size, last = [], 0, None

    def out():
        places, texts, train = zip(*held)
        return places[0], pa.concat_arrays(texts), np.concatenate(train)

    for batch in batches:
        places, texts, train = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        sizes, begin = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0
        for i, place in enumerate(places):
            if last is not None and (place != last + 1 or place // rows != last // rows or size >= UNIT_BYTES):
                if i > begin:
                    held.append((places[begin], texts[begin:i], train[begin:i]))
                yield out()
                held, size, begin = [], 0, i
            last, size = place, size + sizes[i] + ROW_BYTES
        if places:
            held.append((places[begin], texts[begin:], train[begin:]))
    if held:
        yield out()


def _packets(texts: DataFrame, order: int, slices: int, rows: int) -> DataFrame:
    """Of each unit (its first place) and for each length a packet for each slice: its distinct n-grams and how often
    those occur in rows that are learned from.  Words travel as they are, longer n-grams as keys."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, own, train in _units(batches, rows):
            tokens = Tokens.of(own)
            learned = train[tokens.doc].astype(np.int64)
            for length, grams in enumerate(tokens.distinct(order), 1):
                keys, counts = grams.keys, grams.sums(learned)
                if length < order:  # starts are histories, too
                    keys, counts = np.append(keys, start(length)), np.append(counts, train.sum())
                by, cuts = _dealt(keys, slices)
                counts, filled = counts[by], np.flatnonzero(np.diff(cuts)).tolist()
                if length == 1:
                    words = pa.concat_arrays([tokens.vocabulary, pa.array([START] if order > 1 else [], pa.large_string())]).take(pa.array(by))
                    ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
                    text = memoryview(words.buffers()[2])
                    held = [bytes(text[ends[cuts[k]] : ends[cuts[k + 1]]]) for k in filled]
                    sizes = [_narrow(np.diff(ends[cuts[k] : cuts[k + 1] + 1])) for k in filled]
                else:
                    short = _short(keys[by])
                    held, sizes = [short[cuts[k] : cuts[k + 1]].tobytes() for k in filled], [None] * len(filled)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([length] * len(filled), pa.int32()), pa.array(filled, pa.int32()), pa.array([place] * len(filled), pa.int64()), pa.array(held, pa.binary()), pa.array(sizes, pa.binary()),
                        pa.array([_narrow(counts[cuts[k] : cuts[k + 1]]) for k in filled], pa.binary()),
                    ],
                    names=["length", "slice", "place", "keys", "sizes", "counts"],
                )

    return texts.select("place", "text", "train").mapInArrow(tidied(gather), "length int, slice int, place long, keys binary, sizes binary, counts binary")


def _answers(packets: DataFrame, slices: int) -> DataFrame:
    """For each packet the level of each n-gram in the filter, and for words their exact counts; for each slice a row
    without a place: tokens, words (different ones), singles, histogram."""

    def whole(length: int, own: int, held: list) -> Iterator[pa.RecordBatch]:
        places, packed, sizes, counts = zip(*held)
        counts = [_widened(c) for c in counts]
        cuts, tokens, words, exact = np.cumsum([0, *map(len, counts)]), 0, 0, None
        n = np.concatenate(counts)
        if length == 1:
            ends = np.concatenate([[0], np.cumsum(np.concatenate([_widened(x) for x in sizes]))])
            coded = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(packed))).dictionary_encode()
            of, keys = coded.indices.to_numpy(), mixed(word_hashes(coded.dictionary)) & _KEY
            total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)  # whole numbers below 2^53
            begun = coded.dictionary.index(START).as_py()
            if begun >= 0:
                keys[begun] = start(1)
            true = np.delete(total, begun) if begun >= 0 else total
            tokens, words, exact = int(true.sum()), int((true > 0).sum()), total[of]
        else:
            keys = _long(b"".join(packed))
            by = np.argsort(keys)
            keys = keys[by]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(new) - 1
            begins = np.flatnonzero(new)
            keys, total = keys[begins], np.add.reduceat(n[by], begins)
        there = total > 0
        bits = build(keys[there], total[there])
        levels = Filter.of(1, 1, [(1, 0, bits)], bits.nbytes).levels(keys, 1).astype(np.uint8)[of]
        size = len(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([length] * (size + 1), pa.int32()), pa.array([own] * (size + 1), pa.int32()), pa.array([*places, None], pa.int64()),
                pa.array([*(levels[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), None], pa.binary()),
                pa.array([*(None if exact is None else _narrow(exact[a:b]) for a, b in zip(cuts, cuts[1:])), None], pa.binary()),
                pa.array([None] * size + [tokens], pa.int64()), pa.array([None] * size + [words], pa.int64()), pa.array([None] * size + [int((total == 1).sum())], pa.int64()),
                pa.array([None] * size + [np.bincount(np.searchsorted(STEPS, total[there], side="right")).tolist()], pa.list_(pa.int64())),
            ],
            names=["length", "slice", "place", "levels", "counts", "tokens", "words", "singles", "histogram"],
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for length, own, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (length, own) != now and held:
                    yield from whole(*now, held)
                    held = []
                now = (length, own)
                held.append(rest)
        if held:
            yield from whole(*now, held)

    met = packets.repartition(slices, "length", "slice").sortWithinPartitions("length", "slice")
    return met.mapInArrow(tidied(answer), "length int, slice int, place long, levels binary, counts binary, tokens long, words long, singles long, histogram array<long>")


def _scores(tokens: Tokens, model: Model, answers: dict[int, list]) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text, of the answers (levels, counts) of slices in their order."""
    low = np.concatenate([[0], STEPS])
    high = np.concatenate([[0], STEPS[1:] - 1, STEPS[-1:]])
    last = p = known = None
    for length, grams in enumerate(tokens.distinct(model.order), 1):
        keys = np.append(grams.keys, start(length)) if length < model.order else grams.keys
        by, _ = _dealt(keys, model.slices)
        level = np.empty(len(keys), np.int64)
        levels = np.frombuffer(b"".join(x for x, _ in answers[length]), np.uint8)
        if len(levels) != len(by):
            raise RuntimeError("answers don't fit their texts")
        level[by] = levels
        if length == 1:
            known = np.empty(len(keys), np.int64)
            known[by] = np.concatenate([_widened(c) for _, c in answers[1]])
            p = (low[level] + 1.0) / (model.tokens + model.vocabulary + 1.0)
        else:
            own, history, m = slice(len(grams.keys)), last[grams.history], model.m[length - 1]
            level[own] = np.minimum(np.minimum(level[own], last[grams.shorter]), history)  # no n-gram is more frequent than its parts
            p = (np.minimum(low[level[own]], high[history]) + m * p[grams.shorter]) / (high[history] + m)
        last, of = level, grams.of
    n, base = tokens.n_docs, np.log10((known + 1) / (model.tokens + model.vocabulary + 1))
    added = lambda x: np.bincount(tokens.doc, weights=x, minlength=n).astype(float)
    return [np.bincount(tokens.doc, minlength=n), added(known[tokens.word] > 0).astype(np.int64), added(base[tokens.word]), added(np.log10(p)[of])]


def _by_slices(texts: DataFrame, order: int, slices: int, rows: int, id_col: str) -> DataFrame:
    """Texts are written once with a place each, in blocks of rows.  Units of a block, as they are read, send packets;
    answers meet the texts of their block in the order of places, so that a unit's come before its first row."""
    train = F.coalesce(_fold() != HELD_OUT, F.lit(True)).alias("train")
    blocks = write_once(texts.select(F.monotonically_increasing_id().alias("place"), "id", "text", train), "blocks")
    answers = write_once(_answers(_packets(blocks, order, slices, rows), slices), "answers")
    stats = answers.where(F.col("place").isNull())
    whole = stats.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    model = Model(order, slices, whole["n"] or 0, whole["v"] or 0, _masses(stats, order))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = texts.schema["id"].dataType.simpleString()
    asked = answers.where(F.col("place").isNotNull()).select("place", "length", "slice", "levels", "counts", none(kind, "id"), none("string", "text"))
    own = blocks.select("place", F.lit(order + 1).alias("length"), F.lit(0).alias("slice"), none("binary", "levels"), none("binary", "counts"), "id", "text")
    met = asked.unionByName(own).withColumn("block", F.expr(f"place div {rows}")).repartition(slices, "block")
    met = met.sortWithinPartitions("block", "place", "length", "slice").drop("block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, held, now = {}, [], None

        def out():
            ids, own = (pa.concat_arrays(x) for x in zip(*held))
            n, known, base, score = _scores(Tokens.of(own), model, answers)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            lengths, begin = batch.column(1).to_numpy(), 0
            for i in [*np.flatnonzero(lengths <= order).tolist(), len(lengths)]:
                if i > begin:  # texts before the next answer
                    held.append((batch.column(5)[begin:i], batch.column(6)[begin:i]))
                begin = i + 1
                if i < len(lengths):
                    place = batch.column(0)[i].as_py()
                    if place != now:
                        if held:
                            yield from out()
                        answers, held, now = {}, [], place
                    answers.setdefault(int(lengths[i]), []).append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
        if held:
            yield from out()

    scored = met.mapInArrow(tidied(score), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_col), (_fold() == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row.

    The model learns from the rows whose crc32(id as text) mod 7 isn't 2 (a null id is learned from, held_out is null
    then).  A null text is empty: its only token is the end.  Repeated rows count, and come back, as often as they occur;
    without any training row all words are unknown; an empty table gives an empty result; further columns are left out.
    base_score is exact: words travel as they are.  With a broadcast filter, counts of frequent words are at hand
    everywhere, those of others are joined by word, of which none has more than one in FREQUENT of the tokens.
    """
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a token has a byte and a blank at least, or ends a text; each enters the filter once for each length, starts besides
    most = order * (size // 2 + 3 * n + 1) * ENTRY_BITS // 8
    size += ROW_BYTES * n
    slices = max(1, -(-size // SLICE_BYTES))
    if most > broadcast_bytes:
        return _by_slices(texts, order, slices, max(1, UNIT_BYTES * n // max(1, size)), id_col)
    model, slices, counts = fit(_training(texts), order, slices=slices)
    schema = f"key long, word string, n long, id {kind}, n_tokens long, n_known long, base_score double, score double"
    size = slices.agg(F.sum(F.length("bits"))).first()[0] or 0
    scored = write_once(_by_broadcast(texts, model, slices, size, schema), "scored")
    drop_table(slices)
    rest = scored.where(F.col("word").isNotNull()).select("key", "word", F.col("n").alias("times")).join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.tokens + model.vocabulary + 1)))
    rest = rest.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * log).alias("part"))
    return scored.where(F.col("word").isNull()).join(rest, "key", "left").select(
        F.col("id").alias(id_col), (_fold() == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score",
    )
