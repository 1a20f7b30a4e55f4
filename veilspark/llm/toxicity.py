"""Toxicity by multiple-instance learning.

Only whole documents carry labels.  A document is a bag of sentences; a sentence's probability is a logistic
function of its features (words and word beginnings), and the document's is the noisy-or of its sentences with a
leak.  The likelihood of the document labels trains the sentence model, which then also says which sentences
offend.

The model is fitted on a bounded sample of labelled rows (``sample``, by hash of the id); features are counted
and the sentences of the sample are reduced to their few selected features on the executors, so the driver gets
at most ``features`` rows of counts and short lists of numbers.  Scoring is one pass over the scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, only, ship, small_batches, tidied, write_once

ship(__name__)

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8000
#: Features of the model, at most, and the share of chance finds among them that is put up with.
FEATURES, FALSE_SHARE = 4096, 0.1
HEAD = 4
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


def features_of(words) -> set[str]:
    """Whole words and the beginnings of longer ones."""
    found = set()
    for w in words:
        found.add("=" + w)
        for n in PREFIXES:
            if len(w) > n:
                found.add("^" + w[:n])
    return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0  # the probability of a document in which no sentence has a feature
    heads: frozenset[str] = frozenset()

    def plain(self) -> tuple:
        """What a broadcast carries: executors need not have this class."""
        return self.weights, self.bias, self.leak, self.heads

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence with a feature of the model."""
        lower = text.lower()
        if not any(w[:HEAD] in self.heads for w in TOKEN.findall(lower)):
            return []
        if len(lower) != len(text):  # a letter whose lower case is longer: offsets are those of the text
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out = []
        for m in SENTENCE.finditer(lower):
            words = [w for w in TOKEN.findall(m[0]) if w[:HEAD] in self.heads]
            if words and (found := [self.weights[f] for f in features_of(words) if f in self.weights]):
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(found)))))))
        return out

    def document(self, sentences: list[tuple[int, int, float]]) -> float:
        none = math.log1p(-self.leak) + sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in sentences)
        return -math.expm1(none)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text is divisible by 5.  So are rows without an id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that are not held out, ``sample`` of them at most, chosen by hash of the id.

    Rows without an id or label don't count; of several labels of one id the largest does; of several texts of
    one id each is an instance.  With no rows, or rows of one class only, the model has no features and scores
    every document with the share of the label.
    """
    known = only(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # its size is bounded by the parameter
    bags = only(docs, id_col, text_col).join(F.broadcast(known), id_col).select("_y", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        toxic, clean, sizes = Counter(), Counter(), [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (toxic if y else clean).update(features_of(set(TOKEN.findall(text.as_py().lower()))))
                sizes[bool(y)] += 1
        rows = [("", sizes[1], sizes[0])] + [(f, toxic[f], clean[f]) for f in toxic]
        rows += [(f, 0, n) for f, n in clean.items() if f not in toxic]
        for i in range(0, len(rows), 20_000):
            f, a, b = zip(*rows[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["feature", "toxic", "clean"])

    counts = bags.mapInArrow(tidied(counted), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c"))
    counts = write_once(counts, "toxicity-counts")  # of the bounded sample
    size = counts.where("feature = ''").first()
    n1, n0 = (int(size["a"]), int(size["c"])) if size else (0, 0)
    if not n1 or not n0:
        return Model(leak=min(0.999, n1 / max(1, n1 + n0)))
    share = n1 / (n1 + n0)
    counts = counts.where("feature <> ''").withColumn("k", F.col("a") + F.col("c"))
    least = thresholds([(r["k"], r["a"], r["count"]) for r in counts.groupBy("k", "a").count().collect()], share)
    chosen = []
    if least:
        rule = docs.sparkSession.createDataFrame(sorted(least.items()), "k long, least long")  # as many rows as the sample, at most
        a, c = F.col("a"), F.col("c")
        g = a * F.log(a / ((a + c) * share)) + F.when(c > 0, c * F.log(c / ((a + c) * (1 - share)))).otherwise(0.0)
        found = counts.join(F.broadcast(rule), "k").where(a >= F.col("least")).orderBy(g.desc(), "feature").select("feature").limit(FEATURES)
        chosen = [r["feature"] for r in found.collect()]
    drop_table(counts)
    if not chosen:
        return Model(leak=share)
    model = Model(dict.fromkeys(chosen, 1.0), 0.0, share, frozenset(f[1 : 1 + HEAD] for f in chosen))
    number = {f: i for i, f in enumerate(chosen)}
    sent = docs.sparkSession.sparkContext.broadcast((model.plain(), number))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        plain, number = sent.value
        model = Model(*plain)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text, bag = text.as_py(), Counter()  # sentences with the same features count as often as they stand there
                for start, end, _ in model.sentences(text):
                    words = [w for w in TOKEN.findall(text[start:end].lower()) if w[:HEAD] in model.heads]
                    bag[tuple(sorted(number[f] for f in features_of(words) if f in number))] += 1
                rows.append([(list(x), n) for x, n in bag.items() if x])
            lists = pa.array([[x for x, _ in r] for r in rows], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))], names=["y", "bag", "times"])

    rows = bags.mapInArrow(tidied(reduced), "y int, bag array<array<int>>, times array<long>").collect()  # of the bounded sample
    return trained(chosen, [(r["y"], r["bag"], r["times"]) for r in rows], share, model.heads)


def thresholds(counts: list[tuple[int, int, int]], share: float) -> dict[int, int]:
    """From (documents with a feature, toxic ones among them, features of that kind): for each number of documents
    the least number of toxic ones at which few enough of the features are chance finds.  The binomial tail (its
    Chernoff bound for frequent features) says how many of that kind chance would bring."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for k, a, n in counts:
        by_size.setdefault(k, []).append((a, n))
    least = {}
    for k, kinds in by_size.items():
        everything, seen = sum(n for _, n in kinds), 0
        for a, n in sorted(kinds, reverse=True):
            seen += n
            if a <= k * share:
                break
            if k <= 100:
                tail = sum(math.comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(a, k + 1))
            else:
                tail = math.exp(-a * math.log(a / (k * share)) - ((k - a) * math.log((k - a) / (k * (1 - share))) if a < k else 0.0))
            if everything * tail <= FALSE_SHARE * seen:
                least[k] = a
    return least


def laid_out(bags: list[tuple[int, list[list[int]], list[int]]]) -> tuple:
    """Flat arrays of bags with a sentence each at least: labels, the bag and the times of each sentence, and the
    sentence and the number of each feature."""
    import numpy as np

    sentences = [s for _, bag, _ in bags for s in bag]
    of_bag = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    of_sentence = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    times = np.array([n for _, _, own in bags for n in own], float)
    return np.array([b[0] for b in bags], float), of_bag, times, of_sentence, np.concatenate([np.array(s) for s in sentences])


def loss_and_gradient(w, b: float, data: tuple, leak: float, decay: float):
    """The mean negative log likelihood of the labels with a penalty on weights, and its gradient by weights and bias."""
    import numpy as np

    y, of_bag, times, of_sentence, feature = data
    z = np.clip(b + np.bincount(of_sentence, w[feature], len(of_bag)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    none_of = math.log1p(-leak) - np.bincount(of_bag, times * np.logaddexp(0, z), len(y))  # log of 1 - document
    q = np.maximum(-np.expm1(none_of), 1e-9)
    loss = -np.where(y > 0, np.log(q), none_of).mean() + decay * np.dot(w, w) / (2 * len(w))
    # d loss / d z: each sentence pushes its document's "none" by -p
    pull = np.where(y > 0, -np.exp(none_of) / q, 1.0)
    dz = pull[of_bag] * times * p / len(y)
    return loss, np.append(np.bincount(feature, dz[of_sentence], len(w)) + decay * w / len(w), dz.sum())


def trained(names: list[str], bags: list[tuple[int, list[list[int]], list[int]]], share: float, heads: frozenset[str], steps: int = 400, decay: float = 1e-3) -> Model:
    """Maximise the likelihood of the document labels under noisy-or, by Adam.  A bag has the features of each kind of
    sentence, and how often it stands in the document."""
    import numpy as np

    none = [y for y, bag, _ in bags if not bag]
    leak = (sum(none) + 0.1) / (len(none) + 1)
    bags = [b for b in bags if b[1]]
    if not bags:
        return Model(leak=min(leak, 0.999))
    data = laid_out(bags)
    w, b = np.full(len(names), 0.5), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(w, b, data, leak, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({n: float(x) for n, x in zip(names, w)}, float(b), float(min(leak, 0.999)), heads)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and, with spans, the offending sentences (start, end in code points,
    probability of 0.5 or more), for every row and its whole text.

    Null and empty texts get the leak.  Repeated rows give repeated results, an empty table an empty one;
    further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded by FEATURES
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                sentences = model.sentences(text.as_py() or "")
                scores.append(model.document(sentences))
                found.append([{"start": a, "end": b, "probability": p} for a, b, p in sentences if p >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=[id_col, "score", "spans"])

    out = only(docs, id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {id_type}, score double, spans array<struct<start:int,end:int,probability:double>>")
    columns = [F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")]
    return out.select(*columns, *["spans"] * spans)


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, whatever these are called.  Null and empty
    texts score the leak; repeated rows stay or go alike; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([model.document(model.sentences(t.as_py() or "")) < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
