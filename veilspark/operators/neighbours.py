"""Exact nearest neighbours in Gower space, by pruned search.

The other rows are dealt to the leaves of a tree over their numbers and categories.  A row's second-best distance is
bounded from above by a sample; it visits just the leaves whose box isn't farther than that, so no row that is among
its two closest is missed and most are never measured.  Work grows like n^1.5 for rows that lie like their mock,
not like all pairs.  The sample shapes tree and bound, never the result.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import as_text
from .running import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leaves of a tree, sampled rows a leaf (for its shape), and sampled rows that bound distances, at most.
LEAVES, LEAF_SAMPLE, BOUND_SAMPLE = 8192, 16, 4096
#: Values of a category on one side of a split, at most.
SIDE_VALUES = 64
#: Cells of a matrix of distances.
CELLS = 2_000_000
#: Boxes are taken for a little larger than they are, so that rounding loses nothing.
SLACK = 1e-9


def coordinates(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], spans: Sequence[float]) -> list[Column]:
    """Numbers (null and NaN as 0) and 64-bit hashes of categories."""
    xs = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(numeric)]
    return [*xs, *[F.xxhash64(as_text(c)).alias(f"_t{i}") for i, c in enumerate(categorical)]]


@dataclass
class Node:
    leaf: int = 0
    dim: int = -1  # of the split: a number's place, or that of a category plus the count of numbers
    cut: float = 0.0  # numbers up to it go left
    side: np.ndarray | None = None  # sorted values of a category that go left
    left: Node | None = None
    right: Node | None = None


@dataclass
class Tree:
    """Leaves over points; spans scale the numbers."""

    spans: np.ndarray
    root: Node = field(default_factory=Node)
    leaves: int = 1

    @classmethod
    def grown(cls, x: np.ndarray, t: np.ndarray, spans: np.ndarray, leaves: int) -> Tree:
        """The largest leaf is split where it parts points best, until there are enough leaves or nothing is left to part."""
        tree = cls(spans)
        heap = [(-len(x), 0, tree.root, np.arange(len(x)))]
        count = 0
        while heap and tree.leaves < leaves:
            _, _, node, own = heapq.heappop(heap)
            left = _split(node, x[own] / spans, t[own])
            if left is None:
                continue
            node.left, node.right = Node(leaf=node.leaf), Node(leaf=tree.leaves)
            tree.leaves += 1
            for child, part in ((node.left, own[left]), (node.right, own[~left])):
                count += 1
                if len(part) > 1:
                    heapq.heappush(heap, (-len(part), count, child, part))
        return tree

    def assign(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        x, out, todo = x / self.spans, np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node.left is None or not len(own):
                out[own] = node.leaf
                continue
            left = _goes_left(node, x, t, own)
            todo += [(node.left, own[left]), (node.right, own[~left])]
        return out

    def reach(self, x: np.ndarray, t: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a leaf whose box is not farther from it than ``far``."""
        x, n = x / self.spans, x.shape[1]
        points, leaves = [], []
        todo = [(self.root, np.arange(len(x)), np.zeros((len(x), n + t.shape[1])))]
        while todo:
            node, own, gaps = todo.pop()
            near = gaps.sum(axis=1) <= far[own] + SLACK
            if not near.all():
                own, gaps = own[near], gaps[near]
            if not len(own):
                continue
            if node.left is None:
                points.append(own)
                leaves.append(np.full(len(own), node.leaf, np.int32))
                continue
            left = _goes_left(node, x, t, own)
            off = np.abs(x[own, node.dim] - node.cut) if node.side is None else np.ones(len(own))
            for child, outside in ((node.left, ~left), (node.right, left)):
                more = gaps.copy()
                more[outside, node.dim] = np.maximum(more[outside, node.dim], off[outside])
                todo.append((child, own, more))
        if not points:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(points), np.concatenate(leaves)


def _goes_left(node: Node, x: np.ndarray, t: np.ndarray, own: np.ndarray) -> np.ndarray:
    if node.side is None:
        return x[own, node.dim] <= node.cut
    values = t[own, node.dim - x.shape[1]]
    at = np.minimum(np.searchsorted(node.side, values), len(node.side) - 1)
    return node.side[at] == values


def _split(node: Node, x: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """Give the node the split that keeps its points apart most, weighed by how often points agree in a category;
    what goes left, None if all points are alike."""
    size, best = len(x), (0.0, None)
    for k in range(x.shape[1]):
        values = np.sort(x[:, k])
        if values[0] < values[-1]:
            cut = values[(size - 1) // 2]
            cut = cut if cut < values[-1] else values[values < values[-1]][-1]
            gain = float(np.abs(values - cut).mean())
            if gain > best[0]:
                best = gain, (k, float(cut), None)
    for k in range(t.shape[1]):
        counts = Counter(t[:, k].tolist()).most_common()
        agree = sum(c * (c - 1) for _, c in counts) / max(1, size * (size - 1))
        side, held = [], 0
        for value, c in counts[:SIDE_VALUES]:
            if len(side) + 1 < len(counts) and (not side or 2 * (held + c) <= size):
                side.append(value)
                held += c
        gain = 2 * held * (size - held) / size**2 * min(1.0, 4 * agree)
        if side and gain > best[0]:
            best = gain, (x.shape[1] + k, 0.0, np.sort(np.array(side, np.int64)))
    if best[1] is None:
        return None
    node.dim, node.cut, node.side = best[1]
    return _goes_left(node, x, t, np.arange(size))


def _distances(x: np.ndarray, t: np.ndarray, y: np.ndarray, u: np.ndarray, spans: Sequence[float]) -> np.ndarray:
    """Sums of shares of the span and of unequal categories."""
    far = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        far += np.abs(x[:, k, None] - y[None, :, k]) / spans[k]
    for k in range(t.shape[1]):
        far += t[:, k, None] != u[None, :, k]
    return far


def _two(far: np.ndarray) -> np.ndarray:
    """The two smallest of each row; infinity where there is one."""
    if far.shape[1] > 2:
        far = np.partition(far, 1, axis=1)[:, :2]
    far = np.sort(far, axis=1)
    return far if far.shape[1] > 1 else np.hstack([far, np.full((len(far), 1), np.inf)])


def _matrices(batch: pa.RecordBatch, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    own = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name.startswith(("_x", "_t"))}
    pick = lambda kind, size, dtype: np.stack([own[f"{kind}{i}"] for i in range(size)], axis=1).astype(dtype) if size else np.zeros((batch.num_rows, 0), dtype)
    return pick("_x", n, float), pick("_t", m, np.int64)


def closest(rows: DataFrame, key: str, others: DataFrame, numeric: Sequence[str], categorical: Sequence[str], spans: Sequence[float], *, measured: bool = False) -> DataFrame:
    """key, d1, d2: Gower distances of each row to the two closest of the others (d2 null if there is one other, both if
    there is none); with ``measured`` also n, how many distinct others its point was measured against.

    Distances are exact, up to 64-bit hashes of categories.  Equal rows on either side are searched once, so hot values
    aren't hot tasks.  Null and NaN count as 0, a null category equals another.  Without columns all distances are 0.
    """
    n, m, width, spans = len(numeric), len(categorical), max(1, len(numeric) + len(categorical)), np.array(spans, float)
    names = [*[f"_x{i}" for i in range(n)], *[f"_t{i}" for i in range(m)]]
    shape = ", ".join(f"{c} {'double' if c.startswith('_x') else 'long'}" for c in names)
    if not names:
        some = others.limit(2).count()
        return rows.select(F.col(f"`{key}`"), *[F.lit(0.0 if some >= k else None).cast("double").alias(f"d{k}") for k in (1, 2)], *([F.lit(0).cast("long").alias("n")] if measured else []))

    theirs = settled(others.select(*coordinates(others, numeric, categorical, spans)).groupBy(*names).agg(F.count("*").alias("_m")))
    total = theirs.count()
    leaves = min(LEAVES, 1 << math.ceil(math.log2(max(1, math.sqrt(total)))))
    # at most LEAVES * LEAF_SAMPLE points, in an order that has nothing to do with where they lie
    sample = theirs.orderBy(F.xxhash64(*names), *names).limit(max(BOUND_SAMPLE, leaves * LEAF_SAMPLE)).toArrow().combine_chunks()
    batch = sample.to_batches()[0] if total else pa.RecordBatch.from_pylist([], sample.schema)
    x, t = _matrices(batch, n, m)
    tree = Tree.grown(x, t, spans, leaves)
    twice = np.flatnonzero(batch.column(batch.schema.get_field_index("_m")).to_numpy(zero_copy_only=False)[:BOUND_SAMPLE] > 1)
    bound_x, bound_t = (np.concatenate([a[:BOUND_SAMPLE], a[twice]]) for a in (x, t))
    # pickled here with its classes, so that executors need no copy of the package
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((tree, bound_x, bound_t)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cloudpickle.loads(sent.value)[0]
        for batch in batches:
            leaf = tree.assign(*_matrices(batch, n, m))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["_leaf", *batch.schema.names])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bound_x, bound_t = cloudpickle.loads(sent.value)
        for batch in batches:
            x, t = _matrices(batch, n, m)
            far = np.full(len(x), np.inf)
            step = max(1, CELLS // max(1, len(bound_x)))
            for at in range(0, len(x) if len(bound_x) > 1 else 0, step):
                far[at : at + step] = _two(_distances(x[at : at + step], t[at : at + step], bound_x, bound_t, spans))[:, 1]
            points, leaf = tree.reach(x, t, far)
            for at in range(0, len(points), 50_000):
                own = pa.array(points[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at : at + 50_000]), *[c.take(own) for c in batch.columns]], names=["_leaf", *batch.schema.names])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, x, t = None, [], None, None
        for batch in batches:
            leaf, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            xs, ts = _matrices(batch, n, m)
            cuts = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | ((weight[1:] == 0) != (weight[:-1] == 0))])) if len(leaf) else []
            for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
                if leaf[a] != now:
                    now, parts, x = leaf[a], [], None
                if weight[a]:  # others come first
                    again = np.concatenate([np.arange(a, b), a + np.flatnonzero(weight[a:b] > 1)])
                    parts.append((xs[again], ts[again]))
                    continue
                if x is None:
                    x, t = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros((0, n)), np.zeros((0, m), np.int64))
                if not len(x):
                    continue
                step = max(1, CELLS // len(x))
                for at in range(a, b, step):
                    end = min(b, at + step)
                    two = _two(_distances(xs[at:end], ts[at:end], x, t, spans)) / width
                    own = batch.slice(at, end - at)
                    yield pa.RecordBatch.from_arrays([*own.columns[2:], pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(np.full(end - at, len(x)))], names=[*names, "_d1", "_d2", "_n"])

    points = rows.select(*coordinates(rows, numeric, categorical, spans)).distinct()
    both = theirs.select(*names, "_m").mapInArrow(placed, f"_leaf int, {shape}, _m long").unionByName(points.mapInArrow(asking, f"_leaf int, {shape}").withColumn("_m", F.lit(0).cast("long")))
    met = both.select("_leaf", "_m", *names).repartition("_leaf").sortWithinPartitions("_leaf", F.col("_m") == 0)
    found = met.mapInArrow(measure, f"{shape}, _d1 double, _d2 double, _n long").groupBy(*names)
    two = found.agg(F.array_sort(F.flatten(F.collect_list(F.array("_d1", "_d2")))).alias("_d"), F.sum("_n").alias("_n"))  # two for each visited leaf
    keyed = rows.select(F.col(f"`{key}`").alias("_key"), *coordinates(rows, numeric, categorical, spans)).join(two, names, "left")
    second = F.when(F.col("_d")[1] < float("inf"), F.col("_d")[1])
    return keyed.select(F.col("_key").alias(key), F.col("_d")[0].alias("d1"), second.alias("d2"), *([F.coalesce("_n", F.lit(0)).alias("n")] if measured else []))
