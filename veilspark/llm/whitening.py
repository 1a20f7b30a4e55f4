"""Whitening of embeddings by a tiled covariance.

The dimensions are cut into column blocks; a pair of column blocks is a tile of the covariance.  Blocks of rows
send the column blocks that a row of tiles needs to one place, where tile pairs are multiplied; products are
summed in the task and then tile by tile.  Only the assembled matrix, d x d numbers whatever the rows, reaches
the driver, which finds its eigenvectors.  No key comes from a value: equal vectors aren't a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship, tidied, write_once

ship(__name__)

#: An entry c becomes floor(SCALE * c) + SHIFT, within plus and minus LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**32
#: Bytes of a column block of one block of rows, about.
BLOCK_BYTES = 65_536
#: Bytes of tile sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Rows whose sums of whole numbers fit 64 bits.
SUM_ROWS = 1 << 19
#: A component with less than this share of the largest variance has none.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n rows, sums by dimension (exact), eigenvalues falling, unit eigenvectors by column, and the
    trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        """From a centred vector to whitened components; a component without variance gives 0."""
        flat = self.values <= FLAT * max(self.values[0], 0.0)
        return np.where(flat, 0.0, self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))

    @property
    def spread(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > FLAT * max(self.values[0], 0.0)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of long) of the rows whose vector isn't null or empty and holds neither null nor non-finite entries.
    Entries beyond plus and minus 2**32 count as these."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)) * SCALE) + SHIFT)
    return only(df, id_col, vector_col).where(sound).select(F.col(f"`{id_col}`"), whole.alias("x"))


def fit_list(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The usable rows as a written table, since it is read several times and blocks of rows must stay the same.  The
    dimension is that of most rows (the larger one if two tie); vectors of another length aren't usable."""
    rows = write_once(whole_numbers(df, id_col, vector_col).withColumn("d", F.size("x")), "vectors")
    most = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.col("d") == (most["d"] if most else 0)).drop("d")


def _cells(column: pa.Array) -> np.ndarray:
    """rows x d of an array column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of the matrices of each key, as streams of rows: no group is held, only sums."""
    schema = parts.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, cells in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(cells)
                sums[tuple(key)] = sums[tuple(key)] + part if tuple(key) in sums else part
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], names=[*keys, "cells"])

    return parts.repartition(*keys).mapInArrow(tidied(add), schema)


def sums_by_dimension(fitted: DataFrame) -> tuple[int, tuple[int, ...]]:
    """n and the exact sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.int64())], names=["at", "n", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = _cells(batch.column(0)).sum(axis=0)
            n, total = n + batch.num_rows, part if total is None else total + part
            if n >= SUM_ROWS:
                yield out()
                n, total = 0, None
        if n:
            yield out()

    rows = only(fitted, "x").mapInArrow(tidied(add), "at int, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(rows.collect(), key=lambda r: r["at"])  # a row for each dimension
    return (found[0]["n"] if found else 0), tuple(int(r["s"]) for r in found)


def covariance(fitted: DataFrame, n: int, sums: tuple[int, ...], width: int | None = None) -> np.ndarray:
    """The covariance of the columns, divisor n, centred before multiplying.  A tile is ``width`` dimensions wide; by
    default four column blocks make the whole, so that a column block travels at most four times."""
    d = len(sums)
    width = width or max(16, -(-d // 4))
    means = np.array([s / n for s in sums])
    starts = range(0, d, width)
    tall = max(16, BLOCK_BYTES // (8 * width))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _cells(batch.column(0)) - means
            for at in range(0, len(centred), tall):
                part, number = centred[at : at + tall], number + 1
                blocks = [np.ascontiguousarray(part[:, s : s + width]).tobytes() for s in starts]
                keys = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(keys), pa.int64()), pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([blocks[j] for _, j in keys], pa.binary())],
                    names=["rows", "i", "j", "cells"],
                )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        left = None

        def out():
            for (i, j), tile in tiles.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([tile.tobytes()], pa.binary())], names=["i", "j", "cells"])
            tiles.clear()

        for batch in batches:
            for i, j, cells in zip(*(c.to_pylist() for c in batch.columns[1:])):
                block = np.frombuffer(cells).reshape(-1, min(width, d - j * width))
                if i == j:  # the first of its block of rows and row of tiles
                    left = block
                product = left.T @ block
                tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
            if sum(t.nbytes for t in tiles.values()) > HELD_BYTES:
                yield from out()
        yield from out()

    blocks = only(fitted, "x").mapInArrow(tidied(cut), "rows long, i int, j int, cells binary")
    met = blocks.repartition("rows", "i").sortWithinPartitions("rows", "i", "j")
    tiles = _added(met.mapInArrow(tidied(multiply), "i int, j int, cells binary"), ["i", "j"])
    whole = np.zeros((d, d))
    for r in tiles.collect():  # the matrix: d x d numbers, whatever the rows
        i, j = r["i"] * width, r["j"] * width
        tile = np.frombuffer(r["cells"]).reshape(min(width, d - i), -1) / n
        whole[i : i + width, j : j + width] = tile
        whole[j : j + width, i : i + width] = tile.T
    return whole


def fit(fitted: DataFrame, components: int = 8, width: int | None = None) -> Whitening | None:
    """The transform of a fit list, None if it is empty."""
    n, sums = sums_by_dimension(fitted)
    if not n:
        return None
    matrix = covariance(fitted, n, sums, width)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(matrix)))


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, among components with variance,
    measured on all rows."""
    means, matrix, k = model.means, model.matrix, len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                white = (_cells(batch.column(0)) - means) @ matrix
                first, second = first + white.sum(axis=0), second + white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["at", "s"])

    found = sorted(only(fitted, "x").mapInArrow(tidied(add), "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect())
    cells = np.array([r["s"] for r in found]) / model.n
    off = cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k]) - np.eye(k)
    kept = model.spread
    return float(np.abs(off[np.ix_(kept, kept)]).max(initial=0.0))


def transform(fitted: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row for each row and component, see :func:`whiten`."""
    name = next(c for c in fitted.columns if c != "x")
    kind = fitted.schema[name].dataType.simpleString()
    n, means, matrix, sums, k = model.n, model.means, model.matrix, model.sums, len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else 0.0 for v in model.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cells(batch.column(1))
            most = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums))
            if most * most * len(sums) < 2**62:
                far = ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
            else:
                far = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
            white = (x - means) @ matrix
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"`{name}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return only(fitted, name, "x").mapInArrow(tidied(project), schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, width: int | None = None) -> DataFrame:
    """id, component (from 1 by falling variance), n, deviation (exact sum over dimensions of (n*x-S)^2, null beyond 38
    digits), whitened, explained (share of the trace), identity_error, for each usable row and component.

    Rows whose vector is null, empty or of another length than most, or holds null, NaN or infinite entries, are
    dropped; an empty list gives an empty result.  Components without variance (one row, equal rows, constant
    dimensions) are 0 in every row and don't count in identity_error.  Repeated rows and ids count and come back as often as they occur, a null id
    stays null, further columns are left out.  Vectors with fewer dimensions than ``components`` have as many components as dimensions.
    """
    fitted = fit_list(df, id_col, vector_col)
    model = fit(fitted, components, width)
    if model is None:
        kind = df.schema[id_col].dataType.simpleString()
        empty = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    return transform(fitted, model, identity_error(fitted, model))
