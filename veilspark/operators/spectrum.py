"""Cycles and steps of series of any length, spread over all tasks.

A long series is transformed as a convolution with a chirp, whose length is a power of two; that transform is done
in two stages of its square root each, as rows and columns of a square, so a task holds about 2 * sqrt(n) values at
a time and the data is shuffled three times.  Places in a series come from ranges of rows with offsets.
"""

from __future__ import annotations

import sys
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .running import running_total, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A series of up to so many values is transformed in one piece.
SHORT = 4096
#: A series with fewer values has no cycle that means anything; a peak stands out beyond so many medians.
LEAST, PEAK = 32, 1.8


def _square(n: int) -> tuple[int, int]:
    """Rows and columns of the square for n values, with room for the convolution."""
    m = (2 * n - 2).bit_length()
    return 1 << (m + 1) // 2, 1 << m // 2


def _chirp(at: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi at^2 / n), with the angle reduced in whole numbers."""
    at = at.astype(np.uint64)
    return np.exp(-1j * np.pi * ((at * at) % np.uint64(2 * n)).astype(float) / n)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _rows(series, **columns: np.ndarray) -> pa.Table:
    size = len(next(iter(columns.values())))
    return pa.table({"series": pa.array([series] * size, pa.string()), **{k: pa.array(v) for k, v in columns.items()}})


def _first(key: tuple, table: pa.Table) -> pa.Table:
    """A row of the square for the series and for the chirp: transformed along the columns and turned."""
    (series, row), n = (k.as_py() for k in key), table.column("n")[0].as_py()
    rows, columns = _square(n)
    at, v = _columns(table, "at", "v")
    out = []
    for which in (0, 1):
        own = np.zeros(columns, complex)
        if which == 0:
            there = at >= 0  # mirrored places of the chirp have a negative one
            own[at[there] // rows] = v[there] * _chirp(at[there], n)
        else:
            place = np.where(at >= 0, at, at + rows * columns)
            own[place // rows] = np.conj(_chirp(np.abs(at), n))
        k = np.arange(columns)
        own = np.fft.fft(own) * np.exp(-2j * np.pi * ((row * k) % (rows * columns)) / (rows * columns))
        out.append(own)
    return _rows(series, col=k, row=np.full(columns, row), n=np.full(columns, n), ar=out[0].real, ai=out[0].imag, br=out[1].real, bi=out[1].imag)


def _second(key: tuple, table: pa.Table) -> pa.Table:
    """A column: both transforms are finished, multiplied, and the way back is begun."""
    (series, col), n = (k.as_py() for k in key), table.column("n")[0].as_py()
    rows, columns = _square(n)
    row, ar, ai, br, bi = _columns(table, "row", "ar", "ai", "br", "bi")
    a, b = np.zeros(rows, complex), np.zeros(rows, complex)
    a[row], b[row] = ar + 1j * ai, br + 1j * bi
    k = np.arange(rows)
    back = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * np.exp(2j * np.pi * ((col * k) % (rows * columns)) / (rows * columns))
    return _rows(series, row=k, col=np.full(rows, col), n=np.full(rows, n), re=back.real, im=back.imag)


def _third(key: tuple, table: pa.Table) -> pa.Table:
    """A row again: the strengths of the cycles in it."""
    (series, row), n = (k.as_py() for k in key), table.column("n")[0].as_py()
    rows, columns = _square(n)
    col, re, im = _columns(table, "col", "re", "im")
    own = np.zeros(columns, complex)
    own[col] = re + 1j * im
    k = row + rows * np.arange(columns)
    kept = (k >= 1) & (k <= n // 2)
    return _rows(series, k=k[kept], power=np.abs(np.fft.ifft(own))[kept])


def placed(rows: DataFrame) -> DataFrame:
    """series, at (0, 1, ... in the order of t, then v), v: places from ranges of rows."""
    run = running_total(rows, [F.col("series"), F.col("t"), F.col("v")], F.lit(1), "upto")
    starts = run.groupBy("series").agg(F.min("upto").alias("first"))
    return run.join(starts, "series").select("series", (F.col("upto") - F.col("first")).cast("long").alias("at"), "v")


def powers(rows: DataFrame) -> DataFrame:
    """series, n, k, power: the strength |sum of (v - mean) exp(-2 pi i k at / n)| of the cycle that is there k times, for
    k from 1 to n / 2.  rows has series (text), t and v."""
    ordered = placed(rows)
    about = ordered.groupBy("series").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    values = ordered.join(about, "series").select("series", "at", "n", (F.col("v") - F.col("mean")).alias("v"))
    # the chirp stands at each place and at its mirror; the number of rows of the square follows from n
    bits = F.length(F.bin(2 * F.col("n") - 2))
    square_rows = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((bits + 1) / 2).cast("int"))
    mirrored = values.where("at > 0").select("series", (-F.col("at")).alias("at"), "n", F.lit(0.0).alias("v"))
    both = values.unionByName(mirrored).withColumn("row", F.pmod("at", square_rows))
    one = both.groupBy("series", "row").applyInArrow(_first, "series string, col long, row long, n long, ar double, ai double, br double, bi double")
    two = one.groupBy("series", "col").applyInArrow(_second, "series string, row long, col long, n long, re double, im double")
    found = two.groupBy("series", "row").applyInArrow(_third, "series string, k long, power double")
    return found.join(about.select("series", "n"), "series")


def _whole(key: tuple, table: pa.Table) -> pa.Table:
    t, v = _columns(table, "t", "v")
    v = v[np.lexsort((v, t))]
    power = np.abs(np.fft.rfft(v - v.mean()))[1:]
    k = int(power.argmax())
    found = power[k] > PEAK * np.median(power)
    return pa.table({"series": pa.array([key[0].as_py()], pa.string()), "n": pa.array([len(v)], pa.int64()), "period": pa.array([len(v) / (k + 1) if found else None], pa.float64())})


def dominant_period(rows: DataFrame, short: int = SHORT) -> DataFrame:
    """series, n, period: the strongest cycle, in steps, of each series of 32 values or more; null unless it stands out.
    rows has series (text), t and v, without nulls."""
    rows = settled(rows)
    sizes = rows.groupBy("series").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    few = rows.join(sizes.where(F.col("n") <= short).select("series"), "series").groupBy("series").applyInArrow(_whole, "series string, n long, period double")
    long = sizes.where(F.col("n") > short)
    if not long.limit(1).count():
        return few
    found = settled(powers(rows.join(long.select("series"), "series")))
    middle = quantiles(found.select("series", F.col("power").alias("v")), [0.5], ["series"]).select("series", F.col("q")[0].alias("median"))
    top = found.groupBy("series").agg(F.max(F.struct("power", (-F.col("k")).alias("k"))).alias("top"), F.first("n").alias("n")).join(middle, "series")
    period = F.when(F.col("top.power") > PEAK * F.col("median"), F.col("n") / -F.col("top.k"))
    return few.unionByName(top.select("series", "n", period.alias("period")))


def steps(times: DataFrame) -> DataFrame:
    """s, step, m: how often each step between consecutive times occurs in each series.  times has s and t.

    Equal times are counted first, so a moment that holds many rows is one; steps are taken within ranges of times, and across
    their ends."""
    rows = times.groupBy("s", "t").agg(F.count("*").alias("m"))
    ranges = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(rows.repartitionByRange(ranges, "s", "t").withColumn("r", F.spark_partition_id()))
    turn = Window.partitionBy("r").orderBy("s", "t")
    within = rows.select("s", F.when(F.lag("s").over(turn).eqNullSafe(F.col("s")), F.col("t") - F.lag("t").over(turn)).alias("step"))
    ends = rows.groupBy("r").agg(F.min(F.struct("s", "t")).alias("a"), F.max(F.struct("s", "t")).alias("b"))
    ends = ends.withColumn("z", F.lag("b").over(Window.orderBy("r")))  # a row for each range
    across = ends.where(F.col("z").isNotNull() & F.col("z.s").eqNullSafe(F.col("a.s"))).select("a.s", (F.col("a.t") - F.col("z.t")).alias("step"))
    moved = within.where(F.col("step").isNotNull()).unionByName(across).select("s", "step", F.lit(1).cast("long").alias("m"))
    still = rows.groupBy("s").agg(F.sum(F.col("m") - 1).alias("m")).where("m > 0").select("s", F.lit(0).cast("long").alias("step"), "m")
    return moved.unionByName(still).groupBy("s", "step").agg(F.sum("m").alias("m"))


def middle(counts: DataFrame) -> DataFrame:
    """s, steps, median: the exact median of counted steps, from running counts."""
    run = settled(running_total(counts, [F.col("s"), F.col("step")], F.col("m"), "upto"))
    about = run.groupBy("s").agg(F.sum("m").alias("steps"), F.min(F.col("upto") - F.col("m")).alias("before"))
    here = run.join(about, "s").withColumns({"a": F.col("upto") - F.col("m") - F.col("before"), "b": F.col("upto") - F.col("before")})
    at = lambda i: F.max(F.when((F.col("a") <= i) & (i < F.col("b")), F.col("step")))
    low, high = F.floor((F.col("steps") - 1) / 2), F.floor(F.col("steps") / 2)
    return here.groupBy("s", "steps").agg(((at(low) + at(high)) / 2.0).alias("median"))
