"""Exact quantiles by brackets against the engine's own and plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import quantiles as module
from veilspark.operators.quantiles import quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0)


def plain(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] if lo == hi else (hi - at) * values[lo] + (at - lo) * values[hi]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(module, "ACCURACY", accuracy)
    r = random.Random(accuracy)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("b", float(r.choice([1, 1, 1, 2, 5]))) for _ in range(2000)] + [("c", 7.0), ("d", None), ("a", float("nan")), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: (x.n, x.q) for x in quantiles(df, SHARES, ["g"]).collect()}
    for g in "abce":
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == (len(own), [plain(own, p) for p in SHARES])
    assert "d" not in got
    whole = quantiles(df, SHARES).first()
    own = [v for _, v in rows if v is not None and v == v]
    assert (whole.n, whole.q) == (len(own), [plain(own, p) for p in SHARES])
    same = df.where(~F.isnan("v")).agg(F.percentile("v", F.array(*[F.lit(p) for p in SHARES])).alias("q")).first().q
    assert whole.q == same
    none = quantiles(df.where("false"), (0.5, 0.9)).first()
    assert (none.n, none.q) == (0, [None, None]) and quantiles(df.where("false"), (0.5,), ["g"]).collect() == []
