"""Pruned partitions, bits, the native filter and the table function against plain forms."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import filters, tables
from tideline.operators import kernels as K
from tideline.operators import labelers as L
from tideline.operators import leadlag as LL
from tideline.operators import learners
from tideline.plans.base import FIXED, grid, walk


def every_start(y, cost, least=6):
    """The dynamic program over all starts."""
    n = len(y)
    x, total, prev = np.arange(n), np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    total[0] = -cost
    for j in range(least, n + 1):
        for i in range(j - least + 1):
            if np.isfinite(total[i]):
                sse = ((y[i:j] - np.polyval(np.polyfit(x[i:j], y[i:j], 1), x[i:j])) ** 2).sum()
                if total[i] + sse + cost < total[j] - 1e-12:
                    total[j], prev[j] = total[i] + sse + cost, i
    out, j = [], n
    while j:
        out.append((int(prev[j]), j - 1))
        j = prev[j]
    return out[::-1]


def test_pruned_partition_is_the_full_one():
    draw = np.random.default_rng(0)
    for n in (6, 13, 40, 70):
        for scale in (0.1, 1.0, 5.0):
            y = np.cumsum(draw.normal(size=n)).round(3)
            cost = K.penalty(y) * scale
            assert [(a, b) for a, b, _ in K.piecewise(y, cost)] == every_start(y, cost)


def test_long_partition_is_fast():
    draw = np.random.default_rng(1)
    y = np.cumsum(np.repeat(draw.normal(size=200), 50) + draw.normal(0, 0.3, 10_000))
    began = time.time()
    assert len(K.piecewise(y)) > 100
    assert time.time() - began < 5


def test_concordance_counts_months_at_lags(spark):
    draw = np.random.default_rng(2)
    labels = {f"s{k}": {int(t): int(v) for t, v in zip(np.flatnonzero(draw.random(200) < 0.9), draw.integers(-1, 2, 200))} for k in range(4)}
    frame = spark.createDataFrame([(s, t, v) for s, m in labels.items() for t, v in m.items()], "series_id string, t int, label int")
    pairs = spark.createDataFrame([("s0", "s1"), ("s1", "s0"), ("s3", "s2")], "x string, y string")
    got = {(r["x"], r["y"], r["lag"]): r["share"] for r in LL.concordance(frame, frame, pairs).collect()}
    want = {}
    for x, y in (("s0", "s1"), ("s1", "s0"), ("s3", "s2")):
        for k in range(-12, 13):
            both = [t for t in labels[x] if t + k in labels[y]]
            want[x, y, k] = np.mean([labels[x][t] == labels[y][t + k] for t in both])
    assert got == pytest.approx(want)


def test_nearest_turns_of_listed_pairs(spark):
    turns = lambda rows: spark.createDataFrame(rows, "series_id string, t int, dir int")
    x, y = turns([("x", 5, 1), ("x", 11, 1), ("x", 30, -1), ("z", 8, 1)]), turns([("y", 8, 1), ("y", 20, -1), ("y", 60, 1)])
    got = sorted(tuple(r) for r in LL.nearest_turns(x, y, spark.createDataFrame([("x", "y")], "x string, y string")).collect())
    assert got == [("x", "y", 8, 1, -3), ("x", "y", 20, -1, 10)]


def test_native_filter_equals_the_model(spark):
    draw = np.random.default_rng(4)
    z, u, states = draw.normal(size=120), draw.normal(size=120), np.repeat(draw.integers(0, 3, 24), 5)
    m = learners.Switching().fit_labelled(z[:, None], u[:, None], states)
    alpha, moves = m.filter(z[:, None], u[:, None])
    row = ([float(v) for v in z], m.mean[:, 0].tolist(), m.cov[:, 0, 0].tolist(), m.first.tolist(), moves.tolist())
    frame = spark.createDataFrame([row, ([0.5], *row[1:]), ([], *row[1:])], "z array<double>, mean array<double>, variance array<double>, first array<double>, moves array<array<array<double>>>")
    out = frame.select(filters.forward(*[F.col(c) for c in ("z", "mean", "variance", "first", "moves")]).alias("p")).collect()
    assert np.allclose(out[0]["p"], alpha, atol=1e-9) and np.isclose(sum(out[1]["p"][0]), 1) and out[2]["p"] is None


def test_segments_as_a_table_function(spark, sf):
    tables.register(spark)
    rows = L.with_sigma(walk(spark, sf)).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value", "sig"))).alias("r"))
    rows.selectExpr("series_id", "transform(r, x -> x.value) as ys", "transform(r, x -> x.sig) as sg").createOrReplaceTempView("some_series")
    got = spark.sql("select s.series_id, g.* from some_series s, lateral segments(s.ys, s.sg, 'A,B,D,E,F,G', 1.0D, false, 2.0D, 0) g")
    want = L.machine_segments(walk(spark, sf), grid(spark, FIXED)).drop("setting_id").select(*got.columns)
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want)
    assert spark.sql("select * from segments(cast(null as array<double>), cast(null as array<double>), 'A', 1.0D, false, 2.0D, 0)").count() == 0
