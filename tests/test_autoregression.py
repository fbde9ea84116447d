import math

import numpy as np
import pytest
from tests.helpers import close, fails
from pyspark.sql import functions as F

from ortholake import operators as op
from ortholake.operators import autoregression as ar


N, BEFORE = 1500, 300


@pytest.fixture(scope="module")
def series():
    """Three lags driven by uniform noise, far from zero."""
    noise = np.random.default_rng(41).uniform(-2, 2, N + BEFORE)
    y = np.zeros(N + BEFORE)
    for t in range(3, len(y)):
        y[t] = noise[t] + np.dot([0.45, 0.2, -0.35], y[t - 3 : t][::-1])
    return y[BEFORE:] - 12.5


@pytest.fixture
def df(spark, series):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(series)], "i long, y double").repartition(3)


def gamma_of(y, p, unbiased=False):
    c = y - y.mean()
    return np.array([c[k:] @ c[: len(c) - k] / (len(c) - k if unbiased else len(c)) for k in range(p + 1)])


def test_autocovariance_and_correlation(df, series):
    r = ar.autocovariance(df, "y", max_lag=8, order_by="i", flatten=True).first()
    np.testing.assert_allclose(r["autocovariance"], gamma_of(series, 8), atol=1e-10)
    assert r["lags"] == list(range(9)) and r["n_observations"] == N and math.isclose(r["mean"], series.mean())
    r = ar.autocovariance(df, "y", max_lag=8, order_by="i", unbiased=True, demean=False, flatten=True).first()
    np.testing.assert_allclose(r["autocovariance"], [series[k:] @ series[: N - k] / (N - k) for k in range(9)], rtol=1e-10)
    r = ar.autocorrelation(df, "y", max_lag=3, order_by="i", flatten=True).first()
    np.testing.assert_allclose(r["autocorrelation"], gamma_of(series, 3) / gamma_of(series, 0)[0], atol=1e-12)


def naive_fit(y, p):
    g = gamma_of(y, p)
    t = g[np.abs(np.subtract.outer(range(p), range(p)))]
    phi = np.linalg.solve(t, g[1:])
    return phi, g[0] - phi @ g[1:]


def naive_burg(y, p):
    c = y - y.mean()
    f, b, phi, steps = c.copy(), c.copy(), np.zeros(0), []
    for _ in range(p):
        f, b = f[1:], b[:-1]
        k = 2 * f @ b / (f @ f + b @ b)
        f, b = f - k * b, b - k * f
        phi = np.append(phi - k * phi[::-1], k)
        steps.append(k)
    return phi, np.array(steps)


def test_fit_yule_walker_and_burg(spark, df, series):
    r = ar.fit(df, "y", order=3, order_by="i", flatten=True).first()
    phi, variance = naive_fit(series, 3)
    np.testing.assert_allclose(r["coefficients"], phi, atol=1e-10)
    assert math.isclose(r["variance"], variance, rel_tol=1e-10) and r["stationary"] and r["criterion"] is None and len(r["order_variance"]) == 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        r = ar.fit(df, "y", order=4, method="burg", order_by="i", flatten=True).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    phi, steps = naive_burg(series, 4)
    np.testing.assert_allclose(r["coefficients"], phi, atol=1e-8)
    np.testing.assert_allclose(r["partial_autocorrelations"], steps, atol=1e-8)
    short = df.where("i < 9")
    r = ar.fit(short, "y", order=4, method="burg", order_by="i", flatten=True).first()
    np.testing.assert_allclose(r["coefficients"], naive_burg(series[:9], 4)[0], atol=1e-8)


@pytest.mark.parametrize("name", ["aic", "bic", "hqic"])
def test_criteria(df, series, name):
    r = ar.fit(df, "y", order=name, max_order=6, order_by="i", flatten=True).first()
    n = N
    cost = {"aic": 2, "bic": math.log(n), "hqic": 2 * math.log(math.log(n))}[name]
    want = [n * math.log(naive_fit(series, k)[1] if k else gamma_of(series, 0)[0]) + cost * k for k in range(7)]
    np.testing.assert_allclose(r["criterion"], want, rtol=1e-10)
    assert r["order"] == int(np.argmin(want)) == len(r["coefficients"])


def test_partial_autocorrelation(df, series):
    r = ar.partial_autocorrelation(df, "y", max_lag=5, order_by="i", flatten=True).first()
    np.testing.assert_allclose(r["partial_autocorrelation"], [naive_fit(series, k)[0][-1] for k in range(1, 6)], atol=1e-10)
    assert r["lags"] == [1, 2, 3, 4, 5]


def test_transform(df, series):
    phi, _ = naive_fit(series, 2)
    c = series - series.mean()
    want = [None, None] + [c[t] - phi[0] * c[t - 1] - phi[1] * c[t - 2] for t in range(2, N)]
    got = [r["residual"] for r in ar.transform(df, "y", order=2, order_by="i").orderBy("i").collect()]
    close(got, want, 1e-9)
    got = [r["prediction"] for r in op.ar(df).transform("y", order=2, order_by="i", output="prediction").orderBy("i").collect()]
    close(got[2:], [series[t] - want[t] for t in range(2, N)], 1e-9)


def test_nulls(spark):
    y = [3.0, None, 7.0, 6.5, 2.0, 4.0, None, 5.0, 1.0]
    df = spark.createDataFrame(list(enumerate(y)), "i int, y double")
    got = [r["residual"] for r in ar.transform(df, "y", order=1, order_by="i", null_policy="zero").orderBy("i").collect()]
    assert [i for i, v in enumerate(got) if v is None] == [0, 1, 2, 6, 7]
    mean = np.mean([v for v in y if v is not None])
    c = np.array([0 if v is None else v - mean for v in y])
    r = ar.autocovariance(df, "y", max_lag=2, order_by="i", null_policy="zero", flatten=True).first()
    np.testing.assert_allclose(r["autocovariance"], [c[k:] @ c[: 9 - k] / 9 for k in range(3)], atol=1e-12)
    r = ar.fit(df, "y", order=1, method="burg", order_by="i", null_policy="zero", flatten=True).first()
    assert math.isclose(r["coefficients"][0], 2 * c[1:] @ c[:-1] / (c[1:] @ c[1:] + c[:-1] @ c[:-1]))
    fails(lambda: ar.fit(df, "y", order=1, order_by="i").collect(), "null value")
    fails(lambda: ar.fit(df.withColumn("y", F.lit(float("nan"))), "y", order=1, order_by="i").collect(), "not finite")


def test_refusals(spark, df):
    flat = spark.createDataFrame([(i, 7.5) for i in range(30)], "i int, y double")
    fails(lambda: ar.fit(flat, "y", order=1, order_by="i").collect(), "does not move")
    fails(lambda: ar.autocorrelation(flat, "y", max_lag=1, order_by="i").collect(), "does not move")
    fails(lambda: ar.autocovariance(flat, "y", max_lag=30, order_by="i").collect(), "No pair of observations")
    fails(lambda: ar.autocovariance(flat.where("i > 90"), "y", max_lag=1, order_by="i").collect(), "no rows")
    for order, extra, kind in ((True, {}, TypeError), (1.5, {}, TypeError), (-1, {}, ValueError), ("best", {}, ValueError), ("aic", {}, ValueError), ("aic", {"max_order": 0}, ValueError)):
        with pytest.raises(kind):
            ar.fit(df, "y", order=order, order_by="i", **extra)
    with pytest.raises(ValueError):
        ar.fit(df, "y", order=1, order_by=[])


def test_groups(spark, series):
    rows = [(None if i % 2 else "a", i, float(v)) for i, v in enumerate(series[:400])]
    df = spark.createDataFrame(rows, "k string, i int, y double")
    for r in ar.autocovariance(df, "y", max_lag=2, order_by="i", by="k", flatten=True).collect():
        np.testing.assert_allclose(r["autocovariance"], gamma_of(series[:400][1 if r["k"] is None else 0 :: 2], 2), atol=1e-10)
    assert ar.transform(df, "y", order=1, order_by="i", by="k").count() == 400


def test_toeplitz(spark, rng):
    n = 9
    g, b = 0.7 ** np.arange(n) * np.cos(0.3 * np.arange(n)), rng.uniform(-3, 3, (n, 2))
    df = spark.createDataFrame([(k, float(g[k]), *map(float, b[k])) for k in range(n)], "k long, g double, left double, right double").repartition(3)
    r = op.solve_toeplitz(df, "g", ["left", "right"], row_index="k", diagonal_shift=0.05, flatten=True).first()
    t = g[np.abs(np.subtract.outer(range(n), range(n)))] + 0.05 * np.eye(n)
    np.testing.assert_allclose(r["solution"], np.linalg.solve(t, b).T, atol=1e-10)
    bad = spark.createDataFrame([(0, 2.0, 1.0), (1, 2.5, 0.0), (2, 0.5, 1.0)], "k int, g double, left double")
    fails(lambda: op.solve_toeplitz(bad, "g", "left", row_index="k").collect(), "positive definite")
    alike = bad.withColumn("g", F.lit(3.0))
    fails(lambda: op.solve_toeplitz(alike, "g", "left", row_index="k").collect(), "positive definite")
    assert op.solve_toeplitz(alike, "g", "left", row_index="k", diagonal_shift=1e-5).count() == 1


@pytest.mark.parametrize("method", ["yule_walker", "burg"])
@pytest.mark.parametrize("rows", [9, 400])
def test_a_group_over_many_tasks(spark, series, method, rows):
    y = [None if i % 13 == 5 else float(v) + 1e3 for i, v in enumerate(series[:rows])]
    df = spark.createDataFrame([(i, v, None if i < rows // 3 else "a") for i, v in enumerate(y)], "i long, y double, k string")
    for by in (None, "k"):
        for p in (0, 2):
            fits = [ar.fit(df, "y", order=p, method=method, order_by="i", by=by, null_policy="zero", spread=s, flatten=True).collect() for s in (True, False)]
            key = lambda r: str(r["k"]) if by else ""  # noqa: B023, E731
            for a, b in zip(*(sorted(f, key=key) for f in fits), strict=True):
                np.testing.assert_allclose(a["coefficients"], b["coefficients"], atol=1e-8)
                np.testing.assert_allclose([a["mean"], a["variance"]], [b["mean"], b["variance"]], rtol=1e-8)
                assert a["n_observations"] == b["n_observations"]
            got, want = ([r["residual"] for r in ar.transform(df, "y", order=p, method=method, order_by="i", by=by, null_policy="zero", spread=s).orderBy("i").collect()] for s in (True, False))
            close(got, want, 1e-6)


@pytest.mark.parametrize("method", ["yule_walker", "burg"])
def test_aggregate_expressions(spark, series, method):
    from ortholake.plans import sql

    rows = [(i // 2, i % 2, float(v) if i % 11 else None, "a" if i % 3 else None) for i, v in enumerate(series[:300])]
    df = spark.createDataFrame(rows, "i int, j int, y double, k string").repartition(3)
    order = ["i", "j"]
    got = df.groupBy("k").agg(
        sql.autocovariance("y", max_lag=4, order_by=order, null_policy="zero").alias("c"),
        sql.autocorrelation("y", max_lag=4, order_by=order, null_policy="zero", unbiased=True).alias("r"),
        sql.partial_autocorrelation("y", max_lag=3, order_by=order, null_policy="zero", method=method).alias("p"),
        sql.autoregression_fit("y", order="bic", max_order=4, order_by=order, null_policy="zero", method=method).alias("f"),
    )
    common = {"order_by": order, "by": "k", "null_policy": "zero", "flatten": True}
    want = {
        "c": ar.autocovariance(df, "y", max_lag=4, **common),
        "r": ar.autocorrelation(df, "y", max_lag=4, unbiased=True, **common),
        "p": ar.partial_autocorrelation(df, "y", max_lag=3, method=method, **common),
        "f": ar.fit(df, "y", order="bic", max_order=4, method=method, **common),
    }
    got = {r["k"]: r for r in got.collect()}
    field = {"c": "autocovariance", "r": "autocorrelation", "p": "partial_autocorrelation", "f": "coefficients"}
    for out, rows in want.items():
        rows = rows.collect()
        assert {r["k"] for r in rows} == got.keys() == {"a", None}
        for r in rows:
            np.testing.assert_allclose(got[r["k"]][out][field[out]], r[field[out]], atol=1e-9)
            assert got[r["k"]][out]["n_observations"] == r["n_observations"]
    fails(lambda: df.groupBy("k").agg(sql.autocovariance("y", max_lag=1, order_by="i")).collect(), "'y'", "null")
    fails(lambda: df.groupBy("k").agg(sql.autocovariance("i", max_lag=1, order_by=["j"], null_policy="zero"), sql.autocovariance("k", max_lag=1, order_by="j")).collect(), "'k'", "not numeric")
    with pytest.raises(ValueError, match="order_by"):
        sql.autocovariance("y", max_lag=1, order_by=[])
