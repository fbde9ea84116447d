from datetime import date, datetime, timedelta

import numpy as np
import pytest
from tests.helpers import clocked, close, fails
from pyspark.sql import functions as F

from ortholake import operators as op

NAMES = ["sum", "mean", "variance", "covariance", "correlation"]


def made(spark, clock, x, y=None, kind="long"):
    rows = [(i, c, v, None if y is None else y[i]) for i, (c, v) in enumerate(zip(clock, x, strict=True))]
    return spark.createDataFrame(rows, f"i long, t {kind}, x double, y double").repartition(3)


def run(df, kind, name, span, **options):
    values = ("x", "y") if name in ("covariance", "correlation") else ("x",)
    width = {"half_life": span} if kind == "ewm" else {"window": span}
    out = getattr(op, f"{kind}_{name}")(df, *values, clock="t", order_by=["t", "i"], out="out", **width, **options)
    return [r["out"] for r in out.orderBy("i").collect()]


N, SPAN, HALF_LIFE = 260, 130, 55.0


@pytest.fixture
def series(rng):
    """A clock that stands still now and then, a wandering value and one that bends with it, nulls in both."""
    clock = np.cumsum(rng.geometric(0.04, N) * (rng.random(N) < 0.8)).tolist()
    x = np.cumsum(rng.standard_t(5, N)) / 4
    y = np.sin(x) - rng.laplace(scale=0.3, size=N)
    x, y = ([None if gone else v for v, gone in zip(values.tolist(), rng.random(N) < share, strict=True)] for values, share in ((x, 0.09), (y, 0.06)))
    return clock, x, y


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["rolling", "ewm"])
def test_equals_the_naive_version(spark, series, kind, name):
    clock, x, y = series
    pair = name in ("covariance", "correlation")
    for options in ({}, {"min_samples": 4}) + (({"bias": True},) if kind == "ewm" and name in ("variance", "covariance") else ()) + (({"min_clock_span": 75},) if kind == "rolling" else ()):
        got = run(made(spark, clock, x, y), kind, name, SPAN if kind == "rolling" else HALF_LIFE, **options)
        want = clocked(kind, name, clock, x, y if pair else None, SPAN if kind == "rolling" else HALF_LIFE, **options)
        if name == "correlation":  # two points lie on a line, to the last bit or not
            for a, b in zip(got, want, strict=True):
                assert (a is None) == (b is None) or (b or a) is not None and abs(abs(b or a)) <= 1 + 1e-9
            got, want = zip(*[(a, b) for a, b in zip(got, want, strict=True) if a is not None and b is not None], strict=True)
        close(got, want, 1e-8 if name in ("correlation", "covariance", "variance") else 1e-9)


@pytest.mark.parametrize(
    ("kind", "span", "clock", "x", "want"),
    [
        ("ewm", 4, [3, 3, 7, 15], [2.0, 6.0, 4.0, 1.0], [2, 8, 8, 3]),
        ("ewm", 2, [2, 90_000], [7.0, 5.0], [7, 5]),
        ("ewm", 3, [0, 6, 12], [16.0, None, 1.0], [16, 4, 2]),
        ("rolling", 5, [1, 2, 4, 6, 7, 20], [1.0, 10.0, 100.0, 1000.0, 10_000.0, 5.0], [1, 11, 111, 1110, 11_100, 5]),
        ("rolling", 1, [8, 8, 9], [4.0, 4.0, 4.0], [4, 8, 4]),
        ("rolling", 7, [2**61 - 3, 2**61, 2**61 + 4], [1.0, 2.0, 8.0], [1, 3, 10]),
    ],
)
def test_sums_worked_out_by_hand(spark, kind, span, clock, x, want):
    close(run(made(spark, clock, x), kind, "sum", span), [float(w) for w in want])


def test_float_and_temporal_clocks(spark):
    close(run(made(spark, [0.25, 1.0, 1.5, 3.0], [2.0] * 4, kind="double"), "rolling", "sum", 1.25), [2.0, 4.0, 4.0, 2.0])
    evening = datetime(2024, 2, 28, 22)
    for kind in ("timestamp", "timestamp_ntz"):
        times = [evening + timedelta(minutes=m) for m in (0, 110, 140, 300)]
        close(run(made(spark, times, [3.0] * 4, kind=kind), "rolling", "sum", timedelta(hours=2)), [3.0, 6.0, 6.0, 3.0])
        times = [evening + timedelta(hours=h) for h in (0, 1, 4)]
        close(run(made(spark, times, [8.0, 0.0, 2.0], kind=kind), "ewm", "sum", timedelta(hours=1)), [8.0, 4.0, 2.5])
    days = [date(2023, 12, 30), date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 12)]
    close(run(made(spark, days, [1.0] * 4, kind="date"), "rolling", "sum", timedelta(days=3)), [1.0, 2.0, 2.0, 1.0])


def test_refusals(spark):
    df = made(spark, [1, 2], [1.0, 1.0])
    when = made(spark, [datetime(2024, 5, 1)], [1.0], kind="timestamp")
    fails(lambda: run(when, "ewm", "sum", 5), "Use datetime.timedelta")
    fails(lambda: run(df, "ewm", "sum", timedelta(hours=1)), "Use a number in the units")
    fails(lambda: run(df, "ewm", "sum", 0), "half_life > 0")
    fails(lambda: run(df, "rolling", "sum", float("inf")), "window > 0")
    fails(lambda: run(df, "rolling", "sum", 5, min_clock_span=6), "min_clock_span <= window")
    fails(lambda: run(made(spark, ["a"], [1.0], kind="string"), "ewm", "sum", 5), "must be an integer")
    fails(lambda: run(made(spark, [1, None, 3], [1.0] * 3), "ewm", "sum", 5), "null clock")
    fails(lambda: run(made(spark, [1.0, float("nan")], [1.0] * 2, kind="double"), "ewm", "sum", 5), "not finite")
    fails(lambda: run(made(spark, [0, 10], [1.0, None]), "ewm", "sum", 5, null_policy="raise"), "null value")
    fails(lambda: run(made(spark, [0, 10], [1.0, float("inf")]), "rolling", "sum", 5), "not finite")
    fails(lambda: op.ewm_sum(made(spark, [4, 9, 8], [1.0] * 3), "x", clock="t", half_life=5, order_by="i").collect(), "non-decreasing clock")
    fails(lambda: run(df, "ewm", "sum", True), "half_life")
    fails(lambda: op.ewm_sum(df, "x", clock="t", half_life=5, ddof=1), "no parameter ddof")


def test_groups_apart_and_together_and_in_small_batches(spark, series):
    clock, x, y = series
    df = made(spark, clock, x, y).withColumn("k", F.when(F.col("i") % 3 == 0, None).otherwise(F.col("i") % 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stats = [op.Statistic("rolling", "variance", ("x",), SPAN), op.Statistic("ewm", "correlation", ("x", "y"), HALF_LIFE), op.Statistic("ewm", "mean", ("x",), HALF_LIFE, out="m")]
        rows = op.clocked(df, stats, clock="t", by="k", order_by=["t", "i"]).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == N
    for k in (None, 1, 2):
        own = [r for r in rows if r["k"] == k]
        t, xs, ys = ([r[c] for r in own] for c in ("t", "x", "y"))
        close([r["rolling_variance"] for r in own], clocked("rolling", "variance", t, xs, None, SPAN), 1e-8)
        close([r["m"] for r in own], clocked("ewm", "mean", t, xs, None, HALF_LIFE))
    bound = op.qr(df).rolling_sum("x", clock="t", window=SPAN, by="k", order_by=["t", "i"])
    assert bound.columns == [*df.columns, "rolling_sum"] and bound.count() == N


def test_offsets_and_constants(spark, series):
    clock, x, y = series
    far = [None if v is None else v + 3e8 for v in x]
    got = run(made(spark, clock, far, y), "rolling", "covariance", SPAN)
    close(got, clocked("rolling", "covariance", clock, x, y, SPAN), 1e-6)
    got = run(made(spark, clock, [2.5] * N, y), "rolling", "correlation", SPAN)
    assert all(v is None for v in got)
    moved = [5.0 if i > 100 else float(i) for i in range(N)]
    got = run(made(spark, clock, moved, y), "rolling", "variance", 30)
    assert got[250] == 0.0


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["rolling", "ewm"])
@pytest.mark.parametrize("by", [None, "k"])
def test_a_group_over_many_tasks(spark, series, kind, name, by):
    clock, x, y = series
    df = made(spark, clock, x, y).withColumn("k", F.when(F.col("i") < 40, None).otherwise(F.lit(1)))
    span = SPAN if kind == "rolling" else HALF_LIFE
    options = {"by": by} if by else {}
    got, want = (run(df, kind, name, span, spread=spread, **options) for spread in (True, False))
    if name == "correlation":
        got, want = zip(*[(a, b) for a, b in zip(got, want, strict=True) if a is not None and b is not None], strict=True)
    close(got, want, 1e-8)


def test_rolling_without_keys_runs_by_ranges(spark, series):
    clock, x, y = series
    df = made(spark, clock, x, y)
    for width in (3, SPAN, 10**7):
        stats = [op.Statistic("rolling", "sum", ("x",), width), op.Statistic("rolling", "covariance", ("x", "y"), width / 2)]
        out = op.clocked(df, stats, clock="t", order_by=["t", "i"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce 1" not in plan and plan.count("Exchange hashpartitioning(_range") == 1
        rows = out.orderBy("i").collect()
        assert len(rows) == N and out.columns == [*df.columns, "rolling_sum", "rolling_covariance"]
        close([r["rolling_sum"] for r in rows], clocked("rolling", "sum", clock, x, None, width))
        close([r["rolling_covariance"] for r in rows], clocked("rolling", "covariance", clock, x, y, width / 2), 1e-8)
    close(run(made(spark, [2**61 - 3, 2**61, 2**61 + 4] * 1, [1.0, 2.0, 8.0]), "rolling", "sum", 7, spread=True), [1.0, 3.0, 10.0])
