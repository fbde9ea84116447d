import math

import numpy as np
import pytest
from tests.helpers import fails
from pyspark.sql import functions as F

from ortholake import operators as op


N = 311


@pytest.fixture
def frame(spark, rng):
    """Parcels from three shops: sizes that hang together, two loads that bend with them, whole masses."""
    width = rng.gamma(3.0, 0.4, N)
    depth = width * rng.uniform(0.2, 1.4, N) + rng.exponential(0.5, N)
    height = rng.triangular(-1, 0.5, 3, N)
    load = np.sqrt(width + depth) + 0.3 * height**2 + rng.normal(scale=0.2, size=N)
    lift = np.cos(height) + 2.2 * depth
    data = {"width": width, "depth": depth, "height": height, "load": load, "lift": lift, "shop": rng.choice([0, 1, 1, 2], N), "mass": rng.integers(1, 9, N) / 4, "part": np.arange(N) * 7 % 19}
    return data, spark.createDataFrame([tuple(v[i].item() for v in data.values()) for i in range(N)], list(data)).repartition(5)


def column(data, *names):
    return np.column_stack([data[n] for n in names])


@pytest.mark.parametrize("solver", ["qr", "svd"])
@pytest.mark.parametrize("weighted", [False, True])
def test_least_squares_equals_lstsq(frame, solver, weighted):
    data, df = frame
    rows = op.least_squares(df, ["load", "lift"], ["width", "depth", "height"], by="shop", weights="mass" if weighted else None, intercept=True, solver=solver, flatten=True).collect()
    assert len(rows) == 3
    for r in rows:
        own = data["shop"] == r["shop"]
        w = np.sqrt(data["mass"][own]) if weighted else np.ones(own.sum())
        x = np.column_stack([np.ones(own.sum()), column(data, "width", "depth", "height")[own]]) * w[:, None]
        t = column(data, "load", "lift")[own] * w[:, None]
        beta, rss, rank, s = np.linalg.lstsq(x, t, rcond=None)
        np.testing.assert_allclose(r["intercept"], beta[0], atol=1e-9)
        np.testing.assert_allclose(r["coefficients"], beta[1:].T, atol=1e-9)
        np.testing.assert_allclose(r["residual_sum_of_squares"], rss, rtol=1e-8)
        assert r["rank"] == 4 and r["n_observations"] == own.sum() and r["targets"] == ["load", "lift"] and r["features"] == ["width", "depth", "height"]
        if solver == "svd":
            np.testing.assert_allclose(r["singular_values"], s, rtol=1e-9)
            assert math.isclose(r["condition"], s[0] / s[-1], rel_tol=1e-8)
        else:
            assert r["singular_values"] is None


def test_ridge_spares_the_intercept_and_reports_plain_residuals(frame):
    data, df = frame
    r = op.least_squares(df, "load", ["width", "depth"], intercept=True, l2_penalty=25.0, flatten=True).first()
    x, y = column(data, "width", "depth"), data["load"]
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + 25 * np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(r["coefficients"][0], beta, atol=1e-9)
    a = y.mean() - x.mean(0) @ beta
    assert math.isclose(r["intercept"][0], a, abs_tol=1e-9)
    assert math.isclose(r["residual_sum_of_squares"][0], ((y - a - x @ beta) ** 2).sum(), rel_tol=1e-9)


def test_few_rows_and_rank(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (0.0, 1.0, 1.0, 2.0)], "a double, b double, c double, y double")
    fails(lambda: op.least_squares(df, "y", ["a", "b", "c"]).collect(), "at least as many observations")
    r = op.least_squares(df, "y", ["a", "b", "c"], solver="svd", flatten=True).first()
    want = np.linalg.lstsq(np.array([[1, 2, 3], [0, 1, 1.0]]), np.array([1, 2.0]), rcond=None)[0]
    np.testing.assert_allclose(r["coefficients"][0], want, atol=1e-12)
    twice = spark.createDataFrame([(float(i), 2.0 * i, float(i * i)) for i in range(9)], "a double, b double, y double")
    assert op.least_squares(twice, "y", ["a", "b"], solver="svd", flatten=True).first()["rank"] == 1


def test_null_policy_and_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, None, 1.0), (3.0, 3.0, 0.0), (4.0, float("nan"), 1.0), (5.0, 5.5, 1.0)], "y double, x double, w double")
    fails(lambda: op.least_squares(df, "y", "x").collect(), "'x'", "2 null or non-finite")
    assert op.least_squares(df, "y", "x", null_policy="drop", weights="w", flatten=True).first()["n_observations"] == 3
    fails(lambda: op.least_squares(df.withColumn("w", -F.col("w")), "y", "x", null_policy="drop", weights="w").collect(), "negative weight")
    fails(lambda: op.least_squares(df.withColumn("w", F.lit(0.0)), "y", "x", null_policy="drop", weights="w").collect(), "no observation carries any weight")
    for run in (op.least_squares, lambda d, y, x, **k: op.covariance(d, [y, x], **k), lambda d, y, x, **k: op.pca(d, [y, x], **k)):
        fails(lambda: run(df.where("y > 9"), "y", "x").collect(), "no rows")  # noqa: B023
        fails(lambda: run(df.where("y = 2"), "y", "x", null_policy="drop").collect(), "leaving nothing to compute from")  # noqa: B023
    for kind in ("string", "boolean", "decimal(9,2)"):
        fails(lambda: op.least_squares(df.withColumn("x", F.lit(1).cast(kind)), "y", "x"), "not numeric")  # noqa: B023
    fails(lambda: op.least_squares(df, "y", []), "at least one column")
    fails(lambda: op.least_squares(df, "y", "x", solver="lu"), "solver")


def test_null_keys_are_a_group_and_columns_may_be_expressions(spark):
    df = spark.createDataFrame([(None if i % 3 else 1, float(i), float(i * i % 7)) for i in range(30)], "k int, x double, y double")
    rows = op.least_squares(df, "y", (F.col("x") * 2).alias("double_x"), by="k", flatten=True).collect()
    assert {r["k"] for r in rows} == {None, 1} and rows[0]["features"] == ["double_x"]
    assert op.covariance(df, [F.col("x") + F.col("y"), "y"], flatten=True).first()["features"] == ["x", "y"]


@pytest.mark.parametrize("weighted", [False, True])
def test_covariance_and_correlation(frame, weighted):
    data, df = frame
    x, w = column(data, "width", "depth", "load"), data["mass"] if weighted else np.ones(N)
    r = op.covariance(df, ["width", "depth", "load"], weights="mass" if weighted else None, flatten=True).first()
    np.testing.assert_allclose(r["covariance"], np.cov(x.T, aweights=w, ddof=1), atol=1e-10)
    np.testing.assert_allclose(r["means"], np.average(x, axis=0, weights=w), atol=1e-12)
    np.testing.assert_allclose(r["standard_deviations"], np.sqrt(np.diag(np.cov(x.T, aweights=w))), atol=1e-10)
    assert math.isclose(r["sum_weights"], w.sum()) and r["size"] == 3
    r = op.correlation(df, ["width", "depth", "load"], weights="mass" if weighted else None, flatten=True).first()
    np.testing.assert_allclose(r["correlation"], np.corrcoef(x.T) if not weighted else (lambda c: c / np.sqrt(np.outer(np.diag(c), np.diag(c))))(np.cov(x.T, aweights=w)), atol=1e-9)


def test_moments_edges(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0), (4.0, 3.0)], "x double, flat double")
    assert math.isclose(op.covariance(df, "x", flatten=True).first()["covariance"][0][0], 5 / 3)
    assert op.covariance(df, "x", ddof=0, flatten=True).first()["covariance"] == [[1.25]]
    r = op.correlation(df, ["x", "flat"], flatten=True).first()["correlation"]
    assert r[0][0] == 1.0 and all(math.isnan(v) for v in (r[0][1], r[1][0], r[1][1]))
    fails(lambda: op.covariance(df.where("x = 1"), "x").collect(), "nothing to divide by")
    assert op.covariance(df.where("x = 1"), ["x", "flat"], ddof=0, flatten=True).first()["covariance"] == [[0.0, 0.0], [0.0, 0.0]]
    wide = df.select(*(F.col("x").alias(f"x{i}") for i in range(14)))
    np.testing.assert_allclose(op.covariance(wide, wide.columns, flatten=True).first()["covariance"], np.full((14, 14), 5 / 3))


@pytest.mark.parametrize("centre", [True, False])
@pytest.mark.parametrize("scale", [True, False])
def test_pca(frame, centre, scale):
    data, df = frame
    x = column(data, "width", "depth", "load") + (1e4 if centre else 0)
    moved = df.select(*((F.col(c) + (1e4 if centre else 0)).alias(c) for c in ("width", "depth", "load")))
    r = op.pca(moved, ["width", "depth", "load"], n_components=2, centre=centre, scale=scale, flatten=True).first()
    rows = x - x.mean(0) if centre else x
    if scale:
        rows = rows / np.sqrt((rows**2).sum(0) / (N - 1))
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(3), np.abs(vt).argmax(1)])[:, None]
    np.testing.assert_allclose(r["components"], vt[:2], atol=1e-7)
    np.testing.assert_allclose(r["singular_values"], s[:2], rtol=1e-8)
    np.testing.assert_allclose(r["explained_variance_ratio"], (s**2 / (s**2).sum())[:2], rtol=1e-8)
    assert r["rank"] == 3 and r["n_observations"] == N


def test_pca_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.1), (2.0, 5.0, None), (4.0, 5.0, 0.3), (7.0, 5.0, 0.9)], "x double, flat double, z double")
    assert op.pca(df, ["x", "flat"], scale=True, flatten=True).first()["scales"][1] == 1.0
    fails(lambda: op.pca(df, ["x", "flat"], n_components=3).collect(), "support at most")
    fails(lambda: op.pca(df, "x", n_components=0), "at least one component")
    fails(lambda: op.pca(df.where("x = 1"), "x").collect(), "two observations")
    scored = op.pca_transform(df, ["x", "z"], 1, null_policy="drop").orderBy("x").collect()
    assert len(scored) == 4 and scored[1]["component_1"] is None and scored[0]["component_1"] is not None
    keyed = df.withColumn("k", F.when(F.col("x") > 3, 1))
    assert op.pca_transform(keyed.union(keyed), "x", 1, by="k").count() == 8


def test_pca_transform_scores(frame):
    data, df = frame
    rows = op.pca_transform(df.select("shop", "width", "depth"), ["width", "depth"], 2, by="shop").collect()
    own = [r for r in rows if r["shop"] == 1]
    scores = np.array([[r["component_1"], r["component_2"]] for r in own])
    assert abs(np.cov(scores.T)[0, 1]) < 1e-9 and np.allclose(scores.mean(0), 0, atol=1e-9)
    fit = op.pca(df, ["width", "depth"], by="shop", flatten=True).where("shop = 1").first()
    np.testing.assert_allclose(np.diag(np.cov(scores.T)), fit["explained_variance"], rtol=1e-9)


def test_pca_transform_moves_no_rows_for_small_models(spark, frame):
    _, df = frame
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = op.pca_transform(df, ["width", "depth"], 1, by="shop")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_solve_spd(spark):
    rows = [(1, 2.0, 6.0, -1.0), (0, 5.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k int, m0 double, m1 double, b double")
    r = op.solve_spd(df, ["m0", "m1"], "b", row_index="k", flatten=True).first()
    np.testing.assert_allclose(r["solution"][0], [20 / 26, -11 / 26], atol=1e-12)
    assert r["rows"] == ["m0", "m1"] and r["size"] == 2 and r["symmetry_error"] == 0
    fails(lambda: op.solve_spd(spark.createDataFrame([(0, 6.0, 0.5, 1.0), (1, 0.7, 6.0, 1.0)], df.schema), ["m0", "m1"], "b", row_index="k").collect(), "not symmetric")
    fails(lambda: op.solve_spd(spark.createDataFrame([(0, 3.0, 4.0, 1.0), (1, 4.0, 3.0, 1.0)], df.schema), ["m0", "m1"], "b", row_index="k").collect(), "not positive definite")
    fails(lambda: op.solve_spd(df.withColumn("k", F.lit(0)), ["m0", "m1"], "b", row_index="k").collect(), "repeats a value")
    fails(lambda: op.solve_spd(df, ["m0", "m1"], "b", row_index="m0"), "not an integer")
    fails(lambda: op.solve_spd(df, ["m0", "m1", "b"], "b", row_index="k").collect(), "square")
    fails(lambda: op.solve_spd(df.withColumn("b", F.lit(None).cast("double")), ["m0", "m1"], "b", row_index="k").collect(), "null or non-finite")


def test_states_are_the_direct_fit_however_they_were_split(frame):
    data, df = frame
    direct = op.least_squares(df, "load", ["width", "depth", "height"], intercept=True, flatten=True).first()
    cov = op.covariance(df, ["width", "depth", "load"], flatten=True).first()
    for parts in (2, 17):
        split = df.withColumn("p", F.col("part") % parts)
        states = op.least_squares_state(split, "load", ["width", "depth", "height"], by="p", intercept=True)
        fit = op.finalise_least_squares(op.merge_least_squares_states(states)).select("fit.*").first()
        np.testing.assert_allclose(fit["coefficients"], direct["coefficients"], atol=1e-9)
        assert fit["n_observations"] == N and math.isclose(fit["residual_sum_of_squares"][0], direct["residual_sum_of_squares"][0], rel_tol=1e-9)
        moments = op.merge_covariance_states(op.covariance_state(split, ["width", "depth", "load"], by="p"))
        got = op.finalise_covariance(moments, out="m").select("m.*").first()
        np.testing.assert_allclose(got["covariance"], cov["covariance"], atol=1e-10)
        pca = op.finalise_pca(moments, n_components=2).select("pca.*").first()
        want = op.pca(df, ["width", "depth", "load"], n_components=2, flatten=True).first()
        np.testing.assert_allclose(pca["components"], want["components"], atol=1e-7)
        np.testing.assert_allclose(pca["singular_values"], want["singular_values"], rtol=1e-8)
        corr = op.finalise_correlation(moments, out="m").select("m.correlation").first()[0]
        np.testing.assert_allclose(corr, np.corrcoef(column(data, "width", "depth", "load").T), atol=1e-9)


def test_states_travel_and_refuse(spark, frame, tmp_path):
    from ortholake.sources.states import read_merged, write_states

    _, df = frame
    states = op.least_squares_state(df, "load", ["width", "depth", "height"], by="shop")
    write_states(states, str(tmp_path / "s"))
    assert read_merged(spark, str(tmp_path / "s"), "least_squares").count() == 1
    assert all(len(r["state"]) < 400 for r in states.collect())
    cov = op.covariance_state(df, ["width", "depth"], by="shop")
    fails(lambda: op.finalise_least_squares(cov).collect(), "least-squares state, but a covariance")
    fails(lambda: op.merge_least_squares_states(states.union(op.least_squares_state(df, "load", ["width", "depth"], by="shop"))).collect(), "different columns")
    fails(lambda: op.finalise_covariance(cov.withColumn("state", F.expr("substring(state, 1, 60)"))).collect(), "truncated")
    fails(lambda: op.finalise_covariance(spark.createDataFrame([(bytearray(b"certainly not a state"),)], "state binary")).collect(), "not a state")
    none = spark.createDataFrame([(None,)], "state binary")
    fails(lambda: op.merge_covariance_states(none).collect(), "null")
    assert op.merge_covariance_states(cov.select("state").union(none)).count() == 1
    fails(lambda: op.least_squares_state(df.withColumn("w", F.when(F.col("shop") == 1, 0.0).otherwise(1.0)), "load", "width", by="shop", weights="w").collect(), "no observation carries any weight")


def test_plans_are_partial_and_native(frame):
    _, df = frame
    plan = op.covariance(df, ["width", "depth"], by="shop")._jdf.queryExecution().executedPlan().toString()
    assert "partial_covar_pop" in plan and "Arrow" not in plan
    plan = op.least_squares(df, "load", "width", by="shop")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow")


def test_streamed_states(spark, frame, tmp_path):
    from ortholake.sources.states import read_merged
    from ortholake.streaming.states import stream_covariance_states

    data, df = frame
    df.select("width", "depth").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("width double, depth double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_covariance_states(stream, ["width", "depth"], str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination()
    got = op.finalise_covariance(read_merged(spark, str(tmp_path / "out"), "covariance"), out="m").select("m.*").first()
    np.testing.assert_allclose(got["covariance"], np.cov(column(data, "width", "depth").T), atol=1e-10)


def test_sql_and_aggregate_expressions(spark, frame):
    from ortholake.plans import sql

    _, df = frame
    sql.register(spark)
    op.least_squares_state(df, "load", ["width", "depth"], by=["shop", "part"], intercept=True).createOrReplaceTempView("states")
    found = spark.sql("select shop, finalise_least_squares(merge_least_squares_states(state)) as fit from states group by shop").orderBy("shop").collect()
    want = op.least_squares(df, "load", ["width", "depth"], by="shop", intercept=True).orderBy("shop").collect()
    other = df.groupBy("shop").agg(sql.least_squares(["load"], ["width", "depth"], intercept=True).alias("fit"), sql.covariance(["width", "depth"], weights="mass").alias("cov"), sql.pca(["width", "depth"]).alias("pca")).orderBy("shop").collect()
    cov = op.covariance(df, ["width", "depth"], by="shop", weights="mass", out="cov").orderBy("shop").collect()
    pca = op.pca(df, ["width", "depth"], by="shop").orderBy("shop").collect()
    for f, w, o, c, p in zip(found, want, other, cov, pca, strict=True):
        np.testing.assert_allclose(f["fit"]["coefficients"], w["fit"]["coefficients"], atol=1e-9)
        np.testing.assert_allclose(o["fit"]["coefficients"], w["fit"]["coefficients"], atol=1e-9)
        np.testing.assert_allclose(o["cov"]["covariance"], c["cov"]["covariance"], atol=1e-10)
        np.testing.assert_allclose(o["pca"]["components"], p["pca"]["components"], atol=1e-8)
    fails(lambda: df.withColumn("width", F.lit(None).cast("double")).groupBy("shop").agg(sql.covariance(["width", "depth"])).collect(), "'width'", "null or non-finite")


def test_aggregate_expressions_equal_the_operators(spark, frame):
    from pyspark.sql import Window

    from ortholake.plans import sql

    _, df = frame
    features = ["width", "depth"]
    made = df.groupBy("shop").agg(
        sql.correlation(features).alias("r"),
        sql.least_squares_state(["load"], features, weights="mass", intercept=True).alias("state"),
        sql.covariance_state(features).alias("moments"),
    )
    pairs = [
        (made.select("shop", F.col("r.correlation").alias("x")), op.correlation(df, features, by="shop", out="r").select("shop", F.col("r.correlation").alias("x"))),
        (op.finalise_least_squares(made).select("shop", F.col("fit.coefficients").alias("x")), op.least_squares(df, "load", features, by="shop", weights="mass", intercept=True).select("shop", F.col("fit.coefficients").alias("x"))),
        (op.finalise_covariance(made, "moments", out="m").select("shop", F.col("m.covariance").alias("x")), op.covariance(df, features, by="shop", out="m").select("shop", F.col("m.covariance").alias("x"))),
    ]
    for got, want in pairs:
        got, want = (dict(map(tuple, rows.collect())) for rows in (got, want))
        assert got.keys() == want.keys()
        for k in got:
            np.testing.assert_allclose(got[k], want[k], atol=1e-9)
    over = df.select("shop", sql.covariance(features).over(Window.partitionBy("shop"))["covariance"].alias("x"))
    assert over.count() == df.count()
    assert over.distinct().count() == made.count()
    fails(lambda: spark.createDataFrame([("3",)], "x string").groupBy().agg(sql.covariance(["x"])).collect(), "'x'", "not numeric")
    with pytest.raises(ValueError, match="null_policy"):
        sql.covariance(features, null_policy="skip")


def test_systems_as_aggregate_expressions(spark):
    from ortholake.plans import sql

    rows = [(g, i, *(5.0 + i if i == j else 0.5 * g for j in range(3)), float(i - g), 0.8**i) for g in (1, 2) for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, c double, right double, first double").repartition(2)
    got = df.groupBy("g").agg(sql.solve_spd(["a", "b", "c"], ["right"], row_index="i").alias("s"), sql.solve_toeplitz("first", ["right"], row_index="i", diagonal_shift=0.5).alias("t"))
    spd = op.solve_spd(df, ["a", "b", "c"], "right", row_index="i", by="g", out="s")
    toeplitz = op.solve_toeplitz(df, "first", "right", row_index="i", by="g", diagonal_shift=0.5, out="t")
    assert got.orderBy("g").collect() == spd.join(toeplitz, "g").orderBy("g").collect()
    fails(lambda: df.withColumn("i", F.lit(0)).groupBy("g").agg(sql.solve_spd(["a", "b", "c"], ["right"], row_index="i")).collect(), "'i'", "repeats")
    fails(lambda: df.groupBy("g").agg(sql.solve_spd(["b", "c"], ["right"], row_index="a")).collect(), "'a'", "not an integer")
