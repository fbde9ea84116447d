"""Every operator as a query on the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ortholake import operators as op

Query = Callable[[SparkSession, str], DataFrame]
HOUR_US = 3_600_000_000
#: Added before rounding statistics of short decimals, so that none is rounded at a tie.
OFF_TIES = 3.3e-7
HALF_LIFE, WINDOW = timedelta(hours=36), timedelta(hours=72)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a second value and with gaps in the first."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return rows.select("*", F.expr("case when event_id % 7 = 0 then null else value end").alias("x"), F.expr("value * 0.5 + event_id % 11").alias("y"))


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def _long(df: DataFrame, keys: list[str], matrix: str, digits: int) -> DataFrame:
    """A matrix as rows (keys, i, j, value)."""
    rows = df.select(*keys, F.posexplode(matrix).alias("i", "row"))
    return rows.select(*keys, F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "value")).select(*keys, "i", F.col("j").cast("long").alias("j"), _r("value", digits).alias("value"))


PRICE, FLAG = "l_extendedprice", "l_returnflag"
MOMENT_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.least_squares(_lineitem(spark, sf_dir), PRICE, "l_quantity", by=FLAG, intercept=True)
    return fit.select(
        FLAG, _r(F.col("fit.coefficients")[0][0], 4).alias("slope"), _r(F.col("fit.intercept")[0], 3).alias("intercept"),
        F.col("fit.n_observations").alias("n"), _r(F.col("fit.residual_sum_of_squares")[0] / F.col("fit.n_observations"), 1).alias("mean_square"),
    )


def _two_features(fit: DataFrame) -> DataFrame:
    b = F.col("fit.coefficients")
    return fit.select(FLAG, *(_r(b[t][j], 5).alias(f"b{t}{j}") for t in range(2) for j in range(2)), *(_r(F.col("fit.intercept")[t], 4).alias(f"a{t}") for t in range(2)), F.col("fit.n_observations").alias("n"))


def least_squares_ridge_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = (F.col("l_tax") + 0.01).alias("weight")
    rows = _lineitem(spark, sf_dir).select(FLAG, "l_quantity", F.col("l_discount"), (F.col(PRICE) / 1000).alias("price"), (F.col("l_tax") * 100).alias("tax"), weight)
    return _two_features(op.least_squares(rows, ["price", "tax"], ["l_quantity", "l_discount"], by=FLAG, weights="weight", intercept=True, l2_penalty=10.0, solver="svd"))


_RIDGE = """
WITH r AS (SELECT l_returnflag, l_quantity AS x, l_discount AS z, l_extendedprice / 1000 AS y0, l_tax * 100 AS y1, l_tax + 0.01 AS w FROM lineitem),
m AS (SELECT l_returnflag, count(*) AS n, sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*z)/sum(w) AS mz, sum(w*y0)/sum(w) AS m0, sum(w*y1)/sum(w) AS m1 FROM r GROUP BY 1),
s AS (
  SELECT r.l_returnflag, sum(w*(x-mx)*(x-mx)) + 10 AS xx, sum(w*(z-mz)*(z-mz)) + 10 AS zz, sum(w*(x-mx)*(z-mz)) AS xz,
         sum(w*(x-mx)*(y0-m0)) AS x0, sum(w*(z-mz)*(y0-m0)) AS z0, sum(w*(x-mx)*(y1-m1)) AS x1, sum(w*(z-mz)*(y1-m1)) AS z1
  FROM r JOIN m USING (l_returnflag) GROUP BY 1
), b AS (
  SELECT l_returnflag, (x0*zz - z0*xz)/(xx*zz - xz*xz) AS b00, (z0*xx - x0*xz)/(xx*zz - xz*xz) AS b01,
         (x1*zz - z1*xz)/(xx*zz - xz*xz) AS b10, (z1*xx - x1*xz)/(xx*zz - xz*xz) AS b11 FROM s
)
SELECT b.l_returnflag, round(b00, 5) AS b00, round(b01, 5) AS b01, round(b10, 5) AS b10, round(b11, 5) AS b11,
       round(m0 - b00*mx - b01*mz, 4) AS a0, round(m1 - b10*mx - b11*mz, 4) AS a1, n FROM b JOIN m USING (l_returnflag)
"""

_FIT = """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
       round((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / count(*), 1) AS mean_square
FROM lineitem GROUP BY 1
"""


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(op.covariance(_lineitem(spark, sf_dir), MOMENT_COLUMNS, by=FLAG, flatten=True), [FLAG], "covariance", 8)


def covariance_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).select(FLAG, "l_quantity", "l_discount", (F.col("l_tax") + 0.01).alias("w"))
    return _long(op.covariance(rows, ["l_quantity", "l_discount"], by=FLAG, weights="w", ddof=1.0, flatten=True), [FLAG], "covariance", 8)


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(op.correlation(_lineitem(spark, sf_dir), MOMENT_COLUMNS, by=FLAG, flatten=True), [FLAG], "correlation", 8)


def _matrix_sql(kind: str, digits: int = 8) -> str:
    rows = [
        f"SELECT l_returnflag, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round({kind}({a}, {b}), {digits}) AS value FROM lineitem GROUP BY 1"
        for i, a in enumerate(MOMENT_COLUMNS) for j, b in enumerate(MOMENT_COLUMNS)
    ]
    return "\nUNION ALL ".join(rows)


_WEIGHTED = """
WITH r AS (SELECT l_returnflag, l_quantity AS x, l_discount AS z, l_tax + 0.01 AS w FROM lineitem),
m AS (SELECT l_returnflag, sum(w*x)/sum(w) AS mx, sum(w*z)/sum(w) AS mz, sum(w) - sum(w*w)/sum(w) AS d FROM r GROUP BY 1),
s AS (SELECT r.l_returnflag, sum(w*(x-mx)*(x-mx))/any_value(d) AS xx, sum(w*(x-mx)*(z-mz))/any_value(d) AS xz, sum(w*(z-mz)*(z-mz))/any_value(d) AS zz
      FROM r JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, round(xx, 8) AS value FROM s
UNION ALL SELECT l_returnflag, 0, 1, round(xz, 8) FROM s UNION ALL SELECT l_returnflag, 1, 0, round(xz, 8) FROM s UNION ALL SELECT l_returnflag, 1, 1, round(zz, 8) FROM s
"""


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", FLAG, F.col("l_quantity").alias("x"), (F.col("l_discount") * 200).alias("z"))


def _components(found: DataFrame) -> DataFrame:
    p = F.col("pca")
    return found.select(
        FLAG, *(_r(p["components"][c][j], 7).alias(f"c{c}{j}") for c in range(2) for j in range(2)),
        *(_r(p["explained_variance"][c], 6).alias(f"v{c}") for c in range(2)), _r(p["explained_variance_ratio"][0], 8).alias("share"), p["rank"].alias("rank"),
    )


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(op.pca(_plane(spark, sf_dir), ["x", "z"], by=FLAG))


_EIGEN = """
WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_discount * 200) AS mz, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 200) AS b, var_samp(l_discount * 200) AS c FROM lineitem GROUP BY 1),
e AS (SELECT *, (a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b) AS v0, (a + c)/2 - sqrt(pow((a - c)/2, 2) + b*b) AS v1 FROM s),
u AS (SELECT *, (v0 - c)/sqrt(pow(v0 - c, 2) + b*b) AS p, b/sqrt(pow(v0 - c, 2) + b*b) AS q FROM e)
"""
_PCA = _EIGEN + "SELECT l_returnflag, round(p, 7) AS c00, round(q, 7) AS c01, round(-q, 7) AS c10, round(p, 7) AS c11, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v0/(v0 + v1), 8) AS share, CAST(2 AS BIGINT) AS rank FROM u"


def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op.pca_transform(_plane(spark, sf_dir), ["x", "z"], 2, by=FLAG)
    return scored.select("l_orderkey", "l_linenumber", _r("component_1").alias("s1"), _r("component_2").alias("s2"))


_SCORES = _EIGEN + """
SELECT l_orderkey, l_linenumber, round((l_quantity - mx)*p + (l_discount*200 - mz)*q, 6) AS s1, round(-(l_quantity - mx)*q + (l_discount*200 - mz)*p, 6) AS s2
FROM lineitem JOIN u USING (l_returnflag)
"""


def solve_spd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal equations of the price on quantity and discount, a row per feature."""
    s = _lineitem(spark, sf_dir).groupBy(FLAG).agg(
        F.covar_samp("l_quantity", "l_quantity").alias("a"), F.covar_samp("l_quantity", "l_discount").alias("b"), F.covar_samp("l_discount", "l_discount").alias("c"),
        F.covar_samp("l_quantity", PRICE).alias("p"), F.covar_samp("l_discount", PRICE).alias("q"),
    )
    rows = s.select(FLAG, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("m0"), F.col("b").alias("m1"), F.col("p").alias("y")), F.struct(F.lit(1).alias("k"), F.col("b").alias("m0"), F.col("c").alias("m1"), F.col("q").alias("y")))).alias("r"))
    found = op.solve_spd(rows.select(FLAG, "r.*"), ["m0", "m1"], "y", row_index="k", by=FLAG, diagonal_shift=0.5)
    return found.select(FLAG, *(_r(F.col("solution.solution")[0][i], 3).alias(f"b{i}") for i in range(2)), F.col("solution.size").alias("size"))


_SPD = """
WITH s AS (SELECT l_returnflag, var_samp(l_quantity) + 0.5 AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) + 0.5 AS c,
                  covar_samp(l_quantity, l_extendedprice) AS p, covar_samp(l_discount, l_extendedprice) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((p*c - q*b)/(a*c - b*b), 3) AS b0, round((q*a - p*b)/(a*c - b*b), 3) AS b1, CAST(2 AS BIGINT) AS size FROM s
"""


def _ls_states(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    return op.least_squares_state(_lineitem(spark, sf_dir), PRICE, "l_quantity", by=by, intercept=True)


def _fit_row(done: DataFrame, keys: list[str]) -> DataFrame:
    return done.select(*keys, _r(F.col("fit.coefficients")[0][0], 4).alias("slope"), _r(F.col("fit.intercept")[0], 3).alias("intercept"), F.col("fit.n_observations").alias("n"))


def least_squares_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [FLAG, "l_linenumber"]
    return _fit_row(op.finalise_least_squares(_ls_states(spark, sf_dir, keys)), keys)


def merge_least_squares_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _ls_states(spark, sf_dir, [FLAG, "l_linenumber"])
    return _fit_row(op.finalise_least_squares(op.merge_least_squares_states(states, by=FLAG)), [FLAG])


def finalise_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = op.merge_least_squares_states(_ls_states(spark, sf_dir, ["l_linestatus", "l_linenumber"]), by="l_linestatus")
    return _fit_row(op.finalise_least_squares(merged, solver="svd", l2_penalty=1000.0), ["l_linestatus"])


def _state_fit(keys: str, penalty: int = 0) -> str:
    slope = f"regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + {penalty})"
    return f"SELECT {keys}, round({slope}, 4) AS slope, round(avg(l_extendedprice) - {slope} * avg(l_quantity), 3) AS intercept, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY {keys}"


def _cov_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.covariance_state(_lineitem(spark, sf_dir), MOMENT_COLUMNS, by=[FLAG, "l_linenumber"])


def covariance_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op.finalise_covariance(op.covariance_state(_lineitem(spark, sf_dir), MOMENT_COLUMNS, by=FLAG), out="m")
    return _long(done.select(FLAG, "m.covariance"), [FLAG], "covariance", 8)


def merge_covariance_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op.finalise_covariance(op.merge_covariance_states(_cov_states(spark, sf_dir), by=FLAG), out="m")
    return _long(done.select(FLAG, "m.covariance"), [FLAG], "covariance", 8)


def finalise_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op.finalise_covariance(op.merge_covariance_states(_cov_states(spark, sf_dir), by=FLAG), ddof=0.0, out="m")
    return _long(done.select(FLAG, "m.covariance"), [FLAG], "covariance", 8)


def finalise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op.finalise_correlation(op.merge_covariance_states(_cov_states(spark, sf_dir), by=FLAG), out="m")
    return _long(done.select(FLAG, "m.correlation"), [FLAG], "correlation", 8)


def finalise_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = op.covariance_state(_plane(spark, sf_dir), ["x", "z"], by=[FLAG, "l_linenumber"])
    return _components(op.finalise_pca(op.merge_covariance_states(states, by=FLAG)))


def _clocked(kind: str, name: str, **options) -> Query:
    pair = name in ("covariance", "correlation")
    run = getattr(op, f"{kind}_{name}")
    width = {"half_life": HALF_LIFE} if kind == "ewm" else {"window": WINDOW}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = ("x", "y") if pair else ("x",)
        rows = run(_events(spark, sf_dir), *values, clock="ts", by="user_id", order_by=["ts", "event_id"], out="value_out", **width, **options)
        return rows.select("event_id", _r(F.col("value_out") + OFF_TIES, 5).alias("value"))

    query.__name__ = f"{kind}_{name}"
    return query


def _clocked_sql(kind: str, name: str, least: int = 1) -> str:
    pair = name in ("covariance", "correlation")
    here = "b.x IS NOT NULL" + (" AND b.y IS NOT NULL" if pair else "")
    span = WINDOW if kind == "rolling" else HALF_LIFE
    micros = int(span / timedelta(microseconds=1))
    near = f"AND a.c - b.c < {micros}" if kind == "rolling" else ""
    w = "1.0" if kind == "rolling" else f"pow(2.0, -(a.c - b.c) / {micros}.0)"
    m2 = "sxx - sx*sx/sw"
    divisor = "nullif(sw - sw2/sw, 0)"
    value = {
        "sum": "sx", "mean": "sx/sw", "variance": f"({m2}) / {divisor}", "covariance": f"(sxy - sx*sy/sw) / {divisor}",
        "correlation": f"(sxy - sx*sy/sw) / sqrt(({m2}) * (syy - sy*sy/sw))",
    }[name]
    two = "AND n > 1" if name in ("variance", "covariance", "correlation") else ""
    return f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS c, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x, value * 0.5 + event_id % 11 AS y FROM events),
s AS (
  SELECT a.event_id, count(b.event_id) AS n, sum({w}) AS sw, sum({w} * {w}) AS sw2, sum({w} * b.x) AS sx, sum({w} * b.y) AS sy,
         sum({w} * b.x * b.x) AS sxx, sum({w} * b.y * b.y) AS syy, sum({w} * b.x * b.y) AS sxy
  FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND (b.c < a.c OR b.c = a.c AND b.event_id <= a.event_id) AND {here} {near}
  GROUP BY a.event_id
)
SELECT event_id, CASE WHEN n >= {least} {two} THEN round({value} + {OFF_TIES}, 5) END AS value FROM s
"""


_SEQUENCE = ["ts", "event_id"]


def _per_lag(found: DataFrame, kind: str) -> DataFrame:
    rows = found.select("event_type", F.arrays_zip(F.col(f"{kind}.lags").alias("lag"), F.col(f"{kind}.{kind}").alias("value")).alias("z"))
    return rows.select("event_type", F.inline("z")).select("event_type", "lag", _r("value", 7).alias("value"))


def autocovariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_lag(op.autoregression.autocovariance(_events(spark, sf_dir), "value", max_lag=6, order_by=_SEQUENCE, by="event_type"), "autocovariance")


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_lag(op.autoregression.autocorrelation(_events(spark, sf_dir), "x", max_lag=6, order_by=_SEQUENCE, by="event_type", null_policy="zero"), "autocorrelation")


def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_lag(op.autoregression.partial_autocorrelation(_events(spark, sf_dir), "value", max_lag=2, order_by=_SEQUENCE, by="event_type"), "partial_autocorrelation")


def partial_autocorrelation_burg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_lag(op.autoregression.partial_autocorrelation(_events(spark, sf_dir), "value", max_lag=1, method="burg", order_by=_SEQUENCE, by="event_type"), "partial_autocorrelation")


def autoregression_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.autoregression.fit(_events(spark, sf_dir), "value", order="aic", max_order=2, order_by=_SEQUENCE, by="event_type", flatten=True)
    return found.select("event_type", "order", _r("mean").alias("mean"), _r("variance").alias("variance"), *(_r(F.col("criterion")[k], 4).alias(f"aic{k}") for k in range(3)), "n_observations", "stationary")


def autoregression_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.autoregression.transform(_events(spark, sf_dir), "value", order=1, order_by=_SEQUENCE, by="event_type")
    return rows.select("event_id", _r("residual").alias("residual"))


def solve_toeplitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-2 Yule-Walker equations of each event type."""
    found = op.autoregression.autocovariance(_events(spark, sf_dir), "value", max_lag=2, order_by=_SEQUENCE, by="event_type")
    g = F.col("autocovariance.autocovariance")
    rows = found.select("event_type", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), g[k].alias("g"), g[k + 1].alias("y")) for k in range(2)))).alias("r"))
    done = op.solve_toeplitz(rows.select("event_type", "r.*"), "g", "y", row_index="k", by="event_type")
    return done.select("event_type", *(_r(F.col("solution.solution")[0][i], 7).alias(f"phi{i + 1}") for i in range(2)))


def _gamma(value: str, mean: str = "avg(v)") -> str:
    return f"""
WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, {value} AS v FROM events),
m AS (SELECT event_type, count(*) AS n, {mean} AS mean FROM o GROUP BY 1),
d AS (SELECT event_id, o.event_type, t, coalesce(v - mean, 0) AS c, v, n, mean FROM o JOIN m USING (event_type)),
g AS (SELECT a.event_type, CAST(a.t - b.t AS BIGINT) AS lag, sum(a.c * b.c) / any_value(a.n) AS gamma, any_value(a.n) AS n, any_value(a.mean) AS mean
      FROM d a JOIN d b ON a.event_type = b.event_type AND b.t BETWEEN a.t - 6 AND a.t GROUP BY 1, 2),
h AS (SELECT event_type, any_value(n) AS n, any_value(mean) AS mean, max(gamma) FILTER (lag = 0) AS g0, max(gamma) FILTER (lag = 1) AS g1, max(gamma) FILTER (lag = 2) AS g2 FROM g GROUP BY 1)
"""


_VALUE, _GAPS = _gamma("value"), _gamma("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under their type, which a third of them don't have."""
    return _events(spark, sf_dir).select("x", "y", F.expr("case when user_id % 3 > 0 then event_type end").alias("kind"))


def least_squares_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.least_squares(_gaps(spark, sf_dir), "y", "x", by="kind", intercept=True, null_policy="drop")
    return fit.select("kind", _r(F.col("fit.coefficients")[0][0], 7).alias("slope"), _r(F.col("fit.intercept")[0], 6).alias("intercept"), F.col("fit.n_observations").alias("n"))


def covariance_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(op.covariance(_gaps(spark, sf_dir), ["x", "y"], by="kind", null_policy="drop", ddof=0.0, flatten=True), ["kind"], "covariance", 6)


_KINDS = "SELECT CASE WHEN user_id % 3 > 0 THEN event_type END AS kind, value AS x, value * 0.5 + event_id % 11 AS y FROM events WHERE event_id % 7 <> 0"
_FIT_DROP = f"SELECT kind, round(regr_slope(y, x), 7) AS slope, round(regr_intercept(y, x), 6) AS intercept, CAST(count(*) AS BIGINT) AS n FROM ({_KINDS}) GROUP BY 1"
_COVARIANCE_DROP = "\nUNION ALL ".join(
    f"SELECT kind, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(covar_pop({a}, {b}), 6) AS value FROM ({_KINDS}) GROUP BY 1" for i, a in enumerate("xy") for j, b in enumerate("xy")
)


def pca_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pca")
    found = op.pca(_plane(spark, sf_dir), ["x", "z"], by=FLAG, scale=True)
    return found.select(FLAG, *(_r(p["scales"][j], 7).alias(f"s{j}") for j in range(2)), *(_r(p["explained_variance"][c], 7).alias(f"v{c}") for c in range(2)))


def pca_uncentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(op.pca(_plane(spark, sf_dir), ["x", "z"], by=FLAG, centre=False))


_PCA_SCALED = """
SELECT l_returnflag, round(stddev_samp(l_quantity), 7) AS s0, round(stddev_samp(l_discount * 200), 7) AS s1,
       round(1 + abs(corr(l_quantity, l_discount)), 7) AS v0, round(1 - abs(corr(l_quantity, l_discount)), 7) AS v1 FROM lineitem GROUP BY 1
"""
_UNCENTRED = _PCA.replace("var_samp(l_quantity)", "sum(l_quantity * l_quantity) / (count(*) - 1)").replace("covar_samp(l_quantity, l_discount * 200)", "sum(l_quantity * l_discount * 200) / (count(*) - 1)").replace("var_samp(l_discount * 200)", "sum(pow(l_discount * 200, 2)) / (count(*) - 1)")


def autocovariance_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_lag(op.autoregression.autocovariance(_events(spark, sf_dir), "value", max_lag=6, unbiased=True, order_by=_SEQUENCE, by="event_type"), "autocovariance")


def _selected(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = op.autoregression.fit(_events(spark, sf_dir), "value", order=name, max_order=2, order_by=_SEQUENCE, by="event_type", flatten=True)
        return found.select("event_type", "order", *(_r(F.col("criterion")[k], 4).alias(f"c{k}") for k in range(3)))

    query.__name__ = f"autoregression_fit_{name}"
    return query


def _selected_sql(penalty: str) -> str:
    return _VALUE + f"""
, v AS (SELECT *, g0 AS v0, g0*(1 - pow(g1/g0, 2)) AS v1, g0*(1 - pow(g1/g0, 2))*(1 - pow((g2/g0 - pow(g1/g0, 2)) / (1 - pow(g1/g0, 2)), 2)) AS v2 FROM h),
a AS (SELECT *, n*ln(v0) AS c0, n*ln(v1) + {penalty} AS c1, n*ln(v2) + 2*{penalty} AS c2 FROM v)
SELECT event_type, CAST(CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS BIGINT) AS "order", round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2 FROM a"""


def autoregression_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.autoregression.transform(_events(spark, sf_dir), "value", order=1, order_by=_SEQUENCE, by="event_type", output="prediction")
    return rows.select("event_id", _r("prediction").alias("prediction"))


def rolling_mean_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence of all events, in windows of 50 on a whole-number clock."""
    rows = op.rolling_mean(_events(spark, sf_dir), "x", clock="event_id", window=50, out="value_out")
    return rows.select("event_id", _r(F.col("value_out") + OFF_TIES, 5).alias("value"))


_MEAN_NUMBER = f"""
SELECT event_id, round(avg(CASE WHEN event_id % 7 <> 0 THEN value END) OVER (ORDER BY event_id RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) + {OFF_TIES}, 5) AS value FROM events
"""


_SQL = {
    "least_squares": _FIT,
    "least_squares_ridge_weighted": _RIDGE,
    "covariance": _matrix_sql("covar_samp"),
    "covariance_weighted": _WEIGHTED,
    "correlation": _matrix_sql("corr"),
    "pca": _PCA,
    "pca_transform": _SCORES,
    "solve_spd": _SPD,
    "least_squares_state": _state_fit("l_returnflag, l_linenumber"),
    "merge_least_squares_states": _state_fit("l_returnflag"),
    "finalise_least_squares": _state_fit("l_linestatus", 1000),
    "covariance_state": _matrix_sql("covar_samp"),
    "merge_covariance_states": _matrix_sql("covar_samp"),
    "finalise_covariance": _matrix_sql("covar_pop"),
    "finalise_correlation": _matrix_sql("corr"),
    "finalise_pca": _PCA,
    "autocovariance": _VALUE + "SELECT event_type, lag, round(gamma, 7) AS value FROM g",
    "autocorrelation": _GAPS + "SELECT event_type, lag, round(gamma / g0, 7) AS value FROM g JOIN h USING (event_type)",
    "partial_autocorrelation": _VALUE + """
SELECT event_type, CAST(1 AS BIGINT) AS lag, round(g1/g0, 7) AS value FROM h
UNION ALL SELECT event_type, 2, round((g2/g0 - pow(g1/g0, 2)) / (1 - pow(g1/g0, 2)), 7) FROM h""",
    "partial_autocorrelation_burg": _VALUE + """
SELECT a.event_type, CAST(1 AS BIGINT) AS lag, round(2 * sum(a.c * b.c) / sum(a.c * a.c + b.c * b.c), 7) AS value
FROM d a JOIN d b ON a.event_type = b.event_type AND b.t = a.t - 1 GROUP BY 1""",
    "autoregression_fit": _VALUE + """
, v AS (SELECT *, g0 AS v0, g0*(1 - pow(g1/g0, 2)) AS v1, g0*(1 - pow(g1/g0, 2))*(1 - pow((g2/g0 - pow(g1/g0, 2)) / (1 - pow(g1/g0, 2)), 2)) AS v2 FROM h),
a AS (SELECT *, n*ln(v0) AS aic0, n*ln(v1) + 2 AS aic1, n*ln(v2) + 4 AS aic2 FROM v),
p AS (SELECT *, CASE WHEN aic0 <= aic1 AND aic0 <= aic2 THEN 0 WHEN aic1 <= aic2 THEN 1 ELSE 2 END AS o FROM a)
SELECT event_type, CAST(o AS BIGINT) AS "order", round(mean, 6) AS mean, round(CASE o WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END, 6) AS variance,
       round(aic0, 4) AS aic0, round(aic1, 4) AS aic1, round(aic2, 4) AS aic2, CAST(n AS BIGINT) AS n_observations, true AS stationary FROM p""",
    "autoregression_transform": _VALUE + """
SELECT a.event_id, round(a.c - g1/g0*b.c, 6) AS residual FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.t = a.t - 1 JOIN h ON h.event_type = a.event_type""",
    "solve_toeplitz": _VALUE + "SELECT event_type, round((g1*g0 - g2*g1)/(g0*g0 - g1*g1), 7) AS phi1, round((g2*g0 - g1*g1)/(g0*g0 - g1*g1), 7) AS phi2 FROM h",
    "least_squares_drop": _FIT_DROP,
    "covariance_drop": _COVARIANCE_DROP,
    "pca_scaled": _PCA_SCALED,
    "pca_uncentred": _UNCENTRED,
    "autocovariance_unbiased": _VALUE + "SELECT event_type, lag, round(gamma * n / (n - lag), 7) AS value FROM g",
    "autoregression_fit_bic": _selected_sql("ln(n)"),
    "autoregression_fit_hqic": _selected_sql("2*ln(ln(n))"),
    "autoregression_prediction": _VALUE + """
SELECT a.event_id, round(h.mean + g1/g0*b.c, 6) AS prediction FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.t = a.t - 1 JOIN h ON h.event_type = a.event_type""",
    "rolling_mean_number": _MEAN_NUMBER,
}


def queries() -> dict[str, Query]:
    plain = (
        least_squares, least_squares_ridge_weighted, covariance, covariance_weighted, correlation, pca, pca_transform, solve_spd, least_squares_state,
        merge_least_squares_states, finalise_least_squares, covariance_state, merge_covariance_states, finalise_covariance, finalise_correlation,
        finalise_pca, autocovariance, autocorrelation, partial_autocorrelation, partial_autocorrelation_burg, autoregression_fit,
        autoregression_transform, solve_toeplitz, least_squares_drop, covariance_drop, pca_scaled, pca_uncentred, autocovariance_unbiased,
        _selected("bic"), _selected("hqic"), autoregression_prediction, rolling_mean_number,
    )
    clocked = [_clocked(kind, name, **({"min_samples": 3} if name == "correlation" else {})) for kind in ("rolling", "ewm") for name in ("sum", "mean", "variance", "covariance", "correlation")]
    return {q.__name__: q for q in (*plain, *clocked)}


def oracle_sql() -> dict[str, str]:
    clocked = {f"{kind}_{name}": _clocked_sql(kind, name, 3 if name == "correlation" else 1) for kind in ("rolling", "ewm") for name in ("sum", "mean", "variance", "covariance", "correlation")}
    return _SQL | clocked
