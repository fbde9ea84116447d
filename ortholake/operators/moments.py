"""Covariance and correlation matrices for every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholake.functions import schemas
from ortholake.functions.columns import ColumnArg, as_list, flat, keys_of, names_of, numeric, one_of
from ortholake.functions.states import CovarianceState, moments_row
from ortholake.operators.least_squares import POLICIES
from ortholake.plans.two_stage import two_stage

#: Columns up to which the pairs are aggregated as expressions; beyond, states of whole matrices cost less.
MOST_NATIVE = 12


def folded(df, features, by, weights, null_policy, finish, result, out) -> DataFrame:
    features, by = as_list(features), keys_of(by)
    one_of(null_policy, POLICIES, "null_policy")
    columns = features + ([] if weights is None else [weights])
    names = names_of(df, columns)
    return two_stage(
        df, by, numeric(df, columns), names, weights is not None,
        lambda: CovarianceState(names[: len(features)]), lambda state, rows, w: state.add(rows, w), finish, result, out, null_policy,
    )


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def _native(df: DataFrame, features: list[ColumnArg], by: list[str], ddof: float, policy: str, kind: str, out: str) -> DataFrame:
    """Built-in aggregates, partial and final, without Python: a mean per column and a covariance per pair."""
    names, p = names_of(df, features), len(features)
    columns = [f"_v{i}" for i in range(p)]
    rows = df.select(*by, *(v.alias(c) for v, c in zip(numeric(df, features), columns, strict=True)))
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    usable = good[0]
    for g in good[1:]:
        usable = usable & g
    # left out rows are nulls in every column; worked out once, ahead of the aggregates
    rows = rows.select(*by, *(g.alias(f"_g{i}") for i, g in enumerate(good)), usable.alias("_usable"), *(F.when(usable, F.col(c)).alias(f"_x{i}") for i, c in enumerate(columns)))
    x = [F.col(f"_x{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = (
        rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_total"),
            F.count_if("_usable").alias("_n"),
            F.array(*(F.count_if(~F.col(f"_g{i}")) for i in range(p))).alias("_bad"),
            _array([F.avg(c) for c in x]).alias("_means"),
            *(F.covar_pop(x[i], x[j]).alias(f"_c{i}_{j}") for i, j in pairs),
        )
    )
    n = F.col("_n").cast("double")
    divisor = n - F.lit(float(ddof))
    cov = {(i, j): F.col(f"_c{i}_{j}") * n / divisor for i, j in pairs}
    spread = [F.sqrt(F.greatest(cov[i, i], F.lit(0.0))) for i in range(p)]

    def entry(i: int, j: int) -> Column:
        value = cov[min(i, j), max(i, j)]
        if kind == "covariance":
            return value
        moves = (spread[i] > 0) & (spread[j] > 0)
        bounded = F.lit(1.0) if i == j else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / (spread[i] * spread[j])))
        return F.when(moves, bounded).otherwise(F.lit(float("nan")))

    matrix = _array([_array([entry(i, j) for j in range(p)]) for i in range(p)])
    row = F.struct(
        _array([F.lit(x) for x in names]).alias("features"), F.col("_means").alias("means"), _array(spread).alias("standard_deviations"), matrix.alias(kind),
        F.col("_n").alias("n_observations"), n.alias("sum_weights"), F.lit(p).cast("long").alias("size"),
    )

    def fails(*message: Column | str) -> Column:
        return F.raise_error(F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message)))

    checked = F.when(F.col("_total") == 0, fails("the input has no rows"))
    if policy == "raise":
        for i, name in enumerate(names):
            checked = checked.when(F.col("_bad")[i] > 0, fails(f"column {name!r} holds ", F.col("_bad")[i], " null or non-finite values; null_policy='drop' leaves their rows out"))
    checked = checked.when(F.col("_n") == 0, fails("all ", F.col("_total"), " rows were dropped, leaving nothing to compute from"))
    checked = checked.when(~(divisor > 0), fails(F.col("_n"), f" observations with ddof={ddof:g} leaves nothing to divide by"))
    return sums.select(*by, checked.otherwise(row).alias(out))


def _moments(df, features, by, weights, ddof, null_policy, kind, out, flatten) -> DataFrame:
    features, keys = as_list(features), keys_of(by)
    one_of(null_policy, POLICIES, "null_policy")
    if weights is None and len(features) <= MOST_NATIVE:
        result = _native(df, features, keys, float(ddof), null_policy, kind, out)
    else:
        result = folded(df, features, by, weights, null_policy, lambda s: moments_row(s, float(ddof), kind), schemas.moments(kind), out)
    return flat(result, out, flatten)


def covariance(df: DataFrame, features: ColumnArg | Sequence[ColumnArg], *, by: str | Sequence[str] | None = None, weights: ColumnArg | None = None, ddof: float = 1.0, null_policy: str = "raise", out: str = "covariance", flatten: bool = False) -> DataFrame:
    """One row per group: means, standard deviations and the covariance matrix; rows are left out jointly.

    The divisor is sum(w) - ddof * sum(w²) / sum(w), so reliability weights may be of any scale.
    """
    return _moments(df, features, by, weights, ddof, null_policy, "covariance", out, flatten)


def correlation(df: DataFrame, features: ColumnArg | Sequence[ColumnArg], *, by: str | Sequence[str] | None = None, weights: ColumnArg | None = None, ddof: float = 1.0, null_policy: str = "raise", out: str = "correlation", flatten: bool = False) -> DataFrame:
    """As ``covariance``, with correlations in its place; a column that doesn't move is NaN throughout."""
    return _moments(df, features, by, weights, ddof, null_policy, "correlation", out, flatten)
