"""Autoregression within every group: a lag counts rows, so the order of rows has to be given.

Sequences are streamed through once and leave sums of a size that the number of lags sets; no group is ever held. With
``spread`` a group may go over many tasks, whose sums are merged in order; by default that is so where there are no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions import schemas
from ortholake.functions import sequences as seq
from ortholake.functions.columns import ColumnArg, flat, keys_of, names_of, numeric, one_of
from ortholake.functions.errors import InputError
from ortholake.plans.ordered import fold_groups, fold_spread, map_groups, map_spread, sorted_rows, spread_rows

METHODS, POLICIES = ("yule_walker", "burg"), ("raise", "zero")
Order = ColumnArg | Sequence[ColumnArg]


def _ordered(order_by: Order) -> list[Column]:
    columns = [order_by] if isinstance(order_by, str | Column) else list(order_by)
    if not columns:
        raise ValueError("order_by is required: a lag counts rows")
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def series_values(column: pa.Array, name: str, policy: str) -> np.ndarray:
    if column.null_count and policy == "raise":
        raise InputError(f"a null value in {name!r}; null_policy='zero' lets it deviate by nothing")
    values = column.to_numpy(zero_copy_only=False).astype(float)
    here = column.is_valid().to_numpy(zero_copy_only=False)
    if not np.isfinite(values[here]).all():
        raise InputError(f"a value in {name!r} is not finite")
    return np.where(here, values, np.nan)


def _fold(df: DataFrame, value: ColumnArg, order_by: Order, by, p: int, matrix: bool, policy: str, finish: Callable[[seq.Moments, str], dict], result: T.StructType, out: str, spread: bool | None) -> DataFrame:
    one_of(policy, POLICIES, "null_policy")
    keys, name = keys_of(by), names_of(df, [value])[0]
    rows = df.select("*", numeric(df, [value])[0].alias("_value"))
    spread = not keys if spread is None else spread
    rows = (spread_rows if spread else sorted_rows)(rows, keys, _ordered(order_by)).select(*keys, "_value")

    class State:
        def __init__(self):
            self.moments = seq.Moments(p, matrix)

        def step(self, piece: pa.RecordBatch) -> None:
            self.moments.add(series_values(piece.column("_value"), name, policy))

        def summary(self) -> tuple:
            return self.moments.summary()

        def absorb(self, later: tuple) -> None:
            self.moments.absorb(later)

        def finish(self) -> dict:
            return finish(self.moments, name)

    return (fold_spread if spread else fold_groups)(rows, keys, State, out, result)


def check_lag(max_lag: int, least: int) -> int:
    if isinstance(max_lag, bool) or not isinstance(max_lag, int) or max_lag < least:
        raise ValueError(f"max_lag must be an integer of {least} or more")
    return max_lag


def lags_row(moments: seq.Moments, name: str, max_lag: int, kind: str, demean: bool, unbiased: bool) -> dict:
    """The struct of ``autocovariance`` or ``autocorrelation``, by ``kind``."""
    seq.check_lags(moments.n, max_lag)
    gamma = moments.autocovariance(demean, unbiased)
    if kind == "autocorrelation":
        if not gamma[0] > 0:
            raise InputError("the series does not move")
        gamma = gamma / gamma[0]
    return {"series": name, "lags": list(range(max_lag + 1)), kind: gamma.tolist(), "mean": moments.shift(demean)[0], "n_observations": moments.n}


def partial_row(moments: seq.Moments, name: str, max_lag: int, method: str, demean: bool) -> dict:
    """The struct of ``partial_autocorrelation``."""
    found = seq.fit(moments, name, max_lag, max_lag, method, demean)
    return {"series": name, "lags": list(range(1, max_lag + 1)), "partial_autocorrelation": found["partial_autocorrelations"], "n_observations": moments.n}


def _lags(df, value, max_lag, order_by, by, demean, unbiased, policy, kind, out, flatten, spread) -> DataFrame:
    check_lag(max_lag, 0)

    def finish(moments: seq.Moments, name: str) -> dict:
        return lags_row(moments, name, max_lag, kind, demean, unbiased)

    return flat(_fold(df, value, order_by, by, max_lag, False, policy, finish, schemas.sequence(kind), out, spread), out, flatten)


def autocovariance(df: DataFrame, value: ColumnArg, *, max_lag: int, order_by: Order, by: str | Sequence[str] | None = None, demean: bool = True, unbiased: bool = False, null_policy: str = "raise", out: str = "autocovariance", flatten: bool = False, spread: bool | None = None) -> DataFrame:
    """One row per group: autocovariances of lags 0 to ``max_lag``, divided by all rows (or by the pairs, ``unbiased``)."""
    return _lags(df, value, max_lag, order_by, by, demean, unbiased, null_policy, "autocovariance", out, flatten, spread)


def autocorrelation(df: DataFrame, value: ColumnArg, *, max_lag: int, order_by: Order, by: str | Sequence[str] | None = None, demean: bool = True, unbiased: bool = False, null_policy: str = "raise", out: str = "autocorrelation", flatten: bool = False, spread: bool | None = None) -> DataFrame:
    """As ``autocovariance``, over the variance."""
    return _lags(df, value, max_lag, order_by, by, demean, unbiased, null_policy, "autocorrelation", out, flatten, spread)


def partial_autocorrelation(df: DataFrame, value: ColumnArg, *, max_lag: int, order_by: Order, by: str | Sequence[str] | None = None, method: str = "yule_walker", demean: bool = True, null_policy: str = "raise", out: str = "partial_autocorrelation", flatten: bool = False, spread: bool | None = None) -> DataFrame:
    """One row per group: partial autocorrelations of lags 1 to ``max_lag``."""
    one_of(method, METHODS, "method")
    check_lag(max_lag, 1)

    def finish(moments: seq.Moments, name: str) -> dict:
        return partial_row(moments, name, max_lag, method, demean)

    return flat(_fold(df, value, order_by, by, max_lag, method == "burg", null_policy, finish, schemas.PARTIAL, out, spread), out, flatten)


def fit(df: DataFrame, value: ColumnArg, *, order: int | str, order_by: Order, by: str | Sequence[str] | None = None, max_order: int | None = None, method: str = "yule_walker", demean: bool = True, null_policy: str = "raise", out: str = "fit", flatten: bool = False, spread: bool | None = None) -> DataFrame:
    """One row per group: an autoregression of the order given, or of the one that "aic", "bic" or "hqic" likes best."""
    one_of(method, METHODS, "method")
    p = seq.check_order(order, max_order)

    def finish(moments: seq.Moments, name: str) -> dict:
        return seq.fit(moments, name, order, p, method, demean)

    return flat(_fold(df, value, order_by, by, p, method == "burg", null_policy, finish, schemas.AUTOREGRESSION, out, spread), out, flatten)


def transform(df: DataFrame, value: ColumnArg, *, order: int | str, order_by: Order, by: str | Sequence[str] | None = None, max_order: int | None = None, method: str = "yule_walker", demean: bool = True, output: str = "residual", null_policy: str = "raise", out: str | None = None, spread: bool | None = None) -> DataFrame:
    """``df`` with each row's residual or prediction by its group's fit; null where a lag it needs isn't there."""
    one_of(output, ("residual", "prediction"), "output")
    keys, name = keys_of(by), names_of(df, [value])[0]
    model = fit(df, value, order=order, order_by=order_by, by=by, max_order=max_order, method=method, demean=demean, null_policy=null_policy, out="_fit", spread=spread)
    model = model.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_fit.coefficients").alias("_phi"), F.col("_fit.mean").alias("_mean"))
    rows = df.select("*", numeric(df, [value])[0].alias("_value"))
    if keys:
        same = rows[keys[0]].eqNullSafe(model["_key0"])
        for i, k in enumerate(keys[1:], 1):
            same = same & rows[k].eqNullSafe(model[f"_key{i}"])
        joined = rows.join(model, same).drop(*(f"_key{i}" for i in range(len(keys))))
    else:  # one row
        joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(model.withColumn("_one", F.lit(1))), "_one").drop("_one")

    class State:
        def __init__(self):
            self.order, self.tail = 0, np.zeros(0)

        def _keep(self, values: np.ndarray) -> None:
            self.tail = values[max(0, len(values) - self.order) :]

        def step(self, piece: pa.RecordBatch) -> list[pa.Array]:
            phi = np.array(piece.column("_phi")[0].as_py(), float)
            mean = piece.column("_mean")[0].as_py()
            values = series_values(piece.column("_value"), name, null_policy) - mean
            p = self.order = len(phi)
            joined = np.concatenate([np.full(p - len(self.tail), np.nan), self.tail, values])
            found = np.zeros(len(values))
            for k in range(p):
                found += phi[k] * joined[p - 1 - k : len(joined) - 1 - k]
            self._keep(np.concatenate([self.tail, values]))
            found = np.where(np.isnan(values), np.nan, found + mean if output == "prediction" else values - found)
            return [pa.array(found, mask=np.isnan(found))]

        def summary(self) -> tuple[int, np.ndarray]:
            return self.order, self.tail

        def absorb(self, later: tuple[int, np.ndarray]) -> None:
            self.order = later[0]
            self._keep(np.concatenate([self.tail, later[1]]))

    fields = [T.StructField(out or output, T.DoubleType())]
    spread = not keys if spread is None else spread
    order = _ordered(order_by)
    result = map_spread(spread_rows(joined, keys, order), keys, State, fields) if spread else map_groups(sorted_rows(joined, keys, order), keys, State, fields)
    return result.drop("_value", "_phi", "_mean")
