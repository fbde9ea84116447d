"""The operators on states as SQL functions, and fits of whole groups as aggregate expressions.

    register(spark)
    spark.sql("select day, finalise_least_squares(merge_least_squares_states(state)).coefficients from states group by day")

An aggregate expression here brings each group to one task, and its columns into memory; the functions in
``ortholake.operators`` fold rows where they lie and are the better choice for large groups. Columns are names.
Sequences and systems are put in order within the expression, by columns that ascend with nulls first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.functions import ArrowUDFType

from ortholake.functions import schemas
from ortholake.functions.columns import one_of
from ortholake.functions.errors import InputError
from ortholake.functions.linear import pca_of_covariance, pca_of_factor
from ortholake.functions.sequences import Moments, check_order, fit
from ortholake.functions.states import CovarianceState, LeastSquaresState, moments_row
from ortholake.operators.autoregression import METHODS, POLICIES, check_lag, lags_row, partial_row, series_values
from ortholake.operators.least_squares import fit_of_state
from ortholake.operators.solve import in_order, spd_row, toeplitz_row
from ortholake.plans.two_stage import Rows


def _merge(kind: type):
    def merge(states: pa.Array) -> Any:
        held = None
        for data in states.to_pylist():
            if data is not None:
                other = kind.decode(data)
                if held is None:
                    held = other
                else:
                    held.merge(other)
        if held is None:
            raise InputError("there is no state to merge: every one is null")
        return held.encode()

    return arrow_udf(merge, T.BinaryType(), ArrowUDFType.GROUPED_AGG)


def _finalise(finish: Callable[[bytes], dict], result: T.StructType):
    def run(states: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([None if x is None else finish(x) for x in states.to_pylist()], to_arrow_type(result))

    return arrow_udf(run, result)


def _pca_of_state(data: bytes) -> dict:
    held = CovarianceState.decode(data)
    return {"features": held.features} | pca_of_covariance(held.covariance(1.0)[0], held.means, held.n, None, False)


def register(spark: SparkSession) -> None:
    """Add merge_least_squares_states, merge_covariance_states and the four finalise_ functions to the session's SQL.

    The finalise functions take their operators' defaults; a null state gives null.
    """
    functions = {
        "merge_least_squares_states": _merge(LeastSquaresState),
        "merge_covariance_states": _merge(CovarianceState),
        "finalise_least_squares": _finalise(lambda x: fit_of_state(LeastSquaresState.decode(x), "qr", 0.0), schemas.LEAST_SQUARES),
        "finalise_covariance": _finalise(lambda x: moments_row(CovarianceState.decode(x), 1.0, "covariance"), schemas.moments("covariance")),
        "finalise_correlation": _finalise(lambda x: moments_row(CovarianceState.decode(x), 1.0, "correlation"), schemas.moments("correlation")),
        "finalise_pca": _finalise(_pca_of_state, schemas.PCA),
    }
    for name, function in functions.items():
        spark.udf.register(name, function)


def _numbers(name: str, column: pa.Array) -> np.ndarray:
    """Doubles, NaN where null; anything but integers and floats is refused."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_null(column.type)):
        raise InputError(f"column {name!r} of type {column.type} is not numeric")
    return column.to_numpy(zero_copy_only=False).astype(float)


def _expression(run: Callable[..., Any], result: T.DataType, names: Sequence[str]) -> Column:
    run.__annotations__ = {"arrays": pa.Array, "return": Any}
    return arrow_udf(run, result, ArrowUDFType.GROUPED_AGG)(*names)


def _aggregate(columns: Sequence[str], weights: str | None, policy: str, finish: Callable[[np.ndarray, np.ndarray | None], Any], result: T.DataType) -> Column:
    names = [*columns, *([weights] if weights else [])]
    one_of(policy, ("raise", "drop"), "null_policy")

    def run(*arrays: pa.Array) -> Any:
        data = np.column_stack([_numbers(n, a) for n, a in zip(names, arrays, strict=True)])
        good = np.isfinite(data)
        seen = Rows(names, len(data), (~good).sum(0))
        data = data[good.all(1)]
        w = data[:, -1] if weights else None
        seen.negative = int((w < 0).sum()) if weights else 0
        seen.check(len(data), float(w.sum()) if weights else len(data), bool(weights), policy)
        return finish(data[:, : len(columns)], w)

    return _expression(run, result, names)


def _least_squares_state(targets: Sequence[str], features: Sequence[str], intercept: bool) -> Callable[..., LeastSquaresState]:
    def state(data: np.ndarray, w: np.ndarray | None) -> LeastSquaresState:
        held = LeastSquaresState(list(features), list(targets), intercept)
        held.add(data[:, len(targets) :], data[:, : len(targets)], w)
        return held

    return state


def _covariance_state(features: Sequence[str]) -> Callable[..., CovarianceState]:
    def state(data: np.ndarray, w: np.ndarray | None) -> CovarianceState:
        held = CovarianceState(list(features))
        held.add(data, w)
        return held

    return state


def least_squares(targets: Sequence[str], features: Sequence[str], *, weights: str | None = None, intercept: bool = False, solver: str = "qr", l2_penalty: float = 0.0, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.least_squares``."""

    state = _least_squares_state(targets, features, intercept)
    return _aggregate([*targets, *features], weights, null_policy, lambda data, w: fit_of_state(state(data, w), solver, l2_penalty), schemas.LEAST_SQUARES)


def least_squares_state(targets: Sequence[str], features: Sequence[str], *, weights: str | None = None, intercept: bool = False, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the bytes of ``operators.least_squares_state``."""
    state = _least_squares_state(targets, features, intercept)
    return _aggregate([*targets, *features], weights, null_policy, lambda data, w: state(data, w).encode(), schemas.STATE)


def covariance(features: Sequence[str], *, weights: str | None = None, ddof: float = 1.0, null_policy: str = "raise", kind: str = "covariance") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.covariance`` (or of "correlation", by ``kind``)."""

    state = _covariance_state(features)
    return _aggregate(features, weights, null_policy, lambda data, w: moments_row(state(data, w), ddof, kind), schemas.moments(kind))


def correlation(features: Sequence[str], *, weights: str | None = None, ddof: float = 1.0, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.correlation``."""
    return covariance(features, weights=weights, ddof=ddof, null_policy=null_policy, kind="correlation")


def covariance_state(features: Sequence[str], *, weights: str | None = None, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the bytes of ``operators.covariance_state``."""
    state = _covariance_state(features)
    return _aggregate(features, weights, null_policy, lambda data, w: state(data, w).encode(), schemas.STATE)


def pca(features: Sequence[str], *, n_components: int | None = None, centre: bool = True, scale: bool = False, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.pca``."""

    def finish(data: np.ndarray, w: np.ndarray | None) -> dict:
        state = LeastSquaresState(list(features), [], centre)
        state.add(data, data[:, :0], None)
        return {"features": list(features)} | pca_of_factor(state.design()[0], state.n, n_components, centre, scale)

    return _aggregate(features, None, null_policy, finish, schemas.PCA)


def _system(columns: Sequence[str], row_index: str, finish: Callable[[np.ndarray], dict], result: T.StructType) -> Column:
    names = [row_index, *columns]

    def run(*arrays: pa.Array) -> Any:
        index = arrays[0]
        if not pa.types.is_integer(index.type):
            raise InputError(f"the row index {row_index!r} is not an integer")
        if index.null_count:
            raise InputError(f"the row index {row_index!r} holds {index.null_count} null values")
        data = np.column_stack([_numbers(n, a) for n, a in zip(columns, arrays[1:], strict=True)])
        return finish(in_order(index.to_numpy(zero_copy_only=False), data, names))

    return _expression(run, result, names)


def solve_spd(matrix: Sequence[str], rhs: Sequence[str], *, row_index: str, diagonal_shift: float = 0.0) -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.solve_spd``."""
    names, n = [*matrix, *rhs], len(matrix)
    return _system(names, row_index, lambda data: spd_row(data, names, n, diagonal_shift), schemas.SPD)


def solve_toeplitz(first_column: str, rhs: Sequence[str], *, row_index: str, diagonal_shift: float = 0.0) -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``operators.solve_toeplitz``."""
    names = list(rhs)
    return _system([first_column, *names], row_index, lambda data: toeplitz_row(data, names, diagonal_shift), schemas.TOEPLITZ)


def _sequence(value: str, order_by: str | Sequence[str], p: int, matrix: bool, policy: str, finish: Callable[[Moments], dict], result: T.StructType) -> Column:
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not order:
        raise ValueError("order_by is required: a lag counts rows")
    one_of(policy, POLICIES, "null_policy")

    def run(*arrays: pa.Array) -> Any:
        for name, column in zip(order, arrays[1:], strict=True):
            if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
                raise InputError(f"the order {name!r} holds a NaN")
        _numbers(value, arrays[0].slice(0, 0))
        keys = pa.Table.from_arrays(list(arrays[1:]), names=[f"o{i}" for i in range(len(order))])
        rows = pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in keys.column_names], null_placement="at_start")
        moments = Moments(p, matrix)
        moments.add(series_values(arrays[0].take(rows), value, policy))
        return finish(moments)

    return _expression(run, result, [value, *order])


def autocovariance(value: str, *, max_lag: int, order_by: str | Sequence[str], demean: bool = True, unbiased: bool = False, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``autoregression.autocovariance``."""
    check_lag(max_lag, 0)
    return _sequence(value, order_by, max_lag, False, null_policy, lambda m: lags_row(m, value, max_lag, "autocovariance", demean, unbiased), schemas.sequence("autocovariance"))


def autocorrelation(value: str, *, max_lag: int, order_by: str | Sequence[str], demean: bool = True, unbiased: bool = False, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``autoregression.autocorrelation``."""
    check_lag(max_lag, 0)
    return _sequence(value, order_by, max_lag, False, null_policy, lambda m: lags_row(m, value, max_lag, "autocorrelation", demean, unbiased), schemas.sequence("autocorrelation"))


def partial_autocorrelation(value: str, *, max_lag: int, order_by: str | Sequence[str], method: str = "yule_walker", demean: bool = True, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``autoregression.partial_autocorrelation``."""
    one_of(method, METHODS, "method")
    check_lag(max_lag, 1)
    return _sequence(value, order_by, max_lag, method == "burg", null_policy, lambda m: partial_row(m, value, max_lag, method, demean), schemas.PARTIAL)


def autoregression_fit(value: str, *, order: int | str, order_by: str | Sequence[str], max_order: int | None = None, method: str = "yule_walker", demean: bool = True, null_policy: str = "raise") -> Column:
    """For ``groupBy(...).agg(...)``: the struct of ``autoregression.fit``."""
    one_of(method, METHODS, "method")
    p = check_order(order, max_order)
    return _sequence(value, order_by, p, method == "burg", null_policy, lambda m: fit(m, value, order, p, method, demean), schemas.AUTOREGRESSION)
