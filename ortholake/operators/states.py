"""Summaries of groups as bytes: built from rows, stored, merged in any order, and finalised later."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions import schemas
from ortholake.functions.columns import ColumnArg, keys_of, one_of
from ortholake.functions.errors import InputError
from ortholake.functions.linear import pca_of_covariance
from ortholake.functions.states import CovarianceState, LeastSquaresState, moments_row
from ortholake.operators.least_squares import fit_of_state, folded
from ortholake.operators.moments import folded as folded_moments
from ortholake.plans.two_stage import finished, grouped


def least_squares_state(df: DataFrame, targets: ColumnArg | Sequence[ColumnArg], features: ColumnArg | Sequence[ColumnArg], *, by: str | Sequence[str] | None = None, weights: ColumnArg | None = None, intercept: bool = False, null_policy: str = "raise", out: str = "state") -> DataFrame:
    """One row per group: ``by`` and the bytes ``out``, which any number of least-squares fits can be finalised from."""
    return folded(df, targets, features, by, weights, intercept, null_policy, lambda s: s.encode(), schemas.STATE, out)


def covariance_state(df: DataFrame, features: ColumnArg | Sequence[ColumnArg], *, by: str | Sequence[str] | None = None, weights: ColumnArg | None = None, null_policy: str = "raise", out: str = "state") -> DataFrame:
    """One row per group: ``by`` and the bytes ``out``, for covariances, correlations and principal components."""
    return folded_moments(df, features, by, weights, null_policy, lambda s: s.encode(), schemas.STATE, out)


def _merged(df: DataFrame, state: str, by: str | Sequence[str] | None, kind: type, out: str) -> DataFrame:
    """States are merged within each task first, so a group's shuffle is a state per task however many it has."""
    keys = keys_of(by)
    fields = [df.schema[k] for k in keys]

    def fold(table: pa.Table) -> pa.Table:
        held = None
        for data in table["_state"].to_pylist():
            if data is not None:
                other = kind.decode(data)
                if held is None:
                    held = other
                else:
                    held.merge(other)
        if held is None:
            raise InputError("there is no state to merge: every one is null")
        return finished(table, keys, held.encode(), out, schemas.STATE)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ortholake.plans.two_stage import key_rows

        for batch in batches:
            states = batch.column("_state")
            for _, one, at in key_rows(batch, keys):
                held = None
                for i in at.tolist():
                    if (data := states[i].as_py()) is not None:
                        other = kind.decode(data)
                        if held is None:
                            held = other
                        else:
                            held.merge(other)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([None if held is None else held.encode()], pa.binary())], names=[*keys, "_state"])

    rows = df.select(*keys, F.col(state).alias("_state"))
    return grouped(rows.mapInArrow(ahead, T.StructType([*fields, T.StructField("_state", T.BinaryType())])), keys, fold, fields, out, schemas.STATE)


def merge_least_squares_states(df: DataFrame, state: str = "state", *, by: str | Sequence[str] | None = None, out: str = "state") -> DataFrame:
    """One row per group: the states of its rows as one. Null states are left out; a group of only nulls is an error."""
    return _merged(df, state, by, LeastSquaresState, out)


def merge_covariance_states(df: DataFrame, state: str = "state", *, by: str | Sequence[str] | None = None, out: str = "state") -> DataFrame:
    """As ``merge_least_squares_states``, for covariance states."""
    return _merged(df, state, by, CovarianceState, out)


def _finalised(df: DataFrame, state: str, finish: Callable[[bytes], dict], result: T.StructType, out: str) -> DataFrame:
    from pyspark.sql.functions import arrow_udf

    def run(states: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        if states.null_count:
            raise InputError("a null state can't be finalised")
        return pa.array([finish(x) for x in states.to_pylist()], to_arrow_type(result))

    return df.withColumn(out, arrow_udf(run, result)(F.col(state)))


def finalise_least_squares(df: DataFrame, state: str = "state", *, solver: str = "qr", l2_penalty: float = 0.0, out: str = "fit") -> DataFrame:
    """``df`` with ``out``, the fit of each state; the same struct as ``least_squares``."""
    one_of(solver, ("qr", "svd"), "solver")
    return _finalised(df, state, lambda x: fit_of_state(LeastSquaresState.decode(x), solver, float(l2_penalty)), schemas.LEAST_SQUARES, out)


def finalise_covariance(df: DataFrame, state: str = "state", *, ddof: float = 1.0, out: str = "covariance") -> DataFrame:
    """``df`` with ``out``, the covariance matrix of each state."""
    return _finalised(df, state, lambda x: moments_row(CovarianceState.decode(x), float(ddof), "covariance"), schemas.moments("covariance"), out)


def finalise_correlation(df: DataFrame, state: str = "state", *, ddof: float = 1.0, out: str = "correlation") -> DataFrame:
    """``df`` with ``out``, the correlation matrix of each state."""
    return _finalised(df, state, lambda x: moments_row(CovarianceState.decode(x), float(ddof), "correlation"), schemas.moments("correlation"), out)


def finalise_pca(df: DataFrame, state: str = "state", *, n_components: int | None = None, scale: bool = False, out: str = "pca") -> DataFrame:
    """``df`` with ``out``, the principal components of each covariance state, always about the means.

    All features are reported unless ``n_components`` says otherwise; a column that doesn't move keeps scale 1.
    """

    def finish(data: bytes) -> dict:
        held = CovarianceState.decode(data)
        if held.n < 2:
            raise InputError("principal components need at least two observations")
        return {"features": held.features} | pca_of_covariance(held.covariance(1.0)[0], held.means, held.n, n_components, scale)

    return _finalised(df, state, finish, schemas.PCA, out)


