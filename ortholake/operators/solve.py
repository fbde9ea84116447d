"""Solves of the symmetric positive-definite system that each group's rows lay out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholake.functions import linear, schemas
from ortholake.functions.columns import INTEGRAL, ColumnArg, as_list, flat, keys_of, names_of, numeric
from ortholake.functions.errors import InputError
from ortholake.plans.two_stage import finished, grouped


def in_order(index: np.ndarray, data: np.ndarray, names: list[str]) -> np.ndarray:
    """``data`` in order of its index; ``names`` are those of the index and of the columns."""
    order = np.argsort(index, kind="stable")
    if (np.diff(index[order]) == 0).any():
        raise InputError(f"the row index {names[0]!r} repeats a value")
    bad = ~np.isfinite(data)
    if bad.any():
        at = int(bad.any(0).argmax())
        raise InputError(f"column {names[at + 1]!r} holds {int(bad[:, at].sum())} null or non-finite values")
    return data[order]


def spd_row(data: np.ndarray, names: list[str], n: int, shift: float) -> dict:
    """The result for ``n`` columns of a matrix and the right-hand sides beside them."""
    solution, error = linear.solve_spd(data[:, :n], data[:, n:], shift)
    return {"rows": names[:n], "rhs": names[n:], "solution": solution.T.tolist(), "size": n, "symmetry_error": error, "diagonal_shift": float(shift)}


def toeplitz_row(data: np.ndarray, names: list[str], shift: float) -> dict:
    """The result for a first column and the right-hand sides, ``names``, beside it."""
    first = data[:, 0].copy()
    first[0] += shift
    return {"rhs": names, "solution": linear.solve_toeplitz(first, data[:, 1:]).T.tolist(), "size": len(first), "diagonal_shift": float(shift)}


def _by_index(df: DataFrame, columns: list[ColumnArg], row_index: ColumnArg, by: str | Sequence[str] | None, solve: Callable[[np.ndarray], dict], result, out: str) -> DataFrame:
    """``solve`` of each group's columns in order of its index. A system is as large as a group, and dense."""
    keys, names = keys_of(by), names_of(df, [row_index, *columns])
    if not isinstance(df.select(row_index).schema[0].dataType, INTEGRAL):
        raise InputError(f"the row index {names[0]!r} is not an integer")
    values = [v.alias(f"_v{i}") for i, v in enumerate(numeric(df, columns))]
    index = F.col(row_index) if isinstance(row_index, str) else row_index
    rows = df.select(*keys, index.cast("long").alias("_index"), *values)

    def fold(table: pa.Table) -> pa.Table:
        if table["_index"].null_count:
            raise InputError(f"the row index {names[0]!r} holds {table['_index'].null_count} null values")
        data = np.column_stack([table[f"_v{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))])
        return finished(table, keys, solve(in_order(table["_index"].to_numpy(), data, names)), out, result)

    return grouped(rows, keys, fold, [df.schema[k] for k in keys], out, result)


def solve_spd(df: DataFrame, matrix: ColumnArg | Sequence[ColumnArg], rhs: ColumnArg | Sequence[ColumnArg], *, row_index: ColumnArg, by: str | Sequence[str] | None = None, diagonal_shift: float = 0.0, out: str = "solution", flatten: bool = False) -> DataFrame:
    """One row per group: the solution for each right-hand side, by one Cholesky factor of the averaged triangles."""
    matrix, rhs = as_list(matrix), as_list(rhs)
    names, n = names_of(df, [*matrix, *rhs]), len(matrix)

    solve = partial(spd_row, names=names, n=n, shift=diagonal_shift)
    return flat(_by_index(df, [*matrix, *rhs], row_index, by, solve, schemas.SPD, out), out, flatten)


def solve_toeplitz(df: DataFrame, first_column: ColumnArg, rhs: ColumnArg | Sequence[ColumnArg], *, row_index: ColumnArg, by: str | Sequence[str] | None = None, diagonal_shift: float = 0.0, out: str = "solution", flatten: bool = False) -> DataFrame:
    """One row per group: the solution for each right-hand side; the matrix is never laid out."""
    rhs = as_list(rhs)
    names = names_of(df, rhs)

    solve = partial(toeplitz_row, names=names, shift=diagonal_shift)
    return flat(_by_index(df, [first_column, *rhs], row_index, by, solve, schemas.TOEPLITZ, out), out, flatten)
