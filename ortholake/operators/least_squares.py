"""Weighted, ridge-penalised, multi-target least squares for every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ortholake.functions import schemas
from ortholake.functions.columns import ColumnArg, as_list, flat, keys_of, names_of, numeric, one_of
from ortholake.functions.linear import solve_design
from ortholake.functions.states import LeastSquaresState
from ortholake.plans.two_stage import two_stage

POLICIES = ("raise", "drop")


def fit_of_state(state: LeastSquaresState, solver: str, l2_penalty: float) -> dict:
    design, targets = state.design()
    found = solve_design(design, targets, state.n, solver, l2_penalty, state.intercept)
    return {"features": state.features, "targets": state.targets, "n_observations": state.n, "solver": solver} | found


def folded(df, targets, features, by, weights, intercept, null_policy, finish, result, out) -> DataFrame:
    """``finish`` of each group's state."""
    targets, features, by = as_list(targets), as_list(features), keys_of(by)
    one_of(null_policy, POLICIES, "null_policy")
    columns = [*targets, *features] + ([] if weights is None else [weights])
    names, n_targets = names_of(df, columns), len(targets)
    target_names, feature_names = names[:n_targets], names[n_targets : n_targets + len(features)]
    return two_stage(
        df, by, numeric(df, columns), names, weights is not None,
        lambda: LeastSquaresState(feature_names, target_names, intercept),
        lambda state, rows, w: state.add(rows[:, n_targets:], rows[:, :n_targets], w),
        finish, result, out, null_policy,
    )


def least_squares(
    df: DataFrame,
    targets: ColumnArg | Sequence[ColumnArg],
    features: ColumnArg | Sequence[ColumnArg],
    *,
    by: str | Sequence[str] | None = None,
    weights: ColumnArg | None = None,
    intercept: bool = False,
    solver: str = "qr",
    l2_penalty: float = 0.0,
    null_policy: str = "raise",
    out: str = "fit",
    flatten: bool = False,
) -> DataFrame:
    """One row per group: ``by`` and the struct ``out`` (its fields, with ``flatten``).

    Rows are folded into a triangular factor where they lie, so what is shuffled is a few numbers per group and task.
    ``solver="svd"`` takes fewer rows than columns, with the solution of least norm. The penalty spares the intercept;
    rank, condition and singular values are those of the penalised design, residuals those without the penalty.
    """
    one_of(solver, ("qr", "svd"), "solver")
    result = folded(df, targets, features, by, weights, intercept, null_policy, lambda s: fit_of_state(s, solver, float(l2_penalty)), schemas.LEAST_SQUARES, out)
    return flat(result, out, flatten)
