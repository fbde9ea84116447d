"""Principal components of every group, and the scores of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholake.functions import schemas
from ortholake.functions.columns import ColumnArg, as_list, flat, keys_of, names_of, numeric, one_of
from ortholake.functions.linear import pca_of_factor
from ortholake.functions.states import LeastSquaresState
from ortholake.operators.least_squares import POLICIES
from ortholake.plans.shared import shared_dir
from ortholake.plans.two_stage import two_stage

#: Models of all groups up to this size are broadcast.
BROADCAST_BYTES = 32 << 20


def pca(
    df: DataFrame,
    features: ColumnArg | Sequence[ColumnArg],
    *,
    by: str | Sequence[str] | None = None,
    n_components: int | None = None,
    centre: bool = True,
    scale: bool = False,
    null_policy: str = "raise",
    out: str = "pca",
    flatten: bool = False,
) -> DataFrame:
    """One row per group: means, scales, loadings, strongest first, and the variance that each explains.

    One pass: the triangular factor of the rows beside a column of ones holds the means, and its trailing block has
    the singular values of the centred rows, at their precision rather than that of their squares.
    """
    features = as_list(features)
    one_of(null_policy, POLICIES, "null_policy")
    if n_components is not None and n_components < 1:
        raise ValueError("at least one component is required")
    names = names_of(df, features)

    def finish(state: LeastSquaresState) -> dict:
        return {"features": names} | pca_of_factor(state.design()[0], state.n, n_components, centre, scale)

    result = two_stage(
        df, keys_of(by), numeric(df, features), names, False,
        lambda: LeastSquaresState(names, [], centre), lambda state, rows, w: state.add(rows, rows[:, :0], None), finish, schemas.PCA, out, null_policy,
    )
    return flat(result, out, flatten)


def pca_transform(
    df: DataFrame,
    features: ColumnArg | Sequence[ColumnArg],
    n_components: int,
    *,
    by: str | Sequence[str] | None = None,
    centre: bool = True,
    scale: bool = False,
    null_policy: str = "raise",
    prefix: str = "component_",
) -> DataFrame:
    """``df`` with ``component_1`` to ``component_k``: each row's scores in its group's components.

    The scores are arithmetic on columns, joined with one row per group; a row left out of the fit keeps its place and
    scores null. The models are written first, and broadcast if all of them are small, so that no row is moved; else
    rows are joined with them by their keys.
    """
    features, keys = as_list(features), keys_of(by)
    model = pca(df, features, by=keys or None, n_components=n_components, centre=centre, scale=scale, null_policy=null_policy, out="_pca")
    values = numeric(df, features)
    model = model.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_pca")
    if keys:
        shared_dir(df.sparkSession)
        model = model.checkpoint()
        if model.count() * (64 + 8 * (len(features) + 3) * n_components + 64 * len(features)) <= BROADCAST_BYTES:
            model = F.broadcast(model)
        same = df[keys[0]].eqNullSafe(model["_key0"])
        for i, k in enumerate(keys[1:], 1):
            same = same & df[k].eqNullSafe(model[f"_key{i}"])
        joined = df.join(model, same, "left")
    else:  # one row
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(model.withColumn("_one", F.lit(1))), "_one", "left")
    usable = values[0].isNotNull()
    for v in values:
        usable = usable & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def score(c: int) -> Column:
        total = F.lit(0.0)
        for j, v in enumerate(values):
            total = total + (v - F.col("_pca.means")[j]) / F.col("_pca.scales")[j] * F.col("_pca.components")[c][j]
        return F.when(usable, total)

    return joined.select(*(df[c] for c in df.columns) if keys else df.columns, *(score(c).alias(f"{prefix}{c + 1}") for c in range(n_components)))
