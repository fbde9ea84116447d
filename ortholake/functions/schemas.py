"""Result types; each is known without running anything."""

from pyspark.sql import types as T

DOUBLES, NAMES = T.ArrayType(T.DoubleType()), T.ArrayType(T.StringType())
MATRIX = T.ArrayType(DOUBLES)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


D, L, S, B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()

LEAST_SQUARES = _struct(features=NAMES, targets=NAMES, coefficients=MATRIX, intercept=DOUBLES, n_observations=L, rank=L, residual_sum_of_squares=DOUBLES, singular_values=DOUBLES, condition=D, solver=S)


def moments(kind: str) -> T.StructType:
    return _struct(features=NAMES, means=DOUBLES, standard_deviations=DOUBLES, **{kind: MATRIX}, n_observations=L, sum_weights=D, size=L)


PCA = _struct(features=NAMES, means=DOUBLES, scales=DOUBLES, components=MATRIX, singular_values=DOUBLES, explained_variance=DOUBLES, explained_variance_ratio=DOUBLES, rank=L, n_observations=L)
SPD = _struct(rows=NAMES, rhs=NAMES, solution=MATRIX, size=L, symmetry_error=D, diagonal_shift=D)
TOEPLITZ = _struct(rhs=NAMES, solution=MATRIX, size=L, diagonal_shift=D)


def sequence(kind: str) -> T.StructType:
    return _struct(series=S, lags=T.ArrayType(L), **{kind: DOUBLES}, mean=D, n_observations=L)


PARTIAL = _struct(series=S, lags=T.ArrayType(L), partial_autocorrelation=DOUBLES, n_observations=L)
AUTOREGRESSION = _struct(series=S, coefficients=DOUBLES, mean=D, variance=D, order=L, partial_autocorrelations=DOUBLES, order_variance=DOUBLES, criterion=DOUBLES, n_observations=L, stationary=B, method=S)
STATE = T.BinaryType()
