"""Every operator by name; autoregression's ``fit`` and ``transform`` are in ``autoregression``."""

from ortholake.operators import autoregression
from ortholake.operators.accessors import ar, qr
from ortholake.operators.least_squares import least_squares
from ortholake.operators.moments import correlation, covariance
from ortholake.operators.pca import pca, pca_transform
from ortholake.operators.solve import solve_spd, solve_toeplitz
from ortholake.operators.states import (
    covariance_state,
    finalise_correlation,
    finalise_covariance,
    finalise_least_squares,
    finalise_pca,
    least_squares_state,
    merge_covariance_states,
    merge_least_squares_states,
)
from ortholake.operators.timeseries import (
    Statistic,
    clocked,
    ewm_correlation,
    ewm_covariance,
    ewm_mean,
    ewm_sum,
    ewm_variance,
    rolling_correlation,
    rolling_covariance,
    rolling_mean,
    rolling_sum,
    rolling_variance,
)

__all__ = [
    "Statistic", "ar", "autoregression", "clocked", "correlation", "covariance", "covariance_state", "ewm_correlation", "ewm_covariance", "ewm_mean",
    "ewm_sum", "ewm_variance", "finalise_correlation", "finalise_covariance", "finalise_least_squares", "finalise_pca", "least_squares",
    "least_squares_state", "merge_covariance_states", "merge_least_squares_states", "pca", "pca_transform", "qr", "rolling_correlation",
    "rolling_covariance", "rolling_mean", "rolling_sum", "rolling_variance", "solve_spd", "solve_toeplitz",
]
