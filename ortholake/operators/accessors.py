"""The operators as methods of a DataFrame: ``qr(df)`` for clocked statistics and scores, ``ar(df)`` for sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ortholake.operators import autoregression, pca, timeseries


class _Bound:
    _methods: dict = {}

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str):
        try:
            run = self._methods[name]
        except KeyError:
            raise AttributeError(name) from None
        return lambda *args, **kwargs: run(self._df, *args, **kwargs)

    def __dir__(self):
        return sorted(self._methods)


class qr(_Bound):
    """``qr(df).ewm_sum("x", clock="t", half_life=5)``"""

    _methods = {f"{kind}_{name}": getattr(timeseries, f"{kind}_{name}") for kind in ("rolling", "ewm") for name in ("sum", "mean", "variance", "covariance", "correlation")} | {"pca_transform": pca.pca_transform}


class ar(_Bound):
    """``ar(df).fit("y", order=2, order_by="t")``"""

    _methods = {name: getattr(autoregression, name) for name in ("autocovariance", "autocorrelation", "partial_autocorrelation", "fit", "transform")}
