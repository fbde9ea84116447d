"""Autocovariances, the Durbin and Burg recursions and order selection, from sums that a stream of rows leaves behind."""

from __future__ import annotations

import math

import numpy as np

from ortholake.functions.errors import InputError

CRITERIA = ("aic", "bic", "hqic")


class Moments:
    """Sums over a sequence from which its lagged products about the mean follow, for lags up to ``p``.

    Rows come in pieces; only the last ``p`` and first ``p`` values are kept. Nulls count as rows and deviate by
    nothing. ``matrix`` keeps the products of all pairs of lags, as Burg's recursion needs them.
    """

    def __init__(self, p: int, matrix: bool):
        self.p, self.matrix = p, matrix
        self.n = self.valid = 0
        self.total, self.origin = 0.0, None
        size = (p + 1, p + 1) if matrix else (p + 1,)
        # sums over pairs of lags where both are present: products, left values, right values, counts
        self.xy, self.x, self.y, self.both = (np.zeros(size) for _ in range(4))
        self.head = self.tail = np.zeros(0)

    def add(self, values: np.ndarray) -> None:
        here = ~np.isnan(values)
        if self.origin is None and here.any():
            self.origin = values[here.argmax()]
        shifted = values - (self.origin or 0.0)
        self.n, self.valid = self.n + len(values), self.valid + int(here.sum())
        self.total += float(shifted[here].sum())
        joined = np.concatenate([self.tail, shifted])
        begin = len(self.tail)
        p = self.p
        if self.matrix:
            if len(joined) > p:
                lagged = np.lib.stride_tricks.sliding_window_view(joined, p + 1)[max(0, begin - p) :, ::-1]
                there = (~np.isnan(lagged)).astype(float)
                filled = np.nan_to_num(lagged)
                self.xy += filled.T @ filled
                self.x += filled.T @ there
                self.y += there.T @ filled
                self.both += there.T @ there
        else:
            for k in range(min(p, len(joined) - 1) + 1):
                now, then = joined[max(begin, k) :], joined[max(begin, k) - k : len(joined) - k]
                there = ~np.isnan(now) & ~np.isnan(then)
                now, then = now[there], then[there]
                self.xy[k] += now @ then
                self.x[k] += now.sum()
                self.y[k] += then.sum()
                self.both[k] += len(now)
        if len(self.head) < p:
            self.head = np.concatenate([self.head, shifted])[:p]
        self.tail = joined[max(0, len(joined) - p) :]

    def summary(self) -> tuple:
        return self.n, self.valid, self.total, self.origin, self.xy, self.x, self.y, self.both, self.head, self.tail

    def absorb(self, later: tuple) -> None:
        """Go on with the sums of the rows after these, and with the pairs that lie across."""
        n, valid, total, origin, xy, x, y, both, head, tail = later
        if self.origin is None:
            self.origin = origin
        elif origin is not None and (gap := origin - self.origin):
            xy, x, y = xy + gap * (x + y) + gap * gap * both, x + gap * both, y + gap * both
            total, head, tail = total + gap * valid, head + gap, tail + gap
        p, begin = self.p, len(self.tail)
        joined = np.concatenate([self.tail, head])
        self.xy, self.x, self.y, self.both = self.xy + xy, self.x + x, self.y + y, self.both + both
        if self.matrix:
            if len(joined) > p:
                lagged = np.lib.stride_tricks.sliding_window_view(joined, p + 1)[max(0, begin - p) : begin, ::-1]
                there = (~np.isnan(lagged)).astype(float)
                filled = np.nan_to_num(lagged)
                self.xy += filled.T @ filled
                self.x += filled.T @ there
                self.y += there.T @ filled
                self.both += there.T @ there
        else:
            for k in range(1, p + 1):
                at = np.arange(max(begin, k), min(begin + k, len(joined)))
                now, then = joined[at], joined[at - k]
                there = ~np.isnan(now) & ~np.isnan(then)
                self.xy[k] += now[there] @ then[there]
                self.x[k] += now[there].sum()
                self.y[k] += then[there].sum()
                self.both[k] += there.sum()
        self.n, self.valid, self.total = self.n + n, self.valid + valid, self.total + total
        if len(self.head) < p:
            self.head = np.concatenate([self.head, head])[:p]
        self.tail = np.concatenate([self.tail, tail])[-p:] if p else tail

    def shift(self, demean: bool) -> tuple[float, float]:
        """(the mean reported, the mean about the origin that deviations are taken from)."""
        mean = self.total / self.valid if self.valid else 0.0
        origin = self.origin or 0.0
        return (origin + mean, mean) if demean else (0.0, -origin)

    def autocovariance(self, demean: bool, unbiased: bool) -> np.ndarray:
        _, m = self.shift(demean)
        products = self.xy - m * (self.x + self.y) + m * m * self.both
        return products / (self.n - np.arange(self.p + 1) if unbiased else self.n)

    def lag_products(self, demean: bool) -> list[np.ndarray]:
        """For each order k the products of lags 0 to k summed over rows from k on."""
        _, m = self.shift(demean)
        whole = self.xy - m * (self.x + self.y) + m * m * self.both if self.n > self.p else np.zeros((self.p + 1, self.p + 1))
        head = np.nan_to_num(self.head - m)
        found = []
        for k in range(self.p + 1):
            own = whole[: k + 1, : k + 1].copy()
            for t in range(k, min(self.p, self.n)):
                lags = head[t - k : t + 1][::-1]
                own += np.outer(lags, lags)
            found.append(own)
        return found


def check_lags(n: int, lag: int) -> None:
    if lag >= n:
        raise InputError(f"No pair of observations lies {lag} rows apart in a sequence of {n}")


def durbin(gamma: np.ndarray, p: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(coefficients, reflections, innovation variances) of every order up to ``p``, Yule-Walker."""
    if not np.isfinite(gamma).all():
        raise InputError("the autocovariances overflow")
    if not gamma[0] > 0:
        raise InputError("the series does not move")
    phi, each, steps, variances = np.zeros(0), [np.zeros(0)], [], [gamma[0]]
    for k in range(1, p + 1):
        if not variances[-1] > 0:
            raise InputError(f"the series is exactly predictable from {k - 1} lags")
        step = (gamma[k] - phi @ gamma[k - 1 : 0 : -1]) / variances[-1] if k > 1 else gamma[1] / variances[-1]
        phi = np.append(phi - step * phi[::-1], step)
        each.append(phi)
        steps.append(step)
        variances.append(max(variances[-1] * (1 - step * step), 0.0))
    return each, np.array(steps), np.array(variances)


def burg(products: list[np.ndarray], n: int, p: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As ``durbin``, each step the one that least squares of forward and backward errors gives."""
    start = products[0][0, 0] / n
    if not start > 0:
        raise InputError("the series does not move")
    phi, each, steps, variances = np.zeros(0), [np.zeros(0)], [], [start]
    for k in range(1, p + 1):
        if not variances[-1] > 0:
            raise InputError(f"the series is exactly predictable from {k - 1} lags")
        forward = np.concatenate([[1.0], -phi, [0.0]])
        backward = forward[::-1]
        own = products[k]
        power = forward @ own @ forward + backward @ own @ backward
        if not power > 0:
            raise InputError(f"the series is exactly predictable from {k - 1} lags")
        step = 2 * (forward @ own @ backward) / power
        phi = np.append(phi - step * phi[::-1], step)
        each.append(phi)
        steps.append(step)
        variances.append(max(variances[-1] * (1 - step * step), 0.0))
    return each, np.array(steps), np.array(variances)


def criterion(variances: np.ndarray, n: int, name: str) -> np.ndarray:
    k = np.arange(len(variances))
    cost = {"aic": 2.0, "bic": math.log(n), "hqic": 2 * math.log(math.log(n)) if n > 1 else 0.0}[name]
    with np.errstate(divide="ignore"):
        return n * np.log(variances) + cost * k


def check_order(order: int | str, max_order: int | None) -> int:
    """The greatest order to fit."""
    if isinstance(order, bool) or not isinstance(order, int | str):
        raise TypeError(f"order must be an integer or one of {', '.join(CRITERIA)}, not {type(order).__name__}")
    if isinstance(order, int):
        if order < 0:
            raise ValueError("order must not be negative")
        return order
    if order not in CRITERIA:
        raise ValueError(f"order must be an integer or one of {', '.join(CRITERIA)}, not {order!r}")
    if max_order is None or max_order < 1:
        raise ValueError("choosing an order by a criterion needs max_order of 1 or more")
    return max_order


def fit(moments: Moments, series: str, order: int | str, p: int, method: str, demean: bool) -> dict:
    check_lags(moments.n, p)
    if method == "burg":
        each, steps, variances = burg(moments.lag_products(demean), moments.n, p)
    else:
        each, steps, variances = durbin(moments.autocovariance(demean, False), p)
    scores = criterion(variances, moments.n, order) if isinstance(order, str) else None
    chosen = int(np.argmin(scores)) if scores is not None else order
    return {
        "series": series,
        "coefficients": each[chosen].tolist(),
        "mean": moments.shift(demean)[0],
        "variance": float(variances[chosen]),
        "order": chosen,
        "partial_autocorrelations": steps.tolist(),
        "order_variance": variances.tolist(),
        "criterion": None if scores is None else scores.tolist(),
        "n_observations": moments.n,
        "stationary": bool((np.abs(steps[:chosen]) < 1).all()),
        "method": method,
    }
