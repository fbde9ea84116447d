"""Mergeable summaries of rows: a triangular factor for least squares, centred moments for covariances.

Both merge in any order and grouping, are of a size that only the number of columns sets, and travel as bytes with a
header that names their kind, version and columns.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

from ortholake.functions.errors import InputError

MAGIC, VERSION = b"OLST", 1
HEADER = struct.Struct("<4sBHII")
LEAST_SQUARES, COVARIANCE = 1, 2
KINDS = {LEAST_SQUARES: "a least-squares state", COVARIANCE: "a covariance state"}


def _encode(kind: int, about: dict, numbers: np.ndarray) -> bytes:
    head = json.dumps(about, separators=(",", ":")).encode()
    body = head + np.ascontiguousarray(numbers, "<f8").tobytes()
    return HEADER.pack(MAGIC, kind, VERSION, len(head), zlib.crc32(body)) + body


def _decode(data: bytes, kind: int) -> tuple[dict, np.ndarray]:
    if len(data) < HEADER.size or data[:4] != MAGIC:
        raise InputError("these bytes are not a state")
    _, found, version, size, crc = HEADER.unpack_from(data)
    if found != kind:
        raise InputError(f"expected {KINDS[kind]}, but {KINDS.get(found, 'another kind').removeprefix('a ')} was given: wanted {KINDS[kind].removeprefix('a ')}, but a {KINDS.get(found, 'foreign').removeprefix('a ').split()[0]} state came")
    if version != VERSION:
        raise InputError(f"a state of version {version} can't be read; this reads version {VERSION}")
    body = data[HEADER.size :]
    if zlib.crc32(body) != crc:
        raise InputError("the state is truncated or damaged")
    return json.loads(body[:size]), np.frombuffer(body[size:], "<f8")


def factor(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows, padded with zero rows where there are few."""
    p = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, p))
    return np.vstack([r, np.zeros((p - len(r), p))]) if len(r) < p else r


class LeastSquaresState:
    """The triangular factor of [1?, features, targets], rows scaled by the roots of their weights."""

    kind = LEAST_SQUARES

    def __init__(self, features: list[str], targets: list[str], intercept: bool):
        self.features, self.targets, self.intercept = list(features), list(targets), bool(intercept)
        size = int(self.intercept) + len(self.features) + len(self.targets)
        self.n, self.weight, self.r = 0, 0.0, np.zeros((size, size))

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> None:
        rows = np.hstack([np.ones((len(x), int(self.intercept))), x, y])
        if w is not None:
            rows = rows * np.sqrt(w)[:, None]
        self.r = factor(np.vstack([self.r[self.r.any(1)], rows]))
        self.n, self.weight = self.n + len(x), self.weight + (len(x) if w is None else float(w.sum()))

    def merge(self, other: LeastSquaresState) -> None:
        if (self.features, self.targets, self.intercept) != (other.features, other.targets, other.intercept):
            raise InputError("the states were built from different columns")
        self.r = factor(np.vstack([self.r, other.r]))
        self.n, self.weight = self.n + other.n, self.weight + other.weight

    def design(self) -> tuple[np.ndarray, np.ndarray]:
        p = int(self.intercept) + len(self.features)
        return self.r[:, :p], self.r[:, p:]

    def encode(self) -> bytes:
        return _encode(self.kind, {"x": self.features, "y": self.targets, "i": int(self.intercept), "n": self.n}, np.append(self.r.ravel(), self.weight))

    @classmethod
    def decode(cls, data: bytes) -> LeastSquaresState:
        about, numbers = _decode(data, cls.kind)
        state = cls(about["x"], about["y"], about["i"])
        state.n, state.weight, state.r = about["n"], float(numbers[-1]), numbers[:-1].reshape(state.r.shape).copy()
        return state


class CovarianceState:
    """Counts, weights, means and centred cross-products, merged with the shift between the means."""

    kind = COVARIANCE

    def __init__(self, features: list[str]):
        self.features = list(features)
        p = len(self.features)
        self.n, self.weight, self.weight2, self.means, self.cross = 0, 0.0, 0.0, np.zeros(p), np.zeros((p, p))

    def _take(self, n: int, weight: float, weight2: float, means: np.ndarray, cross: np.ndarray) -> None:
        total = self.weight + weight
        if weight > 0:
            gap = means - self.means
            self.cross = self.cross + cross + (self.weight * weight / total) * np.outer(gap, gap)
            self.means = self.means + gap * (weight / total)
        self.n, self.weight, self.weight2 = self.n + n, total, self.weight2 + weight2

    def add(self, x: np.ndarray, w: np.ndarray | None) -> None:
        if not len(x):
            return
        w = np.ones(len(x)) if w is None else w
        total = float(w.sum())
        if total > 0:
            origin = x[0]
            means = origin + (w @ (x - origin)) / total
            c = x - means
            cross = (c * w[:, None]).T @ c
            self._take(len(x), total, float((w * w).sum()), means, (cross + cross.T) / 2)
        else:
            self.n += len(x)

    def merge(self, other: CovarianceState) -> None:
        if self.features != other.features:
            raise InputError("the states were built from different columns")
        self._take(other.n, other.weight, other.weight2, other.means, other.cross)

    def covariance(self, ddof: float) -> tuple[np.ndarray, np.ndarray]:
        """(covariance, standard deviations)."""
        divisor = self.weight - ddof * self.weight2 / self.weight if self.weight > 0 else 0.0
        if not divisor > 0:
            raise InputError(f"{self.n} observations with ddof={ddof:g} leaves nothing to divide by")
        matrix = self.cross / divisor
        return matrix, np.sqrt(np.maximum(np.diag(matrix), 0))

    def encode(self) -> bytes:
        return _encode(self.kind, {"x": self.features, "n": self.n}, np.concatenate([[self.weight, self.weight2], self.means, self.cross.ravel()]))

    @classmethod
    def decode(cls, data: bytes) -> CovarianceState:
        about, numbers = _decode(data, cls.kind)
        state = cls(about["x"])
        p = len(state.features)
        state.n, state.weight, state.weight2 = about["n"], float(numbers[0]), float(numbers[1])
        state.means, state.cross = numbers[2 : 2 + p].copy(), numbers[2 + p :].reshape(p, p).copy()
        return state


def correlation_of(covariance: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Correlations in [-1, 1] with ones on the diagonal; a column that doesn't move is NaN throughout."""
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.clip(covariance / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(found, 1.0)
    found[spread <= 0, :] = np.nan
    found[:, spread <= 0] = np.nan
    return found


def moments_row(state: CovarianceState, ddof: float, kind: str) -> dict:
    matrix, spread = state.covariance(ddof)
    if kind == "correlation":
        matrix = correlation_of(matrix, spread)
    return {
        "features": state.features, "means": state.means.tolist(), "standard_deviations": spread.tolist(), kind: matrix.tolist(),
        "n_observations": state.n, "sum_weights": state.weight, "size": len(state.features),
    }
