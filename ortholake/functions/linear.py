"""Least squares and principal components from a triangular factor, and solves of small dense systems."""

from __future__ import annotations

import numpy as np

from ortholake.functions.errors import InputError

EPS = np.finfo(float).eps


def _diagonal(r: np.ndarray) -> np.ndarray:
    return np.abs(np.diag(r)) if r.size else np.zeros(0)


def solve_design(design: np.ndarray, targets: np.ndarray, n: int, solver: str, penalty: float, intercept: bool) -> dict:
    """Coefficients for every target at once.

    ``design`` and ``targets`` may be the rows themselves or any factor of them with the same normal equations, so
    the factor of many partitions gives what their rows together would.
    """
    p = design.shape[1]
    if solver == "qr" and n < p:
        raise InputError(f"solver='qr' needs at least as many observations as columns: {n} observations, {p} columns")
    system, right = design, targets
    if penalty > 0:
        ridge = np.sqrt(penalty) * np.eye(p)[int(intercept) :]
        system, right = np.vstack([design, ridge]), np.vstack([targets, np.zeros((len(ridge), targets.shape[1]))])
    spectrum = None
    if solver == "qr":
        q, r = np.linalg.qr(system)
        size = _diagonal(r)
        rank = int((size > p * EPS * size.max(initial=0)).sum())
        condition = float(size.max() / size.min()) if size.min(initial=np.inf) > 0 else np.inf
        try:
            beta = np.linalg.solve(r, q.T @ right)
        except np.linalg.LinAlgError:
            beta = np.linalg.lstsq(system, right, rcond=None)[0]
    else:
        u, s, vt = np.linalg.svd(system, full_matrices=False)
        rows = n + (p - int(intercept) if penalty > 0 else 0)
        s = s[: min(rows, p)]
        u, vt = u[:, : len(s)], vt[: len(s)]
        keep = s > max(rows, p) * EPS * s.max(initial=0)
        beta = vt.T @ (np.where(keep, 1 / np.where(keep, s, 1), 0)[:, None] * (u.T @ right))
        rank, spectrum = int(keep.sum()), s
        condition = float(s[0] / s[-1]) if len(s) and s[-1] > 0 else np.inf
    residual = ((targets - design @ beta) ** 2).sum(0)
    return {
        "coefficients": beta[int(intercept) :].T.tolist(),
        "intercept": beta[0].tolist() if intercept else None,
        "rank": rank,
        "residual_sum_of_squares": residual.tolist(),
        "singular_values": None if spectrum is None else spectrum.tolist(),
        "condition": condition,
    }


def fixed_signs(components: np.ndarray) -> np.ndarray:
    """Each component turned so that its first entry of the greatest size is positive."""
    lead = np.abs(components).argmax(1)
    return components * np.where(components[np.arange(len(components)), lead] < 0, -1.0, 1.0)[:, None]


def check_components(n_components: int | None, most: int, what: str) -> int:
    if n_components is not None and n_components < 1:
        raise InputError("at least one component is required")
    if n_components is not None and n_components > most:
        raise InputError(f"{n_components} components were asked for, but {what} support at most {most}")
    return most if n_components is None else n_components


def pca_of_factor(r: np.ndarray, n: int, n_components: int | None, centre: bool, scale: bool) -> dict:
    """Components from the triangular factor of the rows, with a leading column of ones where ``centre``."""
    p = r.shape[1] - int(centre)
    if n < 2:
        raise InputError("principal components need at least two observations")
    k = check_components(n_components, min(n, p), f"{n} observations of {p} features")
    means = r[0, 1:] / r[0, 0] if centre else np.zeros(p)
    rows = r[1:, 1:] if centre else r
    scales = np.ones(p)
    if scale:
        size = np.sqrt((rows**2).sum(0))
        flat = size <= 16 * EPS * np.sqrt(n) * np.abs(means)  # what rounding leaves of a column that doesn't move
        rows = np.where(flat, 0.0, rows)
        scales = np.where(flat | (size == 0), 1.0, size / np.sqrt(n - 1))
        rows = rows / scales
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    s = s[: min(n, p)]
    variance = s**2 / (n - 1)
    total = variance.sum()
    return {
        "means": means.tolist(),
        "scales": scales.tolist(),
        "components": fixed_signs(vt[:k]).tolist(),
        "singular_values": s[:k].tolist(),
        "explained_variance": variance[:k].tolist(),
        "explained_variance_ratio": (variance[:k] / total if total > 0 else np.zeros(k)).tolist(),
        "rank": int((s > max(n, p) * EPS * s.max(initial=0)).sum()),
        "n_observations": n,
    }


def pca_of_covariance(covariance: np.ndarray, means: np.ndarray, n: int, n_components: int | None, scale: bool) -> dict:
    """Components from a covariance matrix, as a merged state holds it; a column that doesn't move keeps scale 1."""
    p = len(means)
    if n < 2:
        raise InputError("principal components need at least two observations")
    k = check_components(n_components, p, f"{p} features")
    scales = np.ones(p)
    if scale:
        spread = np.sqrt(np.maximum(np.diag(covariance), 0))
        scales = np.where(spread > 0, spread, 1.0)
        covariance = covariance / np.outer(scales, scales)
    values, vectors = np.linalg.eigh(covariance)
    variance = np.maximum(values[::-1], 0)
    total = variance.sum()
    return {
        "means": means.tolist(),
        "scales": scales.tolist(),
        "components": fixed_signs(vectors[:, ::-1].T[:k]).tolist(),
        "singular_values": np.sqrt(variance[:k] * (n - 1)).tolist(),
        "explained_variance": variance[:k].tolist(),
        "explained_variance_ratio": (variance[:k] / total if total > 0 else np.zeros(k)).tolist(),
        "rank": int((variance > p * EPS * variance[0]).sum()),
        "n_observations": n,
    }


def solve_spd(matrix: np.ndarray, right: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """(solution, relative asymmetry) of a symmetric positive-definite system, by Cholesky."""
    n, p = matrix.shape
    if n != p:
        raise InputError(f"the matrix has {n} rows and {p} columns; it has to be square")
    top = np.abs(matrix).max(initial=0)
    error = float(np.abs(matrix - matrix.T).max(initial=0) / top) if top > 0 else 0.0
    if error > 1e-8:
        raise InputError(f"the matrix is not symmetric: relative difference {error:.3g} between its triangles")
    try:
        low = np.linalg.cholesky((matrix + matrix.T) / 2 + shift * np.eye(n))
    except np.linalg.LinAlgError:
        raise InputError("the matrix is not positive definite; a larger diagonal_shift makes it so") from None
    return np.linalg.solve(low.T, np.linalg.solve(low, right)), error


def solve_toeplitz(first: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A symmetric positive-definite Toeplitz system by Levinson recursion; all right-hand sides in one climb."""
    n = len(first)
    refused = InputError("the matrix is not positive definite; a larger diagonal_shift makes it so")
    if not first[0] > 0:
        raise refused
    solution = np.zeros_like(right)
    solution[0] = right[0] / first[0]
    phi, error = np.zeros(0), first[0]
    for k in range(1, n):
        step = (first[k] - phi @ first[k - 1 : 0 : -1]) / error if k > 1 else first[1] / error
        phi = np.append(phi - step * phi[::-1], step)
        error *= 1 - step * step
        if not error > 0:
            raise refused
        gain = (right[k] - first[k:0:-1] @ solution[:k]) / error
        solution[:k] -= np.outer(phi[::-1], gain)
        solution[k] = gain
    return solution
