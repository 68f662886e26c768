"""Leading eigenpairs of a symmetric matrix by contour integration (Polizzi, 2009), with inertia counts."""

from __future__ import annotations

import numpy as np

#: Eigenvalues that one contour encloses, and quadrature points on its upper half.
ENCLOSED, POINTS = 6, 8
#: Residuals below this share of the matrix's norm are done.
TOLERANCE = 1e-13


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` lie above ``shift``: by Sylvester's law the positive ones of a block LDL' factor.

    Pivots are the greatest entries, one on the diagonal or a block of two (Bunch and Parlett, 1971);
    such a block has one eigenvalue of either sign.
    """
    m = a - shift * np.eye(len(a))
    border, above = (1 + np.sqrt(17)) / 8, 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        most = off.max() if len(m) > 1 else 0.0
        if diagonal[p] >= border * most:
            if diagonal[p] == 0:
                break
            above += int(m[p, p] > 0)
            rest = np.delete(np.arange(len(m)), p)
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, p], m[p, rest]) / m[p, p]
        else:
            i, j = np.unravel_index(int(off.argmax()), off.shape)
            above += 1
            rest = np.delete(np.arange(len(m)), [i, j])
            m = m[np.ix_(rest, rest)] - m[np.ix_(rest, [i, j])] @ np.linalg.solve(m[np.ix_([i, j], [i, j])], m[np.ix_([i, j], rest)])
    return above


def _gap(a: np.ndarray, above: int, low: float, high: float) -> float | None:
    """A shift in the middle of the gap below the ``above`` greatest eigenvalues; None if there is no gap."""
    def first(count: int) -> float:
        """Least shift with at most ``count`` eigenvalues above it."""
        s, e = low, high
        for _ in range(60):
            if e - s <= TOLERANCE * high:
                break
            middle = (s + e) / 2
            s, e = (s, middle) if inertia(a, middle) <= count else (middle, e)
        return e

    lower, upper = first(above), first(above - 1)
    return (lower + upper) / 2 if upper - lower > 100 * TOLERANCE * high else None


def _enclosed(a: np.ndarray, low: float, high: float, count: int, norm: float) -> np.ndarray:
    """Orthonormal columns that span the eigenvectors with eigenvalues between ``low`` and ``high``."""
    d, eye = len(a), np.eye(len(a))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * np.pi * (1 + nodes))
    middle, radius = (low + high) / 2, (high - low) / 2
    size = min(d, 2 * count + 4)
    while True:
        y = np.random.default_rng(size).normal(size=(d, size))
        for _ in range(30):
            q = sum(0.5 * w * radius * (t * np.linalg.solve((middle + radius * t) * eye - a, y)).real for t, w in zip(turn, weights))
            basis, kept, _ = np.linalg.svd(q, full_matrices=False)
            basis = basis[:, kept > 1e-14 * kept[0]]
            values, mix = np.linalg.eigh(basis.T @ a @ basis)
            y = basis @ mix
            inside = (values > low) & (values < high)
            wrong = np.abs(a @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
            if inside.sum() == count and wrong <= TOLERANCE * norm:
                return y[:, inside]
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues between {low} and {high}")
        size = min(d, 2 * size)


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the ``wanted`` greatest eigenvalues of a covariance matrix, falling.

    Inertia counts place the contours in gaps of the spectrum and say how many eigenvalues each
    holds; a contour is done when so many are found. Fewer come back where fewer differ from zero.
    Equal eigenvalues get an orthonormal basis of their space.
    """
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if not norm > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    least, most = 1e-12 * norm, norm * (1 + 1e-9)
    wanted = min(wanted, rank := inertia(a, least))
    border, done, found = most, 0, []
    while done < wanted:
        for above in range(min(done + ENCLOSED, wanted), rank + 1):
            low = least if above == rank else _gap(a, above, least, border)
            if low is not None:
                break
        found.append(_enclosed(a, low, border, above - done, norm))
        border, done = low, above
    basis, _ = np.linalg.qr(np.concatenate(found, axis=1))
    values, mix = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-values)[:wanted]
    return values[order], (basis @ mix)[:, order]
