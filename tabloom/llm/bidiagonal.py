"""Singular values and right singular vectors of a small square matrix, for whitening.

Householder reflections make the matrix bidiagonal, differential quotient-difference sweeps
with shifts (dqds) find its singular values to high relative accuracy, and twisted
factorisations give the vectors: the stationary transform from the top and the progressive one
from the bottom meet at the row with the least pivot, from which a vector is read off by
products alone.  Vectors of close values are made orthogonal by inverse iteration with the
stationary factors.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Sweeps for one singular value before the search gives up (about five are needed).
MAX_SWEEPS = 200
#: Relative gap of squared singular values below which vectors are orthogonalised against each other.
CLOSE = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): ``matrix`` is U B V' with B upper bidiagonal and V orthogonal."""
    a = np.array(matrix, dtype=float)
    n = a.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """A unit v such that x - 2 v (v'x) is a multiple of the first unit vector."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0.0 or not np.abs(x[1:]).any():
            return None
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2.0 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool]:
    """One dqds transform; False when the shift is beyond the least value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return q, e, False
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            return q, e, False
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[n - 1] = d
    return new_q, new_e, d >= 0.0


def _shifts(q: list[float], e: list[float]) -> list[float]:
    """Shifts to try, the boldest first; a shift of zero always works."""
    # the least eigenvalue of the trailing 2 by 2 block, less what couples it to the rest
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2.0
    low = b - c / (half + np.copysign(np.hypot(half, np.sqrt(c)), half)) if c else b
    low = max(0.0, min(low, q[-1]))
    roots, sides = [v ** 0.5 for v in q], [0.0, *(v ** 0.5 for v in e), 0.0]
    sure = max(0.0, min(r - (sides[i] + sides[i + 1]) / 2.0 for i, r in enumerate(roots))) ** 2
    return sorted({low * (1.0 - 1e-9), low * 0.9, low * 0.5, sure * (1.0 - 4 * EPS)}, reverse=True) + [0.0]


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    open_parts = [([(x / scale) ** 2 for x in map(float, diagonal)], [(x / scale) ** 2 for x in map(float, above)], 0.0)]
    small = (10 * EPS) ** 2
    while open_parts:
        q, e, moved = open_parts.pop()
        sweeps = 0
        while q:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (moved + q[i + 1]) or e[i] <= EPS * small), None)
            if cut == len(e) - 1:
                found.append(q.pop() + moved)
                e.pop()
                sweeps = 0
                continue
            if cut is not None:
                open_parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # graded the other way round
                q, e = q[::-1], e[::-1]
                # the reversed factors belong to the transposed product, which has the same values
            sweeps += 1
            if sweeps > MAX_SWEEPS:
                raise ArithmeticError("no convergence of the quotient-difference sweeps")
            for shift in _shifts(q, e) if sweeps > 1 else [0.0]:
                next_q, next_e, fits = _sweep(q, e, shift)
                if fits:
                    q, e, moved = next_q, next_e, moved + shift
                    break
            else:
                q[0] = max(q[0], EPS * small)  # an exact zero on the diagonal
    return np.sort(np.maximum(found, 0.0))[::-1] * scale * scale


def _twisted(d: np.ndarray, lower: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vector of L D L' for ``value``, and the stationary factors (L+, D+)."""
    n = len(d)
    tiny = EPS * EPS * max(np.abs(d).max(), value, 1e-300)
    plus, pivot, s = np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot[i] = s[i] + d[i] or tiny
        plus[i] = d[i] * lower[i] / pivot[i]
        s[i + 1] = plus[i] * lower[i] * s[i] - value
    pivot[n - 1] = s[n - 1] + d[n - 1] or tiny
    up, p = np.zeros(n - 1), np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        below = d[i] * lower[i] ** 2 + p[i + 1] or tiny
        t = d[i] / below
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    r = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    top = np.abs(z).max()
    return z / top / np.linalg.norm(z / top), plus, pivot


def _solve(plus: np.ndarray, pivot: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Solution of (L+ D+ L+') y = z, scaled to unit length."""
    y = z.copy()
    for i in range(len(plus)):
        y[i + 1] -= plus[i] * y[i]
    y /= pivot
    for i in range(len(plus) - 1, -1, -1):
        y[i] -= plus[i] * y[i + 1]
    y /= np.abs(y).max() or 1.0
    return y / (np.linalg.norm(y) or 1.0)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared values, vectors as columns) of the ``count`` greatest singular values of a bidiagonal matrix."""
    n = len(diagonal)
    top = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not top:
        return np.zeros(min(count, n)), np.eye(n)[:, :count]
    main = np.where(np.abs(diagonal) <= EPS * top * 1e-3, EPS * top * 1e-3, diagonal)  # no zero pivots
    # parts between negligible couplings have vectors of their own, zero elsewhere
    ends = [i + 1 for i in range(n - 1) if abs(above[i]) <= EPS * EPS * top] + [n]
    parts, start = [], 0
    for end in ends:
        parts += [(value, start, end) for value in singular_squares(main[start:end], above[start: end - 1])]
        start = end
    parts.sort(key=lambda x: (-x[0], x[1]))
    values, vectors = np.array([v for v, _, _ in parts[:count]]), np.zeros((n, min(count, n)))
    noise = np.random.default_rng(0)
    for k, (value, a, b) in enumerate(parts[:count]):
        d, lower = main[a:b] ** 2, above[a: b - 1] / main[a: b - 1]
        z, plus, pivot = _twisted(d, lower, value)
        near = [vectors[a:b, j] for j in range(k) if parts[j][1] == a and parts[j][0] - value <= CLOSE * parts[j][0]]
        if near:
            basis = np.stack(near, axis=1)
            for attempt in range(8):
                clean = z - basis @ (basis.T @ z)
                clean -= basis @ (basis.T @ clean)
                left = np.linalg.norm(clean)
                if left > 0.5 and attempt:
                    break
                start_from = clean / left if left > 1e-3 else noise.standard_normal(b - a)
                z = _solve(plus, pivot, start_from)
            z = clean / (left or 1.0)
        vectors[a:b, k] = z
    return values, vectors


def principal(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns), the ``count`` greatest, falling."""
    diagonal, above, right = bidiagonalise(matrix)
    values, vectors = right_vectors(diagonal, above, count)
    found = right @ vectors
    return values, found / np.linalg.norm(found, axis=0)
