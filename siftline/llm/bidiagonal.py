"""Singular values and right singular vectors of a small matrix by qd iterations.

Householder reflections from both sides make the matrix upper bidiagonal; the differential qd
iteration with shifts finds its singular values to high relative accuracy; a twisted
factorisation of the tridiagonal ``B'B`` at each value gives the vector.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Values closer than this, relative to the larger, are one cluster.
CLUSTER = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transform ``W`` of a square matrix: ``A W = U B``."""
    a = np.array(matrix, float)
    d = a.shape[0]
    w = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = _reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
                w[:, k + 1:] -= 2.0 * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector whose reflection turns ``x`` into a multiple of the first axis."""
    size = np.abs(x).max() if len(x) else 0.0
    if size == 0.0 or not np.any(x[1:]):
        return None
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    A sweep with shift ``s`` turns ``B'B`` into a similar matrix less ``s``.  The shift stays
    below the smallest value of the part in work: one that makes a pivot negative is taken
    back and the sweep repeated with a smaller one, in the end with none, which never fails.
    """
    q, e = list(diagonal.astype(float) ** 2), list(above.astype(float) ** 2)
    found: list[float] = []
    # parts of the matrix in work: pivots, couplings and the shift taken off so far
    parts = [(q, e, 0.0)]
    while parts:
        q, e, taken = parts.pop()
        guess = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + taken)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (taken + q[i]) or e[i] == 0.0), None)
            if cut is not None:
                if cut == n - 2:
                    found.append(q.pop() + taken)
                    e.pop()
                else:
                    parts.append((q[:cut + 1], e[:cut], taken))
                    q, e = q[cut + 1:], e[cut + 1:]
                guess = 0.0
                continue
            if guess == 0.0 and q[-1] + taken > 0.0:
                guess = _smallest_of_two(q[-2], e[-1], q[-1])
            shift = guess
            while True:
                swept = _sweep(q, e, shift)
                if swept is not None:
                    break
                shift = shift * 0.25 if shift > EPS * EPS * taken and shift > 1e-300 else 0.0
            q, e, least = swept
            taken += shift
            # the least pivot bounds the smallest value from above; at first go below it
            guess = min(_smallest_of_two(q[-2], e[-1], q[-1]), least) * (1.0 - 1e-3 if e[-1] < 1e-2 * q[-1] else 0.5)
    return np.sort(np.array(found))[::-1]


def _smallest_of_two(a: float, b: float, c: float) -> float:
    """Smaller eigenvalue of the last two rows of the bidiagonal's tridiagonal product."""
    total = a + b + c
    root = np.sqrt(max(0.0, total * total - 4.0 * a * c))
    return 2.0 * a * c / (total + root) if total + root > 0.0 else 0.0


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd sweep; None if the shift was too large."""
    d = q[0] - shift
    if d < 0.0:
        return None
    new_q, new_e, least = [], [], d
    for i in range(len(q) - 1):
        pivot = d + e[i]
        ratio = q[i + 1] / pivot if pivot > 0.0 else 0.0
        new_q.append(pivot)
        new_e.append(e[i] * ratio)
        d = (d * ratio if pivot > 0.0 else q[i + 1]) - shift
        if d < 0.0:
            return None
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def twisted_vector(main: np.ndarray, off: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """Eigenvector of a symmetric tridiagonal matrix for an eigenvalue.

    The factorisations from the top and from the bottom meet at the row where the twisted
    pivot is least.  Without ``start`` the system with the unit vector of that row is solved;
    with it, one step of inverse iteration on ``start``.
    """
    n = len(main)
    scale = max(np.abs(main).max(), np.abs(off).max() if n > 1 else 0.0, 1e-300)
    tiny = EPS * scale
    guard = lambda x: x if abs(x) > tiny * EPS else np.copysign(tiny * EPS, x)
    down, up = np.empty(n), np.empty(n)
    down[0], up[-1] = main[0] - value, main[-1] - value
    for i in range(1, n):
        down[i] = main[i] - value - off[i - 1] ** 2 / guard(down[i - 1])
    for i in range(n - 2, -1, -1):
        up[i] = main[i] - value - off[i] ** 2 / guard(up[i + 1])
    twist = down + up - (main - value)
    k = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    if start is None:
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -off[i] * z[i + 1] / guard(down[i])
        for i in range(k + 1, n):
            z[i] = -off[i - 1] * z[i - 1] / guard(up[i])
    else:
        r = start.copy()
        for i in range(1, k + 1):
            r[i] -= off[i - 1] / guard(down[i - 1]) * (r[i - 1])
        for i in range(n - 2, k - 1, -1):
            r[i] -= off[i] / guard(up[i + 1]) * r[i + 1]
        z[k] = r[k] / guard(twist[k])
        for i in range(k - 1, -1, -1):
            z[i] = (r[i] - off[i] * z[i + 1]) / guard(down[i])
        for i in range(k + 1, n):
            z[i] = (r[i] - off[i - 1] * z[i - 1]) / guard(up[i])
    size = np.abs(z).max()
    z = z / size if np.isfinite(size) and size > 0.0 else np.eye(n)[k]
    return z / np.linalg.norm(z)


def singular_directions(matrix: np.ndarray, most: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, falling, and unit right vectors of the first ``most``.

    Values of up to ``least`` times the first, and zeros, get no vector.

    Within a cluster of close values, vectors after the first start from fixed vectors made
    orthogonal to the earlier ones, so that ties get an orthonormal basis as well.
    """
    diagonal, above, w = bidiagonalise(matrix)
    values = dqds(diagonal, above)
    main = diagonal ** 2
    main[1:] += above ** 2
    off = diagonal[:-1] * above
    draws = np.random.Generator(np.random.PCG64(7))
    vectors: list[np.ndarray] = []
    for j, value in enumerate(values[values > least * values[0]][:most]):
        near = [v for i, v in enumerate(vectors) if values[i] - value <= CLUSTER * values[i]]
        z = twisted_vector(main, off, value) if not near else draws.standard_normal(len(main))
        for _ in range(3):
            for v in near * 2:
                z = z - (v @ z) * v
            z = twisted_vector(main, off, value, z / np.linalg.norm(z))
        for v in near * 2:
            z = z - (v @ z) * v
        vectors.append(z / np.linalg.norm(z))
    return values, w @ np.array(vectors).T if vectors else np.zeros((len(main), 0))
