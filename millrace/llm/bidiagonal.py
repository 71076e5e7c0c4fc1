"""Singular values and right singular vectors of a small triangular matrix: Householder bidiagonalisation, dqds, twisted factorisations.

The matrix has a row and column for each dimension of the vectors, not for each vector, so this is the small end of a job that Spark does
over all rows (see whitening.py).
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u @ (bidiagonal of diagonal a and upper diagonal b) @ v.T with orthogonal u (not returned) and v."""
    a, n = np.array(r, float), r.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """w of unit length: x - 2 w (w x) has zeros below its first entry."""
        w, norm = x.copy(), np.linalg.norm(x)
        if norm == 0:
            return None
        w[0] += norm if w[0] >= 0 else -norm
        return w / np.linalg.norm(w)

    for i in range(n):
        if (w := reflector(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(w, w @ a[i:, i:])
        if i < n - 2 and (w := reflector(a[i, i + 1 :])) is not None:
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ w, w)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step with a shift; None if the shift was too large (a negative quotient)."""
    n = len(q)
    out_q, out_e, d = np.empty(n), np.empty(n - 1), q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        if out_q[i] == 0:
            return None
        t = q[i + 1] / out_q[i]
        out_e[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    out_q[n - 1] = d
    return out_q, out_e


def _block_values(q: np.ndarray, e: np.ndarray) -> list[float]:
    """Squared singular values of one unreduced block with q > 0: dqds, the smallest first, each to high relative accuracy."""
    out, moved, guess = [], 0.0, 0.0
    while len(q) > 1:
        if e[-1] <= EPS * EPS * (moved + q[-1]):  # a last entry that stands alone
            out.append(moved + q[-1])
            q, e, guess = q[:-1], e[:-1], 0.0
            continue
        cut = np.flatnonzero(e[:-1] <= EPS * EPS * (moved + np.minimum(q[:-2], q[1:-1])))
        if len(cut):
            at = cut[-1] + 1
            return out + [moved + x for x in _block_values(q[:at], e[: at - 1])] + [moved + x for x in _block_values(q[at:], e[at:])]
        if q[0] < q[-1] and moved == 0 and guess == 0:  # graded the other way: turn the block round, which has the same values
            q, e = _turned(q, e)
        # the least eigenvalue of the last two rows bounds the least of all from above: a first shift, made smaller until it fits
        x, y, z = q[-2] + e[-2] if len(q) > 2 else q[-2], q[-1] + e[-1], np.sqrt(q[-2] * e[-1])
        low = (x + y) / 2 - np.hypot((x - y) / 2, z)
        guess = max(0.0, 0.98 * min(low, q.min()))
        while (step := _dqds_step(q, e, guess)) is None:
            guess = guess / 4 if guess > EPS * (moved + q[-1]) else 0.0
            if guess == 0.0:
                step = _dqds_step(q, e, 0.0)
                break
        if step is None:  # a quotient of zero, possible only without a shift: the values below are zero
            q = np.maximum(q, np.finfo(float).tiny)
            continue
        (q, e), moved = step, moved + guess
    return [*out, *(moved + q)]


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block with its rows and columns in reverse order is lower bidiagonal; one zero-shift step makes it upper again."""
    a, b = np.sqrt(q[::-1]), np.sqrt(e[::-1])
    out_a, out_b, n = np.empty(len(a)), np.empty(len(b)), len(a)
    head = a[0]
    for i in range(n - 1):  # rotations from the left
        norm = np.hypot(head, b[i])
        c, s = head / norm, b[i] / norm
        out_a[i], out_b[i], head = norm, s * a[i + 1], c * a[i + 1]
    out_a[n - 1] = head
    return out_a**2, out_b**2


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of an upper bidiagonal matrix with a > 0, falling."""
    return np.sort(_block_values(a**2, b**2))[::-1].clip(0)


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Factors of L D L' - value: multipliers from the top and from the bottom, and the twist's pivot at each place."""
    n, tiny = len(d), EPS * (np.abs(d).max() + abs(value)) + np.finfo(float).tiny
    safe = lambda x: x if abs(x) > tiny * EPS else -tiny * EPS
    up, down, s, p = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    s[0], p[n - 1] = -value, d[n - 1] - value
    for i in range(n - 1):
        up[i] = d[i] * l[i] / safe(d[i] + s[i])
        s[i + 1] = up[i] * l[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * l[i] * l[i] + p[i + 1])
        down[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    return up, down, s + p + value


def _twisted_vector(up: np.ndarray, down: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(up) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(at, len(up)):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(a: np.ndarray, b: np.ndarray, squared: np.ndarray, gap: float = 1e-3) -> np.ndarray:
    """Columns: the right singular vectors of the bidiagonal matrix (a, b) for the given squared singular values (falling, each counted as
    often as it occurs). Each comes from the twisted factorisation of B'B - value at the place of the least pivot. Of values closer than
    `gap`, relatively, one such vector says little about the next: there, and at the next best places, vectors are made orthogonal to those
    before, by applying the inverse twice in the basis of the cluster's candidates (Rayleigh and Ritz)."""
    n = len(a)
    if n == 1:
        return np.ones((1, len(squared)))
    d, l = a * a, b / a[:-1]  # noqa: E741
    out, i = np.empty((n, len(squared))), 0
    while i < len(squared):
        j = i + 1
        while j < len(squared) and squared[j - 1] - squared[j] <= gap * squared[j - 1]:
            j += 1
        if j == i + 1:
            up, down, pivot = _twisted(d, l, squared[i])
            out[:, i] = _twisted_vector(up, down, int(np.argmin(np.abs(pivot))))
        else:
            out[:, i:j] = _cluster(a, b, d, l, squared[i:j], out[:, :i])
        i = j
    return out


def _cluster(a: np.ndarray, b: np.ndarray, d: np.ndarray, l: np.ndarray, values: np.ndarray, before: np.ndarray) -> np.ndarray:  # noqa: E741
    """An orthonormal basis of the cluster's space, then rotated to its singular directions."""
    rng, found = np.random.default_rng(len(values)), np.empty((len(a), 0))
    for x in values:
        up, down, pivot = _twisted(d, l, x)
        for at in np.argsort(np.abs(pivot)):  # the best place that tells something new
            z = _twisted_vector(up, down, int(at))
            old = np.hstack((before, found))
            rest = z - old @ (old.T @ z)
            if np.linalg.norm(rest) > 0.1:
                break
        else:
            rest = rng.standard_normal(len(a))
        for _ in range(2):
            rest -= old @ (old.T @ rest)
            rest /= np.linalg.norm(rest)
        found = np.hstack((found, rest[:, None]))
    for _ in range(3):  # inverse iteration of the whole space, a little off the cluster so that all of it grows alike
        shift = values[0] + 10 * EPS * values[0]
        found = np.column_stack([_solve(d, l, shift, z) for z in found.T])
        found -= before @ (before.T @ found)
        found, _ = np.linalg.qr(found)
    image = a[:, None] * found
    image[:-1] += b[:, None] * found[1:]
    _, _, turn = np.linalg.svd(image, full_matrices=False)  # of as many columns as the cluster has
    return found @ turn.T


def _solve(d: np.ndarray, l: np.ndarray, value: float, y: np.ndarray) -> np.ndarray:  # noqa: E741
    """x with (L D L' - value) x = y, through the twisted factorisation at its least pivot."""
    up, down, pivot = _twisted(d, l, value)
    n, at = len(d), int(np.argmin(np.abs(pivot)))
    tiny = EPS * EPS * (np.abs(d).max() + abs(value)) + np.finfo(float).tiny
    top, bottom = np.empty(n), np.empty(n)
    s = -value
    for i in range(n - 1):  # pivots as in _twisted()
        top[i] = d[i] + s
        s = up[i] * l[i] * s - value
    p = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = d[i] * l[i] * l[i] + p
        p = p * (d[i] / (bottom[i + 1] if abs(bottom[i + 1]) > tiny else -tiny)) - value
    x = y.copy()
    for i in range(at):
        x[i + 1] -= up[i] * x[i]
    for i in range(n - 1, at, -1):
        x[i - 1] -= down[i - 1] * x[i]
    for i in range(n):
        pivot_i = pivot[at] if i == at else top[i] if i < at else bottom[i]
        x[i] /= pivot_i if abs(pivot_i) > tiny else -tiny
    for i in range(at - 1, -1, -1):
        x[i] -= up[i] * x[i + 1]
    for i in range(at, n - 1):
        x[i + 1] -= down[i] * x[i]
    return x / np.linalg.norm(x)
