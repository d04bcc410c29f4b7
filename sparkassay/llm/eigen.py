"""Leading eigenvectors of a small symmetric matrix: tridiagonal form, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are kept orthogonal to each other
ROUNDS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of the tridiagonal form of a symmetric matrix."""
    a = np.array(matrix, float)
    size = len(a)
    mirrors = []
    off = np.zeros(max(size - 1, 0))
    for k in range(size - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = x / scale if scale > 0 else x.copy()
        length = np.sqrt(v @ v)
        if length > 0:
            v[0] += np.copysign(length, v[0])
            off[k] = -np.copysign(length * scale, x[0])
            v /= np.sqrt(v @ v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    if size > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each of ``x``: negative pivots of the shifted matrix (Sturm)."""
    least = EPS * max(np.abs(off).max(initial=0), np.finfo(float).tiny / EPS)
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - x - e * (e / pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each bisected until its interval cannot be halved."""
    size = len(diagonal)
    reach = np.zeros(size)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    lowest, highest = (diagonal - reach).min(), (diagonal + reach).max()
    room = EPS * max(abs(lowest), abs(highest), np.finfo(float).tiny)
    low, high = np.full(k, lowest - room), np.full(k, highest + room)
    rank = size - np.arange(k)  # the eigenvalue sought is smaller than x if that many are
    while True:
        middle = low + (high - low) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        over = below(diagonal, off, middle) >= rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)


def _factor(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Rows of the upper triangle of the shifted matrix and the row exchanges and multipliers that gave it."""
    size = len(diagonal)
    a, b, c = diagonal - value, np.append(off, 0.0), np.zeros(size)
    swaps, times = np.zeros(size, bool), np.zeros(size)
    for i in range(size - 1):
        if abs(off[i]) > abs(a[i]):
            swaps[i] = True
            a[i], lower = off[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], 0.0
            times[i] = lower / a[i]
        else:
            if abs(a[i]) < least:
                a[i] = least
            times[i] = off[i] / a[i]
        a[i + 1] -= times[i] * b[i]
        b[i + 1] -= times[i] * c[i]
    if abs(a[-1]) < least:
        a[-1] = least
    return a, b, c, swaps, times


def _solve(factors, right: np.ndarray) -> np.ndarray:
    a, b, c, swaps, times = factors
    x = right.copy()
    for i in range(len(x) - 1):
        if swaps[i]:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= times[i] * x[i]
    for i in range(len(x) - 1, -1, -1):
        if i + 1 < len(x):
            x[i] -= b[i] * x[i + 1]
        if i + 2 < len(x):
            x[i] -= c[i] * x[i + 2]
        x[i] /= a[i]
    return x


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvectors of close eigenvalues are made orthogonal after every round of inverse iteration; those of equal ones
    are any orthogonal choice. Start vectors have a fixed seed, so equal matrices give equal vectors.
    """
    size = len(matrix)
    k = min(k, size)
    scale = np.abs(matrix).max(initial=0)
    if not scale > 0:
        return np.zeros(k), np.eye(size)[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)
    rng = np.random.default_rng(13)
    out = np.zeros((size, k))
    first = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            first = j
        factors = _factor(diagonal, off, values[j], EPS * norm)
        x = rng.normal(size=size)
        for _ in range(ROUNDS):
            x = _solve(factors, x / np.sqrt(x @ x))
            for _ in range(3):
                x /= np.abs(x).max()
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.sqrt(x @ x)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        out[i + 1 :] -= 2 * np.outer(v, v @ out[i + 1 :])
    return values * scale, out
