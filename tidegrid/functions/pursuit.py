"""Principal component pursuit of many matrices with missing cells at once: low-rank part and sparse part."""

from __future__ import annotations

import numpy as np


class _Matrices:
    """Cells in order of matrix, row and column; rows and columns are numbered over all matrices, those of one matrix next to each other."""

    def __init__(self, row: np.ndarray, col: np.ndarray, of_row: np.ndarray, of_col: np.ndarray, m: np.ndarray, sigma: np.ndarray):
        self.row, self.col, self.of_row, self.of_col, self.m, self.sigma = row, col, of_row, of_col, m, sigma
        self.of, self.cell, self.source = of_row[row], np.arange(len(m)), np.arange(len(sigma))
        rows, cols, n = (np.bincount(x, minlength=len(sigma)) for x in (of_row, of_col, self.of))
        # the largest singular value of scatter alone; the weight of the sparse part
        self.mu, self.weight = (np.sqrt(n / rows) + np.sqrt(n / cols)) * sigma, 1 / np.sqrt(np.maximum(rows, cols))
        self.u, self.w, self.centre = np.zeros((len(of_row), 1)), np.zeros((len(of_col), 1)), np.zeros(len(of_col))
        self.rank, self.still = np.zeros(len(sigma), int), np.ones(len(sigma), bool)

    def keep(self, live: np.ndarray) -> None:
        c, r, k = live[self.of], live[self.of_row], live[self.of_col]
        new = np.cumsum(live) - 1
        self.row, self.col = (np.cumsum(r) - 1)[self.row[c]], (np.cumsum(k) - 1)[self.col[c]]
        self.of, self.of_row, self.of_col = new[self.of[c]], new[self.of_row[r]], new[self.of_col[k]]
        self.m, self.cell, self.u, self.w, self.centre = self.m[c], self.cell[c], self.u[r], self.w[k], self.centre[k]
        self.sigma, self.source, self.mu, self.weight, self.rank, self.still = (x[live] for x in (self.sigma, self.source, self.mu, self.weight, self.rank, self.still))

    def low(self, u: np.ndarray | None = None) -> np.ndarray:
        u, out = self.u if u is None else u, self.centre[self.col]
        for k in range(u.shape[1]):
            out += u[self.row, k] * self.w[self.col, k]
        return out

    def rest(self, level: np.ndarray) -> np.ndarray:
        """Cells less the low-rank and the sparse part: the soft threshold of the sparse part leaves what lies within it."""
        bound = (self.weight * level)[self.of]
        return np.clip(self.m - self.low(), -bound, bound)

    def top(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest singular value of each matrix and its vectors, by power iterations."""
        first = np.searchsorted(self.of_row, np.arange(len(self.sigma)))
        at = np.arange(len(self.of_row)) - first[self.of_row]
        u, tiny = np.random.default_rng(0).standard_normal(at.max() + 1)[at], np.finfo(float).tiny
        for _ in range(15):
            w = np.bincount(self.col, e * u[self.row], len(self.of_col))
            w /= np.maximum(np.sqrt(np.bincount(self.of_col, w * w)), tiny)[self.of_col]
            u = np.bincount(self.row, e * w[self.col], len(self.of_row))
            s = np.sqrt(np.bincount(self.of_row, u * u))
            u /= np.maximum(s, tiny)[self.of_row]
        return s, u, w

    def add(self, more: np.ndarray, s: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        """One more component of the matrices marked, its size s."""
        if more.any() and self.rank[more].max() == self.u.shape[1]:
            self.u, self.w = (np.pad(x, ((0, 0), (0, 1))) for x in (self.u, self.w))
        for x, of, a in ((u, self.of_row, self.u), (w, self.of_col, self.w)):
            at = np.flatnonzero(more[of])
            a[at, self.rank[of[at]]] = x[at] * np.sqrt(s)[of[at]]
        self.rank = self.rank + more

    def alternate(self, level: np.ndarray) -> None:
        """Loadings of the columns given the scores of the rows, then the other way round: ridge regressions on the cells less their sparse
        part, missing cells standing at the low-rank part. Together they lower the nuclear norm's objective. Then the columns' centres."""
        self.w = _ridge(self.rest(level), self.row, self.of_row, self.u, self.col, self.of_col, self.w, level)
        self.u = _ridge(self.rest(level), self.col, self.of_col, self.w, self.row, self.of_row, self.u, level)
        self.centre += np.bincount(self.col, self.rest(level)) / np.bincount(self.col)

    def unshrunk(self) -> np.ndarray:
        """The low-rank part with singular values freed from the threshold: y = s + mu becomes sqrt(y^2 - mu^2)."""
        s, v = np.linalg.eigh(_gram(self.u, self.of_row))
        mu = self.mu[:, None]
        f = np.where(s > 1e-9 * mu, np.sqrt(1 + 2 * mu / np.maximum(s, 1e-9 * mu)), 0.0)
        b = (v * f[:, None, :]) @ v.transpose(0, 2, 1)
        return self.low(np.einsum("nk,nkj->nj", self.u, b[self.of_row]))


def _ridge(e: np.ndarray, by: np.ndarray, of_by: np.ndarray, x: np.ndarray, to: np.ndarray, of_to: np.ndarray, y: np.ndarray, level: np.ndarray) -> np.ndarray:
    """y anew, given x: what is left is e."""
    g, k = _gram(x, of_by), x.shape[1]
    inverse = np.linalg.inv(g + level[:, None, None] * np.eye(k))
    a = np.stack([np.bincount(to, e * x[by, j], len(of_to)) for j in range(k)], axis=1)
    return np.einsum("nk,nkj->nj", a, inverse[of_to]) + np.einsum("nk,nkj->nj", y, (g @ inverse)[of_to])


def _gram(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x[:, :, None] * x[:, None, :], np.flatnonzero(np.diff(of, prepend=-1)))


def low_rank(row: np.ndarray, col: np.ndarray, of_row: np.ndarray, of_col: np.ndarray, m: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Low-rank part of each matrix at its cells, by stable principal component pursuit.

    Least |L|_* + weight |S|_1 + |M - L - S|^2 / 2 mu over the cells that are there; |L|_* is the nuclear norm, weight = 1 / sqrt(longer side),
    mu the largest singular value of scatter sigma alone. L is kept as scores times loadings, fitted in turn with the sparse part, the
    threshold falling to mu in steps of two. A component is added whenever what is left has a singular value above the threshold (the
    optimality condition of the problem), so rank has no limit and a matrix of scatter alone has none. With components the columns' centres
    are fitted too, free of weight, as the median says little where rows are of two kinds; they belong to the result.
    """
    out = np.zeros(len(m))
    x = _Matrices(row, col, of_row, of_col, m, sigma)
    x.keep(x.top(x.rest(x.mu))[0] > 1.02 * x.mu)
    for power in (5, 5, 4, 4, 3, 3, 2, 2, 1, 1):
        if len(x.sigma):
            _turn(x, x.mu * 2.0**power)
    while len(x.sigma):  # each turn lowers the objective of every matrix left
        above, moved = _turn(x, x.mu)
        x.still = moved < 0.5 * x.weight * x.mu
        done = ~(above | (moved >= 0.05 * x.sigma))
        at = done[x.of]
        out[x.cell[at]] = x.unshrunk()[at]
        x.keep(~done)
    return out


def _turn(x: _Matrices, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A component more where one is missing, then six alternations: whether it was missing, and how far the cells moved at most."""
    s, u, w = x.top(x.rest(level))
    above = s > 1.02 * level
    x.add(above & x.still, np.maximum(s - level, 0.0), u, w)
    before = x.low()
    for _ in range(6):
        x.alternate(level)
    return above, np.maximum.reduceat(np.abs(x.low() - before), np.flatnonzero(np.diff(x.of, prepend=-1)))
