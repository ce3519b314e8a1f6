"""Small linear models fitted with NumPy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept: penalised Newton steps; the intercept has no penalty.

    With one class only, the intercept alone answers.
    """
    n, d = x.shape
    w = np.zeros(d + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < n:
        return w
    xb = np.column_stack([x, np.ones(n)])
    penalty = np.append(np.full(d, ridge), 1e-8)
    for _ in range(steps):
        p = sigmoid(xb @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((xb * v[:, None]).T @ xb + np.diag(penalty), xb.T @ (p - y) + penalty * w)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


#: Products with the rows in one Newton step, at most.
PRODUCTS = 25


class SparseRows:
    """Rows of zeros and ones by their (row, column) places, and a few dense columns behind them."""

    def __init__(self, n: int, width: int, row: np.ndarray, column: np.ndarray, dense: np.ndarray | None = None):
        self.n, self.width, self.row, self.column = n, width, row, column
        self.dense = np.empty((n, 0)) if dense is None else dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Margins for weights of the places, the dense columns and, last, an intercept."""
        sums = np.bincount(self.row, weights=w[self.column], minlength=self.n) if len(self.row) else np.zeros(self.n)
        return sums + self.dense @ w[self.width:-1] + w[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        """The transpose of `dot` applied to u."""
        sums = np.bincount(self.column, weights=u[self.row], minlength=self.width) if len(self.row) else np.zeros(self.width)
        return np.concatenate([sums, self.dense.T @ u, [u.sum()]])

    def squares(self, v: np.ndarray) -> np.ndarray:
        """The diagonal of the transpose times v times the rows."""
        sums = np.bincount(self.column, weights=v[self.row], minlength=self.width) if len(self.row) else np.zeros(self.width)
        return np.concatenate([sums, (self.dense**2).T @ v, [v.sum()]])

    def part(self, rows: np.ndarray) -> SparseRows:
        keep = rows[self.row]
        place = np.cumsum(rows) - 1
        return SparseRows(int(rows.sum()), self.width, place[self.row[keep]], self.column[keep], self.dense[rows])

    def with_column(self, values: np.ndarray) -> SparseRows:
        return SparseRows(self.n, self.width, self.row, self.column, np.column_stack([self.dense, values]))


def fit_sparse_logistic(x: SparseRows, y: np.ndarray, ridge: float = 1.0, steps: int = 15, tol: float = 1e-2,
                        start: np.ndarray | None = None) -> np.ndarray:
    """The weights of `fit_logistic` by Newton steps that conjugate gradients solve, so that no matrix is formed.

    Ends when the largest slope has fallen to `tol` of what it is at the base rate. `start`: weights to begin from.
    """
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    rate = (y.sum() + 0.5) / (x.n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < x.n:
        return w
    first = float(np.abs(x.back(sigmoid(x.dot(w)) - y)).max())
    w = w if start is None else start
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-8)
    for _ in range(steps):
        p = sigmoid(x.dot(w))
        v = np.maximum(p * (1 - p), 1e-6)
        gradient = x.back(p - y) + penalty * w
        size = float(np.abs(gradient).max())
        if size <= tol * first:
            break
        # conjugate gradients on the diagonally scaled step, nearer the closer the optimum is
        scale = x.squares(v) + penalty
        aim = min(0.1, size / first) * np.sqrt(float(gradient @ (gradient / scale)))
        move, rest = np.zeros(len(w)), gradient.copy()
        scaled = rest / scale
        way, left = scaled.copy(), float(rest @ scaled)
        for _ in range(PRODUCTS):
            if np.sqrt(left) <= aim:
                break
            turned = x.back(v * x.dot(way)) + penalty * way
            length = left / float(way @ turned)
            move += length * way
            rest -= length * turned
            scaled = rest / scale
            left, before = float(rest @ scaled), left
            way = scaled + left / before * way
        w = w - move
    return w
