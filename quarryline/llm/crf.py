"""Linear-chain conditional random field over dense features; numpy only."""

from __future__ import annotations

import numpy as np


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


class LinearChain:
    """Scores a label sequence by feature weights per label, transitions, and start weights; trained by Adam on the mean log-likelihood."""

    def __init__(self, labels: int, ridge: float = 1e-3, rounds: int = 220, rate: float = 0.08):
        self.labels, self.ridge, self.rounds, self.rate = labels, ridge, rounds, rate

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> LinearChain:
        n, longest, width, k = len(xs), max(map(len, xs)), xs[0].shape[1], self.labels
        x, y, there = np.zeros((n, longest, width)), np.zeros((n, longest), int), np.zeros((n, longest))
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], y[i, : len(a)], there[i, : len(a)] = a, b, 1
        one = np.eye(k)[y] * there[..., None]
        flat = x.reshape(-1, width)
        pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
        theta = [np.zeros((width, k)), np.zeros((k, k)), np.zeros(k)]
        seen = [flat.T @ one.reshape(-1, k), pairs, one[:, 0].sum(0)]
        m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, self.rounds + 1):
            w, trans, start = theta
            e = (flat @ w).reshape(n, longest, k)
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = e[:, 0] + start
            for t in range(1, longest):
                new = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
                alpha[:, t] = np.where(there[:, t, None] > 0, new, alpha[:, t - 1])
            z = _logsumexp(alpha[:, -1], 1)
            for t in range(longest - 2, -1, -1):
                new = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(there[:, t + 1, None] > 0, new, 0)
            marginal = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
            expected = np.zeros((k, k))
            for t in range(1, longest):
                p = np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                expected += (p * there[:, t, None, None]).sum(0)
            model = [flat.T @ marginal.reshape(-1, k), expected, marginal[:, 0].sum(0)]
            for i in range(3):
                g = (model[i] - seen[i]) / n + self.ridge * theta[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                theta[i] = theta[i] - self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.trans, self.start = theta
        return self

    def decode(self, x: np.ndarray) -> list[int]:
        """The best label sequence (Viterbi)."""
        e = x @ self.weights
        best, back = e[0] + self.start, []
        for row in e[1:]:
            scores = best[:, None] + self.trans
            back.append(scores.argmax(0))
            best = scores.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
