"""A linear-chain conditional random field in numpy: fitting by its gradient, decoding by Viterbi, both over batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def padded(chains: list[list[list[int]]], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(chains, steps, features) with n_features for none, and the chains' lengths."""
    size = np.array([len(c) for c in chains], np.int64)
    wide = max((len(f) for c in chains for f in c), default=0)
    out = np.full((len(chains), int(size.max(initial=0)), wide), n_features, np.int64)
    for i, c in enumerate(chains):
        for t, f in enumerate(c):
            out[i, t, : len(f)] = f
    return out, size


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Chain:
    #: (features + 1, labels), the last row zero; (labels, labels) by previous and next; (labels,) of the first.
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[x].sum(axis=2)

    def viterbi(self, chains: list[list[list[int]]]) -> list[list[int]]:
        """The best labels of each chain; of equals the lesser label. All chains move together, a step at a time."""
        if not chains:
            return []
        x, size = padded(chains, len(self.emit) - 1)
        return self.paths(self.scores(x), size)

    def paths(self, e: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """``viterbi`` on the scores (chains, steps, labels) of chains of these lengths."""
        n, steps, _ = e.shape
        best = self.first + e[:, 0]
        back = np.zeros((n, steps, e.shape[2]), np.int64)
        for t in range(1, steps):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(axis=1)
            on = (t < size)[:, None]
            best = np.where(on, step.max(axis=1) + e[:, t], best)
        label = best.argmax(axis=1)
        out = np.zeros((n, steps), np.int64)
        for t in range(steps - 1, -1, -1):
            on = t < size
            out[on, t] = label[on]
            if t:
                label = np.where(on, back[np.arange(n), t, label], label)
        return [row[:k].tolist() for row, k in zip(out, size, strict=True)]


def fit(chains: list[list[list[int]]], labels: list[list[int]], n_features: int, n_labels: int, allowed: np.ndarray, start: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, enough: float = 5e-3) -> Chain:
    """Adam on the likelihood, until no part of its gradient is over ``enough``, ``rounds`` times at most. Moves and first labels that are not allowed stay at a score that no path takes."""
    x, size = padded(chains, n_features)
    n, steps, _ = x.shape
    y = np.zeros((n, steps), np.int64)
    for i, row in enumerate(labels):
        y[i, : len(row)] = row
    on = np.arange(steps) < size[:, None]
    bar_move, bar_first = np.where(allowed, 0.0, -1e4), np.where(start, 0.0, -1e4)
    params = [np.zeros((n_features + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    hot = np.eye(n_labels)[y] * on[:, :, None]
    held = x[on].ravel()
    for round_ in range(1, rounds + 1):
        emit, move, first = params[0], params[1] + bar_move, params[2] + bar_first
        e = emit[x].sum(axis=2)
        alpha, beta = np.zeros((n, steps, n_labels)), np.zeros((n, steps, n_labels))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, steps):
            go = _lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], go, alpha[:, t - 1])
        total = _lse(alpha[np.arange(n), size - 1], 1)
        for t in range(steps - 2, -1, -1):
            go = _lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(on[:, t + 1, None], go, 0)
        p = np.exp(alpha + beta - total[:, None, None]) * on[:, :, None]
        diff = (p - hot) / n
        grads = [np.zeros_like(params[0]), np.zeros_like(params[1]), diff[:, 0].sum(axis=0)]
        for label in range(n_labels):
            grads[0][:, label] = np.bincount(held, np.repeat(diff[on, label], x.shape[2]), minlength=n_features + 1)
        for t in range(1, steps):
            both = np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            grads[1] += ((both - hot[:, t - 1, :, None] * hot[:, t, None, :]) * on[:, t, None, None]).sum(axis=0) / n
        grads = [g + decay * q for q, g in zip(params, grads, strict=True)]
        if max(float(np.abs(np.where(np.abs(q) < 1e3, g, 0)).max()) for q, g in zip(params, grads, strict=True)) < enough:
            break
        for i, (q, g) in enumerate(zip(params, grads, strict=True)):
            m, v = state[i]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            q -= rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
        params[0][n_features] = 0
    return Chain(params[0], params[1] + bar_move, params[2] + bar_first)
