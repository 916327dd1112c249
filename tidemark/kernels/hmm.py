"""Gaussian hidden Markov model: Baum-Welch, forward filter and Viterbi path, on 100 x returns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOOR = 1e-6


def _log_sum(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    log_likelihood: float = -np.inf

    @property
    def stressed(self) -> int:
        return int(np.argmax(self.var))

    def log_density(self, y: np.ndarray) -> np.ndarray:
        return -0.5 * (np.log(2 * np.pi * self.var) + (y[:, None] - self.mean) ** 2 / self.var)


def _scan(steps: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Row vectors ``left`` times all prefixes of matrix products, each scaled to sum 1; ``left`` itself comes first.

    ``steps`` is (time, ..., k, k). Time is cut into about as many blocks as a block has steps: the products within all
    blocks go side by side, then one vector goes from block to block. So n steps cost some 2 sqrt(n) array operations.
    """
    n, k = len(steps), left.shape[-1]
    if n == 0:
        return (left / left.sum(axis=-1, keepdims=True))[None]
    size = max(1, round(n**0.5))
    blocks = -(-n // size)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(k), (blocks * size - n, *steps.shape[1:]))])
    whole = padded.reshape(blocks, size, *steps.shape[1:]).copy()
    for j in range(1, size):
        np.matmul(whole[:, j - 1], whole[:, j], out=whole[:, j])
        if j % 8 == 0:
            whole[:, j] /= np.maximum(whole[:, j].max(axis=(-2, -1), keepdims=True), 1e-300)
    heads = np.empty((blocks, *left.shape))
    now = left / left.sum(axis=-1, keepdims=True)
    for b in range(blocks):
        heads[b] = now
        now = np.matmul(now[..., None, :], whole[b, -1])[..., 0, :]
        now = now / np.maximum(now.sum(axis=-1, keepdims=True), 1e-300)
    out = np.matmul(heads[:, None, ..., None, :], whole)[..., 0, :].reshape(blocks * size, *left.shape)[:n]
    out = out / np.maximum(out.sum(axis=-1, keepdims=True), 1e-300)
    return np.concatenate([heads[:1], out])


def fit_hmm(r: np.ndarray, states: int = 2, seeds: int = 10, max_iter: int = 1000, tol: float = 1e-6) -> Hmm:
    """The best of several seeded Baum-Welch fits, which go on side by side until none gains ``tol``."""
    y = 100.0 * np.asarray(r, dtype=float)
    n, spread = len(y), max(float(np.var(y)), FLOOR)
    mean, var = np.empty((seeds, states)), np.empty((seeds, states))
    for seed in range(seeds):
        draw = np.random.default_rng(seed)
        mean[seed] = 0.2 * (draw.choice(y, states) if n >= states else np.zeros(states))
        var[seed] = spread * np.exp(draw.uniform(-1.5, 1.5, states))
    start = np.full((seeds, states), 1 / states)
    trans = np.full((seeds, states, states), 0.1 / max(1, states - 1))
    trans[:, np.arange(states), np.arange(states)] = 0.9
    before, live = np.full(seeds, -np.inf), np.arange(seeds)
    for _ in range(max_iter):  # seeds that gain nothing more rest
        m, v = mean[live], var[live]
        logs = -0.5 * (np.log(2 * np.pi * v) + (y[:, None, None] - m) ** 2 / v)
        top = logs.max(axis=2)
        dens = np.exp(logs - top[:, :, None])
        steps = trans[live] * dens[1:, :, None, :]
        alpha = _scan(steps, start[live] * dens[0])
        beta = _scan(np.swapaxes(steps[::-1], -1, -2), np.ones((len(live), states)))[::-1]
        ahead = np.concatenate([start[live][None], np.matmul(alpha[:-1][..., None, :], trans[live])[..., 0, :]])
        now = (np.log(np.maximum((ahead * dens).sum(axis=2), 1e-300)) + top).sum(axis=0)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        pairs = alpha[:-1][..., :, None] * steps * beta[1:][..., None, :]
        pairs = (pairs / np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300)).sum(axis=0) + 1e-12
        weight = gamma.sum(axis=0) + 1e-12
        start[live] = (gamma[0] + 1e-12) / (gamma[0] + 1e-12).sum(axis=1, keepdims=True)
        trans[live] = pairs / pairs.sum(axis=2, keepdims=True)
        mean[live] = m = np.einsum("tsk,t->sk", gamma, y) / weight
        var[live] = np.maximum(np.einsum("tsk,tsk->sk", gamma, (y[:, None, None] - m) ** 2) / weight, FLOOR)
        gain, before[live] = now - before[live], now
        live = live[gain >= tol]
        if not len(live):
            break
    k = int(np.argmax(before))
    return Hmm(start[k], trans[k], mean[k], var[k], float(before[k]))


def filter_prob(model: Hmm, r: np.ndarray, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(stressed | data so far) for each day, and the last state, to go on from."""
    y = 100.0 * np.asarray(r, dtype=float)
    logs = model.log_density(y)
    out = np.empty(len(y))
    for t in range(len(y)):
        if alpha is None:
            a = np.log(model.start) + logs[t]
        else:
            a = _log_sum(np.log(np.maximum(alpha, 1e-300))[:, None] + np.log(model.trans), axis=0) + logs[t]
        alpha = np.exp(a - _log_sum(a))
        out[t] = alpha[model.stressed]
    return out, alpha


def viterbi(model: Hmm, r: np.ndarray) -> np.ndarray:
    y = 100.0 * np.asarray(r, dtype=float)
    logs, trans = model.log_density(y), np.log(model.trans)
    best = np.log(model.start) + logs[0]
    back = np.zeros((len(y), len(best)), dtype=int)
    for t in range(1, len(y)):
        reach = best[:, None] + trans
        back[t] = reach.argmax(axis=0)
        best = reach.max(axis=0) + logs[t]
    path = np.empty(len(y), dtype=int)
    path[-1] = best.argmax()
    for t in range(len(y) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
