"""Statistical jump model: clusters in time with a penalty per switch, by coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Jump:
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    penalty: float
    stressed: int
    objective: float

    def losses(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale
        return 0.5 * ((z[:, None, :] - self.centres) ** 2).sum(axis=2)


def forward_values(losses: np.ndarray, penalty: float) -> np.ndarray:
    """V_t(..., k): least loss of a path up to t that ends in state k; losses are (time, ..., state)."""
    out = np.empty_like(losses)
    out[0] = losses[0]
    for t in range(1, len(losses)):
        out[t] = losses[t] + np.minimum(out[t - 1], out[t - 1].min(axis=-1, keepdims=True) + penalty)
    return out


def best_path(losses: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The least-loss path, or one for each of several loss tables side by side, and its loss."""
    v = forward_values(losses, penalty)
    least, first = v.min(axis=-1), v.argmin(axis=-1)
    path = np.empty(v.shape[:-1], dtype=int)
    path[-1] = first[-1]
    for t in range(len(v) - 1, 0, -1):
        stay = np.take_along_axis(v[t - 1], path[t][..., None], axis=-1)[..., 0] <= least[t - 1] + penalty
        path[t - 1] = np.where(stay, path[t], first[t - 1])
    return path, least[-1]


def fit_jump(features: np.ndarray, excess: np.ndarray, penalty: float, states: int = 2, restarts: int = 10, seed: int = 0) -> Jump:
    """Lowest objective of several k-means++ starts, which go on side by side.

    The stressed state is the one with the least summed excess return.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0, ddof=1)
    scale = np.where(scale > 0, scale, 1.0)
    z = (features - mean) / scale
    draw = np.random.default_rng(seed)
    centres = np.empty((restarts, states, z.shape[1]))
    for own in centres:
        own[0] = z[draw.integers(len(z))]
        for k in range(1, states):
            far = ((z[:, None, :] - own[:k]) ** 2).sum(axis=2).min(axis=1)
            own[k] = z[draw.choice(len(z), p=far / far.sum() if far.sum() > 0 else None)]
    live, objectives = np.arange(restarts), np.full(restarts, np.inf)
    paths = np.full((len(z), restarts), -1)
    for _ in range(100):  # starts whose path stays rest
        losses = 0.5 * ((z[:, None, None, :] - centres[live]) ** 2).sum(axis=3)
        new, objectives[live] = best_path(losses, penalty)
        moved = (new != paths[:, live]).any(axis=0)
        paths[:, live] = new
        live = live[moved]
        if not len(live):
            break
        for k in range(states):
            inside = (paths[:, live] == k).astype(float)
            size = inside.sum(axis=0)
            centres[live, k] = np.where(size[:, None] > 0, inside.T @ z / np.maximum(size, 1)[:, None], centres[live, k])
    best = 0
    for i in range(1, restarts):
        if objectives[i] < objectives[best] - 1e-12:
            best = i
    path = paths[:, best]
    totals = [excess[path == k].sum() if (path == k).any() else np.inf for k in range(states)]
    return Jump(mean, scale, centres[best], penalty, int(np.argmin(totals)), float(objectives[best]))


def online_states(model: Jump, features: np.ndarray) -> np.ndarray:
    """1 on days whose best path so far ends in the stressed state."""
    return (forward_values(model.losses(features), model.penalty).argmin(axis=1) == model.stressed).astype(float)


def in_sample_states(model: Jump, features: np.ndarray) -> np.ndarray:
    return (best_path(model.losses(features), model.penalty)[0] == model.stressed).astype(float)
