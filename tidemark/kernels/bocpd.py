"""Bayesian online changepoint detection with a normal-inverse-gamma prior."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.scalars import student_t_logpdf

HAZARD, LONGEST = 1 / 250, 1000
PRIOR = (0.0, 1.0, 2.0)  # location, strength, shape

_GAMMA: dict[int, float] = {}


def _lgamma_half(n2: np.ndarray) -> np.ndarray:
    """log gamma of half-integers n2 / 2, from a table that grows."""
    top = int(n2.max())
    for k in range(len(_GAMMA) + 1, top + 1):
        _GAMMA[k] = math.lgamma(k / 2)
    table = np.array([0.0] + [_GAMMA[k] for k in range(1, top + 1)])
    return table[n2.astype(int)]


class State:
    """Run-length weights and posteriors; ``step`` absorbs a value and returns the mean variance."""

    def __init__(self, beta0: float, hazard: float = HAZARD, longest: int = LONGEST):
        self.beta0, self.hazard, self.longest = beta0, hazard, longest
        self.w = np.ones(1)
        self.mu, self.kappa, self.alpha, self.beta = (np.array([v]) for v in (*PRIOR, beta0))

    def step(self, y: float) -> float:
        scale2 = self.beta * (self.kappa + 1) / (self.alpha * self.kappa)
        df = 2 * self.alpha
        logs = (
            _lgamma_half(df + 1)
            - _lgamma_half(df)
            - 0.5 * np.log(df * math.pi * scale2)
            - (df + 1) / 2 * np.log1p((y - self.mu) ** 2 / scale2 / df)
        )
        pred = self.w * np.exp(logs - logs.max())
        w = np.concatenate([[self.hazard * pred.sum()], (1 - self.hazard) * pred])
        w /= w.sum()
        mu = (self.kappa * self.mu + y) / (self.kappa + 1)
        beta = self.beta + self.kappa * (y - self.mu) ** 2 / (2 * (self.kappa + 1))
        first = (*PRIOR, self.beta0)
        grown = (mu, self.kappa + 1, self.alpha + 0.5, beta)
        keep = self.longest + 1
        self.mu, self.kappa, self.alpha, self.beta = (np.concatenate([[f], g])[:keep] for f, g in zip(first, grown))
        self.w = w[:keep] / w[:keep].sum()
        return float((self.w * self.beta / (self.alpha - 1)).sum())


def variance_path(y: np.ndarray, beta0: float, hazard: float = HAZARD, longest: int = LONGEST) -> np.ndarray:
    state = State(beta0, hazard, longest)
    return np.array([state.step(v) for v in y])


__all__ = ["HAZARD", "LONGEST", "State", "student_t_logpdf", "variance_path"]
