"""Kernels against closed forms, brute force and known regimes; gates must not look ahead."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import scalars
from tidemark.kernels import bocpd, hmm, jump, paths, resample
from tidemark.plans import gates

TRANS = [[0.996, 0.004], [0.008, 0.992]]


@pytest.fixture(scope="module")
def path():
    return paths.hmm_path(2260, [0.001, -0.002], [0.006, 0.02], TRANS, 4)


def frame(r):
    rows = pd.DataFrame({"r": r, "x": r})
    rows["rv"] = np.sqrt(252 * (rows["r"] ** 2).rolling(21, min_periods=1).mean())
    loss = np.minimum(rows["x"], 0) ** 2
    rows["dd10"] = np.sqrt(loss.ewm(halflife=10).mean())
    for h in (20, 60):
        rows[f"sortino{h}"] = (rows["x"].ewm(halflife=h).mean() / np.sqrt(loss.ewm(halflife=h).mean()).replace(0, np.nan)).fillna(0)
    return rows.iloc[60:].reset_index(drop=True)  # without the warm-up


@pytest.mark.parametrize("kind, floor", [("hmm", 0.9), ("rv", 0.8), ("bocpd", 0.75), ("jump", 0.75)])
def test_regimes_are_recovered_without_looking_ahead(path, kind, floor):
    r, state = path[0], path[1][60:]
    rows = frame(r)
    gate, _ = gates.DETECTORS[kind](rows.iloc[:1200], rows)
    assert (gate[1200:] == state[1200:]).mean() > floor
    other = r.copy()
    other[1860:] *= -3
    changed = frame(other)
    again, _ = gates.DETECTORS[kind](changed.iloc[:1200], changed)
    assert (again[:1800] == gate[:1800]).all()


def test_hmm_filter_is_the_exact_posterior(path):
    r = path[0][:8]
    model = hmm.Hmm(np.array([0.7, 0.3]), np.array(TRANS), np.array([0.05, -0.1]), np.array([0.36, 4.0]))
    y, logs = 100 * r, model.log_density(100 * r)
    total = np.zeros((len(y), 2))
    for t in range(len(y)):
        for code in range(2 ** (t + 1)):
            s = [code >> k & 1 for k in range(t + 1)]
            p = model.start[s[0]] * math.exp(logs[0, s[0]])
            for k in range(1, t + 1):
                p *= model.trans[s[k - 1], s[k]] * math.exp(logs[k, s[k]])
            total[t, s[-1]] += p
    want = total[:, 1] / total.sum(axis=1)
    whole, _ = hmm.filter_prob(model, r)
    first, alpha = hmm.filter_prob(model, r[:3])
    rest, _ = hmm.filter_prob(model, r[3:], alpha)
    assert np.allclose(whole, want) and np.allclose(np.concatenate([first, rest]), whole)


def test_viterbi_and_jump_paths_by_brute_force(path):
    r = path[0][:9]
    model = hmm.Hmm(np.array([0.7, 0.3]), np.array(TRANS), np.array([0.05, -0.1]), np.array([0.36, 4.0]))
    logs = model.log_density(100 * r)

    def score(s):
        return np.log(model.start[s[0]]) + logs[0, s[0]] + sum(np.log(model.trans[a, b]) + logs[k + 1, b] for k, (a, b) in enumerate(zip(s, s[1:])))

    every = [[c >> k & 1 for k in range(9)] for c in range(512)]
    assert score(list(hmm.viterbi(model, r))) == pytest.approx(max(map(score, every)))
    losses = np.random.default_rng(0).uniform(size=(9, 2))
    cost = lambda s: sum(losses[k, x] for k, x in enumerate(s)) + 0.4 * sum(a != b for a, b in zip(s, s[1:]))
    found, value = jump.best_path(losses, 0.4)
    assert value == pytest.approx(min(map(cost, every))) and cost(list(found)) == pytest.approx(value)


def test_bocpd_without_hazard_is_the_conjugate_posterior(path):
    y = path[0][:50]
    got = bocpd.variance_path(y, 1e-4, hazard=0.0)
    mu, kappa, alpha, beta = *bocpd.PRIOR, 1e-4
    for k, v in enumerate(y):
        beta += kappa * (v - mu) ** 2 / (2 * (kappa + 1))
        mu, kappa, alpha = (kappa * mu + v) / (kappa + 1), kappa + 1, alpha + 0.5
        assert got[k] == pytest.approx(beta / (alpha - 1))


def test_pricing():
    f, k, t, rate = 100.0, np.array([90.0, 100, 115]), 0.3, 0.05
    value = scalars.straddle_value(f, k, t, rate, 0.24)
    assert np.allclose(scalars.straddle_iv(value, np.full(3, f), k, np.full(3, t), np.full(3, rate)), 0.24, atol=1e-8)
    draws = f * np.exp(0.24 * math.sqrt(t) * np.random.default_rng(0).standard_normal(400_000) - 0.24**2 * t / 2)
    assert value[0] == pytest.approx(math.exp(-rate * t) * np.abs(draws - 90).mean(), rel=0.01)
    assert np.isnan(scalars.straddle_iv([1.0, 5.0, 0.0], [100.0] * 3, [100.0, 100, 100], [0.0, 0.3, 0.3], [0.0] * 3)[[0, 2]]).all()
    assert scalars.student_t_logpdf(0.3, 5.0, 0.0, 1.0) == pytest.approx(math.log(0.3634 - 0.0), abs=0.07)


def test_statistics():
    x = np.random.default_rng(1).standard_normal(3000) * 0.01
    assert resample.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    d, se = resample.sharpe_difference(x, x[::-1])
    assert d == pytest.approx(0, abs=1e-9) and 0.01 < se < 0.05
    assert 0.4 < resample.probabilistic_sharpe(x - x.mean()) < 0.6
    assert resample.expected_max_sharpe(0.01, 1) == 0 < resample.expected_max_sharpe(0.01, 10)
    index = resample.circular_blocks(100, 7, np.random.default_rng(0))[0]
    assert len(index) == 100 and ((index[1:7] - index[:6]) % 100 == 1).all()
    assert resample.block_length(x) <= 10 < resample.block_length(np.cumsum(x))
    assert len(resample.cscv_splits(8)) == 70
    a, b = np.array([0, 0, 1, 1, 1]), np.array([1, 1, 0, 0, 0])
    assert resample.adjusted_rand(a, b) == 1 and resample.adjusted_rand(a, np.array([0, 1, 0, 1, 0])) < 0.2
    base = np.random.default_rng(2).standard_normal((500, 2))
    wide = np.column_stack([base[:, 0] + 0.1 * np.random.default_rng(k).standard_normal(500) for k in range(3)] + [base[:, 1] + 0.1 * np.random.default_rng(9 + k).standard_normal(500) for k in range(3)])
    k, variance, labels = resample.effective_trials(wide)
    assert k == 2 and labels[:3] == [0, 0, 0] and variance >= 0


def test_generators():
    _, state = paths.semi_markov_path(200_000, [0, 0], [1, 2], [50, 20], 2.0, 5.0, 1)
    edges = np.flatnonzero(np.diff(state)) + 1
    lengths = np.diff(edges)
    own = state[edges[:-1]]
    assert lengths[own == 0].mean() == pytest.approx(50, rel=0.1) and lengths[own == 1].mean() == pytest.approx(20, rel=0.1)
    r = paths.garch_path(100_000, 0.0, 0.02, 0.08, 0.9, 8.0, 1)
    assert (100 * r).var() == pytest.approx(0.02 / 0.02, rel=0.15)
    fitted = paths.fit_garch(paths.garch_path(3000, 0.05, 0.02, 0.1, 0.85, 8.0, 2))
    assert 0.8 < fitted["alpha"] + fitted["beta"] < 1 and fitted["df"] > 3


def test_detection_score():
    truth = np.array([1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 1, 0])
    gate = np.array([0, 1, 0, 0, 0, 1, 1, 1, 0, 0, 1, 0])
    got = gates.score_gate(gate, truth)
    assert (got["episodes"], got["miss_rate"], got["median_delay"]) == (2, 0, 1)
