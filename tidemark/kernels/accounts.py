"""Accounts of many gates at once, for tests that rotate a gate; one row a gate, one column a day."""

from __future__ import annotations

import numpy as np


def delayed(gates: np.ndarray, lag: int) -> np.ndarray:
    """The gates ``lag`` days ago; 0 before, and where missing."""
    out = np.zeros(gates.shape)
    known = np.nan_to_num(gates)
    out[:, lag:] = known[:, : known.shape[1] - lag]
    return out


def switch_path(tri: np.ndarray, rf: np.ndarray, gates: np.ndarray, lag: int, buy: float, sell: float) -> np.ndarray:
    """Daily returns of the index unless the gate was 1, then cash; the first day has none (NaN)."""
    after = 1 - delayed(gates, lag)
    held = np.concatenate([np.ones((len(gates), 1)), after[:, :-1]], axis=1)
    ret = np.concatenate([[np.nan], tri[1:] / tri[:-1] - 1])
    moved = after - held
    return held * ret + (1 - held) * rf - np.where(moved > 0, moved * buy, -moved * sell)


def straddle_path(days: dict[str, np.ndarray], gates: np.ndarray, lag: int, buy: float, sell: float) -> np.ndarray:
    """Values of the account of a straddle seller.

    ``days`` has is_entry, is_expiry, forward, premium, payoff, mark, exit_px and rf. A day accrues cash, settles
    at expiry or buys back on the signal, then sells a new straddle on an entry day without position or signal.
    """
    signal = delayed(gates, lag) == 1
    cash, units = np.ones(len(gates)), np.zeros(len(gates))
    out = np.empty(gates.shape)
    for t in range(gates.shape[1]):
        cash = cash * (1 + days["rf"][t])
        settles = days["is_expiry"][t]
        closes = (units > 0) & (settles | signal[:, t])
        price = days["payoff"][t] if settles else days["exit_px"][t] * (1 + buy)
        cash = np.where(closes, cash - units * price, cash)
        units = np.where(closes, 0.0, units)
        if days["is_entry"][t]:
            opens = (units == 0) & ~signal[:, t]
            sold = cash / days["forward"][t]
            cash = np.where(opens, cash + sold * days["premium"][t] * (1 - sell), cash)
            units = np.where(opens, sold, units)
        out[:, t] = np.where(units > 0, cash - units * days["mark"][t], cash)
    return out
