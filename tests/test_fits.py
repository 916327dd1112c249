"""Fits use all rows they are given."""

import numpy as np
import pandas as pd

from tidemark.kernels import hmm
from tidemark.plans import gates


def test_dgps_are_fitted_to_all_returns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gates.hmm, "fit_hmm", lambda r, **options: seen.append((len(r), options)) or hmm.Hmm(np.ones(2) / 2, np.eye(2), np.zeros(2), np.array([1.0, 4.0])))
    monkeypatch.setattr(gates.paths, "fit_garch", lambda r: seen.append((len(r), {})) or dict.fromkeys(("mu", "omega", "alpha", "beta", "df"), 0.0))

    class Rows:
        def groupBy(self, *keys):
            return self

        def applyInPandas(self, run, schema):
            return run(pd.DataFrame({"k": "a", "date": range(1700), "r": np.linspace(-1, 1, 1700)}))

    gates.fit_dgps(Rows(), ["k"])
    assert seen == [(1700, {"states": 2}), (1700, {})]
