"""Anchors where a k-gram's rolling hash is 0."""

import numpy as np
import pytest

from tidemark.llm import anchors
from tidemark.llm.repeats import Shape, Units, anchored


@pytest.mark.parametrize("k", [1, 3, 4, 21])
def test_no_kgram_hash_is_zero(k):
    assert (anchors.rolling(np.zeros(50, dtype=np.uint32), k) > 0).all()  # their rolling hash is 0


def test_windows_over_a_zero_hash_have_an_anchor(monkeypatch):
    shape = Shape(8, 2, 3, words=False)
    units = Units(b"a text whose first byte value is zero aaaaaaaaaaaaaaaa", shape)
    units.values[10:20] = 0  # k-grams with rolling hash 0
    at, _, own = anchored(units, shape)
    starts = np.arange(units.n - shape.window + 1)
    assert len(own) == len(starts) and (at[own] >= starts).all() and (at[own] + shape.k <= starts + shape.window).all()
