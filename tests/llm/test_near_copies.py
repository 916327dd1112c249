"""Near copies by brute force."""

import random

import pytest

from tidemark.llm import minhash, simhash

from .conftest import random_texts


def brute_near(texts, similarity):
    sets = [minhash.shingles((t or "").encode(), 5) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= similarity * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("bands", [24, 1])
def test_near_copies_by_brute_force(docs, monkeypatch, bands):
    draw = random.Random(12)
    texts = random_texts(seed=13, n=15)
    words = [f"w{i}" for i in range(2000)]
    for _ in range(12):  # chains of edits and copies around the threshold
        own = [draw.choice(words) for _ in range(draw.randint(60, 300))]
        for _ in range(8):
            texts.append(" ".join(own))
            for k in draw.sample(range(len(own)), draw.randint(1, max(1, len(own) // 40))):
                own[k] = draw.choice(words)
    if bands == 1:  # all texts in one bucket: pairs across components are found too
        monkeypatch.setattr(minhash, "sketch", lambda own, f=minhash.sketch: (f(own)[0], f(own)[1][:0] if not own else f(own)[1][:1] * 0))
    monkeypatch.setattr(minhash, "PIECE", 7 if bands == 1 else 512)
    want = {i for i, r in enumerate(brute_near(texts, 0.8)) if i == r}
    assert len(want) < len(texts) - 40
    got = simhash.near_dedup(docs(list(enumerate(texts)))).collect()
    assert {r.doc_id for r in got} == want


def test_near_copies_of_odd_rows(docs):
    assert simhash.near_dedup(docs([])).collect() == []
    kept = simhash.near_dedup(docs([(1, "a b c d e"), (2, "A b  c d e"), (None, "a b c d e"), (3, None), (4, " "), (1, "a b c d e")])).select("doc_id", "n").collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 1, 3, None]
