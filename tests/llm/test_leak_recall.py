"""Leaks against alignment of everything with everything."""

import random

import numpy as np
import pytest

from tidemark.llm import decontaminate

WORDS = [f"w{i}" for i in range(300)]


def brute(items, doc):
    """item -> score by full alignment, under the rules for short items."""
    want = {}
    for item, text in items:
        own, vocab = decontaminate.words_of(text), {}
        if not own:
            continue
        a = np.array([vocab.setdefault(w, len(vocab)) for w in own])
        b = np.array([vocab.get(w, -1) for w in doc], dtype=np.int64)
        score = decontaminate.align(a, b)[0] / (2 * len(own)) if doc else 0.0
        if len(own) < 4:
            held = own == doc
        else:
            held = score >= (1.0 if len(own) < 8 else 0.5)
        if held:
            want[item] = score
    return want


def edited(draw, words, dense):
    out = []
    for w in words:  # replaced, dropped and added words
        kind = draw.random() * dense
        out += [draw.choice(WORDS)] if kind < 0.4 else [] if kind < 0.5 else [w, draw.choice(WORDS)] if kind < 0.7 else [w]
    return out


def cases(n=300):
    draw = random.Random(21)
    sizes = [1, 2, 3, 4, 5, 7, 8, 9] + [draw.randint(10, 40) for _ in range(12)]
    items = [(i, " ".join(draw.choice(WORDS) for _ in range(k))) for i, k in enumerate(sizes)]
    rows = []
    for k in range(n):
        i, text = items[k % len(items)]
        copy = edited(draw, text.split(), draw.choice([1.8, 2.2, 3.0]))
        if k % 30 == 0:
            copy = " added ".join(text.split()).split()  # no two words of the item stay together
        if k % 30 == 1:
            copy = text.split()
        pad = lambda: [draw.choice(WORDS) for _ in range(draw.choice([0, 0, draw.randint(1, 60)]))]
        rows.append((i, pad() + copy + pad()))
    return items, rows


def test_leaks_are_those_of_brute_force_alignment():
    items, rows = cases()
    own = decontaminate.Items(items)
    got = own.scan([" ".join(doc) for _, doc in rows])
    wanted = found = unseeded = 0
    for (i, doc), mine in zip(rows, got):
        want = brute(items, doc)
        mine = {x[0]: x[1] for x in mine}
        assert all(want.get(k) == v for k, v in mine.items())
        wanted += len(want)
        found += len(mine)
        grams = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
        unseeded += i in want and not grams(items[i][1].split()) & grams(doc)
    assert wanted > 100 and unseeded > 20
    assert found >= 0.99 * wanted


def test_common_seeds_count_only_where_an_item_has_few_others():
    phrase = "which of the following is true about the thing named"
    items = [(i, f"{phrase} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} k{i} l{i} m{i}") for i in range(40)] + [(99, phrase)]
    own = decontaminate.Items(items)
    assert {x[0] for x in own.scan([phrase])[0]} == {99}
    assert {x[0] for x in own.scan([items[3][1]])[0]} == {3, 99}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 50])
def test_any_size_of_benchmark_gives_the_same(spark, docs, monkeypatch, block):
    items, rows = cases(60)
    items += [(50, items[12][1]), (50, items[12][1]), (None, items[13][1])]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    table = [(k, " ".join(doc)) for k, (_, doc) in enumerate(rows)] + [(None, items[9][1]), (7, ""), (8, None)]
    got = decontaminate.find_leaks(docs(table), spark.createDataFrame(items, "item_id long, text string")).collect()
    distinct = list(dict.fromkeys(items))
    own = decontaminate.Items(distinct)
    want = [(k, *x) for (k, _), found in zip(table, own.scan([t for _, t in table])) for x in found]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 30


def test_a_very_long_text_and_equal_scores():
    draw = random.Random(3)
    text = " ".join(f"q{i}" for i in range(20))
    long = [draw.choice(WORDS) for _ in range(200_000)]
    long[150_000:150_000] = text.split()
    assert decontaminate.Items([(1, text)]).scan([" ".join(long)])[0] == [(1, 1.0, 150_000, 150_020)]
    twice = ["x"] * 100 + text.split() + ["x"] * 100 + text.split()
    assert decontaminate.Items([(1, text)]).scan([" ".join(twice)])[0] == [(1, 1.0, 100, 120)]
