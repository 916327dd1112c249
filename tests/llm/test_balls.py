"""Candidates of near copies by SimHash balls."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import balls, minhash, simhash

from .test_near_copies import brute_near


def test_long_simhash_counts_every_hash():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2)
    ones = [0] * (64 * balls.WORDS)
    for h in hashes.tolist():
        for word in range(balls.WORDS):
            x = (h + (word + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
            x ^= x >> 31
            for b in range(64):
                ones[64 * word + b] += x >> b & 1
    got = np.unpackbits(balls.simhash_words(hashes).view(np.uint8), bitorder="little")
    assert got.tolist() == [int(2 * n > len(hashes)) for n in ones]


def test_balls_meet_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balls, "ROWS_PER_PASS", 14)
    draw, rows = random.Random(3), []
    for family in range(6):  # families around one word, and short texts with more tables
        own = [draw.getrandbits(64) for _ in range(balls.WORDS)]
        for member in range(8):
            words = [w ^ sum(1 << b for b in range(64) if draw.random() < 0.04 * (member % 4)) for w in own]
            rows.append((100 * family + member, draw.choice([3, 50]), np.array(words, dtype=np.uint64).view(np.int64).tolist()))
    total, similarity = 1 << 9, 0.95
    width = 20
    usual, short = balls.table_count(width, balls.bit_chance(similarity)), balls.table_count(width, balls.SHORT_CHANCE)
    cut = balls.table_bits(width, max(usual, short))
    bits = {n: np.unpackbits(np.array(w).view(np.uint8), bitorder="little")[cut] for n, _, w in rows}
    tables = {n: usual if size >= balls.SHORT else len(cut) for n, size, _ in rows}
    want = set()
    for a, b in combinations(sorted(bits), 2):
        both = min(tables[a], tables[b])
        if ((bits[a] != bits[b])[:both].sum(axis=1) <= balls.RADIUS).any():
            want.add((a, b))
    assert 40 < len(want) < len(rows) * (len(rows) - 1) // 2
    nodes = spark.createDataFrame(rows, "node long, size long, bits array<long>")
    members, got = {}, set()
    for r in balls.meetings(nodes, total, similarity).collect():
        members.setdefault(r.bucket, []).append(r)
    for own in members.values():
        assert {(r.centre, r.n) for r in own} == {(own[0].centre, len(own))} and own[0].centre in {r.node for r in own}
        got |= set(combinations(sorted(r.node for r in own), 2))
    assert got == want


def test_near_copies_come_from_the_balls_alone(docs, monkeypatch):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text.replace("w50 ", "x ")), (3, "other words of a text that is none of the two")]
    assert {r.doc_id for r in simhash.near_dedup(docs(rows)).collect()} == {1, 3}
    monkeypatch.setattr(minhash, "meetings", lambda *a, f=balls.meetings: f(*a).where(F.lit(False)))
    assert {r.doc_id for r in simhash.near_dedup(docs(rows)).collect()} == {1, 2, 3}


def test_pairs_at_the_threshold_are_found(docs):
    draw, rows = random.Random(8), []
    for k in range(600):  # 4 of 5 shingles, or 80 of 100, in common
        words = [f"{draw.getrandbits(40):x}" for _ in range(9 if k < 300 else 104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - len(words) // 9 + (k >= 300) * -9]))]
    sets = [minhash.shingles(t.encode(), 5) for _, t in rows]
    near = [k for k in range(600) if len(sets[2 * k] & sets[2 * k + 1]) == 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    assert len(near) == 600
    kept = {r.doc_id for r in simhash.near_dedup(docs(rows)).collect()}
    assert set(range(0, 1200, 2)) <= kept
    assert len(kept) <= 600 + 5  # each is lost with a chance of 0.001


def test_members_apart_from_their_centre_are_compared(docs, monkeypatch):
    """Three pairs in one small bucket: whichever text is its centre, the other pairs are linked."""
    monkeypatch.setattr(minhash, "sketch", lambda own, f=minhash.sketch: (f(own)[0], f(own)[1][:1] * 0))
    rows = []
    for k in range(3):
        words = [f"{k}v{i}" for i in range(60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    assert {r.doc_id for r in simhash.near_dedup(docs(rows)).collect()} == {0, 2, 4}


def test_pairs_listed_grow_with_a_group_not_with_its_square(docs, monkeypatch):
    """Texts that all meet and of which few are links: each keeps 0.96 of one text's words, so two have about 0.7 of their shingles in common."""
    seen, listed = [], minhash.close
    monkeypatch.setattr(minhash, "close", lambda pairs, *a: (seen.append(pairs.count()), listed(pairs, *a))[1])
    monkeypatch.setattr(minhash, "MANY", 16, raising=False)
    monkeypatch.setattr(minhash, "PIECE", 50)
    draw, words, texts, counts = random.Random(4), [f"w{i}" for i in range(300)], [], []
    for n in (90, 180):
        while len(texts) < n:
            if len(texts) % 6 == 5:  # the former and one word more
                texts.append(texts[-1] + " more")
                continue
            own = list(words)
            for k in draw.sample(range(300), 10 + len(texts) % 4):
                own[k] = f"{draw.getrandbits(40):x}"
            texts.append(" ".join(own))
        want = {i for i, r in enumerate(brute_near(texts, 0.8)) if i == r}
        seen.clear()
        assert {r.doc_id for r in simhash.near_dedup(docs(list(enumerate(texts)))).collect()} == want
        counts.append(sum(seen))
    assert n // 2 < len(want) < n
    assert counts[1] < 2.5 * counts[0] and counts[1] < 0.1 * n * (n - 1) / 2
