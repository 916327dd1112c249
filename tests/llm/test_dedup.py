"""Deduplication operators against brute force on small tables with odd rows."""

import collections
import hashlib
import random

import pytest
import xxhash

from tidemark.llm import substring_dedup, suffix_dedup
from tidemark.llm.components import connected_components
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.rindex import RunLengthIndex
from tidemark.llm.simhash import ball_masks, fingerprint, near_dedup, simhash_components

from .conftest import random_texts


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_exact_dedup_by_brute_force(docs):
    texts = random_texts() + ["hot"] * 300
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in exact_dedup(docs(rows)).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == sha((t or "").encode())


def test_exact_dedup_odd_rows(docs):
    assert exact_dedup(docs([])).collect() == []
    rows = [(None, "a"), (3, "a"), (3, "a"), (1, "a"), (None, "b"), (None, "b")]
    got = sorted(map(tuple, exact_dedup(docs(rows)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got.count((3, 3, 4, True)) == 2 and got.count((1, 3, 4, False)) == 1 and got.count((None, 3, 4, False)) == 1
    assert got.count((None, None, 2, True)) == 2


def slow_fingerprint(text: bytes, n: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_the_definition():
    for t in random_texts(seed=9, n=30):
        for n in (3, 5):
            assert fingerprint((t or "").encode(), n) == slow_fingerprint((t or "").encode(), n)


def test_simhash_components_by_brute_force(docs):
    draw = random.Random(3)
    base = random_texts(seed=4, n=25, most=400)
    texts = list(base)
    for t in base[:15]:  # chains of light edits
        words = (t or "").split()
        for _ in range(6):
            if len(words) > 30:
                words[draw.randrange(len(words))] = "edit"
                texts.append(" ".join(words))
    rows = list(enumerate(texts))
    prints = [slow_fingerprint((t or "").encode(), 3) for t in texts]
    want = components(prints, 2)
    assert len(set(want)) < len({t or "" for t in texts})  # there are near copies to find
    got = {r.doc_id: r for r in simhash_components(docs(rows)).collect()}
    assert [got[i].component_id for i, _ in rows] == want
    assert [got[i].fp % (1 << 64) for i, _ in rows] == prints


def test_simhash_odd_rows(docs):
    assert simhash_components(docs([])).collect() == []
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s"), (9, None), (7, "")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(docs(rows)).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (9, 7), (7, 7)], key=str)
    kept = near_dedup(docs([(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None)])).select("doc_id", "n").collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None] and all(r.n == 1 for r in kept)
    with pytest.raises(ValueError):
        ball_masks(3)


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1000), (1001, 1000)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def brute_repeats(units, window):
    places = collections.Counter(u[j : j + window] for u in units for j in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for j in range(len(u) - window + 1):
            if places[u[j : j + window]] > 1:
                gone[j : j + window] = [True] * window
        out.append(gone)
    return out


def runs(flags):
    return sum(f and not p for f, p in zip(flags, [False, *flags]))


def check_repeats(result, units, window, join):
    got = {r.doc_id: r for r in result.collect()}
    assert len(got) == len(units)
    for i, (u, gone) in enumerate(zip(units, brute_repeats(units, window))):
        kept = [x for x, g in zip(u, gone) if not g]
        r = got[i]
        assert (r.n, r.n_removed, len(r.spans)) == (len(u), sum(gone), runs(gone)), i
        assert bytes(r.kept_sha) == hashlib.sha256(join(kept)).digest(), i


PERIODIC = ["ab" * 40, "abc" * 30 + "tail", "z" * 90, "q" + "ab" * 33, "ab" * 12]


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup_by_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_KINDS", most)  # 1: all cores take the path of the hot ones
    texts = random_texts(seed=6, n=40) + PERIODIC
    result = suffix_dedup.substring_dedup(docs(list(enumerate(texts))), window=40)
    check_repeats(result, [(t or "").encode() for t in texts], 40, bytes)


def test_window_dedup_by_brute_force(docs):
    texts = random_texts(seed=7, n=50) + [" ".join(t) for t in PERIODIC]
    result = substring_dedup.window_dedup(docs(list(enumerate(texts))), window=8, k=3)
    check_repeats(result, [tuple((t or "").encode().split()) for t in texts], 8, b" ".join)


def test_repeats_odd_rows(docs):
    for run in (lambda d: suffix_dedup.substring_dedup(d, window=10), lambda d: substring_dedup.window_dedup(d, window=3)):
        assert run(docs([])).collect() == []
        text = "one two three four five six"
        got = sorted(((r.doc_id, r.n_removed == r.n) for r in run(docs([(None, text), (4, text), (4, text), (5, "other words here now")])).collect()), key=str)
        assert got == sorted([(None, True), (4, True), (4, True), (5, False)], key=str)


def test_index_merges_runs_and_finds_history(spark, docs, tmp_path):
    from tidemark.llm.repeats import Shape, profile

    shape, path = Shape(6, 2, 2, words=True), f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex.create(spark, path, buckets=3)
    texts = [f"w{i} x{i} y{i} z{i} u{i} v{i} t{i}" for i in range(9)] + ["w0 x0 y0 z0 u0 v0 t0 more of it"]
    hits = []
    for i, t in enumerate(texts):
        hits.append(index.add(profile(docs([(i, t)]), shape, "doc_id", "text")).count())
        if i % 2:
            index = substring_dedup.FingerprintIndex.open(spark, path)  # a later call goes on from the files
    assert hits[:9] == [0] * 9 and hits[9] > 0
    assert [len(level) for level in index.levels] == [2, 2]  # 8 of 10 runs were merged by fours
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("run_")]) == 4
    again = substring_dedup.FingerprintIndex.open(spark, path)
    assert again.levels == index.levels and again.buckets == 3
    plan = again.hits(again.levels[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_matches_of_many_groups_and_long_texts(docs, monkeypatch):
    index = RunLengthIndex([b"abcabc%d" % (g % 10) for g in range(600)], list(range(600)))
    assert index.matching_statistics(b"abcabc0", 0) == [7, 6, 5, 4, 3, 2, 1]
    assert index.matching_statistics(b"abcabc9", 599) == [7, 6, 5, 4, 3, 2, 1]
    assert {x for x in index.repeats(3)} == {(i, 0, 6) for i in range(600)}
    from tidemark.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", 64)  # long texts are hashed in pieces
    texts = random_texts(seed=8, n=12) + PERIODIC
    result = suffix_dedup.substring_dedup(docs(list(enumerate(texts))), window=40)
    check_repeats(result, [(t or "").encode() for t in texts], 40, bytes)


def test_run_length_index_by_brute_force():
    draw = random.Random(1)
    for _ in range(150):
        window = draw.choice([3, 6, 8, 13])
        segments = [bytes(draw.choice(b"\0ab") for _ in range(draw.randint(0, 50))) * draw.choice([1, 2]) for _ in range(draw.randint(1, 5))]
        groups = [draw.randint(0, 2) for _ in segments]
        index = RunLengthIndex(segments, groups, draw.choice([1, window]))
        covered = [set() for _ in segments]
        for i, a, b in index.repeats(window):
            covered[i].update(range(a, b))
        for g in set(groups):
            own = [i for i, x in enumerate(groups) if x == g]
            for i, gone in zip(own, brute_repeats([segments[i] for i in own], window)):
                assert covered[i] == {k for k, f in enumerate(gone) if f}
        pattern, g = bytes(draw.choice(b"\0ab") for _ in range(15)), draw.randint(0, 2)
        held = [s for s, x in zip(segments, groups) if x == g]
        want = [max((n for n in range(16 - i) if any(pattern[i : i + n] in s for s in held)), default=0) for i in range(15)]
        assert index.matching_statistics(pattern, g) == want
