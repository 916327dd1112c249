"""Classifiers, decontamination, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, quality
from tidemark.llm.queries import pieces_path

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces.of(["▁", "▁a", "a", "ab", "b", "▁ab", "c"])
    names = {}
    for p in ["▁", "▁a", "a", "ab", "b", "▁ab", "c"]:
        key = langid._hash_strings(langid._codes([p])) * np.uint64(64) + np.uint64(len(p))
        names[p] = int(np.searchsorted(pieces.hashes, key[0]))
    draw = np.random.default_rng(0)
    table = np.vstack([draw.uniform(0.01, 0.3, (len(pieces.hashes), 2)), np.zeros((1, 2))])

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            p = table[names[word[:n]]] if word[:n] in names else np.full(2, langid.UNKNOWN if n == 1 else 0.0)
            total = total + p * brute(word[n:])
        return total

    words = ["▁ab", "▁abab", "▁cab", "▁xa", "▁"]
    assert np.allclose(np.exp(langid.forward(words, pieces, table)), [brute(w) for w in words])


def lattice(word, names, table):
    """Sums of all segmentations of every prefix."""
    alpha = [1.0]
    for j in range(1, len(word) + 1):
        alpha.append(sum(alpha[i] * (table[names[word[i:j]]] if word[i:j] in names else langid.UNKNOWN if j - i == 1 else 0.0) for i in range(j)))
    return alpha


@pytest.mark.parametrize("short", [langid.SHORT, 0])
def test_words_of_any_length_are_whole(monkeypatch, short):
    monkeypatch.setattr(langid, "SHORT", short)
    vocab = ["▁", "a", "ab", "b", "ba", "abab", "babababababababab"]
    pieces = langid.Pieces.of(vocab)
    names = {p: int(np.searchsorted(pieces.hashes, (langid._hash_strings(langid._codes([p])) * np.uint64(64) + np.uint64(len(p)))[0])) for p in vocab}
    table = np.append(np.random.default_rng(4).uniform(0.05, 0.3, len(pieces.hashes)), 0.0)
    words = ["▁" + w for w in ("ab", "ab" * 20, "abxab", "ba" * 60)]
    got = langid.forward(words, pieces, table[:, None])[:, 0]
    assert np.allclose(got, [np.log(lattice(w, names, table)[-1]) for w in words])
    # the derivative of the log sum by a piece's log probability is how often the piece is expected
    counts = np.array([1.0, 2.0, 3.0, 0.5])
    expected = langid.expected_pieces(words, counts, pieces, table[:, None])
    for p in vocab:
        moved = table.copy()
        moved[names[p]] *= 1 + 1e-6
        slope = (langid.forward(words, pieces, moved[:, None])[:, 0] - got) @ counts / 1e-6
        assert expected[names[p]] == pytest.approx(slope, rel=1e-3, abs=1e-4)
    long = langid.forward(["▁" + "ab" * 3000], pieces, table[:, None])
    assert np.isfinite(long).all() and long[0, 0] < -750


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_held_out(docs, pieces_path()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(docs):
    rows = [(i, "the of and is that for word " * 3, "en") for i in range(20)] + [(100 + i, "der die und ist ein mit wort " * 3, "de") for i in range(20)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (None, "und der die", None), (503, "x" * 20000, None), (504, "the of", None)]
    got = langid.identify_held_out(docs(rows), pieces_path()).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[500].score == 0
    assert by[None].lang_pred == "de" and by[None].held_out is False and by[504].lang_pred == "en"
    assert langid.identify_held_out(docs([]), pieces_path()).collect() == []
    assert {r.lang_pred for r in langid.identify_held_out(docs([(1, "abc", None)]), pieces_path()).collect()} == {"und"}


def test_isotonic_is_the_least_squares_monotone_fit():
    draw = np.random.default_rng(1)
    score, label = draw.uniform(size=60), draw.integers(0, 2, 60).astype(float)
    x, y = quality.isotonic(score, label)
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    order = np.argsort(score)
    # max-min formula
    own = label[order]
    fit = [max(min(own[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(fit, 9))), sorted(set(np.round(y, 9))))


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_statistics_are_those_named():
    text = "Aa aa 12!\n\nb| \u00e9 12!"  # a blank line does not count
    raw, words = text.encode(), [w.encode() for w in text.split()]
    got = dict(zip(quality.FEATURES, quality.statistics(raw), strict=True))
    n, m = len(raw), len(words)
    shares = [raw.count(bytes([b])) / n for b in set(raw)]
    want = {
        "log_bytes": np.log(n + 1), "log_words": np.log(m + 1), "mean_word": sum(map(len, words)) / m, "upper": 1 / n, "digit": 4 / n,
        "space": 6 / n, "high": 2 / n, "common_mark": 0, "symbol": 2 / n, "bar": 1 / n, "line_rate": 2 / m, "distinct_words": 5 / m,
        "top_word": 2 / m, "repeated_lines": 0, "long_words": 0, "marked_words": 3 / m, "repeat_next": 0,
        "entropy": -sum(p * np.log2(p) for p in shares), "capitalised": 1 / m, "log_lines": np.log(3),
    }
    assert got == pytest.approx(want)


def test_summed_normal_equations_are_those_of_all_rows(spark):
    k = quality.COSINES
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=len(quality.FEATURES)).tolist(), float(draw.integers(0, 2))) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, x array<double>, y double").repartition(7)
    model = quality.fit_quality(frame)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    calibrates = {r.doc_id for r in frame.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()}
    fit = np.array([r[0] not in calibrates for r in rows])
    z = model.cosines(x)
    penalty = np.diag([quality.RIDGE * fit.sum()] * k + [quality.RIDGE * fit.sum() * 1e-6]) + 1e-9 * np.eye(k + 1)
    stacked = np.vstack([z[fit], np.sqrt(penalty)])
    want = np.linalg.lstsq(stacked, np.append(y[fit], np.zeros(k + 1)), rcond=None)[0]
    assert np.allclose(model.weights, want, atol=1e-6)
    assert np.allclose(model.knots[1], quality.isotonic(model.raw(x[~fit]), y[~fit])[1])


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality, "COSINES", 20_000)
    d = len(quality.FEATURES)
    model = quality.QualityModel(np.zeros(d), np.ones(d), np.zeros(1), (np.zeros(0), np.zeros(0)))
    x = np.random.default_rng(4).normal(size=(6, d))
    z = model.cosines(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(z @ z.T, np.exp(-gap / (2 * quality.WIDTH**2 * d)), atol=0.05)


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "good text"), (2, None), (None, ""), (3, "$$$ " * 5000), (3, "$$$"), (4, "other")]
    got = quality.classify_quality(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify_quality(docs([]), labels).collect() == []
    assert {r.score for r in quality.classify_quality(docs(rows), labels.limit(0)).collect()} == {0.5}


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_by_brute_force():
    draw = random.Random(0)
    for _ in range(200):
        a = [draw.randint(0, 4) for _ in range(draw.randint(1, 12))]
        b = [draw.randint(0, 4) for _ in range(draw.randint(1, 25))]
        score, start, end = decontaminate.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        assert 0 <= start <= end <= len(b) and brute_align(a, b[start:end]) == score


def test_leaks_survive_edits_and_clean_text_stays(spark, docs):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(draw.choice(words) for _ in range(40))) for i in range(12)]
    filler = lambda n: [draw.choice(words) for _ in range(n)]
    rows, want = [], set()
    for i, text in items:
        own = text.split()
        for k in draw.sample(range(40), 6):
            own[k] = "changed"
        del own[draw.randrange(len(own))]
        rows.append((i, " ".join(filler(50) + own + filler(50)).upper()))
        want.add((i, i))
    rows += [(100 + i, " ".join(filler(300))) for i in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "!!")], "item_id long, text string")
    got = decontaminate.find_leaks(docs([*rows, (None, items[0][1]), (200, None), (201, "")]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    assert all(45 <= r.start_word <= 60 and 80 <= r.end_word <= 95 for r in got if r.doc_id is not None)
    kept = decontaminate.drop_leaks(docs(rows), bench).select("doc_id", "score").collect()
    assert sorted(r.doc_id for r in kept) == [100 + i for i in range(30)]


def test_leaks_of_empty_tables_and_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten")], "item_id long, text string")
    assert decontaminate.find_leaks(docs([]), bench).collect() == []
    assert decontaminate.find_leaks(docs([(1, "a")]), bench.limit(0)).collect() == []
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    got = decontaminate.find_leaks(docs([(5, "x one two three four five six y"), (6, "seven eight nine ten")]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 1), (6, 2)}


def test_raking_meets_the_targets(spark):
    draw = random.Random(4)
    cells = [(s, la, t, draw.randint(1, 1000)) for s in "abc" for la in ("x", "y") for t in ("p", "q")]
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").coalesce(1)
    got = mixing.rake(frame, targets).collect()
    for d, shares in targets.items():
        for v, share in shares.items():
            assert sum(r.weight for r in got if r[d] == v) == pytest.approx(share, abs=1e-12)


def raked_plainly(cells, targets, rounds):
    total = sum(c[3] for c in cells)
    weight = {c[:3]: c[3] / total for c in cells}
    for _ in range(rounds):
        for k, d in enumerate(mixing.DIMENSIONS):
            margin = {v: sum(w for c, w in weight.items() if c[k] == v) for v in targets[d]}
            weight = {c: w * targets[d][c[k]] / margin[c[k]] for c, w in weight.items()}
    return weight


def test_raking_of_sparse_cells_goes_on_until_the_margins_agree(spark):
    cells = [("a", "x", "p", 900), ("a", "y", "q", 1), ("b", "x", "q", 5), ("b", "y", "p", 70), ("c", "x", "p", 3), ("c", "y", "q", 400), ("c", "y", "p", 2)]
    reachable = dict(zip([c[:3] for c in cells], [0.3, 0.1, 0.1, 0.1, 0.1, 0.2, 0.1]))
    targets = {d: {v: sum(w for c, w in reachable.items() if c[k] == v) for v in {c[k] for c in cells}} for k, d in enumerate(mixing.DIMENSIONS)}
    assert len({round(raked_plainly(cells, targets, n)[cells[0][:3]], 9) for n in (mixing.ROUNDS, 2000)}) == 2  # one block is not enough
    want = raked_plainly(cells, targets, 2000)
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").coalesce(1)
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(frame, targets).collect()}
    assert got == pytest.approx(want, abs=1e-11)


def test_targets_that_cannot_be_met_are_named(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 12)
    frame = spark.createDataFrame([("a", "x", "p", 5), ("b", "y", "p", 5)], "source string, lang string, topic string, tokens long").coalesce(1)
    with pytest.warns(UserWarning, match="cannot be met"):
        mixing.rake(frame, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert {r.weight for r in mixing.rake(frame, {"source": {"z": 1.0}}).collect()} == {0.0}


def test_many_cells_give_the_same_as_few(docs, monkeypatch):
    draw = random.Random(7)
    rows = [(i, "w " * draw.randint(0, 9) + draw.choice(["", "@", "|"]), draw.choice(["en", "de", None]), draw.choice("aab")) for i in range(300)]
    few = {r.doc_id: (round(r.probability, 9), r.kept) for r in mixing.mix_probabilities(docs(rows)).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 0)
    assert few == {r.doc_id: (round(r.probability, 9), r.kept) for r in mixing.mix_probabilities(docs(rows)).collect()}
    kept = sorted(r.doc_id for r in mixing.sample_mix(docs(rows)).collect())
    assert kept == sorted(i for i, (_, k) in few.items() if k)


def test_topics_are_the_callers(docs):
    words = {"law": ["court", "judge"], "food": ["bread", "judge"]}
    rows = [(1, "The Court, the judge."), (2, "bread judge"), (3, "judge"), (4, None), (5, "bread " * 300_000), (6, "")]
    topic = mixing.topic_by_words(F.col("text"), words)
    got = {r.doc_id: r.topic for r in mixing.mix_probabilities(docs(rows), topic=topic).collect()}
    assert got == {1: "law", 2: "food", 3: "law", 4: "other", 5: "food", 6: "other"}
    own = mixing.mix_probabilities(docs(rows), topic=F.col("kept")).collect()
    assert {r.topic for r in own} == {"z"}
    assert mixing.sample_mix(docs(rows), topic=topic).columns == docs(rows).columns


def test_mixing_odd_rows(docs):
    rows = [(1, "a b c", "en", "s"), (2, None, None, None), (None, "d e", "en", None), (3, "", "de", "s"), (3, "x", "de", "s")]
    got = mixing.mix_probabilities(docs(rows)).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got) and max(r.probability for r in got) == pytest.approx(1)
    assert mixing.mix_probabilities(docs([])).collect() == []
    assert {r.probability for r in mixing.mix_probabilities(docs([(1, None), (2, "")])).collect()} == {0.0}
    assert all(r.n == 1 for r in mixing.sample_mix(docs(rows)).collect())


def test_sampled_mix_is_near_its_weights(docs):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randint(5, 15), draw.choice(["en", "en", "en", "de"]), draw.choice("aab")) for i in range(6000)]
    got = mixing.mix_probabilities(docs(rows)).collect()
    kept = [r for r in got if r.kept]
    total = sum(r.n_tokens for r in kept)
    for cell in {(r.source, r.lang) for r in got}:
        share = sum(r.n_tokens for r in kept if (r.source, r.lang) == cell) / total
        assert share == pytest.approx(next(r.weight for r in got if (r.source, r.lang) == cell), abs=0.03)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(before[r.doc_id] == r for r in rows), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows}


def test_pipeline_stages_on_odd_tables(spark, docs):
    import corpus_pipeline

    base = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = docs([(1, None), (2, ""), (None, "und der die"), (3, "the of and", "en", "s"), (3, "the of and", "en", "s")]).select(*base)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, odd.limit(0), SF).collect() == [], name
