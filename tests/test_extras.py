"""Durations, events and episodes of gates by brute force, with two series interleaved."""

import datetime as dt
import random

import pytest

from tidemark import cli
from tidemark.plans import catalogue, gates

START = dt.date(2020, 1, 1)


def series(n=150):
    draw = random.Random(9)
    out = []
    for name in "ab":
        state = 0
        for i in range(n):
            if draw.random() < 0.06:
                state = 1 - state
            out.append((name, START + dt.timedelta(i), i, draw.gauss(0, 0.01), None if i < 5 else float(state)))
    draw.shuffle(out)
    return out


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(series(), "series_id string, date date, pos int, r double, g double")


def by_series(name):
    return sorted((r for r in series() if r[0] == name), key=lambda r: r[2])


def test_durations(days):
    got = {(r.series_id, r.g): r for r in gates.regime_durations(days).collect()}
    for name in "ab":
        g = [r[4] for r in by_series(name) if r[4] is not None]
        for state in set(g):
            runs, n = [], 0
            for x in [*g, None]:
                if x == state:
                    n += 1
                elif n:
                    runs.append(n)
                    n = 0
            seen = [(x, y) for x, y in zip(g, g[1:]) if x == state]
            left = sum(y != state for _, y in seen)
            row = got[name, state]
            assert (row.runs, row.longest) == (len(runs), max(runs))
            assert row.realised == pytest.approx(sum(runs) / len(runs))
            assert row.expected == (pytest.approx(len(seen) / left) if left else None)


def test_events(spark, days):
    known = spark.createDataFrame([(s, START + dt.timedelta(i)) for s in "ab" for i in (0, 30, 77, 140, 999)], "series_id string, date date")
    got = {(r.series_id, r.date): (r.delay, r.caught) for r in gates.event_table(days, known, within=20).collect()}
    assert len(got) == 8
    for (name, date), found in got.items():
        at = (date - START).days
        hits = [r[2] - at for r in by_series(name) if r[4] == 1 and at <= r[2] <= at + 20]
        assert found == ((min(hits), True) if hits else (None, False))


@pytest.mark.parametrize("gap", [1, 4, 21])
def test_episodes(days, gap):
    got = sorted((r.series_id, r.start, r.end, r.days, r.signal_days, round(r.ret, 9)) for r in gates.episodes(days, gap).collect())
    want = []
    for name in "ab":
        rows, spans = by_series(name), []
        for r in rows:
            if r[4] == 1:
                if spans and r[2] - spans[-1][1] - 1 < gap:
                    spans[-1][1] = r[2]
                else:
                    spans.append([r[2], r[2]])
        for a, b in spans:
            part = rows[a : b + 1]
            want.append((name, part[0][1], part[-1][1], len(part), sum(r[4] == 1 for r in part), round(sum(r[3] for r in part), 9)))
    assert got == sorted(want)


def test_no_days(days):
    empty = days.limit(0)
    assert gates.regime_durations(empty).collect() == gates.event_table(empty, empty).collect() == gates.episodes(empty).collect() == []


def test_command_line_names_registered_queries(monkeypatch):
    class Rows:
        def show(self, *args, **kwargs):
            pass

    ran = []
    fakes = {n: (lambda s, d, n=n: ran.append((n, d)) or Rows()) for n in catalogue.QUERIES}
    monkeypatch.setattr(catalogue, "QUERIES", fakes)
    monkeypatch.setattr(cli, "build_session", lambda: None)
    assert cli.main(["synthetic"]) == cli.main(["stability", "--data", "x"]) == cli.main(["walkforward", "--data", "x"]) == 0
    assert [n for n, _ in ran] == ["gen5_path_scores", "met7_refit_stability", "orc3_runner"]
