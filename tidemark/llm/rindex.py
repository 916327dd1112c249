"""Run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Built over a small block of segments. A segment has a group; symbols of different groups never
match, so unrelated segments can share one sort. Suffixes are sorted by prefix doubling, whose ranks are dropped;
runs of equal preceding symbols and the suffix positions at their ends are kept, beside the text.

A suffix's matching statistic is its longest match with another suffix of its group. One step to the right it
shrinks by one at most, and it is more than that only where the preceding symbols of neighbouring suffixes differ, which
is at the ends of runs. So the statistics of all positions are streamed from the matches at the run ends.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

#: Symbols in a first sort key: 9 bits each, and 10 bits for the group.
FIRST = 6
GROUPS = 1 << 10


class RunLengthIndex:
    def __init__(self, segments: list[bytes], groups: list[int], least: int = 1):
        """``groups`` are below GROUPS; each segment ends in a symbol of its own; matches shorter than ``least`` count as 0."""
        self.n_segments = len(segments)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.text = np.frombuffer(b"\0".join([*segments, b""]), dtype=np.uint8)
        self.segment = np.repeat(np.arange(len(segments)), size + 1)
        self.end = (self.start + size)[self.segment]
        self.group = np.array(groups, dtype=np.int64)[self.segment]
        self._sort(int(size.max(initial=0)), least)

    def _sort(self, longest: int, least: int) -> None:
        n = len(self.text)
        at = np.arange(n)
        inside = at < self.end
        symbol = np.where(inside, self.text.astype(np.int64) + 1, 0)
        key = self.group.astype(np.uint64)  # all 64 bits are used
        for j in range(FIRST):
            shifted = np.zeros(n, dtype=np.int64)
            if j < n:
                shifted[: n - j] = symbol[j:]
            key = (key << np.uint64(9)) | np.where(at + j < self.end, shifted, 0).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        rank = self._ranks(key, order)
        near = (FIRST, rank) if FIRST <= least else None  # ranks of the longest prefixes that a match must share
        done = FIRST
        while done <= longest or done == FIRST:
            ahead = at + done
            tail = np.where(ahead < self.end, rank[np.minimum(ahead, n - 1)] + self.n_segments, self.segment)
            key = (rank.astype(np.uint64) << np.uint64(32)) | tail.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key, order)
            done *= 2
            if done <= least:
                near = (done, rank)
            if rank[order[-1]] == n - 1:
                break
        before = order - 1
        first = order == self.start[self.segment[order]]
        symbol = np.where(first, -1 - self.segment[order], (self.group[order] << 9) | (self.text[before].astype(np.int64) + 1))
        heads = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if n else np.zeros(0, dtype=np.int64)
        self.row = heads
        self.symbol = symbol[heads]
        self.sample_first = order[heads]
        self.sample_last = order[np.concatenate([heads[1:], [n]]) - 1] if n else order
        p, q = self.sample_last[:-1], self.sample_first[1:]
        live = (self.end[p] - p >= least) & (self.end[q] - q >= least)
        p, q = p[live], q[live]
        if near:
            depth, rank = near
            live = (rank[p] == rank[q]) & (rank[p + least - depth] == rank[q + least - depth])
            p, q = p[live], q[live]
        length = self.common(p, q)
        long = length >= least
        self.match_at, self.match = np.concatenate([p[long], q[long]]), np.concatenate([length[long], length[long]])

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        sorted_key = key[order]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if len(key) else 0
        return rank

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q, pairwise, within segments."""
        most = np.minimum(self.end[p] - p, self.end[q] - q)
        most = np.where(self.group[p] == self.group[q], most, 0)
        out = np.zeros(len(p), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        step = np.arange(64)
        while len(live):
            at = np.minimum(out[live, None] + step, most[live, None] - 1)
            same = self.text[p[live, None] + at] == self.text[q[live, None] + at]
            run = np.where(same.all(axis=1), 64, np.argmin(same, axis=1))
            out[live] = np.minimum(out[live] + run, most[live])
            live = live[(run == 64) & (out[live] < most[live])]
        return out

    def self_statistics(self) -> np.ndarray:
        """For each place of the joined text the longest match with another place of its group, streamed from the run ends."""
        places = np.arange(len(self.text))
        reach = np.zeros(len(self.text), dtype=np.int64)
        np.maximum.at(reach, self.match_at, self.match_at + self.match)
        return np.maximum(np.maximum.accumulate(reach) - places, 0) if len(reach) else reach

    def repeats(self, window: int) -> list[tuple[int, int, int]]:
        """(segment, start, end) of the maximal stretches covered by matches of at least ``window`` symbols."""
        found = self.self_statistics()
        start = np.flatnonzero(found >= window)
        if not len(start):
            return []
        edge = np.zeros(len(self.text) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + found[start], -1)
        covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        change = np.flatnonzero(np.diff(covered))
        a, b = change[::2], change[1::2]
        own = self.segment[a]
        return list(zip(own.tolist(), (a - self.start[own]).tolist(), (b - self.start[own]).tolist()))

    def matching_statistics(self, pattern: bytes, group: int = 0) -> list[int]:
        """For each position of ``pattern`` the longest prefix from there that the group's text holds.

        Streams the pattern from its end: while the preceding symbol agrees, the match grows;
        otherwise it jumps to the nearest run of the symbol above or below, at its sampled end.
        """
        runs = len(self.row)
        if not hasattr(self, "_of"):
            self._of: dict[int, list[int]] = {}
            size = np.diff(np.concatenate([self.row, [len(self.text)]]))
            for r, s in enumerate(self.symbol.tolist()):
                self._of.setdefault(s, []).append(r)
            # rows of suffixes that start with a symbol are consecutive, in the order of the runs
            before = np.zeros(runs, dtype=np.int64)
            head = np.where(
                np.arange(len(self.text)) < self.end, (self.group << 9) | (self.text.astype(np.int64) + 1), self.group << 9
            )
            values, counts = np.unique(head, return_counts=True)
            first_row = dict(zip(values.tolist(), (np.cumsum(counts) - counts).tolist()))
            for s, own in self._of.items():
                if s >= 0:
                    before[own] = first_row[s] + np.cumsum(size[own]) - size[own]
            self._before = before
        out = [0] * len(pattern)
        row, at, length = 0, None, 0
        for i in range(len(pattern) - 1, -1, -1):
            symbol = (group << 9) | (pattern[i] + 1)
            own = self._of.get(symbol)
            if not own:
                at, length = None, 0
                continue
            run = bisect_right(self.row, row) - 1
            if at is not None and self.symbol[run] == symbol:
                row, at, length = int(self._before[run] + row - self.row[run]), at - 1, length + 1
            else:
                k = bisect_left(own, run)
                options = []
                if k:
                    r = own[k - 1]
                    last = (self.row[r + 1] if r + 1 < runs else len(self.text)) - 1
                    options.append((int(self.sample_last[r]), int(last), r))
                if k < len(own):
                    r = own[k]
                    options.append((int(self.sample_first[r]), int(self.row[r]), r))
                best = -1
                for sample, place, r in options:
                    shared = 0 if at is None else min(length, int(self.common(np.array([at]), np.array([sample]))[0]))
                    if shared > best:
                        best, pick = shared, (sample, place, r)
                sample, place, r = pick
                row, at, length = int(self._before[r] + place - self.row[r]), sample - 1, best + 1
            out[i] = length
        return out
