"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is three words of a test item, next to each other or with one word skipped in either place. Both sides
have all of them, so a replaced, dropped or added word between any three does not hide a seed. Seeds that
many items share (the set phrases of a benchmark) are left out where the item has enough others. Where a
document has a seed, the item is scored with the words around it; local alignment tolerates edits.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize
from tidemark.llm.repeats import keyed_texts

WORD = re.compile(r"[^\W_]+")
#: Places of a seed's second and third word after its first.
SEEDS = ((1, 2), (1, 3), (2, 3), (2, 4))
#: A seed is common if more items than this, and more than this share of all, have it.
COMMON, COMMON_SHARE = 8, 0.05
#: Alignment scores, and the share of the perfect score from which a document is contaminated.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: A few words stand in any text. Items of fewer words than these must stand verbatim, or be a whole document.
ALIGNED_WORDS, VERBATIM_WORDS = 8, 4
#: Characters of test items up to which they are sent to every task; beyond, seeds are joined by a shuffle.
BLOCK_CHARS = 4 << 20
#: Words of regions that are scored at once.
CELLS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of word numbers: best score, and start and end of the aligned part of b."""
    n = len(b)
    ramp = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, dtype=np.int64)
    origin = np.arange(n + 1)  # where in b the alignment that ends here began
    best, span = 0, (0, 0)
    for x in a.tolist():
        diagonal = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = row + GAP
        new, start = up.copy(), origin.copy()
        better = diagonal >= up[1:]
        new[1:] = np.where(better, diagonal, up[1:])
        start[1:] = np.where(better, origin[:-1], origin[1:])
        fresh = new <= 0
        new[fresh] = 0
        start[fresh] = np.flatnonzero(fresh)
        level = new + ramp
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, np.arange(n + 1), 0))
        new, start = top - ramp, start[source]
        row, origin = new, start
        k = int(np.argmax(row))
        if row[k] > best:
            best, span = int(row[k]), (int(origin[k]), k)
    return best, *span


def seeds_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of a sequence of word numbers or hashes, and the place of each one's first word."""
    wide = numbers.astype(np.uint64)
    keys, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for b, c in SEEDS:
        n = len(wide) - c
        if n > 0:
            keys.append(((wide[:n] * _MIX + wide[b : b + n]) * _MIX + wide[c:]) * _MIX)
            places.append(np.arange(n))
    return np.concatenate(keys), np.concatenate(places)


class Items:
    """A block of test items with their seeds; shipped to the tasks."""

    def __init__(self, items: list[tuple[int, str]], all_rare: bool = False):
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in own], dtype=np.int64) for own in words]
        self.sizes = sizes = np.array([len(own) for own in self.words], dtype=np.int64)
        self.need = np.where(sizes < ALIGNED_WORDS, MATCH * sizes, np.ceil(THRESHOLD * MATCH * sizes)).astype(np.int64)
        self.whole: dict[tuple, list[int]] = {}
        keys, items_, places = [], [], []
        for item, own in enumerate(self.words):
            if 0 < len(own) < VERBATIM_WORDS:
                self.whole.setdefault(tuple(own.tolist()), []).append(item)
            elif len(own):
                key, place = seeds_of(own)
                keys.append(key)
                places.append(place)
                items_.append(np.full(len(key), item))
        key, item, place = (np.concatenate([*x, np.zeros(0, dtype=t)]) for x, t in ((keys, np.uint64), (items_, np.int64), (places, np.int64)))
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.rare = np.full(len(key), True) if all_rare else self._rare(key, item)[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))
        self.slots = np.zeros(1 << _SLOTS, dtype=bool)  # most words of a document are settled by this table
        self.slots[(self.keys >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True

    def _rare(self, key: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which seeds are rare: those few items have, or all of an item if less than half of its own are such."""
        if not len(key):
            return np.zeros(0, dtype=bool)
        own, back = np.unique(np.stack([key, item.astype(np.uint64)]), axis=1, return_inverse=True)
        distinct, holders = np.unique(own[0], return_counts=True)
        rare = ~np.isin(own[0], distinct[(holders > COMMON) & (holders > COMMON_SHARE * len(self.ids))])
        owner = own[1].astype(np.int64)
        share = np.bincount(owner, rare, len(self.ids)) / np.maximum(1, np.bincount(owner, minlength=len(self.ids)))
        return (rare | (share[owner] < 0.5))[back.ravel()]

    def regions(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to) around the seeds of the items of which a rare one is here.

        A region is wide enough for every alignment through its seeds that counts; one with a single seed is chance.
        """
        key, at = seeds_of(numbers)
        hit = np.flatnonzero(self.slots[(key >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        if not len(hit) or not len(self.keys):
            return []
        key, at = key[hit], at[hit]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[found] == key
        found, at = found[same], at[same]
        if not len(found):
            return []
        count = self.first[found + 1] - self.first[found]
        posting = np.repeat(self.first[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, start = self.item[posting], np.repeat(at, count) - self.place[posting]
        if not self.rare.all():
            here = np.isin(item, item[self.rare[posting]])
            item, start = item[here], start[here]
            if not len(item):
                return []
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        size = self.sizes[item]
        slack = MATCH * size - self.need[item]  # added words that a perfect score can pay for
        low, high = np.maximum(start - slack, 0), np.minimum(start + size + slack, len(numbers))
        apart = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (low[1:] > high[:-1])]))
        last = np.append(apart[1:], len(item)) - 1
        enough = (last > apart) | (size[apart] < ALIGNED_WORDS)
        apart, last = apart[enough], last[enough]
        return list(zip(item[apart].tolist(), low[apart].tolist(), high[last].tolist()))

    def best_scores(self, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Best alignment score of each (item, words of a region); regions of like width at once."""
        out = np.zeros(len(parts), dtype=np.int64)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k][1]))
        k = 0
        while k < len(order):
            own = order[k : k + max(1, CELLS // max(1, len(parts[order[k]][1])))]
            n = len(parts[own[-1]][1])
            own = own[: max(1, CELLS // max(1, n))]
            k += len(own)
            n, m = len(parts[own[-1]][1]), max(len(self.words[parts[c][0]]) for c in own)
            text = np.full((len(own), n), -2, dtype=np.int32)
            item = np.full((len(own), m), -3, dtype=np.int32)
            for r, c in enumerate(own):
                text[r, : len(parts[c][1])] = parts[c][1]
                item[r, : len(self.words[parts[c][0]])] = self.words[parts[c][0]]
            ramp = np.arange(n + 1, dtype=np.int32) * np.int32(-GAP)
            row, best = np.zeros((len(own), n + 1), dtype=np.int32), np.zeros(len(own), dtype=np.int32)
            for w in range(m):
                new = np.maximum(row + np.int32(GAP), 0)
                np.maximum(new[:, 1:], row[:, :-1] + np.where(text == item[:, w, None], np.int32(MATCH), np.int32(MISMATCH)), out=new[:, 1:])
                row = np.maximum.accumulate(new + ramp, axis=1) - ramp
                np.maximum(best, row.max(axis=1), out=best)
            out[own] = best
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text the (item id, score, first word, end word) of the items that it holds.

        Of alignments with equal scores the first is reported.
        """
        found: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        get, known, todo, parts = self.vocab.get, {}, [], []
        for t, text in enumerate(texts):
            words = words_of(text)
            numbers = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
            if 0 < len(words) < VERBATIM_WORDS:
                found[t] += [(self.ids[i], 1.0, 0, len(words)) for i in self.whole.get(tuple(numbers.tolist()), ())]
            for item, a, b in self.regions(numbers):
                part = numbers[a:b].astype(np.int32)
                key = (item, part.tobytes())
                if key not in known:
                    known[key] = len(parts)
                    parts.append((item, part))
                todo.append((t, known[key], a))
        scores = self.best_scores(parts)
        spans: dict[int, tuple[int, int, int]] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, k, a in todo:
            item = parts[k][0]
            if scores[k] >= self.need[item] and scores[k] > best.get((t, item), (0,))[0]:
                if k not in spans:
                    spans[k] = align(self.words[item], parts[k][1])
                _, s, e = spans[k]
                best[t, item] = (int(scores[k]), a + s, a + e)
        for (t, item), (score, s, e) in best.items():
            found[t].append((self.ids[item], score / (MATCH * len(self.words[item])), s, e))
        return found


_LEAKS = "doc_id long, item_id long, score double, start_word long, end_word long"
#: Documents that are scanned at once.
SCANNED = 2000


def _leak_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "start_word", "end_word"])


def _by_broadcast(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    own = Items(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for a in range(0, batch.num_rows, SCANNED):
            part = batch.slice(a, SCANNED)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows += [(d, *x) for d, found in zip(ids, own.scan(texts)) for x in found]
        return _leak_rows(rows)

    return map_arrow(docs, run, _LEAKS)


def _by_join(docs: DataFrame, items: DataFrame, n_items: int, blocks: int) -> DataFrame:
    """The same for a benchmark of any size: texts meet the items whose rare seeds they have by a shuffle on seeds.

    Copies of a text are joined once. A text's items come in ``blocks`` rows, so none holds more than a block.
    """

    def seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words_of(text)], dtype=np.uint64)
            if 0 < len(hashes) < VERBATIM_WORDS:
                out.append(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], dtype=np.uint64).view(np.int64))
            else:
                out.append(np.unique(seeds_of(hashes)[0]).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "seeds"])

    keyed = keyed_texts(docs, "doc_id", "text")
    texts = materialize(keyed.groupBy("dg").agg(F.first("text").alias("text")), "leak-texts")
    own = map_arrow(texts.select("dg", "text"), seeds, "id binary, seeds array<long>").select(F.col("id").alias("dg"), F.explode("seeds").alias("seed"))
    tests = materialize(items.select(F.expr("unhex(sha2(concat_ws(':', item_id, text), 256))").alias("test"), F.struct("item_id", "text").alias("item")), "leak-tests")
    held = map_arrow(tests.select("test", "item.text"), seeds, "id binary, seeds array<long>")
    held = materialize(held.select(F.col("id").alias("test"), F.explode("seeds").alias("seed")), "leak-seeds")
    holders = held.groupBy("seed").agg((F.count(F.lit(1)) <= max(COMMON, COMMON_SHARE * n_items)).alias("rare"))
    rated = held.join(holders, "seed")
    scarce = rated.groupBy("test").agg((F.avg(F.col("rare").cast("int")) < 0.5).alias("scarce"))
    wanted = rated.join(scarce, "test").where("rare or scarce").select("test", "seed")
    pairs = own.join(wanted, "seed").select("dg", "test").distinct()
    lists = pairs.join(tests, "test").groupBy("dg", F.pmod(F.xxhash64("test"), F.lit(blocks)).alias("block")).agg(F.collect_list("item").alias("items"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for dg, text, tests in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(dg, *x) for x in Items([(x["item_id"], x["text"]) for x in tests], all_rare=True).scan([text])[0]]
        found = _leak_rows([(None, *x[1:]) for x in rows])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), *found.columns[1:]], names=["dg", *found.schema.names[1:]])

    found = map_arrow(texts.join(lists, "dg").select("dg", "text", "items"), run, _LEAKS.replace("doc_id long", "dg binary"))
    return keyed.select("doc_id", "dg").join(found, "dg").select("doc_id", "item_id", "score", "start_word", "end_word")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: the test items that documents hold.

    score is the best local alignment's share of the item's perfect score, at least THRESHOLD; the
    span counts words (runs of letters and digits, case ignored) of the whole text. Items of fewer than
    ALIGNED_WORDS words must stand verbatim, items of fewer than VERBATIM_WORDS be the whole document. Null
    or empty texts and items hold nothing and are held by nothing. Items with equal texts are all reported, repeated
    item rows once; repeated document rows are reported each; a null doc_id is reported as null. Empty tables give an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    if (size.chars or 0) > BLOCK_CHARS:
        return _by_join(docs, items, size.n, int(size.chars // BLOCK_CHARS) + 1)
    return _by_broadcast(docs, [(r.item_id, r.text) for r in items.collect()])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that hold a test item; rows without an id stay."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__leak_id")).distinct()
    return docs.join(leaks, docs[id_col] == leaks["__leak_id"], "left_anti")
