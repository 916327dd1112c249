"""Finding fixed-length repeated windows in all texts, over bytes or words.

Shared by the two substring operators. Three narrowing steps, none of which can lose a repeat:

1. *Fingerprints.* Winnowing gives each window the smallest k-gram hash in it; neighbouring
   windows mostly share it, so few hashes stand for all windows. Equal windows have equal
   fingerprints, hence only fingerprints seen twice matter.
2. *Blocks.* The windows around a repeated anchor are cut into blocks of up to ``group`` starts at
   fixed offsets from the anchor. All windows of a block contain its *core*; equal windows lie in
   blocks with equal cores. Only cores seen twice matter.
3. *Verdicts.* A block that equals another block of its core repeats as a whole. Blocks of a core
   that differ somewhere are settled exactly by the calling operator, one of each content.

Texts are grouped by the first 16 bytes of their SHA-256 (``dg``), so copies are examined once:
each window of a text that has a copy repeats in that copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import byte_values, rolling, select
from tidemark.llm.common import map_arrow, materialize, text_or_empty, utf8

#: Units that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20


@dataclass(frozen=True)
class Shape:
    """``window`` units judged, ``k`` units hashed, ``group`` window starts in a block."""

    window: int
    k: int
    group: int
    words: bool = False

    @property
    def width(self) -> int:
        return self.window - self.k + 1


class Units:
    """One text as hashable units; ``cut(a, b)`` are the bytes of units a to b."""

    def __init__(self, text: bytes, shape: Shape):
        if shape.words:
            words = text.split()  # bytes: ASCII white space only
            self.data = b" ".join(words)
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            self.end = np.cumsum(size + 1) - 1
            self.start = self.end - size
            low = xxhash.xxh32_intdigest
            self.values = np.fromiter(map(low, words), dtype=np.uint32, count=len(words))
        else:
            self.data, self.start = text, None
            self.values = _BYTES[np.frombuffer(text, dtype=np.uint8)]
        self.n = len(self.values)

    def cut(self, a: int, b: int) -> bytes:
        if self.start is None:
            return self.data[a:b]
        return self.data[self.start[a] : self.end[b - 1]] if b > a else b""


_BYTES = byte_values()


def anchored(units: Units, shape: Shape) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Selected positions, their 64-bit hashes, and for each window its selected position's index.

    The last array is empty for texts shorter than a window.
    """
    n, step = units.n, PIECE
    if n < shape.window:
        return np.zeros(0, dtype=np.int64), [], np.zeros(0, dtype=np.int64)
    if n <= step + shape.window:
        hashes = rolling(units.values, shape.k)
        least, at = select(hashes, shape.width, np.ones(len(hashes) - shape.width + 1, dtype=np.uint32))
        picked = hashes[at]
    else:
        mins, ats, vals = [], [], []
        for a in range(0, n - shape.window + 1, step):
            hashes = rolling(units.values[a : a + step + shape.window - 1], shape.k)
            least, at = select(hashes, shape.width, np.ones(len(hashes) - shape.width + 1, dtype=np.uint32))
            mins.append(least)
            ats.append(at + a)
            vals.append(hashes[at])
        least, at = np.concatenate(mins), np.concatenate(ats)
        at, first = np.unique(at, return_index=True)
        picked = np.concatenate(vals)[first]
    # the window's own anchor: the first selected position in it that has the window's minimum
    starts = np.arange(len(least))
    own = np.searchsorted(at, starts)
    wrong = np.flatnonzero(picked[np.minimum(own, len(at) - 1)] != least)
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[picked[own[wrong]] != least[wrong]]
    digest = xxhash.xxh64_intdigest
    return at, [digest(units.cut(p, p + shape.k)) for p in at.tolist()], own


def _profile(shape: Shape) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, shas, prints, twice = [], [], [], []
        for text in utf8(batch.column(2)):
            units = Units(text, shape)
            _, hashes, _ = anchored(units, shape)
            values, counts = np.unique(np.array(hashes, dtype=np.uint64), return_counts=True)
            sizes.append(units.n)
            shas.append(hashlib.sha256(units.data).digest())
            prints.append(values.view(np.int64))
            twice.append(values[counts > 1].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(shas, pa.binary()),
                pa.array(prints, pa.list_(pa.int64())),
                pa.array(twice, pa.list_(pa.int64())),
            ],
            names=["doc_id", "dg", "n", "sha", "prints", "twice"],
        )

    return run


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, dg, text)``; null texts are empty."""
    text = text_or_empty(text_col)
    dg = F.expr("substring(unhex(sha2(text, 256)), 1, 16)")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", dg.alias("dg"), "text")


def profile(docs: DataFrame, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    """Scratch table ``(doc_id, dg, n, sha, prints, twice)``: units, digest of all units, fingerprints.

    ``twice`` lists the fingerprints that stand at several places of the text.
    """
    schema = "doc_id long, dg binary, n long, sha binary, prints array<long>, twice array<long>"
    return materialize(map_arrow(keyed_texts(docs, id_col, text_col), _profile(shape), schema), "profile")


def as_run(profiles: DataFrame) -> DataFrame:
    """Run rows ``(print, lo, hi, n)`` of a batch of texts: smallest and largest text holding it.

    n is 2 if a text holds the fingerprint twice. Copies of a text count once: its windows are
    settled by the copy itself.
    """
    once = profiles.select("dg", F.explode("prints").alias("print"), F.lit(1).alias("n"))
    twice = profiles.select("dg", F.explode("twice").alias("print"), F.lit(2).alias("n"))
    return merge_runs(once.union(twice).select("print", F.col("dg").alias("lo"), F.col("dg").alias("hi"), "n"))


def merge_runs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("print").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))


def repeated(runs: DataFrame) -> DataFrame:
    """Fingerprints of merged runs that stand at more than one place."""
    return runs.where("n > 1 or lo <> hi").select("print")


def candidates(docs: DataFrame, profiles: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Scratch table ``(dg, text, prints)``: one row per text with repeated fingerprints, and those."""
    unique = profiles.groupBy("dg").agg(F.max("doc_id").alias("rep"))
    hits = (
        profiles.select("dg", F.explode("prints").alias("print"))
        .join(prints, "print")
        .groupBy("dg")
        .agg(F.collect_set("print").alias("prints"))
    )
    chosen = materialize(hits.join(unique, "dg"), "chosen").withColumnRenamed("dg", "cdg")
    texts = keyed_texts(docs, id_col, text_col)
    found = texts.join(chosen, (F.col("dg") == F.col("cdg")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return materialize(found.select("dg", "text", "prints"), "candidates")


_BLOCK_ROWS = "dg binary, key long, snip long, a long, b long, first long, last long"


def _blocks(shape: Shape, by_print: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Blocks of a text: core key, content hash, and the units a to b that the block spans.

    Of the window starts whose fingerprint is listed, or of those in the listed ranges.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dgs, keys, snips, lows, highs, firsts, lasts = [], [], [], [], [], [], []
        digest = xxhash.xxh64_intdigest
        wanted = batch.column(2).to_pylist()
        for dg, text, want in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), wanted):
            units = Units(text, shape)
            at, hashes, own = anchored(units, shape)
            if by_print:
                hit = np.isin(np.array(hashes, dtype=np.uint64).view(np.int64), np.array(want, dtype=np.int64))
                live = np.flatnonzero(hit[own])
            else:
                ranges = [np.arange(r["first"], r["last"] + 1) for r in want]
                live = np.unique(np.concatenate(ranges)) if ranges else np.zeros(0, dtype=np.int64)
            if not len(live):
                continue
            place = at[own[live]]
            block = (place - live) // shape.group
            edge = np.flatnonzero(np.diff(own[live]) | np.diff(block)) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(live)]]) - 1
            for i, j in zip(first.tolist(), last.tolist()):
                p, g = int(place[i]), int(block[i])
                high = p - g * shape.group  # last start of the block
                low = max(high - shape.group + 1, p + shape.k - shape.window)
                a, b = max(low, 0), min(high + shape.window, units.n)
                core = units.cut(high, low + shape.window)
                dgs.append(dg)
                keys.append(digest(core, g + 1))
                snips.append(digest(b"%d:%d:" % (high - a, b - high) + units.cut(a, b)))
                lows.append(a)
                highs.append(b)
                firsts.append(int(live[i]))
                lasts.append(int(live[j]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(dgs, pa.binary()),
                pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(snips, dtype=np.uint64).view(np.int64)),
                *(pa.array(x, pa.int64()) for x in (lows, highs, firsts, lasts)),
            ],
            names=["dg", "key", "snip", "a", "b", "first", "last"],
        )

    return run


def _judge(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled spans and mixed blocks of block rows.

    A block that equals another block of its core repeats as a whole. One of each such set, and the
    blocks that equal no other, are mixed: single windows of them may still repeat.
    """
    rows = materialize(rows.withColumn("place", F.xxhash64("dg", "a")), "blocks")
    snips = rows.groupBy("key", "snip").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first_place"))
    kinds = snips.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("places")).where("places > 1")
    verdict = materialize(snips.join(kinds, "key").select("key", "snip", "c", "first_place", "kinds"), "verdicts")
    judged = materialize(rows.join(verdict, ["key", "snip"]), "judged")
    mixed = judged.where("kinds > 1 and (c = 1 or place = first_place)")
    return judged.where("c > 1").select("dg", "a", "b"), mixed.select("dg", "key", "a", "b", "first", "last", "kinds")


def refine(cands: DataFrame, mixed: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Cut mixed blocks into those of a finer shape, and judge them again."""
    todo = mixed.groupBy("dg").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"))
    todo = cands.select("dg", "text").join(todo, "dg").select("dg", "text", "r")
    return _judge(map_arrow(todo, _blocks(shape, by_print=False), _BLOCK_ROWS))


def blocks(cands: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Scratch tables of blocks whose core repeats: settled spans ``(dg, a, b)``, and mixed blocks.

    Mixed blocks are ``(dg, key, a, b, first, last, kinds)``; first and last are the window
    starts that the block's anchor stands for, kinds the number of contents with that core.
    """
    return _judge(map_arrow(cands, _blocks(shape, by_print=True), _BLOCK_ROWS))


def exact_windows(cands: DataFrame, mixed: DataFrame, shape: Shape) -> DataFrame:
    """Spans ``(dg, a, b)`` of the windows of mixed blocks that repeat, by 128-bit hashes of them.

    Every window belongs to one anchor and so is hashed once; equal windows all lie in mixed
    blocks of one core. Rows per hash are counted map-side first, so a common window is one row a
    task.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dgs, hashes, starts = [], [], []
        digest = xxhash.xxh3_128_digest
        for dg, text, firsts, lasts in zip(
            batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ):
            units = Units(text, shape)
            own = [s for i, j in zip(firsts, lasts) for s in range(i, j + 1)]
            dgs += [dg] * len(own)
            starts += own
            hashes += [digest(units.cut(s, s + shape.window)) for s in own]
        return pa.RecordBatch.from_arrays(
            [pa.array(dgs, pa.binary()), pa.array(starts, pa.int64()), pa.array(hashes, pa.binary())], names=["dg", "a", "h"]
        )

    todo = mixed.groupBy("dg").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"))
    todo = cands.select("dg", "text").join(todo, "dg").select("dg", "text", "r.first", "r.last")
    rows = materialize(map_arrow(todo, run, "dg binary, a long, h binary"), "windows")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    return materialize(rows.join(often, "h").select("dg", "a", (F.col("a") + shape.window).alias("b")), "window-spans")


def _cut_out(shape: Shape) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, shas = [], [], []
        for text, starts, ends in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            units = Units(text, shape)
            delta = np.zeros(units.n + 1, dtype=np.int64)
            np.add.at(delta, np.array(starts, dtype=np.int64), 1)
            np.add.at(delta, np.array(ends, dtype=np.int64), -1)
            gone = np.cumsum(delta[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            removed.append(int(gone.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            cuts = [0, *edges.tolist(), units.n]
            kept = [units.cut(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if b > a]
            shas.append(hashlib.sha256((b" " if shape.words else b"").join(kept)).digest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(shas, pa.binary())],
            names=["dg", "n_removed", "spans", "kept_sha"],
        )

    return run


def settle(profiles: DataFrame, cands: DataFrame, spans: DataFrame, shape: Shape) -> DataFrame:
    """Per input row ``doc_id, n, n_removed, spans, kept_sha`` from the repeated spans.

    A text with a copy loses everything if it is as long as a window, else nothing.
    """
    copies = profiles.groupBy("dg").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("dg")
    per_text = spans.groupBy("dg").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    cut = map_arrow(
        cands.select("dg", "text").join(per_text, "dg").select("dg", "text", "starts", "ends"),
        _cut_out(shape),
        "dg binary, n_removed long, spans array<struct<start:long,end:long>>, kept_sha binary",
    )
    cut = cut.join(copies, "dg", "left_anti")
    whole = copies.select(
        "dg",
        F.lit(None).cast("long").alias("n_removed"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
        F.lit(None).cast("binary").alias("kept_sha"),
    )
    verdicts = materialize(cut.withColumn("copied", F.lit(False)).unionByName(whole.withColumn("copied", F.lit(True))), "cut")
    out = profiles.select("doc_id", "dg", "n", "sha").join(verdicts, "dg", "left")
    all_gone = F.coalesce("copied", F.lit(False)) & (F.col("n") >= shape.window)
    none_gone = F.col("n_removed").isNull()
    return out.select(
        "doc_id",
        "n",
        F.when(all_gone, F.col("n")).when(none_gone, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(all_gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))))
        .when(none_gone, F.expr("cast(array() as array<struct<start:long,end:long>>)"))
        .otherwise(F.col("spans"))
        .alias("spans"),
        F.when(all_gone, F.expr("unhex(sha2('', 256))")).when(none_gone, F.col("sha")).otherwise(F.col("kept_sha")).alias("kept_sha"),
    )
