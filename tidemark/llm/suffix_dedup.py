"""Repeated byte strings, settled by run-length indexes over small blocks.

``repeats`` narrows all texts down to blocks that share a core of some 270 bytes but differ
elsewhere. The segments of a core go to one task, where a run-length index over them marks every
match of the full length. A core with more than ``MAX_KINDS`` contents could not be held by one task:
its blocks are cut finer and judged again, so it falls apart into longer cores, until each is small enough
for an index. The finest core is a whole window.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize, utf8
from tidemark.llm.repeats import Shape, as_run, blocks, candidates, profile, refine, repeated, settle
from tidemark.llm.rindex import GROUPS, RunLengthIndex

MAX_KINDS = 2000
#: Segment bytes that one task takes, on average, and that one index is built over.
BUCKET_BYTES = 4 << 20
INDEX_BYTES = 1 << 20


def _segments(cands: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(key, dg, a, segment)``; overlapping blocks of one core in one text become one segment.

    So no byte of a text is twice among the segments of a core, and each match is a real repeat.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, dgs, starts, parts = [], [], [], []
        for dg, text, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for x in own:  # sorted by key and start
                if merged and merged[-1][0] == x["key"] and x["a"] < merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], x["b"])
                else:
                    merged.append([x["key"], x["a"], x["b"]])
            for key, a, b in merged:
                keys.append(key)
                dgs.append(dg)
                starts.append(a)
                parts.append(text[a:b])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(dgs, pa.binary()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
            names=["key", "dg", "a", "segment"],
        )

    todo = mixed.groupBy("dg").agg(F.sort_array(F.collect_list(F.struct("key", "a", "b"))).alias("own"))
    rows = cands.select("dg", "text").join(todo, "dg").select("dg", "text", "own")
    return map_arrow(rows, run, "key long, dg binary, a long, segment binary")


def _index_spans(window: int):
    """Spans of one bucket's segments: indexes over groups of cores, at most INDEX_BYTES each."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        dgs, starts, parts = (table.column(c).to_pylist() for c in ("dg", "a", "segment"))
        out_dg, out_a, out_b = [], [], []

        def flush(places: dict[tuple[int, bytes], list[int]]) -> None:
            names = list(places)
            spans: list[list[tuple[int, int]]] = [[] for _ in names]
            for i, name in enumerate(names):  # equal segments at several places repeat as a whole
                if len(places[name]) > 1:
                    spans[i].append((0, len(name[1])))
            index = RunLengthIndex([x for _, x in names], [g for g, _ in names], window)
            for i, a, b in index.repeats(window):
                spans[i].append((a, b))
            for name, found in zip(names, spans):
                for a, b in set(found):
                    for row in places[name]:
                        out_dg.append(dgs[row])
                        out_a.append(starts[row] + a)
                        out_b.append(starts[row] + b)

        places: dict[tuple[int, bytes], list[int]] = {}
        size, group, last = 0, 0, None
        for row in np.argsort(keys, kind="stable").tolist():
            if keys[row] != last:
                if last is not None and (size >= INDEX_BYTES or group + 1 >= GROUPS):
                    flush(places)
                    places, size, group = {}, 0, -1
                group, last = group + (last is not None), keys[row]
            name = (group, parts[row])
            if name not in places:
                size += len(parts[row])
            places.setdefault(name, []).append(row)
        if places:
            flush(places)
        return pa.table({"dg": pa.array(out_dg, pa.binary()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """Per input row ``doc_id, n, n_removed, spans, kept_sha`` over the UTF-8 bytes of whole texts.

    A byte goes if a string of ``window`` bytes covering it also starts anywhere else, in this text
    or another; strings are judged on the input and overlaps count. spans are the removed byte
    ranges, kept_sha the SHA-256 of the rest. Null texts are empty; texts shorter than the window
    lose nothing. Rows with a null or repeated id count as documents of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    shape = Shape(window, max(1, min(32, window // 4)), max(1, window // 3))
    profiles = profile(docs, shape, id_col, text_col)
    prints = materialize(repeated(as_run(profiles)), "prints")
    cands = candidates(docs, profiles, prints, id_col, text_col)
    same, mixed = blocks(cands, shape)
    settled, parts = same, []
    while True:
        parts.append(_segments(cands, mixed.where(F.col("kinds") <= MAX_KINDS)))
        hot = mixed.where(F.col("kinds") > MAX_KINDS)
        if not hot.limit(1).count():
            break
        shape = replace(shape, group=max(1, shape.group // 8))
        same, mixed = refine(cands, hot, shape)
        settled = settled.union(same)
    segments = materialize(reduce(DataFrame.union, parts), "segments")
    total = segments.agg(F.sum(F.length("segment"))).first()[0] or 0
    buckets = max(1, int(total // BUCKET_BYTES))
    bucketed = segments.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    spans = bucketed.groupBy("bucket").applyInArrow(_index_spans(window), "dg binary, a long, b long")
    spans = materialize(settled.union(spans), "spans")
    return settle(profiles, cands, spans, shape)
