"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at distance r or less share a string at distance r/2 or less from both. So every
distinct fingerprint emits all its variants within half the radius and the shuffle is on the
variant. A bucket holds only fingerprints within r/2 of its variant; they are pairwise within r,
hence linking each member to the smallest one loses no connection and never lists all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.common import map_arrow, materialize, utf8
from tidemark.llm.components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash, unsigned, of a text's word shingles, repeats included."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())]
    ones = np.zeros(BITS, dtype=np.int64)
    step = 1 << 16  # bounds the unpacked bits of very long texts
    for k in range(0, len(hashes), step):
        part = np.array(hashes[k : k + step], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint as a signed long; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, fp long")


def ball_masks(radius: int) -> list[int]:
    """Signed 64-bit masks of every bit set up to half the radius."""
    if radius < 0 or radius % 2 or radius > 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(BITS), k)]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct verified links (u, v) between distinct fingerprints ``fp`` of ``nodes``.

    The links span the same components as all pairs within the radius.
    """
    masks = F.array(*[F.lit(m) for m in ball_masks(radius)])
    variants = nodes.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.select("fp", least.alias("least")).where("fp <> least")
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius)
    return pairs.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; a component's
    id is its smallest doc_id. Texts without words (null, empty, white space) have fingerprint
    zero and are linked like any other. Rows with a null id take part and get their component's
    id, which is null only if no member has one. Repeated rows come out as often as they went
    in; an empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["u"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Texts whose sets of word shingles have at least the Jaccard similarity are linked; texts without
    words are linked to each other. Candidates come by SimHash and balls of half the radius, as in ``links``, but from many
    short fingerprints: at similarity 0.8 ten of 64 bits differ, and a ball of half that has eight million
    variants, while two of some 28 bits suffice in one table of several (``balls.meetings``). The texts decide
    (``minhash.links``). All columns are kept. Rows with a null id take part, cannot be named a
    representative, and stay. Repeated rows of a staying id stay.
    """
    prints = materialize(minhash.sketches(docs, id_col, text_col, shingle), "sketches")
    nodes = prints.groupBy("key").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(minhash.links(prints, shingle, similarity))
    rooted = nodes.join(roots, nodes["key"] == roots["u"], "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = rooted.join(named, "root").select("key", "component_id")
    gone = prints.select("doc_id", "key").join(names, "key").where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
