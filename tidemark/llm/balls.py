"""Candidates of near copies: SimHash tables met by ball hashing.

A text's long SimHash is cut into tables of ``width`` bits. In each table every fingerprint emits its
ball of half the radius, and fingerprints at distance RADIUS or less meet in a variant of both. Bits of two texts
differ with a chance that depends on the angle of their shingle sets only, so the number of tables
follows from the similarity and the loss that is allowed; the width follows from the number of texts, so that
chance meetings do not grow with it.

The shuffle is not on the variant but on its leading bits: of a ball only the variants that
change those are sent one by one, the others are made in the task that they all belong to.
"""

from __future__ import annotations

import gc
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize

#: 64-bit words of the long SimHash.
WORDS = 16
#: Bits by which fingerprints of one table that meet differ at most; the ball has half of it.
RADIUS = 2
#: Chance that a pair just as similar as asked for meets in no table.
LOSS = 0.001
#: Texts of fewer shingles have more tables, as ties make their bits differ more often: 0.1875 where 4 of 5 shingles are common.
SHORT, SHORT_CHANCE = 8, 0.1875
#: Shuffled rows a text in one pass, and rows of a task.
ROWS_PER_PASS, ROWS_PER_TASK = 84, 1_000_000
_STEPS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None, None]
_LANES = np.uint64(0x0101010101010101)


def simhash_words(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WORDS times 64 bits, each word of another mix of the 64-bit ``hashes``."""
    ones = np.zeros((8, WORDS, 8), dtype=np.int64)
    for k in range(0, len(hashes), 255):  # a byte counts up to 255
        x = hashes[k : k + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += ((x >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(8, WORDS, 8)
    bits = ones.transpose(1, 2, 0).reshape(WORDS * 64) * 2 > len(hashes)
    return np.packbits(bits, bitorder="little").view(np.int64)


def bit_chance(similarity: float) -> float:
    """Chance that a SimHash bit differs between sets of this Jaccard similarity, at their widest angle."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_width(total: int) -> int:
    """Bits of a table for this many texts: chance meetings of a text do not grow with them."""
    return max(20, total.bit_length() + 10)


def table_count(width: int, chance: float) -> int:
    """Tables until a pair whose bits differ with this chance meets but for LOSS."""
    meet = sum(math.comb(width, k) * chance**k * (1 - chance) ** (width - k) for k in range(RADIUS + 1))
    return 1 if meet == 1 else math.ceil(math.log(LOSS) / math.log1p(-meet))


def table_bits(width: int, tables: int) -> np.ndarray:
    """Bits of the long SimHash that each table has: all bits in drawn order, again and again."""
    draw, per = np.random.default_rng(42), WORDS * 64 // width
    rounds = [draw.permutation(WORDS * 64)[: per * width].reshape(per, width) for _ in range(-(-tables // per))]
    return np.concatenate(rounds)[:tables]


def far_bits(chance: float) -> int:
    """Bits of the long SimHash by which no two similar texts differ, with six deviations to spare."""
    bits, chance = WORDS * 64, max(chance, SHORT_CHANCE)
    return math.ceil(bits * chance + 6 * math.sqrt(bits * chance * (1 - chance)))


def _tables_of(bits: np.ndarray, first: int):
    tables, width = bits.shape
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    numbers = (np.arange(first, first + tables, dtype=np.int64) << np.int64(width))[None, :]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
        for row, own in zip(words, batch.column(1).to_pylist()):
            row[: len(own)] = own
        flat = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        out = numbers + flat[:, bits].astype(np.int64) @ weights
        lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "bases"])

    return run


def _meet(low: int):
    """Buckets of a partition with two members or more; the rows' masks change only bits from ``low`` on."""
    flips = np.concatenate([[0], np.int64(1) << np.arange(low, dtype=np.int64)]).astype(np.int64)

    def run(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        base, mask, node = (np.concatenate(x) for x in zip(*got))
        own = mask == 0
        bucket = np.concatenate([(base[own][:, None] ^ flips).ravel(), (base ^ mask)[~own]])
        at = np.concatenate([np.repeat(np.flatnonzero(own), len(flips)), np.flatnonzero(~own)])
        order = np.argsort(bucket)
        bucket, at = bucket[order], at[order]
        edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(bucket)))
        prints = base[at]
        # equal fingerprints meet in all their variants: one, the fingerprint itself, is enough
        mixed = np.minimum.reduceat(prints, first) != np.maximum.reduceat(prints, first)
        keep = np.repeat((count > 1) & (mixed | (prints[first] == bucket[first])), count)
        bucket, node = bucket[keep], node[at[keep]]
        if not len(bucket):
            return
        mix = (bucket ^ node).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((node, mix ^ (mix >> np.uint64(29)), bucket))
        bucket, node = bucket[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        count = np.diff(np.append(first, len(bucket)))
        out = pa.table({"bucket": bucket, "node": node, "centre": np.repeat(node[first], count), "n": np.repeat(count, count).astype(np.int64)})
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def meetings(nodes: DataFrame, total: int, similarity: float) -> DataFrame:
    """``(bucket, node, centre, n)``: variants where two or more of ``nodes`` (node, size, bits) meet.

    centre is one of the n members of a bucket, another in each; the bits of bucket above ``table_width`` number its
    table. ``total`` is about the number of nodes. Passes over
    some tables each bound the shuffle files, which go before the next pass.
    """
    spark = nodes.sparkSession
    width = table_width(total)
    usual = table_count(width, bit_chance(similarity))
    most = max(usual, table_count(width, SHORT_CHANCE))
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(parts, total * ROWS_PER_PASS // ROWS_PER_TASK)
    lead = min(width - 1, max(6, parts.bit_length()))
    step = max(1, ROWS_PER_PASS // (1 + lead))
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width - lead, width)])
    cuts, out = [*range(0, usual, step), usual, most], []
    bits = table_bits(width, most)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        some = nodes if a < usual else nodes.where(F.col("size") < SHORT)
        bases = map_arrow(some.select("node", "bits"), _tables_of(bits[a:b], a), "node long, bases array<long>")
        rows = bases.select("node", F.explode("bases").alias("base")).select("node", "base", F.explode(masks).alias("mask"))
        shard = F.shiftright(F.col("base").bitwiseXOR(F.col("mask")), width - lead)
        dealt = rows.select("base", "mask", "node", shard.alias("shard")).repartition(parts, "shard").select("base", "mask", "node")
        found = dealt.mapInArrow(_meet(width - lead), "bucket long, node long, centre long, n long")
        out.append(materialize(found, "meetings"))
        del bases, rows, dealt, found
        gc.collect()
        spark._jvm.System.gc()  # else the pass's shuffle files stay until the driver happens to collect its garbage
    return reduce(DataFrame.union, out)
