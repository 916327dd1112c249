"""Links of near copies by word-shingle similarity: SimHash balls propose pairs, the texts decide.

``balls.meetings`` has the buckets where texts meet; only a bucket's texts are compared. First each is compared with
the few it meets most; then with those of its buckets that are not yet of its component. These pairs are listed
one by one, but not those within a large group, which are as many as the square of its size even if few of them are
links: a group's texts are dealt into pieces and compared piece by piece, so what is sent of a text is a row a piece.
No link of a bucket is lost. Listed pairs whose whole SimHash is too far apart for the similarity met by chance and
are not looked up. (The module is named after its former candidates, by which the tests import it.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.balls import bit_chance, far_bits, meetings, simhash_words, table_width
from tidemark.llm.common import map_arrow, materialize, utf8
from tidemark.llm.components import connected_components

#: Texts of a zone that are compared by one task with as many others.
PIECE = 512
#: Members up to which the pairs of a bucket are listed, and partners up to which those of a text are.
SMALL, MANY = 16, 64
#: Partners that each text is compared with first.
BEST = 3


def shingles(text: bytes, width: int) -> set[bytes]:
    """Word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def sketch(own: set[bytes]) -> tuple[bytes, np.ndarray]:
    """A digest of the set, and its long SimHash (none if it is empty)."""
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own)))
    key = xxhash.xxh3_128_digest(hashes.tobytes())
    return key, simhash_words(hashes) if len(own) else np.zeros(0, dtype=np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(doc_id, text, key, size, bits)``; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, bits = [], [], []
        for text in utf8(batch.column(1)):
            own = shingles(text, width)
            key, word = sketch(own)
            keys.append(key)
            sizes.append(len(own))
            bits.append(word)
        columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "key", "size", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, text string, key binary, size long, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose texts have at least the Jaccard similarity, counted exactly."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, held, keep = None, set(), []
        for v, a, b in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3))):
            if v != last:
                last, held = v, shingles(b, width)
            own = shingles(a, width)
            both = len(own & held)
            keep.append(both >= similarity * (len(own) + len(held) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("a")), "u")
    rows = rows.join(texts.select(F.col("key").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    return map_arrow(rows, run, "u binary, v binary")


def _compare(block: list[tuple], width: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that span those of a block's pairs that share a bucket and are neither of one root nor of one piece (of two)."""
    sets, roots = [shingles(row[3], width) for row in block], {}
    diagonal, held, out = block[0][0][1] == block[0][0][2], {}, []

    def top(x):
        while (up := roots.get(x, x)) != x:
            roots[x] = x = roots.get(up, up)
        return x

    for i, (_, key, root, _, buckets, piece) in enumerate(block):
        own, near = sets[i], set()
        for b in buckets:
            near.update(held.get(b, ()))
            held.setdefault(b, []).append(i)
        for j in near:
            other = sets[j]
            small, large = sorted((len(own), len(other)))
            if (not diagonal and block[j][5] == piece) or small < similarity * large or (here := top(root)) == (there := top(block[j][2])):
                continue
            both = len(own & other)
            if both >= similarity * (small + large - both):
                roots[here] = there
                out.append((max(key, block[j][1]), min(key, block[j][1])))
    return out


def across(own: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Verified links that span those between different roots in a bucket and a zone, of ``own`` (key, root, zone, buckets).

    A zone's keys are dealt into pieces, and each two pieces are a block that one task compares, so a large zone is
    many blocks and a text is sent once a piece, not once a pair.
    """
    pieces = own.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("g"))
    rows = own.join(texts, "key").join(pieces, "zone").withColumn("piece", F.expr("pmod(xxhash64(key), g)"))
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0L, g - 1)")))
    rows = rows.select("zone", F.least("piece", "j").alias("a"), F.greatest("piece", "j").alias("b"), "key", "root", "text", "buckets", "piece")

    def run(batches):
        block: list[tuple] = []

        def links_of(block):
            found = _compare(block, width, similarity) if len(block) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for zone, a, b, key, root, text, buckets, piece in zip(*columns):
                at = (zone, a, b)
                if block and block[0][0] != at:
                    yield links_of(block)
                    block = []
                block.append((at, key, root, (text or "").encode(), buckets, piece))
        if block:
            yield links_of(block)

    n = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.repartition(n, "zone", "a", "b").sortWithinPartitions("zone", "a", "b")
    return blocks.mapInArrow(run, "u binary, v binary").distinct()


def close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Keys (u, v) of the ``pairs`` of nodes that sizes and the whole SimHash do not rule out."""
    far = far_bits(bit_chance(similarity))
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("key", "size", "bits")]), side)
    distance = F.expr("aggregate(zip_with(bits_u, bits_v, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    pairs = pairs.where(f"least(size_u, size_v) >= {similarity}D * greatest(size_u, size_v)").where(distance <= far)
    return pairs.select(F.greatest("key_u", "key_v").alias("u"), F.least("key_u", "key_v").alias("v"))


def texts_of(prints: DataFrame, keys: DataFrame) -> DataFrame:
    """One text of each of the ``keys``."""
    own = prints.select("key", "text").join(keys.distinct(), "key", "left_semi")
    return materialize(own.groupBy("key").agg(F.min("text").alias("text")), "texts")


def partners(members: DataFrame, total: int) -> DataFrame:
    """``(node, heavy, best)``: whether a text has many partners, and the few it meets most, in two tables at least.

    Texts that meet by chance do so in one table only.
    """
    table = F.shiftright("bucket", table_width(total))
    star = members.where("node <> centre").groupBy("node", "centre")
    star = star.agg(F.count(F.lit(1)).alias("times"), (F.min(table) != F.max(table)).alias("twice"), F.max("n").alias("n"))
    sides = [star.select(F.col(a).alias("node"), F.col(b).alias("other"), "times", "twice", "n") for a, b in (("node", "centre"), ("centre", "node"))]
    heavy = (F.count(F.lit(1)) > MANY) | (F.max("n") > SMALL)
    ranked = F.when(F.col("twice"), F.struct((-F.col("times")).alias("times"), F.xxhash64("node", "other").alias("mix"), "other"))
    best = F.slice(F.sort_array(F.collect_list(ranked)), 1, BEST)["other"]
    return materialize(sides[0].union(sides[1]).groupBy("node").agg(heavy.alias("heavy"), best.alias("best")), "partners")


def listed(labelled: DataFrame) -> DataFrame:
    """Pairs (u, v) of different roots in the small buckets of ``labelled``, but for two heavy ones of a zone."""
    member = F.struct("node", "root", F.expr("if(heavy, zone, null)").alias("zone"))
    groups = labelled.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list(member).alias("own"))
    others = "filter(own, y -> y.node > x.node and y.root <> x.root and not coalesce(x.zone = y.zone, false))"
    pairs = F.expr(f"flatten(transform(own, x -> transform({others}, y -> struct(y.node as u, x.node as v))))")
    return groups.select(F.explode(pairs).alias("pair")).select("pair.u", "pair.v").distinct()


def zoned(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, root, zone, buckets)`` of the heavy texts in buckets of several roots; zones that share a large bucket are one."""
    bucket = Window.partitionBy("bucket")
    rows = labelled.where("heavy").withColumn("a", F.min("root").over(bucket)).withColumn("b", F.max("root").over(bucket)).where("a <> b")
    own = rows.groupBy("node").agg(F.min("root").alias("root"), F.min("zone").alias("zone"), F.collect_set("bucket").alias("buckets"))
    shared = labelled.where(F.col("n") > SMALL).groupBy("bucket").agg(F.collect_set("zone").alias("zones")).where("size(zones) > 1")
    merged = connected_components(shared.select(F.explode("zones").alias("u"), F.col("zones")[0].alias("v")))
    own = own.join(merged.select(F.col("u").alias("zone"), F.col("root").alias("whole")), "zone", "left")
    own = own.join(nodes.select("node", "key"), "node").select("key", "root", F.coalesce("whole", "zone").alias("zone"), "buckets")
    return materialize(own, "zoned")


def links(prints: DataFrame, width: int, similarity: float) -> DataFrame:
    """Verified links (u, v) between keys; they span the components of all pairs that meet in a bucket."""
    nodes = prints.where("size > 0").groupBy("key").agg(F.min("size").alias("size"), F.first("bits").alias("bits"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("key")), "nodes")
    total = nodes.count()
    members = meetings(nodes, total, similarity)
    met = partners(members, total)
    pairs = met.select("node", F.explode("best").alias("other")).select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
    pairs = materialize(pairs.distinct(), "pairs")
    near = materialize(close(pairs, nodes, similarity), "near")
    found = materialize(verified(near, texts_of(prints, near.select(F.col("u").alias("key")).union(near.select("v"))), width, similarity), "links")
    roots = connected_components(found).withColumnRenamed("u", "key")
    zones = connected_components(pairs).select(F.col("u").alias("node"), F.col("root").alias("zone"))
    labels = nodes.select("node", "key").join(met.select("node", "heavy"), "node").join(roots, "key", "left").join(zones, "node", "left")
    labels = labels.select("node", "heavy", F.xxhash64(F.coalesce("root", "key")).alias("root"), F.coalesce("zone", "node").alias("zone"))
    labelled = materialize(members.select("bucket", "n", "node").join(labels, "node"), "labelled")
    near = materialize(close(listed(labelled), nodes, similarity), "near")
    own = zoned(labelled, nodes)
    texts = texts_of(prints, own.select("key").union(near.select("u")).union(near.select("v")))
    few = materialize(verified(near, texts, width, similarity), "links")
    return found.union(few).union(materialize(across(own, texts, width, similarity), "links"))
