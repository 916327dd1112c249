"""Exact deduplication with a heavy-hitter split.

A Misra-Gries sketch (Spark's ``approx_top_k``, the DataSketches frequent-items summary)
finds digests that may be frequent. One exact count over those few digests gives their
winners, which are broadcast, so the rows of hot groups are answered map-side and never meet
in a task. All other digests go through an ordinary shuffle, where no group can exceed the
sketch's error, a small fixed share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

#: Counters of the sketch: any digest above about 3.5 / SKETCH_ITEMS of the rows is found.
SKETCH_ITEMS = 4096
#: Winners that are broadcast, at most; each is one digest, one id and one count (< 100 bytes).
HEAVY_HITTERS = 1024


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are identical (compared by SHA-256); a null text
    counts as empty. The largest id of a group stays. Rows with a null id belong to their
    group's size and stay only if the whole group has no id (``keep_id`` is then null).
    Repeated rows of the winning id all count as that document and are kept. An empty table
    gives an empty result; other columns of the input are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
    )
    rows = materialize(rows, "digests")
    sketch = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {HEAVY_HITTERS}, {SKETCH_ITEMS})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"))
    winners = (
        rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("key"), "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    winners = materialize(winners, "winners").withColumn("heavy", F.lit(True))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("heavy").select("doc_id", "digest", "keep_id", "group_size")
    group = Window.partitionBy("digest")
    rest = marked.where("heavy is null").select(
        "doc_id",
        "digest",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
