"""Repeated word windows by a log-structured fingerprint index.

The index is a folder of immutable runs, each a table bucketed and sorted by window fingerprint, and numbered
manifests that list them. A new batch becomes a run and is merge-joined, bucket by bucket and without a shuffle,
with every earlier run to find the fingerprints that history already holds; when a level has ``FANOUT`` runs they are
merged into one of the next level. A window's fingerprint is the smallest k-gram hash in it, which neighbouring
windows share, so an index row stands for many windows. Fingerprint hits are only candidates; windows are verified by
128-bit hashes of their whole content.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shared_path
from tidemark.llm.repeats import Shape, as_run, blocks, candidates, exact_windows, merge_runs, profile, settle

FANOUT = 4
BATCHES = 5
_RUN = "print BIGINT, lo BINARY, hi BINARY, n INT"


class FingerprintIndex:
    """Runs of ``(print, lo, hi, n)`` by level. All state is files under ``path``, so an index can be opened again.

    A manifest is written after the runs that it lists, and runs that it no longer lists are deleted after it, so a
    job that dies leaves the last manifest's index whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, levels: list[list[str]], version: int):
        self.spark, self.path, self.buckets, self.levels, self.version = spark, path, buckets, levels, version

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int | None = None) -> FingerprintIndex:
        """An empty index; ``buckets`` is the number of files of a run, by default that of shuffle partitions."""
        return cls(spark, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its last manifest has it; raises if there is none."""
        last = spark.read.text(f"{path}/manifest-*").select("value", F.regexp_extract(F.col("_metadata.file_path"), "manifest-([0-9]+)", 1).alias("v"))
        held = json.loads(last.orderBy(F.desc("v")).first().value)
        index = cls(spark, path, held["buckets"], held["levels"], held["version"])
        known = {t.name for t in spark.catalog.listTables()}
        for name in (n for level in index.levels for n in level if n not in known):
            spark.sql(
                f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'"
            )
        return index

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def hits(self, name: str) -> DataFrame:
        """Fingerprints ``print`` of the run that stand at several places, in it or together with an earlier run."""
        batch = self.spark.table(name)
        found = batch.where("n > 1 or lo <> hi").select("print")
        for run in self.runs():
            found = found.union(batch.select("print").join(run.select("print").hint("merge"), "print", "left_semi"))
        return found

    def add(self, profiles: DataFrame) -> DataFrame:
        """Append a batch; returns the fingerprints ``print`` of it that repeat, here or in history."""
        name = self._write(as_run(profiles))
        found = materialize(self.hits(name).distinct(), "hits")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        old = []
        level = 0
        while len(self.levels[level]) >= FANOUT:
            old += self.levels[level]
            self._compact(level)
            level += 1
        self._save()
        for name in old:
            self._drop(name)
        return found

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next."""
        merged = None
        for name in self.levels[level]:
            run = self.spark.table(name)
            merged = run if merged is None else merged.union(run)
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(merge_runs(merged)))
        self.levels[level] = []

    def _save(self) -> None:
        self.version += 1
        text = json.dumps({"version": self.version, "buckets": self.buckets, "levels": self.levels})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def window_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8, batches: int = BATCHES
) -> DataFrame:
    """Per input row ``doc_id, n, n_removed, spans, kept_sha`` over words ``[^\\\\x20\\\\x09-\\\\x0D]+``.

    A word goes if a window of ``window`` words covering it also starts anywhere else, in this text
    or another; windows are judged on the input. spans are the removed word ranges, kept_sha the
    SHA-256 of the kept words joined by one space. The documents are fed to the index in
    ``batches``. Null, empty and short texts have no window and lose nothing. Rows with a null or
    repeated id count as documents of their own. An empty table gives an empty result; other
    columns are ignored.
    """
    shape = Shape(window, min(k, window), max(1, window // 4), words=True)
    profiles = profile(docs, shape, id_col, text_col)
    index = FingerprintIndex.create(docs.sparkSession, shared_path(docs.sparkSession, "prints"))
    hits = None
    for b in range(batches):
        found = index.add(profiles.where(F.pmod(F.xxhash64("dg"), F.lit(batches)) == b))
        hits = found if hits is None else hits.union(found)
    cands = candidates(docs, profiles, hits.distinct(), id_col, text_col)
    same, mixed = blocks(cands, shape)
    spans = same.union(exact_windows(cands, mixed, shape))
    return settle(profiles, cands, spans, shape)
