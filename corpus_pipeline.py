"""Corpus preparation: the stages in order, each written as Parquet and reread by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of
documents; the last writes token shards and returns one row per document from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.langid import fit_language_model, identify
from tidemark.llm.mixing import sample_mix
from tidemark.llm.queries import pieces_path, tokenizer_path
from tidemark.llm.simhash import near_dedup
from tidemark.llm.token_output import read_tokens, write_tokens

#: Posterior below which a text's language counts as not identified.
LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: no letter, or no language above LANGUAGE_SCORE.

    The model learns from the documents whose crc32(doc_id) mod 4 is not 2. Rows without an id
    cannot be named and stay.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = identify(docs, fit_language_model(docs.where(fold != 2), pieces_path()))
    rejected = found.where((F.col("lang_pred") == "und") | (F.col("score") < LANGUAGE_SCORE))
    rejected = rejected.select(F.col("doc_id").alias("__rejected_id")).distinct()
    return docs.join(rejected, docs["doc_id"] == rejected["__rejected_id"], "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return near_dedup(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the tempered mix of sources, languages and topics."""
    return sample_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; ``doc_id, start, n_tokens, ids_crc32`` per document, read back from them."""
    return read_tokens(write_tokens(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL has neither the language model nor the alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
