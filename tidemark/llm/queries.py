"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.langid import identify_held_out
from tidemark.llm.mixing import mix_probabilities, mixing_sql
from tidemark.llm.quality import classify_quality
from tidemark.llm.simhash import fingerprint_hex, simhash_components
from tidemark.llm.substring_dedup import window_dedup
from tidemark.llm.suffix_dedup import substring_dedup
from tidemark.llm.token_output import read_tokens, write_tokens
from tidemark.llm.warc import arc_to_warc, pages_to_arc, read_warc

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), window=400).select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.lower(F.hex("kept_sha")).alias("kept_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return parts.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(read_table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", F.col("n").alias("n_words"), "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = arc_to_warc(pages_to_arc(read_table(spark, sf_dir, "pages"), version=2), min_payload=0)
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_probabilities(read_table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(read_table(spark, sf_dir, "documents"), pieces_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("score", F.round("score", 6))


#: Positions are cut to pieces of 256 first, as taking a substring costs its distance from the start.
SQL_OP2 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
     c AS (SELECT rid, base, substr(x, 2 * base + 1, 1310) AS y FROM (SELECT rid, x, unnest(range(0, (len(x) // 2 - 399)::BIGINT, 256)) AS base FROM d WHERE len(x) >= 800)),
     h AS (SELECT rid, base + j AS i, md5(substr(y, 2 * j + 1, 800)) AS s FROM (SELECT rid, base, y, unnest(range(0, least(256, (len(y) // 2 - 399)::BIGINT))) AS j FROM c)),
     r AS (SELECT rid, i FROM h WHERE s IN (SELECT s FROM h GROUP BY s HAVING count(*) > 1)),
     e AS (SELECT rid, i, coalesce(i > lag(i) OVER o + 400, true) AS new FROM r WINDOW o AS (PARTITION BY rid ORDER BY i)),
     g AS (SELECT rid, i, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM e),
     spans AS (SELECT rid, k, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY rid, k),
     cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS prev FROM spans),
     kept AS (SELECT rid, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS t, sum(b - a) AS n, count(*) AS c FROM cuts JOIN d USING (rid) GROUP BY rid)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(kept.n, 0)::BIGINT AS n_removed, coalesce(kept.c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.t, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

SQL_OP4 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     h AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
     gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM h WHERE s IN (SELECT s FROM h GROUP BY s HAVING count(*) > 1)),
     words AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
     kept AS (SELECT rid, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid),
     lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""

#: Base32 of a SHA-1 in hex: every five hex digits are four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
SQL_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

SQL_OP7 = mixing_sql()

SQL_OP9 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_output": op1_token_output,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_simhash": op3_simhash,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality": op5_quality,
        "op6_warc": op6_warc,
        "op7_mixing": op7_mixing,
        "op8_langid": op8_langid,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": SQL_OP2, "op4_substring_dedup": SQL_OP4, "op6_warc": SQL_OP6, "op7_mixing": SQL_OP7, "op9_exact_dedup": SQL_OP9}
