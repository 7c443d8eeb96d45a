"""Queries and oracle SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bitplane, brown, collocations, drake, exact_dedup, langid, matroska, oneperm, packing, quality, simhash, substring, wfst
from paperloom.llm.common import documents

WORDS = r"string_split_regex(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\x09-\x0D\x20]+')"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir)).drop("spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(documents(spark, sf_dir))


def op5_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.piece_digests(documents(spark, sf_dir))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.lm_scores(documents(spark, sf_dir))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_output(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneperm.edited_pairs(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_matroska": op4_matroska,
        "op5_piece_transducer": op5_piece_transducer,
        "op6_brown_lm": op6_brown_lm,
        "op7_token_ids": op7_token_ids,
        "op8_packing": op8_packing,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_drake_clusters": op11_drake_clusters,
        "op12_collocations": op12_collocations,
        "op13_one_permutation": op13_one_permutation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
            FROM d
        """,
        "op11_drake_clusters": drake.oracle_sql(),
        "op12_collocations": collocations.ORACLE_SQL,
    }
