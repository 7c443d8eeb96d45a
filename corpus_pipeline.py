"""A corpus pipeline: what stays of ``documents``, packed into training sequences.

Each stage takes the rows that its predecessor kept and applies one operator of
``paperloom.llm`` with its production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, packing, quality, similar, substring
from paperloom.llm.common import cut_at, documents, remove


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.without_rejects(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the one with the largest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, the one with the smallest id: five-word shingles with a similarity of 0.8 or more, by SimHash and what it can't reach."""
    return similar.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that stand in a window of an earlier one; n_chars follows the text."""
    out = substring.without_duplicates(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents are a table in the shared folder, which goes once the next one is there."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = cut_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
