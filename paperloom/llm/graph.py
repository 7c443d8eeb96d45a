"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh_path, remove


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free hash sum; equal marks mean that nothing moved."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u long, v long) -> (node, root): root is the smallest node that is reachable.

    Only nodes with an edge to another node are returned. Null ends are ignored,
    as are repeats and loops. The minimum of each neighbourhood is an aggregate
    that combines before its shuffle and is joined back, so a node with very many
    neighbours never meets them in one task as a window would. Rounds grow with
    the logarithm of the longest path; each is written to the shared folder.
    """
    spark = edges.sparkSession
    edge = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = fresh_path(spark, "edges")
    edge.write.parquet(path)
    now = spark.read.schema("u long, v long").parquet(path)
    before = _mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, path = path, fresh_path(spark, "edges")
        small.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        after = _mark(now)
        remove(spark, last)
        gc.collect()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
