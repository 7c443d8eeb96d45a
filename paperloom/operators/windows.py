"""Ordered operators: timelines, islands, progress, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(events: DataFrame, by: list[str], ts: str, tie: str, end: Column) -> DataFrame:
    """Seconds from each event to the next of its group, or to ``end``; running where neither exists."""
    following = F.lead(ts).over(W.partitionBy(*by).orderBy(ts, tie))
    out = events.withColumn("next_ts", following)
    seconds = F.unix_timestamp(F.coalesce("next_ts", end)) - F.unix_timestamp(ts)
    return out.withColumn("seconds", F.greatest(seconds, F.lit(0))).withColumn("running", F.col("next_ts").isNull() & end.isNull()).drop("next_ts")


def islands(df: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a row for which ``starts`` holds opens a new one, as does a group's first row.

    ``starts`` may use lag and lead over the same window; Spark then sorts once for both.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_opens", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.first("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("_opens")


def largest_gap(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: the widest step between neighbours (first one of equals), where it is, and group sizes on both sides."""
    w = W.partitionBy(*by).orderBy(value)
    steps = df.withColumn("place", F.row_number().over(w)).withColumn("gap", F.lead(value).over(w) - F.col(value))
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("place", "gap"), F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col("place"))).alias("best")).select(
        *by, "n", F.col("best.place").alias("left_n"), (F.col("n") - F.col("best.place")).alias("right_n"), F.col("best.gap").alias("gap")
    )


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the running weight reaches half of the total."""
    per = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    w = W.partitionBy(*by)
    run = per.withColumn("run", F.sum("w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(w))
    return run.where(F.col("run") >= F.col("total") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def changed_progress(df: DataFrame, by: list[str], order: list, status: str, progress: str) -> DataFrame:
    """Rows at which (status, running maximum of progress) differs from the row before; groups' first rows stay."""
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumn("top", F.max(progress).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # Each group's rows are sorted once: both windows have the same specification.
    out = out.withColumn("was_top", F.lag("top").over(w)).withColumn("was_status", F.lag(status).over(w))
    first = F.col("was_top").isNull()
    return out.where(first | (F.col("was_top") != F.col("top")) | (F.col("was_status") != F.col(status))).drop("was_top", "was_status")


def failure_sessions(events: DataFrame, key: str, ts: str, gap: str, limit: int) -> DataFrame:
    """Sessions of inactivity windows: (key, start, n, limited). Works on batch and streaming tables alike."""
    got = events.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("start"), "n", (F.col("n") >= limit).alias("limited"))
