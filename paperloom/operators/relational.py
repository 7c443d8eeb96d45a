"""Operational queries: predicates, joins, paging, counting, settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered table. ``order`` must end with a unique key, or page contents are undefined."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset is 0 or more, limit 1 to 100")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_summary(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """total, page size and has_more of a page, from one aggregate."""
    got = F.least(F.greatest(F.col("total") - offset, F.lit(0)), F.lit(limit))
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", got.alias("items"), (offset + got < F.col("total")).alias("has_more"))


def visible_to(df: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """Row-level security: an admin sees all rows, anyone else their own."""
    return df if is_admin else df.where(F.col("created_by") == user_id)


def recoverable(jobs: DataFrame, now: Column) -> DataFrame:
    """Unfinished jobs that nobody holds: queued, never leased, or with a lease that ran out."""
    running = F.col("status").isin("queued", "parsing", "ocr_running", "translating", "rebuilding", "validating")
    return jobs.where(running & ((F.col("status") == "queued") | F.col("lease_until").isNull() | (F.col("lease_until") < now)))


def latest_duplicate(files: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """For each live input file that shares ``key`` with another one: the newest other file.

    The two newest of each key are enough to answer for every member, so the
    group is aggregated and never paired with itself.
    """
    live = files.where((F.col("kind") == "input") & ~F.col("deleted")).withColumn("dup_key", key)
    best = live.groupBy("dup_key").agg(F.max_by(F.struct(*order), F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = live.join(best, "dup_key")
    second = rest.where(F.struct(*order) != F.col("first")).groupBy("dup_key").agg(F.max(F.struct(*order)).alias("second"))
    return rest.join(second, "dup_key").withColumn("other", F.when(F.struct(*order) == F.col("first"), F.col("second")).otherwise(F.col("first")))


def upsert_changed(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``wanted`` that exist, are not null and differ; stored and new value."""
    both = stored.join(wanted.withColumnRenamed("value", "new_value"), key)
    return both.where(F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("value")))


def merge_settings(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Upsert by key: a full outer join in which a new value that is not null wins."""
    return stored.alias("s").join(wanted.alias("w"), key, "full_outer").select(*key, F.coalesce("w.value", "s.value").alias("value"))


def nearest_in_window(left: DataFrame, right: DataFrame, by: list[str], pos: str, reach: int, keep: list[str]) -> DataFrame:
    """For each row of ``left`` the nearest row of ``right`` with equal ``by`` and a position at most ``reach`` away.

    The range is turned into an equi join: each right row is sent to the few
    positions around it, so no partition is paired with itself.
    """
    around = right.select(*by, F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach)).alias("at"), F.col(pos).alias("other_pos"), *(F.col(k).alias(f"other_{k}") for k in keep))
    hit = left.withColumn("at", F.col(pos)).join(around, [*by, "at"]).where(F.col("other_pos") != F.col(pos))
    rank = F.row_number().over(W.partitionBy(*by, pos).orderBy(F.abs(F.col("other_pos") - F.col(pos)), "other_pos"))
    return hit.withColumn("rank", rank).where("rank = 1").drop("rank", "at")


def strict_zip(segments: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """Both tables' rows by (key, pos); ``paired`` is false where one has no counterpart."""
    a = segments.withColumn("has_segment", F.lit(True))
    b = translations.withColumn("has_translation", F.lit(True))
    both = a.join(b, [key, "pos"], "full_outer")
    return both.withColumn("paired", F.col("has_segment").isNotNull() & F.col("has_translation").isNotNull()).drop("has_segment", "has_translation")


def inside(path: Column) -> Column:
    """Whether a relative path stays in its folder at every step; an absolute one doesn't, null stays null."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # Depth below the folder; once outside it stays outside.
    step = lambda depth, p: F.when(depth < 0, depth).when(p == "..", depth - 1).otherwise(depth + 1)
    return ~path.startswith("/") & (F.aggregate(parts, F.lit(0), step) > 0)


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` with the value computed once: an expression that a lambda refers to would be computed anew in each call."""
    return F.transform(F.array(value), rule)[0]
