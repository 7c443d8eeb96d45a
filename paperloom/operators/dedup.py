"""Repetition: equal contents, repeated edge lines, leaders of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(checksum, n, first): groups of two or more rows with equal text."""
    return df.groupBy(F.sha2(text, 256).alias("checksum")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, n, line): a text's lines that aren't blank, their place and how many there are."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return df.select(key, F.size(lines).cast("long").alias("n"), F.posexplode(lines).alias("pos", "line"))


def repeated_edge_text(lines: DataFrame, page: str, canon: Column, edge: Column, pages: int = 3, share: float = 0.8) -> DataFrame:
    """(group_id, canon, pages, hits, edge_hits) of texts on ``pages`` pages or more, mostly in the edge band.

    The group id is a short digest of the text, so groups of different runs compare.
    Distinct pages are counted after (text, page) pairs are made unique, so a text
    that stands on very many pages is spread over tasks before it is one row.
    """
    rows = lines.select(F.col(page).alias("page"), canon.alias("canon"), edge.alias("edge"))
    rows = rows.where(F.length("canon").between(3, 160) & F.col("canon").rlike("(?U)\\p{L}"))
    per_page = rows.groupBy("canon", "page").agg(F.count(F.lit(1)).alias("hits"), F.count_if("edge").alias("edge_hits"))
    groups = per_page.groupBy("canon").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").alias("hits"), F.sum("edge_hits").alias("edge_hits"))
    kept = groups.where((F.col("pages") >= pages) & (F.col("edge_hits") / F.col("hits") >= share))
    return kept.select(F.concat(F.lit("repeated-edge:"), F.substring(F.sha1("canon"), 1, 12)).alias("group_id"), "canon", "pages", "hits", "edge_hits")


def leader_values(df: DataFrame, group: str, order: str, value: str, changed: Column) -> DataFrame:
    """Every member of a group with the value of its first changed member, or its own if none changed."""
    leaders = df.where(changed).groupBy(group).agg(F.min_by(value, order).alias("leader_value"))
    return apart(df, leaders, [group], "left").withColumn("value_now", F.coalesce("leader_value", value))


def apart(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with an aggregate over ``by``, in a plan whose hot keys can be split.

    Joined by the same keys alone, the aggregate's partitions would be the join's, and
    Spark couldn't divide a large one. With a hash as one more key both sides are dealt
    out for the join itself; of the aggregate that is a row for each group. Null keys meet.
    """
    mark = F.xxhash64(*by).alias("_mark")
    left, right = df.select("*", mark).alias("l"), groups.select("*", mark).alias("r")
    same = F.col("l._mark") == F.col("r._mark")
    for key in by:
        same &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    kept = [F.col(f"l.{c}") for c in df.columns] + [F.col(f"r.{c}") for c in groups.columns if c not in by]
    return left.join(right, same, how).select(*kept)


def first_seen(df: DataFrame, by: list[str], order: list, keep: str = "seen") -> DataFrame:
    """Marks the first row of each key."""
    return df.withColumn(keep, F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1)
