"""Text of pages as a reader gives it: blocks of lines of spans, nested; flattened to lines and words.

A page comes as JSON with blocks of a type, each with lines, each with spans (text,
size, box). Only blocks of text count; blank spans and those of less than ``LEAST``
points are left out, and a line is its spans' texts put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smallest size of a span that is read, and the type of a block of text (fixed values).
LEAST, TEXT_BLOCK = 2.5, 0
SPAN = "struct<text:string,size:double,x1:double,y1:double,x2:double,y2:double>"
PAGE = f"struct<blocks:array<struct<type:int,lines:array<struct<spans:array<{SPAN}>>>>>>"


def lines(pages: DataFrame, page: str, json: str) -> DataFrame:
    """(page, block, line, spans, text, x1, y1, x2, y2) of every line with a span that is read.

    Blocks and lines keep their places on the page as numbers. A page that can't be
    read, or is null, has no lines.
    """
    read = pages.select(F.col(page).alias("page"), F.from_json(json, PAGE)["blocks"].alias("blocks"))
    blocks = read.select("page", F.posexplode("blocks").alias("block", "b")).where(F.col("b.type") == TEXT_BLOCK)
    each = blocks.select("page", "block", F.posexplode("b.lines").alias("line", "l"))
    kept = F.filter("l.spans", lambda s: (F.trim(F.coalesce(s["text"], F.lit(""))) != "") & (s["size"] >= LEAST))
    out = each.select("page", F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), kept.alias("s")).where(F.size("s") > 0)
    edge = lambda c, f: f(F.transform("s", lambda s: s[c])).alias(c)
    return out.select("page", "block", "line", F.size("s").cast("long").alias("spans"), F.array_join(F.transform("s", lambda s: s["text"]), "").alias("text"), edge("x1", F.array_min), edge("y1", F.array_min), edge("x2", F.array_max), edge("y2", F.array_max))


def words(pages: DataFrame, page: str, json: str) -> DataFrame:
    """(page, block, line, word, text): the words of every line, numbered within it."""
    each = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return lines(pages, page, json).select("page", "block", "line", F.posexplode(each).alias("n", "word")).select("page", "block", "line", F.col("n").cast("long").alias("n"), F.col("word").alias("text"))
