"""Sources: nested text of pages, and a queue that is consumed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.relational import once
from paperloom.plans.registry import query
from paperloom.sources import page_text
from paperloom.sources.fragments import FRAGMENTS_SQL, pages
from paperloom.sources.tables import Tables
from paperloom.streaming import ordered

# Rows of a page are lines, ten of them a block; a block that begins with a table's row is an image; a fragment that ends
# with a full stop is set very small.
SMALL, NORMAL = 2.0, 10.0
SIZE = "CASE WHEN right(text, 1) = '.' THEN 2.0 ELSE 10.0 END"


def page_json(t: Tables) -> DataFrame:
    """(page, json): the documents' pages as a reader gives them; a page is nested where it is made, from its fragments in order."""
    at = lambda x, n: F.floor(x["idx"] / n)
    parts = lambda items, n, rule: F.transform(F.array_distinct(F.transform(items, lambda x: at(x, n))), lambda k: once(F.filter(items, lambda x: at(x, n) == k), rule))
    split = lambda items, n, rule: once(items, lambda x: parts(x, n, rule))
    size = lambda text: F.when(F.right(text, F.lit(1)) == ".", SMALL).otherwise(NORMAL)
    span = lambda x: F.struct(x["text"].alias("text"), size(x["text"]).alias("size"), *(x[c].alias(c) for c in ("x1", "y1", "x2", "y2")))
    line = lambda items: F.struct(F.transform(items, span).alias("spans"))
    block = lambda items: F.struct(F.when(items[0]["label"] == "plain text", 0).otherwise(1).alias("type"), split(items, 3, line).alias("lines"))
    whole = pages(t.documents).select("page", F.explode(F.array("items")).alias("items")).where(F.size("items") > 0)
    return whole.select("page", F.to_json(F.struct(split(F.col("items"), 30, block).alias("blocks"))).alias("json"))


_ROWS = f"(SELECT *, idx // 3 AS row, idx // 30 AS tenth, {SIZE} AS size FROM {FRAGMENTS_SQL})"
LINES_SQL = f"""SELECT page, block, line, count(*) AS spans, string_agg(text, '' ORDER BY idx) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
    FROM (SELECT f.*, dense_rank() OVER (PARTITION BY f.page ORDER BY f.tenth) - 1 AS block, dense_rank() OVER (PARTITION BY f.page, f.tenth ORDER BY f.row) - 1 AS line, b.kind FROM {_ROWS} f
          JOIN (SELECT page, tenth, min_by(label, (row, label)) AS kind FROM {_ROWS} GROUP BY ALL) b ON b.page = f.page AND b.tenth = f.tenth)
    WHERE kind = 'plain text' AND size >= 2.5 GROUP BY page, block, line"""


@query("src2_text_spans", LINES_SQL)
def _(t: Tables):
    """Lines of the pages' blocks of text, from the nested value of each page."""
    return page_text.lines(page_json(t), "page", "json")


@query("src3_page_words", f"SELECT page, block, line, unnest(range(len(w))) AS n, unnest(w) AS text FROM (SELECT page, block, line, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM ({LINES_SQL}))")
def _(t: Tables):
    return page_text.words(page_json(t), "page", "json")


@query("stm1_queue", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken FROM events WHERE event_type = 'purchase'")
def _(t: Tables):
    """Jobs of a queue: taken from the stream file by file, one file for each trigger being the cap; each is given out once."""
    jobs = ordered.stored_events(t.spark, t.folder, 1).where("event_type = 'purchase'").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken"))
    return ordered.drained(jobs, ordered.fresh_folder(t.spark, "queue"))
