"""Ordered queries: timelines, islands, quantiles, sessions, state checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators import windows as win
from paperloom.plans.registry import query, values_sql
from paperloom.sources.tables import Tables
from paperloom.streaming import ordered

END = "2024-12-31 00:00:00"


@query(
    "win1_event_timeline",
    f"""SELECT event_id, greatest(CAST(floor(epoch(coalesce(lead(ts) OVER w, TIMESTAMP '{END}'))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT), 0) AS seconds
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t: Tables):
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return win.timeline(events, ["user_id"], "ts", "event_id", F.lit(END).cast("timestamp")).select("event_id", "seconds")


@query("win2_exclusive_running_sum", "SELECT l_orderkey, l_linenumber, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem")
def _(t: Tables):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(W.unboundedPreceding, -1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("before"))


@query("win3_latest_per_key", "SELECT created_by, max_by(job_id, (created_at, job_id)) AS latest_job FROM {jobs} GROUP BY created_by")
def _(t: Tables):
    return t.jobs.groupBy("created_by").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("latest_job"))


GAPS_SQL = """WITH c AS (SELECT page, y1, y2, x1, x2, part_key, order_key, {key} AS v FROM {{boxes}}),
     s AS (SELECT *, CASE WHEN v - lag(v) OVER w > {gap} OR lag(v) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM c WINDOW w AS (PARTITION BY page ORDER BY v, x1, x2, y1, y2, part_key, order_key)),
     i AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY v, x1, x2, y1, y2, part_key, order_key ROWS UNBOUNDED PRECEDING) AS island FROM s)
     SELECT page, CAST(island AS BIGINT) AS island, count(*) AS n, min(v) AS low, max(v) AS high FROM i GROUP BY page, island"""


def gap_islands(t: Tables, key, gap: float):
    boxes = t.boxes.withColumn("at", key)
    order = ["at", "x1", "x2", "y1", "y2", "part_key", "order_key"]
    step = F.col("at") - F.lag("at").over(W.partitionBy("page").orderBy(*order))
    return win.islands(boxes, ["page"], order, step > gap).groupBy("page", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))


@query("win4_center_islands_by_step", GAPS_SQL.format(key="(x1 + x2) / 2", gap="7.0"))
def _(t: Tables):
    """Segments by the step between neighbours; the running-mean variant is the fold ``fold_center_segments``."""
    return gap_islands(t, (F.col("x1") + F.col("x2")) / 2, 7.0)


@query("win5_vertical_gap_islands", GAPS_SQL.format(key="y1", gap="24.0"))
def _(t: Tables):
    return gap_islands(t, F.col("y1"), 24.0)


@query("win13_position_clusters", GAPS_SQL.format(key="x2 * 0.6", gap="1.0"))
def _(t: Tables):
    return gap_islands(t, F.col("x2") * 0.6, 1.0)


@query(
    "win8_column_split",
    """WITH c AS (SELECT page, (x1 + x2) / 2 AS center FROM {boxes} WHERE y1 > 79.2 AND y2 < 712.8 AND x1 > 36.72 AND x2 < 575.28),
            g AS (SELECT page, row_number() OVER w AS place, count(*) OVER (PARTITION BY page) AS n, lead(center) OVER w - center AS gap FROM c WINDOW w AS (PARTITION BY page ORDER BY center)),
            b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(gap, -1) DESC, place) AS best FROM g)
       SELECT page, n >= 6 AND coalesce(gap, 0) >= 97.92 AND place >= 3 AND n - place >= 3 AS two_columns, n, gap FROM b WHERE best = 1""",
)
def _(t: Tables):
    body = t.boxes.where("y1 > 79.2 AND y2 < 712.8 AND x1 > 36.72 AND x2 < 575.28").select("page", ((F.col("x1") + F.col("x2")) / 2).alias("center"))
    best = win.largest_gap(body, ["page"], "center")
    two = (F.col("n") >= 6) & (F.coalesce("gap", F.lit(0.0)) >= 97.92) & (F.col("left_n") >= 3) & (F.col("right_n") >= 3)
    return best.select("page", two.alias("two_columns"), "n", "gap")


@query(
    "win9_adjacent_repeats",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
             k AS (SELECT *, regexp_replace(line, '[ \t\r\n\f\v]+', '', 'g') AS bare FROM l)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k) WHERE before IS NULL OR before <> bare""",
)
def _(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bare", F.regexp_replace("line", "\\s+", ""))
    before = F.lag("bare").over(W.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("before", before).where("before IS NULL OR before <> bare").select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line")


GRID = [(k, float(x)) for k, x in enumerate((0, 0.6, 1.4, 5, 5.9, 8))]


@query(
    "win14_nearest_position",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, min(k) AS grid FROM (SELECT l.*, g.k, dense_rank() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ORDER BY CASE WHEN abs(x - l_discount * 80) <= 1 THEN 0 ELSE 1 END, CASE WHEN abs(x - l_discount * 80) <= 1 THEN k ELSE abs(x - l_discount * 80) END, k) AS r FROM lineitem l, "
    + values_sql(GRID, "k, x").replace(" AS v(", " AS g(")
    + ") WHERE r = 1 GROUP BY ALL",
)
def _(t: Tables):
    # The grid is a literal: the nearest index is an expression over a constant array, with no join.
    at = F.col("l_discount") * 80
    grid = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in GRID))
    near = F.filter(grid, lambda g: F.abs(g["x"] - at) <= 1)
    ranked = F.transform(grid, lambda g: F.struct(F.abs(g["x"] - at).alias("d"), g["k"].alias("k")))
    k = F.coalesce(F.try_element_at(near, F.lit(1))["k"], F.array_min(ranked)["k"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", k.alias("grid")).distinct()


@query(
    "stm5_failure_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS opens FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS session FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, count(*) >= 3 AS limited FROM s GROUP BY user_id, session""",
)
def _(t: Tables):
    errors = t.events.where("event_type = 'error'").select("user_id", "ts")
    return win.failure_sessions(errors, "user_id", "ts", "12 hours", 3).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "limited")


@query(
    "stm7_monotonic_progress",
    """WITH p AS (SELECT event_id, user_id, ts, event_type, max(event_id % 101) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events)
       SELECT event_id, top FROM (SELECT *, lag(top) OVER w AS t0, lag(event_type) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t0 IS NULL OR t0 <> top OR s0 <> event_type""",
)
def _(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", "event_type", (F.col("event_id") % 101).alias("progress"))
    return win.changed_progress(rows, ["user_id"], ["ts", "event_id"], "event_type", "progress").select("event_id", "top")


LATE = "1 day"


@query(
    "stm7_progress_stream",
    """WITH p AS (SELECT event_id, user_id, ts, event_type, max(event_id % 101) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events)
       SELECT event_id, top FROM (SELECT *, lag(top) OVER w AS t0, lag(event_type) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE (t0 IS NULL OR t0 <> top OR s0 <> event_type) AND ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def _(t: Tables):
    """The events as a stream: what the state machine gave out by the time its watermark stands a day before the last event."""
    rows = ordered.stored_events(t.spark, t.folder).select("event_id", "user_id", "ts", F.col("event_type").alias("status"), (F.col("event_id") % 101).alias("progress"))
    return ordered.drained(ordered.progress(rows, LATE), ordered.fresh_folder(t.spark, "progress")).select("event_id", "top")


@query(
    "stm5_session_stream",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS opens FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS session FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, count(*) >= 3 AS limited FROM s GROUP BY user_id, session
       HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_type = 'error')""",
)
def _(t: Tables):
    """Sessions of errors that the watermark has closed, from the events as a stream."""
    errors = ordered.stored_events(t.spark, t.folder).where("event_type = 'error'").select("event_id", "user_id", "ts")
    closed = ordered.drained(ordered.sessions(errors, 12 * 3_600_000, 3, LATE), ordered.fresh_folder(t.spark, "sessions"))
    return closed.select("user_id", F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "limited")


@query(
    "stm8_illegal_transitions",
    """SELECT job_id, was, status FROM (SELECT job_id, status, lag(status) OVER (PARTITION BY created_by ORDER BY created_at, job_id) AS was FROM {jobs})
       WHERE was IN ('completed', 'cancelled') AND status IN ('parsing', 'ocr_running', 'translating', 'rebuilding')""",
)
def _(t: Tables):
    was = F.lag("status").over(W.partitionBy("created_by").orderBy("created_at", "job_id"))
    return t.jobs.select("job_id", "status", was.alias("was")).where(F.col("was").isin("completed", "cancelled") & F.col("status").isin("parsing", "ocr_running", "translating", "rebuilding"))


@query("stm2_reconcile", "SELECT job_id, CASE WHEN cancel_requested THEN 'finalize_cancel' WHEN status = 'queued' THEN 'requeue' ELSE 'recover' END AS action FROM {jobs} WHERE status IN ('queued', 'parsing', 'ocr_running', 'translating', 'rebuilding', 'validating') AND (status = 'queued' OR lease_until IS NULL OR lease_until < TIMESTAMP '1997-01-01 00:00:00')")
def _(t: Tables):
    from paperloom.operators.relational import recoverable

    jobs = recoverable(t.jobs, F.lit("1997-01-01 00:00:00").cast("timestamp"))
    return jobs.select("job_id", F.when(F.col("cancel_requested"), "finalize_cancel").when(F.col("status") == "queued", "requeue").otherwise("recover").alias("action"))


@query("stm6_retention", "SELECT file_id FROM {files} WHERE NOT deleted AND file_id NOT IN (SELECT input_file_id FROM {jobs} WHERE created_at >= TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 300 DAY)")
def _(t: Tables):
    used = t.jobs.where("created_at >= TIMESTAMP_NTZ '1997-01-01 00:00:00' - INTERVAL 300 DAY").select(F.col("input_file_id").alias("file_id"))
    return t.files.where("NOT deleted").select("file_id").join(used, "file_id", "left_anti")


# ---- aggregates that depend on order -------------------------------------------------------


@query("agg15_dominant_value", "SELECT l_orderkey, min_by(l_shipmode, (-n, first_line, l_shipmode)) AS dominant FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    n = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_line"))
    return n.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), F.col("first_line"), F.col("l_returnflag"))).alias("dominant"))


@query("agg16_size_mode", "SELECT page, min_by(size, (-n, size)) AS size_mode FROM (SELECT page, size, count(*) AS n FROM {boxes} GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    n = t.boxes.groupBy("page", "size").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("page").agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("size_mode"))


@query("agg17_mean_size", "SELECT p_partkey, coalesce(round(avg(l_quantity), 2), 12.0) AS mean_size FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 30 GROUP BY 1")
def _(t: Tables):
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"), "l_quantity"), "p_partkey", "left").groupBy("p_partkey").agg(F.coalesce(F.round(F.avg("l_quantity"), 2), F.lit(12.0)).alias("mean_size"))


@query("agg18_median", "SELECT page, median(y2 - y1) AS median_height FROM {boxes} GROUP BY page")
def _(t: Tables):
    return t.boxes.groupBy("page").agg(F.median(F.col("y2") - F.col("y1")).alias("median_height"))


@query("agg19_quantile", "SELECT page, round(quantile_cont(size, 0.35), 6) AS q35 FROM {boxes} GROUP BY page")
def _(t: Tables):
    return t.boxes.groupBy("page").agg(F.round(F.percentile("size", F.lit(0.35)), 6).alias("q35"))


@query("agg20_positional_quantile", "SELECT page, list_sort(list(x2))[CAST(least(count(*), CAST(floor(count(*) * 0.85) AS BIGINT) + 1) AS BIGINT)] AS anchor FROM {boxes} GROUP BY page")
def _(t: Tables):
    # A rank instead of an array: a page of any size is sorted with spilling and never held in one cell.
    w = W.partitionBy("page")
    ranked = t.boxes.select("page", "x2", F.row_number().over(w.orderBy("x2")).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where(F.col("place") == F.least(F.col("n"), F.floor(F.col("n") * 0.85) + 1)).select("page", F.col("x2").alias("anchor"))


@query(
    "agg21_weighted_median",
    """SELECT page, min(size) AS median FROM (SELECT page, size, sum(w) OVER (PARTITION BY page ORDER BY size ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY page) AS total
       FROM (SELECT page, size, sum(line_no) AS w FROM {boxes} GROUP BY 1, 2)) WHERE run >= total / 2 GROUP BY 1""",
)
def _(t: Tables):
    return win.weighted_median(t.boxes, ["page"], "size", "line_no")


@query("agg22_rect_union", "SELECT page, round(min(x1), 3) AS x1, round(min(y1), 3) AS y1, round(max(x2), 3) AS x2, round(max(y2), 3) AS y2 FROM {boxes} GROUP BY page")
def _(t: Tables):
    return t.boxes.groupBy("page").agg(*(F.round(f(c), 3).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))


@query(
    "agg23_densest_baseline",
    """SELECT page, max_by(mean, (n, bucket)) AS baseline FROM (SELECT page, CAST(floor((y1 + y2) + 0.5) AS BIGINT) AS bucket, count(*) AS n, avg((y1 + y2) / 2) AS mean FROM {boxes} GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Tables):
    center = (F.col("y1") + F.col("y2")) / 2
    b = t.boxes.groupBy("page", F.floor(center * 2 + 0.5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(center).alias("mean"))
    return b.groupBy("page").agg(F.max_by("mean", F.struct("n", "bucket")).alias("baseline"))


@query("agg24_min_sibling", "SELECT p_partkey, coalesce(min(nullif(l_quantity, 0)), 9.0) AS size FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY 1")
def _(t: Tables):
    q = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.nullif(F.col("l_quantity"), F.lit(0.0)).alias("q"))
    return t.part.select("p_partkey").join(q, "p_partkey", "left").groupBy("p_partkey").agg(F.coalesce(F.min("q"), F.lit(9.0)).alias("size"))


@query("agg26_any_all", "SELECT l_orderkey, bool_and(l_quantity > 5) AS all_text, bool_or(l_discount > 0.09) AS any_resource, CASE WHEN bool_and(l_quantity > 5) OR bool_or(l_discount > 0.09) THEN 'no_ocr' WHEN bool_or(l_quantity > 5) THEN 'no_ocr' ELSE 'rebuild' END AS decision FROM lineitem GROUP BY 1")
def _(t: Tables):
    text, resource = F.bool_and(F.col("l_quantity") > 5), F.bool_or(F.col("l_discount") > 0.09)
    some = F.bool_or(F.col("l_quantity") > 5)
    return t.lineitem.groupBy("l_orderkey").agg(text.alias("all_text"), resource.alias("any_resource"), F.when(text | resource | some, "no_ocr").otherwise("rebuild").alias("decision"))


@query("txt2_repeating_keys", "SELECT l_orderkey, count(*) >= 2 AND count(DISTINCT l_returnflag) < count(*) AS repeating FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def _(t: Tables):
    n = F.count("l_returnflag")
    return t.lineitem.where("l_returnflag IS NOT NULL").groupBy("l_orderkey").agg(((n >= 2) & (F.countDistinct("l_returnflag") < n)).alias("repeating"))


@query(
    "txt3_vertical_step",
    """WITH c AS (SELECT page, y2 - y1 AS h, lead((y1 + y2) / 2) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2) - (y1 + y2) / 2 AS step FROM {boxes})
       SELECT page, greatest(coalesce(median(CASE WHEN step > 1 THEN step END), 0), coalesce(median(CASE WHEN h > 0 THEN h END), 0), 7.0) AS step FROM c GROUP BY page""",
)
def _(t: Tables):
    center = (F.col("y1") + F.col("y2")) / 2
    steps = t.boxes.select("page", (F.col("y2") - F.col("y1")).alias("h"), (F.lead(center).over(W.partitionBy("page").orderBy(center)) - center).alias("d"))
    return steps.groupBy("page").agg(F.greatest(F.coalesce(F.median(F.when(F.col("d") > 1, F.col("d"))), F.lit(0.0)), F.coalesce(F.median(F.when(F.col("h") > 0, F.col("h"))), F.lit(0.0)), F.lit(7.0)).alias("step"))
