"""Queries over boxes on pages: overlap, neighbours, columns, guards, with oracle SQL.

Every pair join is an equi join on the page (and a band where one exists) with
the geometric test as its residual condition; a page holds a bounded number of
boxes, and pages are what grows.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import geometry as geo
from paperloom.functions import labels
from paperloom.operators import folds
from paperloom.plans.registry import query
from paperloom.sources.tables import Tables

NODES = "(SELECT page, x1, y1, x2, y2, row_number() OVER (PARTITION BY page ORDER BY y1, x1, x2, y2) AS idx FROM (SELECT DISTINCT page, x1, y1, x2, y2 FROM {boxes}))"
EDGE = "({p}y1 <= 79.2 OR {p}y2 >= 712.8 OR {p}x1 <= 36.72 OR {p}x2 >= 575.28)"
INTER = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
AREA = "(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"
UNION = f"({AREA.format(p='a')} + {AREA.format(p='b')} - {INTER})"
ADJ = f"""({INTER} > 0 AND {INTER} / {UNION} > 0.3 OR (greatest(b.y1 - a.y2, a.y1 - b.y2, 0.0) <= 5
   AND (greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(least(a.x2 - a.x1, b.x2 - b.x1), 1.0) >= 0.2 OR greatest(b.x1 - a.x2, a.x1 - b.x2, 0.0) <= 18)))"""


def nodes(t: Tables):
    flat = t.boxes.select("page", "x1", "y1", "x2", "y2").distinct()
    return flat.withColumn("idx", F.row_number().over(W.partitionBy("page").orderBy("y1", "x1", "x2", "y2")).cast("long"))


def pairs(t: Tables, condition):
    """Ordered pairs of a page's boxes: columns of the first as a_*, of the second as b_*."""
    n = nodes(t)
    a = n.select("page", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", "idx")))
    b = n.select("page", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "idx")))
    return a.join(b, "page").where(condition)


A, B = geo.corners("a_"), geo.corners("b_")
#: Points of a page's height that make a band.
BAND = 36.0


def banded_pairs(n, reach: float = 0.0, more: tuple[str, ...] = ()):
    """Ordered pairs of different boxes of a page that share a height, or are at most ``reach`` apart there.

    An index of bands: each box stands in every band it touches, so boxes far apart
    never meet. A pair is made in the lowest band that both touch.
    """
    low, high = F.floor((F.col("y1") - reach) / BAND), F.floor((F.col("y2") + reach) / BAND)
    side = lambda p: n.select("page", *(F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2", "idx", *more)), low.alias(f"{p}_low"), F.explode(F.sequence(low, high)).alias("band"))
    met = side("a").join(side("b"), ["page", "band"]).where((F.col("a_idx") != F.col("b_idx")) & (F.col("band") == F.greatest("a_low", "b_low")))
    return met.where((F.col("a_y1") <= F.col("b_y2") + reach) & (F.col("b_y1") <= F.col("a_y2") + reach)).drop("band", "a_low", "b_low")


@query("flt13_edge_band", f"SELECT page, count(*) AS n, count_if({EDGE.format(p='')}) AS in_band, count_if(x2 > 612 * 1.015 OR y2 > 792 * 1.015) AS overflowing FROM {{boxes}} GROUP BY page")
def _(t: Tables):
    box = geo.corners()
    return t.boxes.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(geo.edge_band(box)).alias("in_band"), F.count_if((F.col("x2") > 612 * 1.015) | (F.col("y2") > 792 * 1.015)).alias("overflowing"))


@query("geo1_overlap_measures", f"SELECT a.page, a.idx AS left_idx, b.idx AS right_idx, round({INTER} / {UNION}, 6) AS iou, round({INTER} / {AREA.format(p='a')}, 6) AS ratio FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx < b.idx WHERE {INTER} > 0")
def _(t: Tables):
    hit = pairs(t, (F.col("a_idx") < F.col("b_idx")) & (geo.intersection(A, B) > 0))
    return hit.select("page", F.col("a_idx").alias("left_idx"), F.col("b_idx").alias("right_idx"), F.round(geo.iou(A, B), 6).alias("iou"), F.round(geo.overlap_ratio(A, B), 6).alias("ratio"))


@query("geo2_adjacent_pairs", f"SELECT a.page, a.idx AS left_idx, b.idx AS right_idx FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx < b.idx WHERE {ADJ}")
def _(t: Tables):
    return pairs(t, (F.col("a_idx") < F.col("b_idx")) & geo.adjacent(A, B)).select("page", F.col("a_idx").alias("left_idx"), F.col("b_idx").alias("right_idx"))


@query(
    "geo3_components",
    f"""WITH RECURSIVE n AS (SELECT * FROM {NODES} WHERE page % 5 >= 0), e AS (SELECT a.page, a.idx AS u, b.idx AS v FROM n a JOIN n b ON a.page = b.page AND a.idx <> b.idx WHERE {ADJ}),
        r AS (SELECT page, idx, idx AS root FROM n UNION SELECT r.page, e.v, r.root FROM r JOIN e ON r.page = e.page AND r.idx = e.u WHERE r.root < e.v)
        SELECT page, idx, min(root) AS component FROM r GROUP BY page, idx""",
)
def _(t: Tables):
    return folds.page_components(nodes(t))


HEIGHTS = "greatest(a.y2 - a.y1, 1.0), greatest(b.y2 - b.y1, 1.0)"
REASON = f"""CASE WHEN b.x1 < a.x1 THEN 'right_before_left'
    WHEN (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least({HEIGHTS}) < 0.62 THEN 'low_vertical_overlap'
    WHEN abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) > greatest({HEIGHTS}) * 0.45 THEN 'centerline_delta_too_large'
    WHEN NOT (b.x1 - a.x2 BETWEEN -1 AND greatest(4.0, least({HEIGHTS}) * 0.55)) THEN 'gap_out_of_range' ELSE 'ok' END"""


@query("geo4_baseline_reasons", f"SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx <> b.idx) GROUP BY reason")
def _(t: Tables):
    return pairs(t, F.col("a_idx") != F.col("b_idx")).groupBy(geo.baseline_reason(A, B).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def regions_sql(nodes: str) -> str:
    body = f"(SELECT *, (x1 + x2) / 2 AS center FROM {nodes} WHERE NOT {EDGE.format(p='')})"
    columns = f"""g AS (SELECT page, x1, x2, center, row_number() OVER w AS place, count(*) OVER (PARTITION BY page) AS n, lead(center) OVER w - center AS gap FROM {body} WINDOW w AS (PARTITION BY page ORDER BY center, idx)),
    b AS (SELECT page, n, place AS cut, gap FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(gap, -1) DESC, place) AS r FROM g) WHERE r = 1),
    k AS (SELECT g.page, CASE WHEN b.n >= 6 AND coalesce(b.gap, 0) >= 97.92 AND b.cut >= 3 AND b.n - b.cut >= 3 THEN CASE WHEN g.place <= b.cut THEN 'left' ELSE 'right' END ELSE 'single' END AS column_id, g.x1, g.x2
          FROM g JOIN b ON g.page = b.page WHERE b.n >= 3),
    c AS (SELECT page, column_id, min(x1) AS cx1, max(x2) AS cx2 FROM k GROUP BY 1, 2)"""
    return f"""WITH {columns}, m AS (SELECT n.page, n.idx, min(c.column_id) AS column_id FROM {nodes} n JOIN c ON n.page = c.page AND NOT {EDGE.format(p='n.')}
        AND (n.x1 + n.x2) / 2 BETWEEN cx1 - greatest(6.0, (cx2 - cx1) * 0.08) AND cx2 + greatest(6.0, (cx2 - cx1) * 0.08) GROUP BY 1, 2)
    SELECT n.page, n.idx, CASE WHEN {EDGE.format(p='n.')} THEN 'edge' WHEN m.column_id IS NOT NULL THEN 'body_column' ELSE 'unknown' END AS region, m.column_id,
           CAST(CASE WHEN {EDGE.format(p='n.')} THEN 0.9 WHEN m.column_id IN ('left', 'right') THEN 0.74 WHEN m.column_id = 'single' THEN 0.64 ELSE 0.0 END AS DOUBLE) AS confidence
    FROM {nodes} n LEFT JOIN m ON n.page = m.page AND n.idx = m.idx"""


REGIONS_SQL = regions_sql(NODES)


def regions(t: Tables):
    return regions_of(nodes(t))


def regions_of(n):
    """Edge, body column or unknown for each box; columns come from the widest gap between centers."""
    box = geo.corners()
    n = n.withColumn("center", (F.col("x1") + F.col("x2")) / 2).withColumn("edge", geo.edge_band(box))
    w = W.partitionBy("page").orderBy("center", "idx")
    body = n.where("NOT edge").withColumn("place", F.row_number().over(w)).withColumn("gap", F.lead("center").over(w) - F.col("center"))
    best = body.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("place", "gap"), F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col("place"))).alias("best")).where("n >= 3")
    two = (F.col("n") >= 6) & (F.coalesce("best.gap", F.lit(0.0)) >= 97.92) & (F.col("best.place") >= 3) & (F.col("n") - F.col("best.place") >= 3)
    side = F.when(two, F.when(F.col("place") <= F.col("best.place"), "left").otherwise("right")).otherwise("single")
    columns = body.join(best, "page").groupBy("page", side.alias("column_id")).agg(F.min("x1").alias("cx1"), F.max("x2").alias("cx2"))
    # At most two columns a page: an array per page is joined once instead of a range join.
    packed = columns.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("column_id", "cx1", "cx2"))).alias("columns"))

    return _in_columns(n.join(packed, "page", "left")).select("page", "idx", "x1", "y1", "x2", "y2", "region", "column_id", "confidence")


def _in_columns(n):
    """Region, column and confidence of boxes that have their page's columns (or null) beside them, and center and edge."""

    def inside(c):
        slack = F.greatest(F.lit(6.0), (c["cx2"] - c["cx1"]) * 0.08)
        return F.col("center").between(c["cx1"] - slack, c["cx2"] + slack)

    hit = F.try_element_at(F.filter(F.coalesce("columns", F.array().cast("array<struct<column_id:string,cx1:double,cx2:double>>")), inside), F.lit(1))["column_id"]
    found = n.withColumn("column_id", F.when(~F.col("edge"), hit))
    region = F.when(F.col("edge"), "edge").when(F.col("column_id").isNotNull(), "body_column").otherwise("unknown")
    confidence = F.when(F.col("edge"), 0.9).when(F.col("column_id").isin("left", "right"), 0.74).when(F.col("column_id") == "single", 0.64).otherwise(0.0)
    return found.withColumns({"region": region, "confidence": confidence})


def regions_of_pages(pages):
    """:func:`regions_of` where each row is a page with its boxes as the array ``items``: nothing is shuffled. The boxes keep their other fields."""
    center = lambda b: (b["x1"] + b["x2"]) / 2
    body = F.filter("items", lambda b: ~geo.edge_band((b["x1"], b["y1"], b["x2"], b["y2"])))
    p = pages.withColumn("body", F.sort_array(F.transform(body, lambda b: F.struct(center(b).alias("center"), b["idx"].alias("idx"), b["x1"].alias("x1"), b["x2"].alias("x2")))))
    # The widest gap, the first of equals; behind the last box there is none.
    gap = lambda b, k: F.coalesce(F.get("body", k + 1)["center"] - b["center"], F.lit(-1.0))
    p = p.withColumns({"n": F.size("body"), "best": F.array_max(F.transform("body", lambda b, k: F.struct(gap(b, k).alias("gap"), (-k - 1).alias("place"))))})
    cut = -F.col("best.place")
    two = (F.col("n") >= 6) & (F.col("best.gap") >= 97.92) & (cut >= 3) & (F.col("n") - cut >= 3)
    bounds = lambda name, side: F.struct(F.lit(name).alias("column_id"), F.array_min(F.transform(side, lambda b: b["x1"])).alias("cx1"), F.array_max(F.transform(side, lambda b: b["x2"])).alias("cx2"))
    sides = F.array(bounds("left", F.slice("body", F.lit(1), cut)), bounds("right", F.slice("body", cut + 1, F.col("n"))))
    p = p.withColumn("columns", F.when(two, sides).when(F.col("n") >= 3, F.array(bounds("single", F.col("body")))))
    boxes = p.select("page", "columns", F.inline("items")).withColumns({"center": (F.col("x1") + F.col("x2")) / 2, "edge": geo.edge_band(geo.corners())})
    return _in_columns(boxes).drop("columns", "center")


@query("geo6_layout_regions", REGIONS_SQL)
def _(t: Tables):
    return regions(t).select("page", "idx", "region", "column_id", "confidence")


@query("agg3_region_counts", f"SELECT page, CASE WHEN column_id IS NULL THEN region ELSE region || ':' || column_id END AS key, count(*) AS n FROM ({REGIONS_SQL}) GROUP BY 1, 2")
def _(t: Tables):
    return regions(t).groupBy("page", F.concat_ws(":", "region", "column_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "geo7_geo8_geo9_page_position",
    f"""SELECT page, idx, CASE WHEN (x1 + x2) / 2 < 306 AND x2 <= 324 THEN 'left' WHEN (x1 + x2) / 2 > 306 AND x1 >= 288 THEN 'right' END AS domain,
        CASE WHEN x1 <= 306 AND 306 <= x2 THEN 'full' WHEN (x1 + x2) / 2 < 306 THEN 'left' ELSE 'right' END AS toc_column, CASE WHEN abs((x1 + x2) / 2 - 306) <= 5 THEN 'CENTER' END AS alignment FROM {NODES}""",
)
def _(t: Tables):
    box = geo.corners()
    return nodes(t).select("page", "idx", geo.column_domain(box).alias("domain"), geo.toc_column(box).alias("toc_column"), geo.alignment(box, 612.0).alias("alignment"))


@query(
    "geo12_label_cluster",
    """WITH a AS (SELECT page, min(x1) - 12 AS cx1, min(y1) - 12 AS cy1, max(x2) + 12 AS cx2, max(y2) + 12 AS cy2 FROM {boxes} WHERE size <= 6.5 GROUP BY page HAVING count(*) >= 6)
       SELECT b.page, count(*) AS inside FROM {boxes} b JOIN a ON a.page = b.page WHERE b.size > 6.5 AND (b.x1 + b.x2) / 2 BETWEEN cx1 AND cx2 AND (b.y1 + b.y2) / 2 BETWEEN cy1 AND cy2 GROUP BY 1""",
)
def _(t: Tables):
    cluster = t.boxes.where("size <= 6.5").groupBy("page").agg(F.count(F.lit(1)).alias("n"), (F.min("x1") - 12).alias("cx1"), (F.min("y1") - 12).alias("cy1"), (F.max("x2") + 12).alias("cx2"), (F.max("y2") + 12).alias("cy2")).where("n >= 6")
    inside = geo.contains_point(tuple(F.col(c) for c in ("cx1", "cy1", "cx2", "cy2")), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return t.boxes.where("size > 6.5").join(cluster, "page").where(inside).groupBy("page").agg(F.count(F.lit(1)).alias("inside"))


#: A box's text: the type of its part in capitals, or its name; names of parts are what the rule is about.
PART_TEXT = "(SELECT b.page, b.x1, b.y1, b.x2, b.y2, min(CASE WHEN p_size <= 12 THEN p_type ELSE p_name END) AS text FROM {boxes} b JOIN part ON p_partkey = b.part_key GROUP BY ALL)"
SEED = "^([A-Z0-9]{2,}|[A-Z0-9]+ [A-Z0-9]+|_)$"


@query(
    "geo13_band_neighbours",
    f"""WITH n AS (SELECT n.*, t.text FROM {NODES} n JOIN {PART_TEXT} t ON n.page = t.page AND n.x1 = t.x1 AND n.y1 = t.y1 AND n.x2 = t.x2 AND n.y2 = t.y2)
        SELECT DISTINCT a.page, a.idx FROM n a JOIN n b ON a.page = b.page WHERE regexp_matches(b.text, '{SEED}')
        AND (a.idx = b.idx OR abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= 1.2 * greatest(a.y2 - a.y1, b.y2 - b.y1) AND greatest(b.x1 - a.x2, a.x1 - b.x2, 0.0) <= 8 * greatest(a.y2 - a.y1, b.y2 - b.y1))""",
)
def _(t: Tables):
    """Boxes whose text is a name in capitals, and those next to one on its band."""
    texts = t.boxes.join(t.part, F.col("p_partkey") == F.col("part_key")).groupBy("page", "x1", "y1", "x2", "y2").agg(F.min(F.when(F.col("p_size") <= 12, F.col("p_type")).otherwise(F.col("p_name"))).alias("text"))
    n = nodes(t).join(texts, ["page", "x1", "y1", "x2", "y2"])
    h = F.greatest(A[3] - A[1], B[3] - B[1])
    # Boxes are at most 11 high: middles 1.2 heights apart leave at most that between the edges.
    near = (F.abs((A[1] + A[3]) / 2 - (B[1] + B[3]) / 2) <= 1.2 * h) & (geo.horizontal_gap(A, B) <= 8 * h) & F.col("b_text").rlike(SEED)
    beside = banded_pairs(n, 16.0, ("text",)).where(near).select("page", F.col("a_idx").alias("idx"))
    return beside.unionByName(n.where(F.col("text").rlike(SEED)).select("page", "idx")).distinct()


# ---- spatial joins -------------------------------------------------------------------------

TABLE_RECTS = "(SELECT page, min(x1) AS rx1, min(y1) AS ry1, min(x1) + 200 AS rx2, min(y1) + 200 AS ry2 FROM {boxes} GROUP BY page)"
CENTER_IN = "((n.x1 + n.x2) / 2 BETWEEN rx1 AND rx2 AND (n.y1 + n.y2) / 2 BETWEEN ry1 AND ry2)"


def table_rects(t: Tables):
    return t.boxes.groupBy("page").agg(F.min("x1").alias("rx1"), F.min("y1").alias("ry1"), (F.min("x1") + 200).alias("rx2"), (F.min("y1") + 200).alias("ry2"))


def in_table():
    r = tuple(F.col(c) for c in ("rx1", "ry1", "rx2", "ry2"))
    return geo.contains_point(r, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)


@query("jon11_inside_rect", f"SELECT n.page, n.idx FROM {NODES} n JOIN {TABLE_RECTS} r ON n.page = r.page WHERE {CENTER_IN}")
def _(t: Tables):
    return nodes(t).join(table_rects(t), "page").where(in_table()).select("page", "idx")


@query("jon12_outside_rect", f"SELECT n.page, n.idx FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {TABLE_RECTS} r WHERE n.page = r.page AND {CENTER_IN})")
def _(t: Tables):
    n, r = nodes(t).alias("n"), table_rects(t).alias("r")
    return n.join(r, (F.col("n.page") == F.col("r.page")) & in_table(), "left_anti").select("page", "idx")


@query(
    "jon13_best_right_neighbour",
    f"SELECT page, left_idx, right_idx FROM (SELECT a.page, a.idx AS left_idx, b.idx AS right_idx, row_number() OVER (PARTITION BY a.page, a.idx ORDER BY b.x1 - a.x2, b.x1, b.idx) AS r FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx <> b.idx WHERE {REASON} = 'ok') WHERE r = 1",
)
def _(t: Tables):
    ok = pairs(t, (F.col("a_idx") != F.col("b_idx")) & (geo.baseline_reason(A, B) == "ok"))
    return ok.groupBy("page", F.col("a_idx").alias("left_idx")).agg(F.min_by("b_idx", F.struct(B[0] - A[2], B[0], F.col("b_idx"))).alias("right_idx"))


LANE = "least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0 AND a.y1 - b.y2 BETWEEN -2 AND 14 AND b.y1 < a.y1"


@query(
    "jon14_next_line",
    f"SELECT a.page, a.idx AS line_idx, min_by(b.idx, (abs(a.y1 - b.y2), b.x1, b.idx)) AS next_idx FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx <> b.idx WHERE {LANE} GROUP BY 1, 2",
)
def _(t: Tables):
    lane = (F.least(A[2], B[2]) - F.greatest(A[0], B[0]) > 0) & (A[1] - B[3]).between(-2, 14) & (B[1] < A[1])
    return pairs(t, lane & (F.col("a_idx") != F.col("b_idx"))).groupBy("page", F.col("a_idx").alias("line_idx")).agg(F.min_by("b_idx", F.struct(F.abs(A[1] - B[3]), B[0], F.col("b_idx"))).alias("next_idx"))


@query(
    "jon15_best_left_neighbour",
    f"SELECT b.page, b.idx AS tail_idx, max_by(a.idx, (a.x2, a.idx)) AS left_idx FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx <> b.idx WHERE {REASON} = 'ok' GROUP BY 1, 2",
)
def _(t: Tables):
    ok = pairs(t, (F.col("a_idx") != F.col("b_idx")) & (geo.baseline_reason(A, B) == "ok"))
    return ok.groupBy("page", F.col("b_idx").alias("tail_idx")).agg(F.max_by("a_idx", F.struct(A[2], F.col("a_idx"))).alias("left_idx"))


CONTAINED = "b.x1 >= a.x1 - 2 AND b.y1 >= a.y1 - 2 AND b.x2 <= a.x2 + 2 AND b.y2 <= a.y2 + 2 AND a.idx <> b.idx AND (a.x2 - a.x1) > (b.x2 - b.x1)"


@query("jon16_rw7_subsumed", f"SELECT b.page, b.idx AS idx, max_by(a.idx, (a.x2 - a.x1, {INTER}, -a.idx)) AS anchor_idx FROM {NODES} a JOIN {NODES} b ON a.page = b.page WHERE {CONTAINED} GROUP BY 1, 2")
def _(t: Tables):
    inside = geo.contains(A, B, 2.0) & (F.col("a_idx") != F.col("b_idx")) & ((A[2] - A[0]) > (B[2] - B[0]))
    return pairs(t, inside).groupBy("page", F.col("b_idx").alias("idx")).agg(F.max_by("a_idx", F.struct(A[2] - A[0], geo.intersection(A, B), -F.col("a_idx"))).alias("anchor_idx"))


@query("rw7_remove_subsumed", f"SELECT n.page, n.idx FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {NODES} a JOIN {NODES} b ON a.page = b.page WHERE {CONTAINED} AND b.page = n.page AND b.idx = n.idx)")
def _(t: Tables):
    inside = geo.contains(A, B, 2.0) & (F.col("a_idx") != F.col("b_idx")) & ((A[2] - A[0]) > (B[2] - B[0]))
    gone = pairs(t, inside).select("page", F.col("b_idx").alias("idx")).distinct()
    return nodes(t).select("page", "idx").join(gone, ["page", "idx"], "left_anti")


@query(
    "jon17_nearest_record",
    f"""SELECT page, idx, other FROM (SELECT a.page, a.idx, b.idx AS other, row_number() OVER (PARTITION BY a.page, a.idx ORDER BY abs(b.idx - a.idx), b.idx) AS r FROM {NODES} a JOIN {NODES} b
        ON a.page = b.page AND b.idx BETWEEN a.idx - 2 AND a.idx + 2 AND a.idx <> b.idx AND b.x1 = a.x1) WHERE r = 1""",
)
def _(t: Tables):
    from paperloom.operators.relational import nearest_in_window

    n = nodes(t).select("page", "idx", "x1")
    return nearest_in_window(n, n, ["page", "x1"], "idx", 2, []).select("page", "idx", F.col("other_pos").alias("other"))


@query(
    "jon18_best_overlap",
    f"""WITH p AS (SELECT b.page, b.idx AS glyph, a.idx AS record, round({INTER} / {AREA.format(p='b')}, 9) AS share, abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) AS dx, abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) AS dy,
            (b.x1 + b.x2) / 2 BETWEEN a.x1 - 0.8 AND a.x2 + 0.8 AND (b.y1 + b.y2) / 2 BETWEEN a.y1 - 0.8 AND a.y2 + 0.8 AS holds FROM {NODES} a JOIN {NODES} b ON a.page = b.page AND a.idx <> b.idx AND a.y1 <= b.y2 + 0.8 AND b.y1 <= a.y2 + 0.8)
        SELECT page, glyph, coalesce(max_by(record, (share, -record)) FILTER (WHERE share >= 0.55), min_by(record, (dx, dy, record)) FILTER (WHERE holds)) AS record FROM p WHERE share >= 0.55 OR holds GROUP BY 1, 2""",
)
def _(t: Tables):
    """Each box and the other box of its page that covers most of it, 55 % at least, else the one whose middle is nearest of those that hold its own."""
    share, near = F.round(geo.overlap_ratio(B, A), 9), [F.abs((A[k] + A[k + 2]) / 2 - (B[k] + B[k + 2]) / 2) for k in (0, 1)]
    holds = geo.contains_point((A[0] - 0.8, A[1] - 0.8, A[2] + 0.8, A[3] + 0.8), (B[0] + B[2]) / 2, (B[1] + B[3]) / 2)
    hit = banded_pairs(nodes(t), 0.8).where((share >= 0.55) | holds)
    best = F.max_by(F.when(share >= 0.55, F.col("a_idx")), F.when(share >= 0.55, F.struct(share, -F.col("a_idx"))))
    nearest = F.min_by(F.when(holds, F.col("a_idx")), F.when(holds, F.struct(*near, F.col("a_idx"))))
    return hit.groupBy("page", F.col("b_idx").alias("glyph")).agg(F.coalesce(best, nearest).alias("record"))


# ---- guards --------------------------------------------------------------------------------

GUARD_CASE = """CASE WHEN a.region IS NULL OR b.region IS NULL THEN 'missing_layout_region' WHEN a.region = 'unknown' OR b.region = 'unknown' THEN 'unknown_region'
    WHEN a.region <> 'body_column' OR b.region <> 'body_column' THEN 'non_body_region' WHEN a.column_id IS DISTINCT FROM b.column_id THEN 'cross_column' ELSE '{ok}' END"""


def guarded(t: Tables, step: int = 1):
    r = regions(t)
    a = r.select("page", "idx", F.col("region").alias("lr"), F.col("column_id").alias("lc"))
    b = r.select("page", (F.col("idx") - step).alias("idx"), F.col("region").alias("rr"), F.col("column_id").alias("rc"))
    yes = F.lit(True)
    return a.join(b, ["page", "idx"]).withColumn("guard", geo.merge_guard(F.col("page"), F.col("page"), F.col("lr"), F.col("rr"), F.col("lc"), F.col("rc"), yes, yes))


@query("grd1_merge_guard", f"WITH r AS ({REGIONS_SQL}) SELECT reason, CASE WHEN reason = 'same_body_column' THEN 'allowed' ELSE 'rejected' END AS decision, count(*) AS n FROM (SELECT {GUARD_CASE.format(ok='same_body_column')} AS reason FROM r a JOIN r b ON a.page = b.page AND b.idx = a.idx + 1) GROUP BY 1, 2")
def _(t: Tables):
    return guarded(t).groupBy("guard.reason", "guard.decision").agg(F.count(F.lit(1)).alias("n"))


@query("grd3_remove_guard", f"WITH r AS ({REGIONS_SQL}) SELECT reason, count(*) AS n FROM (SELECT {GUARD_CASE.format(ok='same_body_column_duplicate')} AS reason FROM r a JOIN r b ON a.page = b.page AND b.idx = a.idx + 2) GROUP BY 1")
def _(t: Tables):
    reason = F.col("guard.reason")
    return guarded(t, 2).groupBy(F.when(reason == "same_body_column", "same_body_column_duplicate").otherwise(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "grd4_collapse_guard",
    f"""WITH r AS ({REGIONS_SQL}), n AS (SELECT n.*, r.region, r.column_id FROM {NODES} n JOIN r ON r.page = n.page AND r.idx = n.idx),
        g AS (SELECT a.page, a.idx, b.idx AS other, {GUARD_CASE.format(ok='ok')} AS reason FROM n a JOIN n b ON a.page = b.page AND a.idx < b.idx AND a.y1 <= b.y2 AND b.y1 <= a.y2
              WHERE (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least({HEIGHTS}) >= 0.62 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0)
        SELECT page, idx, count(*) AS absorbed, coalesce(min_by(CASE WHEN reason <> 'ok' THEN reason END, CASE WHEN reason <> 'ok' THEN other END), 'same_body_column_overlap') AS reason FROM g GROUP BY 1, 2""",
)
def _(t: Tables):
    """Each box with the later ones that overlap it on its line; the first rejected one names the reason."""
    n = regions(t).select("page", "idx", "x1", "y1", "x2", "y2", "region", "column_id")
    height = lambda c: F.greatest(c[3] - c[1], F.lit(1.0))
    level = (F.least(A[3], B[3]) - F.greatest(A[1], B[1])) / F.least(height(A), height(B)) >= 0.62
    yes = F.lit(True)
    guard = geo.merge_guard(F.col("page"), F.col("page"), F.col("a_region"), F.col("b_region"), F.col("a_column_id"), F.col("b_column_id"), yes, yes)
    hit = banded_pairs(n, 0.0, ("region", "column_id")).where((F.col("a_idx") < F.col("b_idx")) & level & (F.least(A[2], B[2]) - F.greatest(A[0], B[0]) > 0)).withColumn("g", guard)
    bad = F.col("g.decision") == "rejected"
    first = F.coalesce(F.min_by(F.when(bad, F.col("g.reason")), F.when(bad, F.col("b_idx"))), F.lit("same_body_column_overlap"))
    return hit.groupBy("page", F.col("a_idx").alias("idx")).agg(F.count(F.lit(1)).alias("absorbed"), first.alias("reason"))


@query(
    "txt1_words_to_lines",
    "SELECT page, line_y, string_agg(w, ' ' ORDER BY x1, x2, w) AS line FROM (SELECT page, y1 AS line_y, x1, x2, CAST(part_key AS VARCHAR) AS w FROM {boxes}) GROUP BY page, line_y",
)
def _(t: Tables):
    words = F.array_sort(F.collect_list(F.struct("x1", "x2", F.col("part_key").cast("string").alias("w"))))
    return t.boxes.groupBy("page", F.col("y1").alias("line_y")).agg(F.array_join(F.transform(words, lambda s: s["w"]), " ").alias("line"))


@query("agg7_ocr_lines", "SELECT order_key, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS words, string_agg(CAST(part_key AS VARCHAR), ' ' ORDER BY x1, part_key, supp_key) AS line FROM {boxes} GROUP BY 1, 2")
def _(t: Tables):
    """A line's outline and its words from left to right."""
    words = F.array_sort(F.collect_list(F.struct("x1", "part_key", "supp_key")))
    outline = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("words")]
    return t.boxes.groupBy("order_key", "line_no").agg(*outline, F.array_join(F.transform(words, lambda w: w["part_key"].cast("string")), " ").alias("line"))


@query("agg12_text_coverage", "SELECT page, round(sum((x2 - x1) * (y2 - y1)) / 484704.0, 4) AS coverage FROM {boxes} GROUP BY page")
def _(t: Tables):
    return t.boxes.groupBy("page").agg(F.round(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 484704.0, 4).alias("coverage"))


@query("agg13_overflow", "SELECT page, count_if(x2 > 585 OR y2 > 712) AS overflow_blocks FROM {boxes} GROUP BY ROLLUP(page)")
def _(t: Tables):
    return t.boxes.rollup("page").agg(F.count_if((F.col("x2") > 585) | (F.col("y2") > 712)).alias("overflow_blocks"))


@query("dup5_dup6_rect_dedup", "SELECT DISTINCT page, CAST(floor(x1 + 0.5) AS BIGINT) AS rx, CAST(floor(y1 + 0.5) AS BIGINT) AS ry, font FROM {boxes}")
def _(t: Tables):
    return t.boxes.select("page", F.floor(F.col("x1") + 0.5).alias("rx"), F.floor(F.col("y1") + 0.5).alias("ry"), "font").distinct()


@query("ord4_reading_order", f"SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY -y2, x1, -y1, idx) AS place FROM {NODES}")
def _(t: Tables):
    w = W.partitionBy("page").orderBy(-F.col("y2"), "x1", -F.col("y1"), "idx")
    return nodes(t).select("page", "idx", F.row_number().over(w).cast("long").alias("place"))


@query("ord5_samples", f"SELECT page, idx FROM (SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY idx) AS r FROM {NODES}) WHERE r <= 8")
def _(t: Tables):
    return nodes(t).select("page", "idx").where("idx <= 8")


@query("spl2_line_slices", "SELECT order_key, line_no, x1, part_key, supp_key, x2, y1, y2, y2 - (y2 - y1) * CAST(coalesce(before, 0) AS DOUBLE) / total AS slice_top FROM (SELECT *, sum(line_no) OVER (PARTITION BY order_key ORDER BY line_no, x1, part_key, supp_key, x2, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(line_no) OVER (PARTITION BY order_key) AS total FROM {boxes})")
def _(t: Tables):
    w = W.partitionBy("order_key")
    before = F.sum("line_no").over(w.orderBy("line_no", "x1", "part_key", "supp_key", "x2", "y1").rowsBetween(W.unboundedPreceding, -1))
    top = F.col("y2") - (F.col("y2") - F.col("y1")) * F.coalesce(before, F.lit(0)).cast("double") / F.sum("line_no").over(w)
    return t.boxes.select("order_key", "line_no", "x1", "part_key", "supp_key", "x2", "y1", "y2", top.alias("slice_top"))


@query("vrt1_vertical_candidates", f"SELECT page, idx, y2 - y1 > (x2 - x1) * 0.6 AS tall, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM {NODES}")
def _(t: Tables):
    return nodes(t).select("page", "idx", (F.col("y2") - F.col("y1") > (F.col("x2") - F.col("x1")) * 0.6).alias("tall"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))


@query("xls1_pixel_sizes", "SELECT DISTINCT l_partkey, l_quantity, CAST(least(greatest(floor(l_quantity * 7 + 6 + 0.5), 44), 280) AS BIGINT) AS width_px, CAST(least(greatest(floor(l_quantity * 4 / 3 + 0.5), 22), 120) AS BIGINT) AS height_px FROM lineitem")
def _(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select("l_partkey", "l_quantity", F.least(F.greatest(F.floor(q * 7 + 6 + 0.5), F.lit(44)), F.lit(280)).alias("width_px"), F.least(F.greatest(F.floor(q * 4 / 3 + 0.5), F.lit(22)), F.lit(120)).alias("height_px")).distinct()


@query("src4_table_density", "SELECT sheet, row_count, column_count, cells, row_count >= 2 AND column_count >= 2 AND cells >= 3 AND CAST(cells AS DOUBLE) / (row_count * column_count) >= 0.5 AS accepted FROM (SELECT s_nationkey AS sheet, count(DISTINCT s_suppkey % 7) AS row_count, count(DISTINCT s_suppkey % 5) AS column_count, count(DISTINCT (s_suppkey % 7) * 10 + s_suppkey % 5) AS cells FROM supplier GROUP BY 1)")
def _(t: Tables):
    r, c = F.col("s_suppkey") % 7, F.col("s_suppkey") % 5
    g = t.supplier.groupBy(F.col("s_nationkey").alias("sheet")).agg(F.countDistinct(r).alias("row_count"), F.countDistinct(c).alias("column_count"), F.countDistinct(r * 10 + c).alias("cells"))
    ok = (F.col("row_count") >= 2) & (F.col("column_count") >= 2) & (F.col("cells") >= 3) & (F.col("cells").cast("double") / (F.col("row_count") * F.col("column_count")) >= 0.5)
    return g.withColumn("accepted", ok)
