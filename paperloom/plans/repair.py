"""Queries that rebuild texts and labels from glyphs and boxes, and small state decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import axis, blocks, folds, glyphs, input_text, label_lines, model
from paperloom.plans.layout import NODES, nodes
from paperloom.plans.registry import query
from paperloom.sources.fragments import LABEL_ITEM, LABEL_TEXT, axis_glyphs, axis_scales, fragments, label_items, translator_inputs
from paperloom.sources.fragments import label_lines as line_glyphs
from paperloom.sources.tables import Tables, dealt


GLYPHS = f"""(SELECT page, line, k AS idx, substr(t, k + 1, 1) AS ch, x0 + 4 * k AS x1, x0 + 4 * k + 4 AS x2, 7.0 AS size, substr(t, k + 1, 1) IN ('W', 'm') AS symbol
    FROM (SELECT l_orderkey AS page, {LABEL_ITEM} AS line, {LABEL_TEXT} AS t, CAST(40 + (l_linenumber - 1) % 3 * 62 + l_partkey % 5 AS DOUBLE) AS x0, unnest(range(length({LABEL_TEXT}))) AS k FROM lineitem) WHERE substr(t, k + 1, 1) <> ' ')"""
GAP_SQL = """WITH g AS (SELECT *, lag(x2) OVER w AS px, lag(ch) OVER w AS pc, lag(ch, 2) OVER w AS ppc, lead(ch) OVER w AS nc FROM {v} WINDOW w AS (PARTITION BY page, line ORDER BY x1, idx)),
     s AS (SELECT *, x1 - px > 0 AND x1 - px >= greatest(1.8, 0.22 * size) AND ch NOT IN ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}')
        AND NOT coalesce((regexp_matches(pc, '^[0-9]$') AND ch IN ('.', ',') AND regexp_matches(nc, '^[0-9]$')) OR (pc IN ('.', ',') AND regexp_matches(ch, '^[0-9]$') AND regexp_matches(ppc, '^[0-9]$')), FALSE) AS gap FROM g)
     SELECT page, line, string_agg(CASE WHEN gap THEN ' ' ELSE '' END || ch, '' ORDER BY x1, idx) AS text FROM s GROUP BY 1, 2"""
UNITS_SQL = """(SELECT page, line, idx, x1, x2, size, CASE WHEN symbol AND ch = 'm' AND lead(ch) OVER w IN ('F', 'A', 'V', 's', 'S') AND (lead(x1) OVER w - x2 < -0.7 OR lead(x1) OVER w - x2 <= greatest(1.8, 0.32 * size)) THEN 'µ'
     WHEN symbol AND ch = 'W' AND regexp_matches(lag(ch) OVER w, '[0-9kKM]') AND (x1 - lag(x2) OVER w < -0.7 OR x1 - lag(x2) OVER w <= greatest(1.8, 0.32 * size)) THEN 'Ω' ELSE ch END AS ch FROM {v} WINDOW w AS (PARTITION BY page, line ORDER BY x1, idx))"""


@query("spl1_implied_spaces", GAP_SQL.format(v=GLYPHS))
def _(t: Tables):
    return glyphs.texts_of_lines(line_glyphs(t.lineitem))


@query("str19_symbol_units", GAP_SQL.format(v=UNITS_SQL.format(v=GLYPHS)))
def _(t: Tables):
    return glyphs.texts_of_lines(glyphs.with_units_of_lines(line_glyphs(t.lineitem)))


@query("spl1_split_labels")
def _(t: Tables):
    """Labels of drawings as the lines that they fall into, with ids that name the paragraph."""
    return label_lines.split_lines(label_items(t.lineitem), together=True)


@query("spl1_split_counts")
def _(t: Tables):
    """Paragraphs by the number of parts, and how many of the parts' texts were written anew."""
    parts = label_lines.split_lines(label_items(t.lineitem), together=True).groupBy("paragraph").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("text").rlike("[µΩ]")).alias("repaired"))
    return parts.groupBy("parts").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("repaired").alias("repaired"))


@query("str19_token_merge")
def _(t: Tables):
    """Each document's lines with their tokens joined as those of labels are: how many joins, and a digest."""
    d = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", label_lines.joined_lines("text").alias("joined"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")
    return d.select("doc_id", (words("text") - words("joined")).alias("joins"), F.sha2("joined", 256).alias("joined_sha256"))


@query(
    "geo14_superscript_host",
    f"""SELECT s.page, s.idx, min_by(h.idx, (greatest(h.x1 - s.x2, s.x1 - h.x2, 0.0) + abs(s.y2 - h.y2), h.idx)) AS host FROM {NODES} s JOIN {NODES} h ON s.page = h.page AND s.idx <> h.idx
        WHERE s.y2 - s.y1 <= 9 AND h.y2 - h.y1 > 9 AND s.y1 >= (h.y1 + h.y2) / 2 - 1 AND s.y1 <= h.y2 + 2 AND greatest(h.x1 - s.x2, s.x1 - h.x2, 0.0) <= 6 GROUP BY 1, 2""",
)
def _(t: Tables):
    n = nodes(t)
    return glyphs.superscript_hosts(n.where("y2 - y1 <= 9"), n.where("y2 - y1 > 9"))


@query("geo11_vertical_labels")
def _(t: Tables):
    return glyphs.vertical_labels(nodes(t))


@query("geo15_evt3_axis_reasons", f"SELECT page, idx, CASE WHEN y2 - y1 > (x2 - x1) * 0.6 THEN 'tall;' ELSE '' END || CASE WHEN x2 - x1 <= 14 THEN 'narrow;' ELSE '' END || CASE WHEN x1 <= 36.72 THEN 'left_edge;' ELSE '' END AS reasons FROM {NODES} WHERE y2 - y1 > (x2 - x1) * 0.6 OR x2 - x1 <= 14 OR x1 <= 36.72")
def _(t: Tables):
    tests = [("tall", F.col("y2") - F.col("y1") > (F.col("x2") - F.col("x1")) * 0.6), ("narrow", F.col("x2") - F.col("x1") <= 14), ("left_edge", F.col("x1") <= 36.72)]
    reasons = F.filter(F.array(*(F.when(test, F.lit(name + ";")) for name, test in tests)), lambda r: r.isNotNull())
    return nodes(t).withColumn("r", reasons).where(F.size("r") > 0).select("page", "idx", F.array_join("r", "").alias("reasons"))


@query("geo15_axis_labels")
def _(t: Tables):
    """Runs of glyphs that stand upright, and why they are or aren't axis labels."""
    return axis.axis_labels(axis_glyphs(t.documents))


@query("geo15_label_counts")
def _(t: Tables):
    found = axis.axis_labels(axis_glyphs(t.documents))
    return found.groupBy(F.coalesce("rejected", F.lit("label")).alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.sum("glyphs").alias("glyphs"))


@query("geo15_axis_ticks")
def _(t: Tables):
    """Numbers of the scales above horizontal axis labels."""
    return axis.axis_ticks(*axis_scales(t.documents))


@query("rw3_split_visual_lines")
def _(t: Tables):
    """Each page's boxes as visual lines, with part ids; lines of one box keep the paragraph's id."""
    lines = folds.growing_lines(nodes(t))
    parts = lines.groupBy("page", "line").agg(F.count(F.lit(1)).alias("items"), F.min("idx").alias("first"))
    return parts.select("page", "line", "items", F.when(F.col("items") > 1, F.concat(F.col("page").cast("string"), F.lit(":vline:"), F.col("line").cast("string"))).otherwise(F.col("page").cast("string")).alias("part_id"))


def parsed_paragraphs(t: Tables):
    """Fragments of the documents' pages as a parser may group them: the end of every other row goes with the row below."""
    row, piece = F.floor(F.col("idx") / 3), F.col("idx") % 3
    own = F.floor(row / 2) * 2 + F.when((row % 2 == 0) & (piece < 2), 0).otherwise(1)
    return fragments(t.documents).select("page", own.cast("long").alias("paragraph"), "idx", "x1", "y1", "x2", "y2", "text")


@query("rw6_wrapped_tails")
def _(t: Tables):
    """Paragraphs whose first line is the end of their left neighbour's, split line by line; parts name the paragraph they come from."""
    return blocks.split_tails(parsed_paragraphs(t))


@query(
    "rw6_same_line_counts",
    "SELECT a.page, a.line_y, count(*) AS tails FROM (SELECT page, y1 AS line_y, min(x1) AS x1, max(x2) AS x2 FROM {boxes} GROUP BY 1, 2) a JOIN (SELECT page, y1 AS line_y, x1 FROM {boxes}) b ON a.page = b.page AND b.line_y < a.line_y AND a.line_y - b.line_y <= 18 AND b.x1 <= a.x1 + 6 GROUP BY 1, 2",
)
def _(t: Tables):
    # Boxes at most 18 lower lie in the same band of 18 or the one below: an equi join on page and band.
    band = F.floor(F.col("y1") / 18)
    lines = t.boxes.groupBy("page", F.col("y1").alias("line_y")).agg(F.min("x1").alias("first_x")).withColumn("band", F.explode(F.array(F.floor(F.col("line_y") / 18), F.floor(F.col("line_y") / 18) - 1)))
    below = t.boxes.select("page", "y1", "x1", band.alias("band"))
    down = F.col("line_y") - F.col("y1")
    return lines.join(below, ["page", "band"]).where((down > 0) & (down <= 18) & (F.col("x1") <= F.col("first_x") + 6)).groupBy("page", "line_y").agg(F.count(F.lit(1)).alias("tails"))


@query("str23_txt5_choose_input")
def _(t: Tables):
    """What the translator gets for each document's sentence, and by which branch."""
    rows = translator_inputs(t.documents)
    return rows.withColumn("chosen", input_text.chosen("source", "current", "placeholders", "items")).select("doc_id", "current", "chosen.text", "chosen.branch")


@query("str23_branches")
def _(t: Tables):
    rows = translator_inputs(t.documents).select(input_text.chosen("source", "current", "placeholders", "items").alias("c"), F.col("current"))
    return rows.groupBy("c.branch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c.text") != F.col("current")).alias("changed"))


@query("sty1_target_sizes", "SELECT page, order_key, line_no, part_key, supp_key, size, CASE WHEN abs(size - 6) <= 0.12 OR abs(size - 6) <= 0.02 * greatest(size, 6.0) THEN size ELSE 6.0 END AS target FROM {boxes}")
def _(t: Tables):
    off = F.abs(F.col("size") - 6)
    return t.boxes.select("page", "order_key", "line_no", "part_key", "supp_key", "size", F.when((off <= 0.12) | (off <= 0.02 * F.greatest("size", F.lit(6.0))), F.col("size")).otherwise(6.0).alias("target"))


@query("txt4_block_assembly")
def _(t: Tables):
    """Boxes that hang together as blocks: the union box and the members' number."""
    n = nodes(t)
    return folds.page_components(n).join(n, ["page", "idx"]).groupBy("page", "component").agg(F.count(F.lit(1)).alias("members"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def page_lines(t: Tables):
    """The boxes' lines, from the lower edge they share; a line's text begins with its lowest number, as an item of a list or not."""
    item = F.concat(F.min("line_no").cast("string"), F.when(F.min("part_key") % 10 == 0, ". item").otherwise(" item"))
    lines = t.boxes.groupBy("page", "y1").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), item.alias("text"))
    return lines.select("page", F.col("y1").cast("long").alias("idx"), "x1", "y1", "x2", "y2", "text")


@query("win12_block_split")
def _(t: Tables):
    """Blocks of each page's lines, and what opened each: a list item, a gap against the measured step, too many lines, too much height, an indent taken back."""
    return blocks.line_blocks(page_lines(t))


@query("win12_block_reasons")
def _(t: Tables):
    return blocks.line_blocks(page_lines(t)).groupBy("opened").agg(F.count(F.lit(1)).alias("blocks"), F.sum("lines").alias("lines"))


CLAIMS = "(SELECT event_id % 1500 AS job_id, user_id AS worker, event_id FROM events)"


@query("stm3_claims", f"SELECT j.job_id, min_by(c.worker, c.event_id) AS worker, count(*) AS tried FROM {{jobs}} j JOIN {CLAIMS} c ON j.job_id = c.job_id WHERE j.status = 'queued' AND NOT j.cancel_requested GROUP BY 1")
def _(t: Tables):
    """Of all claims of a queued job the first one wins, as a compare-and-set would let it."""
    claims = t.events.select((F.col("event_id") % 1500).alias("job_id"), F.col("user_id").alias("worker"), "event_id")
    return t.jobs.where("status = 'queued' AND NOT cancel_requested").select("job_id").join(claims, "job_id").groupBy("job_id").agg(F.min_by("worker", "event_id").alias("worker"), F.count(F.lit(1)).alias("tried"))


@query("prv1_schema_checks", "SELECT conv_id, count(*) AS turns, bool_and(role IN ('user', 'assistant', 'system')) AS roles_known, bool_or(length(text) = 0) AS some_empty, count(DISTINCT turn) = count(*) AS turns_unique FROM conversations GROUP BY 1")
def _(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("role").isin("user", "assistant", "system")).alias("roles_known"), F.bool_or(F.length("text") == 0).alias("some_empty"), (F.countDistinct("turn") == F.count(F.lit(1))).alias("turns_unique"))


@query("fmt7_upsert_reject", "SELECT coalesce(b.item_id, e.id) AS id, CASE WHEN b.item_id IS NULL THEN 'rejected' WHEN e.id IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome FROM benchmark b FULL OUTER JOIN (SELECT page_id * 3 AS id FROM pages) e ON b.item_id = e.id")
def _(t: Tables):
    edits = t.pages.select((F.col("page_id") * 3).alias("id"), F.lit(True).alias("edit"))
    known = t.benchmark.select(F.col("item_id").alias("id"), F.lit(True).alias("known"))
    return known.join(edits, "id", "full_outer").select("id", F.when(F.col("known").isNull(), "rejected").when(F.col("edit").isNull(), "unchanged").otherwise("updated").alias("outcome"))


@query("src13_model_answers")
def _(t: Tables):
    """A deterministic stand-in for the endpoint: the first try of every third text fails and is repeated."""

    def endpoint() -> object:
        failed: set[str] = set()

        def ask(text: str) -> str:
            if len(text) % 3 == 0 and text not in failed:
                failed.add(text)
                raise model.CallError(503)
            return f"[T]{text}"

        return ask

    return model.answers(t.benchmark, "item_id", "text", endpoint(), sleep=lambda s: None)
