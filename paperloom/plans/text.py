"""Queries over texts: repetition, string rules, segmentation, with oracle SQL where RE2 and DuckDB can say them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import labels
from paperloom.operators import dedup, folds
from paperloom.plans.registry import query
from paperloom.sources.tables import Tables, dealt

LINES = "(SELECT doc_id, n, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, p, len(p) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents)))"
CANON = r"lower(regexp_replace(line, '[ \t\r\n\f\v]+', '', 'g'))"
BAND = "(pos < greatest(n // 10, 1) OR pos >= n - greatest(n // 10, 1))"

REPEATED_SQL = f"""WITH l AS (SELECT doc_id, {CANON} AS canon, {BAND} AS edge FROM {LINES})
    SELECT 'repeated-edge:' || substr(sha1(canon), 1, 12) AS group_id, canon, count(DISTINCT doc_id) AS pages, count(*) AS hits, count_if(edge) AS edge_hits FROM l
    WHERE length(canon) BETWEEN 3 AND 160 AND regexp_matches(canon, '\\p{{L}}') GROUP BY canon HAVING count(DISTINCT doc_id) >= 3 AND count_if(edge) * 1.0 / count(*) >= 0.8"""


def edge_lines(t: Tables):
    """Documents stand in for pages; the first and last tenth of their lines for the edge band."""
    lines = dedup.numbered_lines(t.documents, "doc_id", "text")
    reach = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    return lines.withColumn("canon", F.lower(F.regexp_replace("line", "\\s+", ""))).withColumn("edge", (F.col("pos") < reach) | (F.col("pos") >= F.col("n") - reach))


@query("dup3_repeated_edge_text", REPEATED_SQL)
def repeated_edge(t: Tables):
    return dedup.repeated_edge_text(edge_lines(t), "doc_id", F.col("canon"), F.col("edge"))


@query("dup1_content_groups", "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def _(t: Tables):
    return dedup.content_groups(t.documents, "doc_id", "text")


@query("dup2_distinct_lines")
def _(t: Tables):
    """All four rules, including near-equal lines; ordered state per text, so a vectorised function."""
    return t.documents.select("doc_id", folds.without_repeated_lines("text").alias("cleaned"))


@query(
    "dup2_exact_long_lines",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), k AS (SELECT *, regexp_replace(line, '[ \t\r\n\f\v]+', '', 'g') AS bare FROM l)
        SELECT doc_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bare ORDER BY pos) AS r FROM k) WHERE r = 1 OR length(bare) < 8 GROUP BY doc_id""",
)
def _(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bare", F.regexp_replace("line", "\\s+", ""))
    # Kept lines per document: distinct long ones and all short ones; two counts, no sort.
    per = lines.groupBy("doc_id", "bare").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id").agg(F.sum(F.when(F.length("bare") >= 8, 1).otherwise(F.col("n"))).alias("kept"))


@query(
    "dup4_leader_sync",
    f"""WITH l AS (SELECT doc_id, pos, {CANON} AS canon, {BAND} AS edge, line FROM {LINES}), g AS (SELECT canon, min_by(line, (doc_id, pos)) AS leader FROM l WHERE edge GROUP BY canon)
        SELECT l.doc_id, l.pos, coalesce(leader, line) AS value_now FROM l LEFT JOIN g ON l.canon = g.canon""",
)
def _(t: Tables):
    rows = edge_lines(t).withColumn("at", F.struct("doc_id", "pos"))
    return dedup.leader_values(rows, "canon", "at", "line", F.col("edge")).select("doc_id", F.col("pos").cast("long").alias("pos"), "value_now")


@query("rw10_reconcile_edges", f"WITH g AS ({REPEATED_SQL}) SELECT l.doc_id, l.pos, g.group_id FROM (SELECT doc_id, pos, {CANON} AS canon FROM {LINES} WHERE {BAND}) l JOIN g ON l.canon = g.canon")
def _(t: Tables):
    groups = repeated_edge(t).select("group_id", "canon")
    return dedup.apart(edge_lines(t).where("edge"), groups, ["canon"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "group_id")


@query("dup8_block_noise")
def _(t: Tables):
    """Lines of all documents, and per document how many are noise."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(folds.block_noise("line")).alias("noise"))


# ---- string rules on fixtures --------------------------------------------------------------


@query("str4_win10_chunks")
def _(t: Tables):
    """Whole lines up to 1800 characters; a longer line stays whole. The pieces joined give the text."""
    return t.documents.select("doc_id", "text", F.posexplode(folds.chunks(F.col("text"), 1800)).alias("piece", "chunk")).select("doc_id", "piece", "chunk")


@query("win11_sections")
def _(t: Tables):
    return folds.sections(t.documents)


@query("str5_split_into", "SELECT doc_id, len(p) AS given, coalesce(p[1], '') AS first, coalesce(p[2], '') AS second, array_to_string(p[3:], chr(10)) AS rest FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def _(t: Tables):
    p = F.split("text", "\n")
    given = F.size(p)
    return t.documents.select(
        "doc_id", given.cast("long").alias("given"), F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")).alias("first"), F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")).alias("second"), F.array_join(F.slice(p, 3, given), "\n").alias("rest")
    )


@query("str6_str7_protect_tokens")
def _(t: Tables):
    """All documents: tokens, a digest of the protected text, and whether restoring gives the text back."""
    from paperloom.operators.tokens import protect, restored

    v = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", protect("text").alias("p"))
    return v.select("doc_id", F.size("p.tokens").cast("long").alias("tokens"), F.sha2("p.text", 256).alias("protected_sha256"), restored("p").eqNullSafe(F.col("text")).alias("restored"))


@query("rw16_protected_tokens")
def _(t: Tables):
    """The tokens that were protected, by how often they occur in all documents."""
    from paperloom.operators.tokens import tokens_of

    # explode would ask for the array twice, once to leave out empty ones.
    tokens = dealt(t.documents.select("doc_id", "text"), "doc_id").select(F.explode_outer(tokens_of("text")).alias("token")).where("token IS NOT NULL")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


#: Each part gets a font name; its number stands in for the traits that are stored so far.
FONT_NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'ABCDEF+Arial-BoldMT' WHEN 1 THEN 'CourierNew' WHEN 2 THEN 'Times-Roman' WHEN 3 THEN 'Noto Sans Mono' WHEN 4 THEN 'Georgia,BoldItalic' WHEN 5 THEN 'F1' WHEN 6 THEN '' WHEN 7 THEN 'SourceHanSerif-Heavy' END"
_SAYS = lambda words: f"CAST(regexp_matches(bare, '{'|'.join(words)}') AS INTEGER)"


@query(
    "rw13_font_traits",
    f"""WITH n AS (SELECT p_partkey, regexp_replace(lower({FONT_NAMES}), '[^a-z0-9]+', '', 'g') AS bare, p_size % 2 AS was_bold FROM part),
    f AS (SELECT p_partkey, was_bold, {_SAYS(labels.BOLD_NAMES)} AS bold, {_SAYS(labels.ITALIC_NAMES)} AS italic, {_SAYS(labels.MONO_NAMES)} AS monospace, CASE WHEN {_SAYS(labels.SANS_NAMES)} = 1 THEN 0 WHEN {_SAYS(labels.SERIF_NAMES)} = 1 THEN 1 END AS serif FROM n)
    SELECT p_partkey, bold, italic, monospace, serif, bold <> was_bold AS changed FROM f WHERE serif IS NOT NULL OR bold + italic + monospace > 0""",
)
def _(t: Tables):
    fonts = t.part.select("p_partkey", F.expr(FONT_NAMES).alias("name"), (F.col("p_size") % 2).alias("was_bold")).withColumn("told", labels.font_traits(F.col("name")))
    return fonts.where("told IS NOT NULL").select("p_partkey", "told.*", (F.col("told.bold") != F.col("was_bold")).alias("changed"))


@query("str17_language_codes", "SELECT lang, count(*) AS n FROM (SELECT lower(trim(lang)) AS lang FROM documents) GROUP BY lang")
def _(t: Tables):
    return t.documents.groupBy(labels.language_code(F.col("lang"), {}).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "str18_flt14_line_shapes",
    rf"""SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, '^[0-9\s.,:;%()+/-]+$')) AS numeric_lines, count_if(regexp_matches(line, '[.!?]["'')]*$')) AS sentence_ends, count_if(regexp_matches(line, '^[a-z]')) AS lower_starts,
         count_if(regexp_matches(line, '^[A-Z0-9 ._/-]{{2,24}}$')) AS upper_short, count_if(regexp_matches(line, '^[ivxlcIVXLC]+$')) AS roman, count_if(regexp_matches(line, '\.{{4,}}')) AS dot_leaders FROM {LINES} GROUP BY doc_id""",
)
def _(t: Tables):
    lines = dedup.numbered_lines(t.documents, "doc_id", "text")
    shape = lambda p: F.count_if(F.col("line").rlike(p))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        shape(r"^[0-9\s.,:;%()+/-]+$").alias("numeric_lines"),
        shape("[.!?][\"')]*$").alias("sentence_ends"),
        shape("^[a-z]").alias("lower_starts"),
        shape("^[A-Z0-9 ._/-]{2,24}$").alias("upper_short"),
        shape("^[ivxlcIVXLC]+$").alias("roman"),
        shape(r"\.{4,}").alias("dot_leaders"),
    )


@query("str20_error_summary", r"SELECT page_id, substr(regexp_replace(trim(html, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\r\n\f\v]+', ' ', 'g'), 1, 600) AS summary FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", F.substring(F.regexp_replace(F.regexp_replace("html", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "\\s+", " "), 1, 600).alias("summary"))


@query("str21_term_prompt", "SELECT lang, 'Use: ' || string_agg(source || '=' || n, '; ' ORDER BY source) AS prompt FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def _(t: Tables):
    n = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda s: F.concat(s["source"], F.lit("="), s["n"].cast("string")))
    return n.groupBy("lang").agg(F.concat(F.lit("Use: "), F.array_join(terms, "; ")).alias("prompt"))


@query("str22_cell_ids", "SELECT DISTINCT 'p' || (l_orderkey // 8) || '_t' || l_linenumber || '_r' || (l_partkey % 9) || '_c' || (l_suppkey % 5) AS cell_id FROM lineitem")
def _(t: Tables):
    return t.lineitem.select(F.format_string("p%d_t%d_r%d_c%d", F.floor(F.col("l_orderkey") / 8), F.col("l_linenumber"), F.col("l_partkey") % 9, F.col("l_suppkey") % 5).alias("cell_id")).distinct()


# ---- rewrites that expressions can state ---------------------------------------------------


@query(
    "rw11_body_sizes",
    """WITH m AS (SELECT page, min(size) AS median FROM (SELECT page, size, sum(w) OVER (PARTITION BY page ORDER BY size ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY page) AS total FROM (SELECT page, size, sum(x2 - x1) AS w FROM {boxes} GROUP BY 1, 2)) WHERE run >= total / 2 GROUP BY 1)
       SELECT b.page, count(*) AS runs, count_if(NOT (abs(size - median) <= 0.15 OR abs(size - median) <= 0.02 * greatest(size, median))) AS changed FROM {boxes} b JOIN m ON b.page = m.page GROUP BY 1""",
)
def _(t: Tables):
    from paperloom.operators.windows import weighted_median

    boxes = t.boxes.withColumn("w", F.col("x2") - F.col("x1"))
    median = weighted_median(boxes, ["page"], "size", "w")
    off = F.abs(F.col("size") - F.col("median"))
    close = (off <= 0.15) | (off <= 0.02 * F.greatest("size", "median"))
    return boxes.join(median, "page").groupBy("page").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~close).alias("changed"))


@query("rw12_body_scales")
def _(t: Tables):
    """Per page and lane: min(0.88, 35 % quantile) of the scales, for lanes of three or more boxes."""
    from paperloom.plans.layout import nodes

    n = nodes(t)
    scaled = folds.scale_lanes(n).join(n.select("page", "idx", (0.5 + F.col("x2") % 5 / 10).alias("scale")), ["page", "idx"])
    return scaled.groupBy("page", "lane").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(0.88), F.percentile("scale", F.lit(0.35))).alias("target")).where("n >= 3")


@query("rw15_skip_translation", r"SELECT doc_id, count(*) AS skipped FROM " + LINES + r" WHERE regexp_matches(line, '^[0-9\s.,:;%()+/-]+$') OR length(trim(line)) <= 2 GROUP BY doc_id")
def _(t: Tables):
    lines = dedup.numbered_lines(t.documents, "doc_id", "text")
    return lines.where(F.col("line").rlike(r"^[0-9\s.,:;%()+/-]+$") | (F.length(F.trim("line")) <= 2)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("skipped"))


@query(
    "rw1_first_match_roles",
    rf"""SELECT doc_id, pos, CASE WHEN regexp_matches(line, '\.{{4,}}\s*[0-9]+$') THEN 'toc_entry' WHEN {BAND} AND length(line) <= 24 THEN 'edge_metadata' WHEN regexp_matches(line, '^[0-9\s.,:;%()+/-]+$') THEN 'preserve' WHEN regexp_matches(line, '^[A-Z0-9 ._/-]{{2,24}}$') THEN 'technical' ELSE 'body' END AS role FROM {LINES}""",
)
def _(t: Tables):
    lines = edge_lines(t)
    line = F.col("line")
    role = (
        F.when(line.rlike(r"\.{4,}\s*[0-9]+$"), "toc_entry")
        .when(F.col("edge") & (F.length(line) <= 24), "edge_metadata")
        .when(line.rlike(r"^[0-9\s.,:;%()+/-]+$"), "preserve")
        .when(line.rlike("^[A-Z0-9 ._/-]{2,24}$"), "technical")
        .otherwise("body")
    )
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), role.alias("role"))


# ---- folds over boxes ----------------------------------------------------------------------


def _nodes(t: Tables):
    from paperloom.plans.layout import nodes

    return nodes(t)


@query("fold_center_segments")
def _(t: Tables):
    n = _nodes(t).withColumn("cx", (F.col("x1") + F.col("x2")) / 2)
    return folds.running_mean_segments(n, "cx", 7.0)


@query("win6_visual_lines")
def _(t: Tables):
    return folds.running_mean_segments(_nodes(t).withColumn("cy", (F.col("y1") + F.col("y2")) / 2), "cy")


@query("win7_growing_lines")
def _(t: Tables):
    return folds.growing_lines(_nodes(t))


@query("rw4_rw8_merge_same_line")
def _(t: Tables):
    return folds.greedy_line_merge(_nodes(t), horizontal=True)


@query("rw5_merge_contiguous_lines")
def _(t: Tables):
    return folds.greedy_line_merge(_nodes(t), horizontal=False)


@query("geo5_rw2_overlap_clusters")
def _(t: Tables):
    return folds.overlap_clusters(_nodes(t))


@query("geo16_scale_lanes")
def _(t: Tables):
    return folds.scale_lanes(_nodes(t))


@query("src7_run_coalescing", "WITH r AS (SELECT l_orderkey AS paragraph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS run, l_returnflag AS format FROM lineitem), c AS (SELECT *, CASE WHEN lag(format) OVER (PARTITION BY paragraph ORDER BY run) = format THEN 0 ELSE 1 END AS opens FROM r) SELECT paragraph, span, min(format) AS format, count(*) AS runs FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY paragraph ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM c) GROUP BY 1, 2")
def _(t: Tables):
    from paperloom.operators.windows import islands

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    w = W.partitionBy("l_orderkey").orderBy(*order)
    changed = F.lag("l_returnflag").over(w) != F.col("l_returnflag")
    got = islands(t.lineitem.select("l_orderkey", "l_returnflag", *order), ["l_orderkey"], order, changed, "span")
    return got.groupBy(F.col("l_orderkey").alias("paragraph"), F.col("span").cast("long").alias("span")).agg(F.min("l_returnflag").alias("format"), F.count(F.lit(1)).alias("runs"))


@query("src8_text_cells", "SELECT page_id, url FROM pages WHERE url IS NOT NULL AND trim(url) <> '' AND left(url, 1) <> '='")
def _(t: Tables):
    return t.pages.where("url IS NOT NULL AND trim(url) <> '' AND left(url, 1) <> '='").select("page_id", "url")


@query("rec1_records", f"SELECT doc_id AS page, pos, length(line) AS chars FROM {LINES}")
def _(t: Tables):
    return dedup.numbered_lines(t.documents, "doc_id", "text").select(F.col("doc_id").alias("page"), F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("chars"))


@query("agg29_repeated_per_page", f"SELECT {CANON} AS canon, count(DISTINCT doc_id) AS pages FROM {LINES} GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def _(t: Tables):
    return edge_lines(t).select("canon", "doc_id").distinct().groupBy("canon").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
