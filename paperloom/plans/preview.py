"""Previews of translated files as nested results, placeholders and styles given back, decisions on scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators import restore
from paperloom.operators.tokens import protect_each
from paperloom.plans.layout import NODES, nodes
from paperloom.plans.metrics import FILE_KIND
from paperloom.plans.registry import query
from paperloom.plans.rules import GATES, STORED, Rows, _pairs, _pairs_sql
from paperloom.sources.tables import Tables, dealt

# ---- previews ------------------------------------------------------------------------------

#: Lines of a block and blocks of a page (pdf), cells of a row (xlsx), paragraphs of a slide (pptx).
BLOCK, PAGE, WIDTH, SLIDE = 4, 5, 3, 6


def previews(t: Tables) -> DataFrame:
    """(file_id, preview): one nested value for each file, its parts in order and their blocks with source and translation.

    Parts are pages, the body, the sheet or slides by the file's kind; a sheet is a grid
    without holes. Everything is made from the file's own lines, so nothing is shuffled.
    """
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    base = t.files.withColumn("kind", F.expr(FILE_KIND)).select("file_id", "kind", F.coalesce(lines, F.array().cast("array<string>")).alias("p")).withColumn("n", F.size("p"))
    told = lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("[T]"), x))
    block = lambda name, src, tgt: F.struct(name.alias("id"), src.alias("src"), tgt.alias("tgt"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    text = lambda k: F.get("p", k)
    number = lambda c: c.cast("int").cast("string")

    def grouped(count: Column, size: int, name: str, each) -> Column:
        """Blocks 0 to count - 1 in parts of ``size``."""
        parts = upto(F.ceil(count / size))
        return F.transform(parts, lambda part: F.struct(F.concat(F.lit(name), number(part + 1)).alias("part"), F.transform(upto(F.least(F.lit(size), count - part * size)), lambda k: each(part, k)).alias("blocks")))

    pdf = grouped(
        F.ceil(F.col("n") / BLOCK), PAGE, "page ",
        lambda part, k: block(F.concat(F.lit("p"), number(part + 1), F.lit("_b"), number(k + 1)), F.array_join(F.slice("p", (part * PAGE + k) * BLOCK + 1, BLOCK), "\n"), F.array_join(F.transform(F.slice("p", (part * PAGE + k) * BLOCK + 1, BLOCK), told), "\n")),
    )
    body = F.array(F.struct(F.lit("body").alias("part"), F.transform("p", lambda x, k: block(F.concat(F.lit("d"), number(k + 1)), x, told(x))).alias("blocks")))
    cell = lambda part, k: block(F.concat(F.lit("R"), number(part + 1), F.lit("C"), number(k + 1)), F.coalesce(text(part * WIDTH + k), F.lit("")), told(F.coalesce(text(part * WIDTH + k), F.lit(""))))
    sheet = grouped(F.ceil(F.col("n") / WIDTH) * WIDTH, WIDTH, "row ", cell)
    slides = grouped(F.col("n"), SLIDE, "slide ", lambda part, k: block(F.concat(F.lit("s"), number(part + 1), F.lit("_p"), number(k)), text(part * SLIDE + k), told(text(part * SLIDE + k))))
    none = F.array().cast("array<struct<part:string,blocks:array<struct<id:string,src:string,tgt:string>>>>")
    parts = F.when(F.col("kind") == "pdf", pdf).when(F.col("kind") == "docx", body).when(F.col("kind") == "xlsx", sheet).when(F.col("kind") == "pptx", slides).otherwise(none)
    return base.select("file_id", F.struct(F.lit(10).alias("schema_version"), F.col("kind").alias("document_kind"), parts.alias("parts")).alias("preview"))


_T = "CASE WHEN x = '' THEN '' ELSE '[T]' || x END"
FMT6_SQL = f"""WITH f AS (SELECT file_id, {FILE_KIND} AS kind, coalesce(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''), []) AS p FROM {{files}}), n AS (SELECT *, len(p) AS n FROM f),
    b AS (SELECT file_id, kind, n, CASE kind
        WHEN 'pdf' THEN list_transform(range(0, CAST(ceil(n / {BLOCK}) AS BIGINT)), lambda b: 'p' || (b // {PAGE} + 1) || '_b' || (b % {PAGE} + 1) || '=' || array_to_string(list_transform(p[b * {BLOCK} + 1:b * {BLOCK} + {BLOCK}], lambda x: {_T}), chr(10)))
        WHEN 'docx' THEN list_transform(range(0, n), lambda b: 'd' || (b + 1) || '=[T]' || p[b + 1])
        WHEN 'xlsx' THEN list_transform(range(0, CAST(ceil(n / {WIDTH}) * {WIDTH} AS BIGINT)), lambda b: 'R' || (b // {WIDTH} + 1) || 'C' || (b % {WIDTH} + 1) || '=' || CASE WHEN b < n THEN '[T]' || p[b + 1] ELSE '' END)
        WHEN 'pptx' THEN list_transform(range(0, n), lambda b: 's' || (b // {SLIDE} + 1) || '_p' || (b % {SLIDE}) || '=[T]' || p[b + 1]) ELSE [] END AS blocks FROM n)
    SELECT file_id, kind, len(blocks) AS blocks, CAST(CASE kind WHEN 'pdf' THEN ceil(ceil(n / {BLOCK}) / {PAGE}) WHEN 'docx' THEN 1 WHEN 'xlsx' THEN ceil(n / {WIDTH}) WHEN 'pptx' THEN ceil(n / {SLIDE}) ELSE 0 END AS BIGINT) AS parts,
           sha256(array_to_string(blocks, chr(30))) AS text_sha256 FROM b"""


@query("fmt6_previews", FMT6_SQL)
def _(t: Tables):
    """The nested previews, by their parts, blocks and a digest of all blocks' ids and translations in order."""
    p = F.col("preview.parts")
    blocks = F.flatten(F.transform(p, lambda x: x["blocks"]))
    said = F.array_join(F.transform(blocks, lambda b: F.concat(b["id"], F.lit("="), b["tgt"])), "\x1e")
    return previews(t).select("file_id", F.col("preview.document_kind").alias("kind"), F.size(blocks).cast("long").alias("blocks"), F.size(p).cast("long").alias("parts"), F.sha2(said, 256).alias("text_sha256"))


# ---- given back after translation ----------------------------------------------------------


def moved_pages(t: Tables) -> DataFrame:
    """(page, lines): each document's lines, whole, with tokens protected, in which a translator moved some placeholders, and who owns what.

    Lines stay in their document's row, so that neighbours are at hand; only the texts are dealt out.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    said = lambda line, pos: F.concat(line, F.lit(" VDD_IO "), pos % 7, F.lit(" mV at "), pos % 4 + 1, F.lit(" kHz"))
    texts = dealt(t.documents.where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    rows = texts.select(F.col("doc_id").alias("page"), F.transform(lines, said).alias("said")).select("page", protect_each("said").alias("p"))

    def line(p: Column, k: Column) -> Column:
        own, following = F.try_element_at(p["tokens"]["name"], F.lit(-1)), F.get(F.get("p", k + 1)["tokens"]["name"], F.lit(0))
        moved = F.when((k % 3 == 0) & following.isNotNull(), F.replace(p["text"], own, F.lower(following))).when(k % 3 == 1, F.concat(p["text"], F.lit(" DTX0123456789Q"))).otherwise(p["text"])
        return F.struct(k.cast("long").alias("idx"), moved.alias("text"), F.transform(p["tokens"], lambda o: F.struct(o["name"].alias("placeholder"), o["token"].alias("token"))).alias("own"))

    return rows.select("page", F.transform("p", line).alias("lines"))


def moved_placeholders(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The same as two tables: texts, and placeholders with their owners."""
    lines = moved_pages(t).select("page", F.inline("lines"))
    return lines.select("page", "idx", "text"), lines.select("page", "idx", F.posexplode("own").alias("place", "o")).select("page", "idx", "place", "o.placeholder", "o.token")


@query("rw14_neighbor_placeholders")
def _(t: Tables):
    """Texts after their neighbours' placeholders were put back, as a digest and how many there were."""
    return restore.restored_of_pages(moved_pages(t)).select("page", "idx", F.col("restored").cast("long").alias("restored"), F.sha2("text", 256).alias("text_sha256"))


@query("rw14_placeholders_once")
def _(t: Tables):
    return restore.taken_once_of_pages(moved_pages(t))


RUNS = Rows(
    "lines",
    {
        "doc_id": "doc_id", "pos": "CAST(pos AS BIGINT)", "head": "CASE pos % 6 WHEN 5 THEN substr(line, 1, 10) ELSE CONCAT(substr(line, 1, 10), ': ') END", "body": "substr(line, 11, 30)",
        "f1": "'F1'", "f2": "CASE WHEN pos % 4 = 3 THEN 'F1' ELSE 'F2' END", "f3": "CASE WHEN pos % 5 = 4 THEN 'F9' WHEN pos % 4 = 3 THEN 'F1' ELSE 'F2' END", "told": "replace(replace(substr(line, 1, 40), ', ', ': '), '.', ':')",
    },
)


@query(
    "rw14_definition_styles",
    f"""WITH c AS (SELECT *, strpos(trim(told), ':') AS cut_at FROM {RUNS.sql}), s AS (SELECT *, trim(substr(trim(told), 1, cut_at)) AS prefix, trim(substr(trim(told), cut_at + 1)) AS rest FROM c)
        SELECT doc_id, pos, CASE WHEN regexp_matches(head, '[:：]\\s*$') AND f1 <> f2 AND f2 = f3 AND cut_at > 0 AND prefix <> '' AND rest <> '' THEN f1 || '=' || prefix || '|' || f2 || '=' || rest ELSE f1 || '=' || told END AS runs FROM s""",
)
def _(t: Tables):
    """A translated definition gets the styles of the source's two kinds of runs: the term up to its colon, and the rest, all alike."""
    told = F.trim("told")
    at = F.locate(":", told)
    prefix, rest = F.trim(told.substr(F.lit(1), at)), F.trim(told.substr(at + 1, F.length(told)))
    runs = F.array(*(F.struct(F.col(x).alias("text"), F.col(f).alias("font")) for x, f in (("head", "f1"), ("body", "f2"), ("body", "f3"))))
    first, others = F.get(runs, F.lit(0)), F.slice(runs, 2, 2)
    alike = F.size(F.array_distinct(F.transform(others, lambda r: r["font"]))) == 1
    two = first["text"].rlike(r"[:：]\s*$") & alike & (first["font"] != F.get(others, F.lit(0))["font"]) & (at > 0) & (prefix != "") & (rest != "")
    styled = F.concat(first["font"], F.lit("="), prefix, F.lit("|"), F.get(others, F.lit(0))["font"], F.lit("="), rest)
    return RUNS.df(t).select("doc_id", "pos", F.when(two, styled).otherwise(F.concat(F.col("f1"), F.lit("="), F.col("told"))).alias("runs"))


@query("rw14_restored_layouts", f"SELECT page, idx, CASE WHEN y2 - y1 > x2 - x1 THEN 'box ' || idx ELSE 'BOX ' || idx END AS text, CASE WHEN y2 - y1 > x2 - x1 THEN 1.0 ELSE 0.9 END AS scale FROM {NODES}")
def _(t: Tables):
    """Upright labels get the text and scale of the source's snapshot back; all else stays translated."""
    n = nodes(t)
    snapshot = n.where("y2 - y1 > x2 - x1").select("page", "idx", F.concat(F.lit("box "), F.col("idx").cast("string")).alias("source"))
    told = n.select("page", "idx", F.concat(F.lit("BOX "), F.col("idx").cast("string")).alias("text"))
    return told.join(snapshot, ["page", "idx"], "left").select("page", "idx", F.coalesce("source", "text").alias("text"), F.when(F.col("source").isNotNull(), 1.0).otherwise(0.9).alias("scale"))


# ---- scans ---------------------------------------------------------------------------------

#: Sampled pages of a file; least mean luminance and share of bright pixels, most drawing items (fixed values); a pixel is bright from 245.
SAMPLED, LUMINANCE, BRIGHT, ITEMS, LIGHT = 5, 235.0, 0.6, 80.0, 245
#: Components of a vector as color values, three to a pixel; light ones for some files.
_COLOR = "CAST(least(greatest(floor((x + 1) * 127), 0), 255) AS BIGINT)"


@query(
    "agg25_prefers_ocr",
    f"""WITH p AS (SELECT vec_id // 8 AS file, vec_id % 8 AS page, label AS items, list_transform(embedding, lambda x: CASE WHEN (vec_id // 8) % 3 = 0 THEN 255 - {_COLOR} // 16 ELSE {_COLOR} END) AS c FROM embeddings WHERE len(embedding) >= 3),
    l AS (SELECT file, page, items, list_transform(range(0, len(c) // 3), lambda k: 2126 * c[3 * k + 1] + 7152 * c[3 * k + 2] + 722 * c[3 * k + 3]) AS lum FROM p),
    s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS nth FROM l),
    m AS (SELECT file, count(*) AS pages, avg(CAST(list_sum(lum) AS DOUBLE) / len(lum)) / 10000 AS luminance, avg(CAST(len(list_filter(lum, lambda v: v >= {LIGHT * 10000})) AS DOUBLE) / len(lum)) AS bright, avg(items) AS items FROM s WHERE nth <= {SAMPLED} GROUP BY file)
    SELECT file, pages, round(luminance, 6) AS luminance, round(bright, 6) AS bright, luminance >= {LUMINANCE} AND bright >= {BRIGHT} AND items <= {ITEMS} AS prefers_ocr FROM m""",
)
def _(t: Tables):
    """Files whose first five pages are light and nearly empty; vectors stand for pages, their components for the colors of pixels."""
    color = lambda x: F.least(F.greatest(F.floor((x + 1) * 127), F.lit(0)), F.lit(255))
    file = F.floor(F.col("vec_id") / 8)
    light = F.floor(F.col("vec_id") / 8) % 3 == 0
    c = F.transform(F.col("embedding"), lambda x: F.when(light, F.lit(255) - F.floor(color(x) / 16)).otherwise(color(x)))
    pages = t.embeddings.where(F.size("embedding") >= 3).select(file.alias("file"), (F.col("vec_id") % 8).alias("page"), F.col("label").alias("items"), c.alias("c"))
    lum = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 3).cast("int") - 1), lambda k: F.get("c", 3 * k) * 2126 + F.get("c", 3 * k + 1) * 7152 + F.get("c", 3 * k + 2) * 722)
    first = pages.withColumn("lum", lum).withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy("page"))).where(F.col("nth") <= SAMPLED)
    mean = F.aggregate("lum", F.lit(0).cast("long"), lambda a, v: a + v).cast("double") / F.size("lum")
    share = F.size(F.filter("lum", lambda v: v >= LIGHT * 10000)).cast("double") / F.size("lum")
    got = first.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), (F.avg(mean) / 10000).alias("l"), F.avg(share).alias("b"), F.avg("items").alias("items"))
    return got.select("file", "pages", F.round("l", 6).alias("luminance"), F.round("b", 6).alias("bright"), ((F.col("l") >= LUMINANCE) & (F.col("b") >= BRIGHT) & (F.col("items") <= ITEMS)).alias("prefers_ocr"))


@query(
    "fmt5_ocr_decision",
    f"""WITH f AS (SELECT page, bool_and(size > 6) AS all_text, bool_or(font = 'AF') AS fonts, bool_or(size > 7) AS any_text, min(order_key) AS first_key FROM {{boxes}} GROUP BY page),
        s AS (SELECT user_id, lower(value) IN ('1', 'true', 'yes', 'on') AS ocr FROM {_pairs_sql(STORED)} WHERE key = 'ocr')
        SELECT page, CASE WHEN all_text OR fonts OR any_text THEN 'no_ocr' WHEN NOT coalesce(ocr, FALSE) THEN 'error' ELSE 'rebuild' END AS decision FROM f LEFT JOIN orders ON o_orderkey = first_key LEFT JOIN s ON s.user_id = o_custkey""",
)
def _(t: Tables):
    """All text, a font or any text: no OCR; else what the owner's setting says: a rebuild, or an error where OCR is off or not set."""
    pages = t.boxes.groupBy("page").agg(F.bool_and(F.col("size") > 6).alias("every"), F.bool_or(F.col("font") == "AF").alias("fonts"), F.bool_or(F.col("size") > 7).alias("some"), F.min("order_key").alias("first"))
    ocr = _pairs(t, STORED).where("key = 'ocr'").select("user_id", F.lower("value").isin("1", "true", "yes", "on").alias("ocr"))
    owner = t.orders.select(F.col("o_orderkey").alias("first"), F.col("o_custkey").alias("user_id"))
    known = pages.join(owner, "first", "left").join(ocr, "user_id", "left")
    return known.select("page", F.when(F.col("every") | F.col("fonts") | F.col("some"), "no_ocr").when(~F.coalesce("ocr", F.lit(False)), "error").otherwise("rebuild").alias("decision"))


@query(
    "snk4_batch_failed",
    f"""WITH g AS (SELECT sample, gate, count(cur) - count(base) AS delta FROM {GATES.sql} GROUP BY ALL HAVING count(cur) + count(base) > 0)
        SELECT sample, bool_or(delta > 0) AS failed, count(*) AS gates, count_if(delta > 0) AS regressed FROM g GROUP BY sample""",
)
def _(t: Tables):
    """A sample failed if any of its gates regressed against the baseline; the summary is one row for each sample."""
    gates = GATES.df(t).groupBy("sample", "gate").agg((F.count("cur") - F.count("base")).alias("delta"), (F.count("cur") + F.count("base")).alias("seen")).where("seen > 0")
    return gates.groupBy("sample").agg(F.bool_or(F.col("delta") > 0).alias("failed"), F.count(F.lit(1)).alias("gates"), F.count_if(F.col("delta") > 0).alias("regressed"))
