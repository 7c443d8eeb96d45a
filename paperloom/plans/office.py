"""Office files end to end: texts become files, files become text units, units are translated."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans.registry import query
from paperloom.sources import office
from paperloom.sources.tables import Tables

LINES = "(SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def units(t: Tables, kind: str, change=None):
    files = office.make_files(t.documents, "doc_id", "text", kind)
    if change:
        files = office.translate(files, change)
    got = office.units(files)
    place = "place" if kind == "xlsx" else "item"
    return got.where("text IS NOT NULL AND trim(text) <> ''").select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), F.col(place).alias("place"), F.col("text").alias("line"))


@query("src6_docx_units", f"SELECT * FROM {LINES} WHERE trim(line) <> ''")
def _(t: Tables):
    return units(t, "docx")


@query("src9_pptx_units", f"SELECT * FROM {LINES} WHERE trim(line) <> ''")
def _(t: Tables):
    return units(t, "pptx")


@query("src8_xlsx_units", f"SELECT * FROM {LINES} WHERE trim(line) <> ''")
def _(t: Tables):
    return units(t, "xlsx")


def mark(texts: list[str]) -> list[str]:
    return [f"[T]{x.strip()}" for x in texts]


MARKED = f"SELECT doc_id, place, regexp_extract(line, '^[ \\t]*') || '[T]' || trim(line, ' ' || chr(9)) || regexp_extract(line, '[ \\t]*$') AS line FROM {LINES} WHERE trim(line) <> ''"


@query("fmt1_translate_docx", MARKED)
def _(t: Tables):
    return units(t, "docx", mark)


@query("fmt2_translate_xlsx", MARKED)
def _(t: Tables):
    return units(t, "xlsx", mark)


@query("fmt3_translate_pptx", MARKED)
def _(t: Tables):
    return units(t, "pptx", mark)
