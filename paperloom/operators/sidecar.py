"""Stored previews of files: loaded as VARIANT, taken through a chain of migrations, ending in one schema.

A preview that can't be read, or is of another version or kind, is built anew; its date
of creation stays if it can be read. A current one goes through the steps below, each
with a test and a change on the typed value. What a step did is listed by its name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version and granularity of today (fixed values).
VERSION, GRANULARITY = 10, "block"
BLOCKS = "array<struct<font_name:string,original:double,current:double,ref:int>>"


@dataclass(frozen=True)
class Step:
    """A migration: ``needed`` and ``change`` of (kind, granularity, blocks); ``change`` gives the new blocks."""

    name: str
    needed: Callable[[Column, Column, Column], Column]
    change: Callable[[Column], Column]


def _merged(blocks: Column) -> Column:
    """Neighbouring blocks of one font and size as one: lines become blocks."""
    same = lambda a, b: a["font_name"].eqNullSafe(b["font_name"]) & a["original"].eqNullSafe(b["original"])
    joined = lambda a, b: F.struct(a["font_name"].alias("font_name"), a["original"].alias("original"), F.greatest(a["current"], b["current"]).alias("current"), a["ref"].alias("ref"))
    head = lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)

    def put(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) > 0) & same(last, b), F.concat(head(acc), F.array(joined(last, b)))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(blocks, F.array().cast(BLOCKS), put)


def _with(block: Column, **new: Column) -> Column:
    return F.struct(*(new.get(c, block[c]).alias(c) for c in ("font_name", "original", "current", "ref")))


def _main_font(blocks: Column) -> Column:
    """The font of most blocks that have one, the first by name of equals."""
    named = F.filter(F.transform(blocks, lambda b: b["font_name"]), lambda f: f != "")
    counted = F.transform(F.array_distinct(named), lambda f: F.struct((-F.size(F.filter(named, lambda g: g == f))).alias("n"), f.alias("font")))
    return F.coalesce(F.array_min(counted)["font"], F.lit("default"))


STEPS = (
    Step("migrate", lambda kind, granularity, blocks: (kind == "pdf") & (granularity != GRANULARITY), _merged),
    Step("clean", lambda kind, granularity, blocks: (kind == "pdf") & F.exists(blocks, lambda b: b["original"] > b["current"]), lambda blocks: F.transform(blocks, lambda b: _with(b, current=F.greatest(b["original"], b["current"])))),
    Step("fonts", lambda kind, granularity, blocks: (kind == "pdf") & F.exists(blocks, lambda b: b["font_name"] == ""), lambda blocks: F.transform(blocks, lambda b: _with(b, font_name=F.when(b["font_name"] == "", _main_font(blocks)).otherwise(b["font_name"])))),
    Step("refs", lambda kind, granularity, blocks: kind.isin("docx", "xlsx", "pptx") & F.exists(blocks, lambda b: b["ref"].isNull()), lambda blocks: F.transform(blocks, lambda b, k: _with(b, ref=F.coalesce(b["ref"], k)))),
)


def loaded(df: DataFrame, payload: str, kind: Column, built: Column, now: Column) -> DataFrame:
    """Columns ``steps``, ``version``, ``granularity``, ``created_at`` and ``blocks`` beside those of ``df``.

    ``payload`` names the stored text, ``kind`` is the file's, ``built`` the blocks that
    building anew gives. Null, broken and foreign payloads take the branch ``rebuild``.
    """
    names = df.columns
    get = lambda path, to: F.try_variant_get(F.col("_v"), path, to)
    read = df.withColumns({"_v": F.try_parse_json(payload), "_kind": kind, "_built": built.cast(BLOCKS)})
    read = read.withColumns({"_version": get("$.schema_version", "int"), "_stored": get("$.document_kind", "string"), "granularity": get("$.granularity", "string"), "created_at": F.coalesce(get("$.created_at", "string"), now), "blocks": get("$.blocks", BLOCKS)})
    current = F.coalesce((F.col("_version") == VERSION) & (F.col("_stored") == F.col("_kind")) & F.col("blocks").isNotNull(), F.lit(False))
    out = read.withColumn("_current", current).withColumns(
        {
            "steps": F.when(F.col("_current"), F.array().cast("array<string>")).otherwise(F.array(F.lit("rebuild"))),
            "blocks": F.when(F.col("_current"), F.col("blocks")).otherwise(F.col("_built")),
            "granularity": F.when(F.col("_current"), F.col("granularity")).otherwise(F.lit(GRANULARITY)),
        }
    )
    for step in STEPS:
        out = out.withColumn("_do", F.coalesce(F.col("_current") & step.needed(F.col("_kind"), F.col("granularity"), F.col("blocks")), F.lit(False)))
        out = out.withColumns({"steps": F.when(F.col("_do"), F.array_append("steps", F.lit(step.name))).otherwise(F.col("steps")), "blocks": F.when(F.col("_do"), step.change(F.col("blocks"))).otherwise(F.col("blocks"))})
    return out.select(*names, "steps", F.lit(VERSION).alias("version"), F.lit(GRANULARITY).alias("granularity"), "created_at", "blocks")
