"""Glyph rows put back into text: implied spaces, symbol-font units, superscripts, label columns.

A glyph row has page, line, idx, ch, x1, y1, x2, y2, size and font; y grows
upward. All of this is windows and joins within a page, so no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.relational import once
from paperloom.operators.windows import islands

#: No space is implied before these (fixed values).
CLOSING = ".,;:!?%)]}"


def _beside(c: str, step: int) -> Column:
    return F.lag(c, step).over(W.partitionBy("page", "line").orderBy("x1", "idx"))


def with_units(glyphs: DataFrame, symbol: Column) -> DataFrame:
    """Symbol-font letters as the units they show: m before F, A, V, s, S is micro; W after a digit or k, K, M is ohm.

    Glyphs are unit neighbours if they overlap by more than 0.7 or are at most max(1.8, 0.32 size) apart.
    """
    out = glyphs.withColumns({"next_ch": _beside("ch", -1), "next_gap": _beside("x1", -1) - F.col("x2"), "prev_ch": _beside("ch", 1), "prev_gap": F.col("x1") - _beside("x2", 1), "is_symbol": symbol})
    near = lambda gap: (F.col(gap) < -0.7) | (F.col(gap) <= F.greatest(F.lit(1.8), 0.32 * F.col("size")))
    micro = F.col("is_symbol") & (F.col("ch") == "m") & F.col("next_ch").isin(*"FAVsS") & near("next_gap")
    ohm = F.col("is_symbol") & (F.col("ch") == "W") & F.col("prev_ch").rlike("[0-9kKM]") & near("prev_gap")
    fixed = F.when(F.coalesce(micro, F.lit(False)), "µ").when(F.coalesce(ohm, F.lit(False)), "Ω").otherwise(F.col("ch"))
    return out.withColumn("ch", fixed).drop("next_ch", "next_gap", "prev_ch", "prev_gap", "is_symbol")


def line_texts(glyphs: DataFrame) -> DataFrame:
    """(page, line, text): glyphs by x, with a space where the gap is max(1.8, 0.22 of the smaller size) or more.

    Never before closing punctuation, never inside a decimal number.
    """
    gap = F.col("x1") - F.col("prev_x2")
    small = F.least("size", F.coalesce("prev_size", "size"))
    decimal = (F.col("prev_ch").rlike("^[0-9]$") & F.col("ch").isin(".", ",") & F.col("next_ch").rlike("^[0-9]$")) | (F.col("prev_ch").isin(".", ",") & F.col("ch").rlike("^[0-9]$") & F.col("prev2_ch").rlike("^[0-9]$"))
    space = (gap > 0) & (gap >= F.greatest(F.lit(1.8), 0.22 * small)) & ~F.col("ch").isin(*CLOSING) & ~F.coalesce(decimal, F.lit(False))
    beside = {"prev_x2": _beside("x2", 1), "prev_size": _beside("size", 1), "prev_ch": _beside("ch", 1), "prev2_ch": _beside("ch", 2), "next_ch": _beside("ch", -1)}
    piece = F.concat(F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), F.col("ch"))
    pieces = F.array_sort(F.collect_list(F.struct("x1", "idx", piece.alias("piece"))))
    return glyphs.withColumns(beside).groupBy("page", "line").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))


def _in_line(rule) -> Column:
    """``rule(glyph, one before, two before, one behind)`` of each glyph of a line's array; null where there is none."""
    each = lambda g: F.transform(g, lambda x, k: rule(x, F.when(k > 0, F.get(g, k - 1)), F.when(k > 1, F.get(g, k - 2)), F.get(g, k + 1)))
    return once(F.col("glyphs"), each)


def with_units_of_lines(lines: DataFrame) -> DataFrame:
    """As ``with_units``, on (page, line, glyphs) with a line's glyphs in order, an array of (x1, idx, x2, size, ch, symbol)."""

    def fixed(g: Column, before: Column, _: Column, after: Column) -> Column:
        near = lambda gap: (gap < -0.7) | (gap <= F.greatest(F.lit(1.8), 0.32 * g["size"]))
        micro = g["symbol"] & (g["ch"] == "m") & after["ch"].isin(*"FAVsS") & near(after["x1"] - g["x2"])
        ohm = g["symbol"] & (g["ch"] == "W") & before["ch"].rlike("[0-9kKM]") & near(g["x1"] - before["x2"])
        ch = F.when(F.coalesce(micro, F.lit(False)), "µ").when(F.coalesce(ohm, F.lit(False)), "Ω").otherwise(g["ch"])
        return F.struct(*(g[c].alias(c) for c in ("x1", "idx", "x2", "size")), ch.alias("ch"), g["symbol"].alias("symbol"))

    return lines.withColumn("glyphs", _in_line(fixed))


def texts_of_lines(lines: DataFrame) -> DataFrame:
    """As ``line_texts``, on lines with their glyphs in order: nothing is shuffled or sorted. A line without glyphs has no text."""

    def piece(g: Column, before: Column, second: Column, after: Column) -> Column:
        gap = g["x1"] - before["x2"]
        digit = lambda x: x["ch"].rlike("^[0-9]$")
        decimal = (digit(before) & g["ch"].isin(".", ",") & digit(after)) | (before["ch"].isin(".", ",") & digit(g) & digit(second))
        space = (gap > 0) & (gap >= F.greatest(F.lit(1.8), 0.22 * F.least(g["size"], F.coalesce(before["size"], g["size"])))) & ~g["ch"].isin(*CLOSING) & ~F.coalesce(decimal, F.lit(False))
        return F.concat(F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), g["ch"])

    return lines.where(F.size("glyphs") > 0).select("page", "line", F.array_join(_in_line(piece), "").alias("text"))


def superscript_hosts(small: DataFrame, hosts: DataFrame) -> DataFrame:
    """(page, idx, host): for each small raised box the nearest host box whose upper half it touches."""
    s = small.select("page", F.col("idx"), *(F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")))
    h = hosts.select("page", F.col("idx").alias("host"), *(F.col(c).alias(f"h_{c}") for c in ("x1", "y1", "x2", "y2")))
    raised = (F.col("s_y1") >= (F.col("h_y1") + F.col("h_y2")) / 2 - 1) & (F.col("s_y1") <= F.col("h_y2") + 2)
    away = F.greatest(F.col("h_x1") - F.col("s_x2"), F.col("s_x1") - F.col("h_x2"), F.lit(0.0))
    hit = s.join(h, "page").where(raised & (away <= 6.0) & (F.col("idx") != F.col("host")))
    return hit.groupBy("page", "idx").agg(F.min_by("host", F.struct(away + F.abs(F.col("s_y2") - F.col("h_y2")), F.col("host"))).alias("host"))


def vertical_labels(boxes: DataFrame) -> DataFrame:
    """(page, island, segment, n, x1, y1, x2, y2): stacks of narrow boxes, by center column and vertical gap over 24."""
    center = (F.col("x1") + F.col("x2")) / 2
    narrow = boxes.where((F.col("x2") - F.col("x1")) <= 14).withColumn("cx", center)
    by_column = islands(narrow, ["page"], ["cx", "idx"], center - F.lag(center).over(W.partitionBy("page").orderBy("cx", "idx")) > 7.0)
    order = W.partitionBy("page", "island").orderBy(F.desc("y2"), "idx")
    stacked = islands(by_column.withColumn("down", -F.col("y2")), ["page", "island"], ["down", "idx"], F.lag("y1").over(order) - F.col("y2") > 24.0, "segment")
    return stacked.groupBy("page", "island", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).where("n >= 2")
