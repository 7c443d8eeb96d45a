"""Axis labels and tick numbers of drawings, found among the glyphs of a page.

Two passes: glyphs are put in columns by their centers, then a column is cut where its
glyphs are apart. What is left is a label if it is narrow, high, made of letters and
reads like one, from below or from above, and if it doesn't look like a table's column.
Tick numbers are columns of small digits above a horizontal label; four or more columns
that read as numbers make a scale. y grows upward, texts of columns read upward.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from paperloom.operators.folds import by_page, is_block_noise
from paperloom.operators.tokens import ELECTRIC

#: Words that only connect, those cut off from a capital behind them, units in brackets and units inside a text (fixed values).
CONNECT = frozenset("of and or vs per from to in on for with".split())
CUT_OFF = ("of", "and", "vs", "per", "from", "to", "in")
LABEL_UNITS = ELECTRIC | {"mW", "W", "LSB", "ppm", "FSR"}
INNER_UNITS = ("µA", "uA", "mA", "µV", "uV", "mV", "dB", "LSB", "%")


class Glyph(NamedTuple):
    idx: int
    ch: str
    x1: float
    y1: float
    x2: float
    y2: float
    font: str | None
    size: float
    xobj: int | None

    @property
    def center(self) -> float:
        return (self.x1 + self.x2) / 2


def around(glyphs: list[Glyph]) -> tuple[float, float, float, float]:
    return min(g.x1 for g in glyphs), min(g.y1 for g in glyphs), max(g.x2 for g in glyphs), max(g.y2 for g in glyphs)


def upward(glyphs: list[Glyph]) -> list[Glyph]:
    return sorted(glyphs, key=lambda g: g.y1)


# ---- texts ---------------------------------------------------------------------------------


def is_measure(text: str) -> bool:
    """Words and a unit in brackets: ``Output noise (mV)``; the unit may be one of the full scale."""
    s = " ".join(unicodedata.normalize("NFKC", text).split())
    head, bracket, unit = s.rpartition("(")
    head = head.rstrip()
    if not bracket or not unit.endswith(")") or not 2 <= len(head) <= 72 or not (head[0].isascii() and head[0].isalpha()):
        return False
    if not all(c.isascii() and c.isalpha() or c in " /+&-" for c in head):
        return False
    words = unit[:-1].split()
    return bool(words) and words[0].translate(_SIGNS) in LABEL_UNITS and words[1:] in ([], ["of", "FSR"]) and not unit[:-1][:1].isspace()


_SIGNS = str.maketrans("\u00b5\u2126", "\u03bc\u03a9")


def _spaced(text: str) -> str:
    """Words of a label that ran together: marks between letters, connecting words before a capital, changes of case."""
    letter = lambda c: c.isascii() and c.isalpha()
    inner = lambda m: letter(text[m.start() - 1 : m.start()]) and letter(text[m.end() : m.end() + 1]) and m.start() > 0
    s = re.sub(r"[^\w\s'-]+", lambda m: " " if inner(m) else m.group(), text)
    for word in CUT_OFF:
        at = 0
        while (at := s.find(word, at)) >= 0:
            end = at + len(word)
            if at and s[at - 1].isascii() and s[at - 1].isalpha() and end < len(s) and "A" <= s[end] <= "Z":
                s = f"{s[:at]} {word} {s[end:]}"
                end += 2
            at = end
    out = []
    for k, c in enumerate(s):
        before, after = s[k - 1 : k], s[k + 1 : k + 2]
        new = "A" <= c <= "Z" and (before.isascii() and before.islower() or before.isascii() and before.isupper() and after.isascii() and after.islower())
        out.append(" " + c if new else c)
    return " ".join("".join(out).split())


def plain_words(text: str) -> str | None:
    """A label of words alone, put right, or None.

    Every word has two letters or more (hyphens and apostrophes may follow the first),
    one that isn't a connecting word has four or is in capitals; 64 characters at most.
    """
    s = unicodedata.normalize("NFKC", text).strip()
    if not s or is_noise(s):
        return None
    s = _spaced(s)
    words = s.split(" ")
    named = lambda w: len(w) > 1 and w[0].isascii() and w[0].isalpha() and all(c.isascii() and c.isalpha() or c in "'-" for c in w)
    if len(s) > 64 or not all(map(named, words)) or sum(map(str.isalpha, s)) < 4:
        return None
    if len(words) == 1:
        return s if len(s) >= 4 else None
    content = [w for w in words if w.casefold() not in CONNECT]
    return s if any(len(w) >= 4 or w.isupper() for w in content) else None


def is_noise(text: str) -> bool:
    """A text that ends in capitals behind small letters without any break between, or that is full of the letter s."""
    bare = "".join(text.split())
    if len(bare) < 5 or len(bare) - len(bare.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) < 2:
        return False
    return bare.count("s") >= 3 or re.search("[a-z]{3}", bare) is not None and not any(c in " _/-()" for c in text)


def reads_as_label(text: str) -> bool:
    """Forward or backward: a measure, plain words, or a text with a unit and few digits."""
    s = unicodedata.normalize("NFKC", text).strip()
    for t in dict.fromkeys((s, s[::-1].strip())):
        bare = "".join(t.split())
        if is_measure(t) or plain_words(t) is not None:
            return True
        if 4 <= len(bare) <= 80 and any(map(str.isalpha, bare)) and any(u in bare for u in INNER_UNITS) and sum(map(str.isdigit, bare)) <= max(3, len(bare) // 3):
            return True
    return False


# ---- columns of labels ---------------------------------------------------------------------


def columns(glyphs: list[Glyph]) -> Iterator[list[Glyph]]:
    """Glyphs whose centers are within 4.5 of the running mean of their column's."""
    column: list[Glyph] = []
    mean = 0.0
    for g in sorted(glyphs, key=lambda g: (g.center, g.y1)):
        if column and abs(g.center - mean) > 4.5:
            yield column
            column = []
        column.append(g)
        mean = (mean * (len(column) - 1) + g.center) / len(column)
    if column:
        yield column


def runs(column: list[Glyph]) -> Iterator[list[Glyph]]:
    """A column's glyphs from below, cut at gaps over 8."""
    run: list[Glyph] = []
    for g in upward(column):
        if run and g.y1 - run[-1].y2 > 8:
            yield run
            run = []
        run.append(g)
    if run:
        yield run


def rejection(run: list[Glyph]) -> str | None:
    """Why a run isn't an axis label, by the first test that says so; None for a label."""
    if len(run) < 5:
        return "short"
    x1, y1, x2, y2 = around(run)
    if x2 - x1 > 24 or y2 - y1 < max((x2 - x1) * 2.5, 18):
        return "not_high"
    text = unicodedata.normalize("NFKC", "".join(g.ch for g in upward(run))).strip()
    if sum(map(str.isalpha, text)) < 4:
        return "few_letters"
    if is_block_noise(text):
        return "repeated_block"
    if has_double_rows(run):
        return "table_rows"
    if is_tail(run):
        return "table_tail"
    if is_mixed(run, text):
        return "mixed_fonts"
    return None if reads_as_label(text) else "text"


def has_double_rows(run: list[Glyph]) -> bool:
    """Whether a third of the glyphs, four at least, share their row, 1.2 apart, with another."""
    sizes, start = [], None
    for g in upward(run):
        if start is None or abs(g.y1 - start) > 1.2:
            sizes.append(0)
            start = g.y1
        sizes[-1] += 1
    shared = sum(n for n in sizes if n > 1)
    return shared >= max(4, len(run) // 3) and shared > 0


def is_tail(run: list[Glyph]) -> bool:
    """The end of a table's column: short texts straight above each other, all but one gap open and 2 or more in the middle."""
    ordered = upward(run)
    centers = [g.center for g in ordered]
    if len(ordered) < 5 or max(centers) - min(centers) > 3.2 or max(g.x2 - g.x1 for g in ordered) > 8.0:
        return False
    gaps = [b.y1 - a.y2 for a, b in zip(ordered, ordered[1:])]
    open_gaps = sorted(x for x in gaps if x > 0)
    if not open_gaps or len(open_gaps) < len(gaps) - 1 or open_gaps[len(open_gaps) // 2] < 2.0:
        return False
    texts = [t for g in ordered if (t := g.ch.strip())]
    return len(texts) >= 4 and sum(len(t) <= 2 for t in texts) >= max(3, len(texts) - 1)


def is_mixed(run: list[Glyph], text: str) -> bool:
    """Narrow glyphs of several fonts whose text changes case upward, or between letters and digits, without being a label."""
    bare = "".join(text.split())
    if len(bare) < 6 or is_measure(text) or plain_words(text) is not None or len({g.font for g in run if g.font is not None}) < 2 or max(g.x2 - g.x1 for g in run) > 6.5:
        return False
    return any(a.islower() and b.isupper() or a.isalpha() and b.isdigit() or a.isdigit() and b.isalpha() for a, b in zip(bare, bare[1:]))


def is_table_column(run: list[Glyph]) -> bool:
    """A table's tail of short words, all but one of one to three letters."""
    texts = [g.ch.strip() for g in run if g.ch.strip()]
    return len(texts) >= 5 and is_tail([g for g in run if g.ch.strip()]) and sum(len(t) <= 3 and t.isascii() and t.isalpha() for t in texts) >= max(4, len(texts) - 1)


def label_groups(glyphs: list[Glyph]) -> Iterator[tuple[list[Glyph], str | None]]:
    """Runs of the page's visible glyphs, with why each isn't a label."""
    seen = [g for g in glyphs if g.ch.strip() and g.x2 > g.x1 and g.y2 > g.y1]
    for column in columns(seen):
        for run in runs(column):
            yield run, rejection(run) or ("table_column" if is_table_column(run) else None)


# ---- ticks ---------------------------------------------------------------------------------


def is_tick_glyph(g: Glyph) -> bool:
    ch = unicodedata.normalize("NFKC", g.ch).strip()
    return len(ch) == 1 and (ch.isdigit() or ch in ".+-−") and 0 < g.x2 - g.x1 <= 10.0 and 0 < g.y2 - g.y1 <= 8.0 and 0 < g.size <= 5.5


def tick_columns(glyphs: list[Glyph], label: tuple[float, float, float, float], xobj: int | None) -> list[list[Glyph]]:
    """Columns of tick numbers above a horizontal label: all of a scale of four or more, else none."""
    x1, _, x2, y2 = label
    pad = max(x2 - x1, 80.0)
    near = [g for g in glyphs if g.xobj == xobj and is_tick_glyph(g) and g.y1 >= y2 - 1.0 and g.y2 <= y2 + 36.0 and g.x1 >= x1 - pad and g.x2 <= x2 + pad]
    found: list[list[Glyph]] = []
    for g in sorted(near, key=lambda g: (g.center, (g.y1 + g.y2) / 2)):
        home = next((c for c in found if abs(g.center - sum(h.center for h in c) / len(c)) <= 3.0), None)
        if home is None:
            found.append([g])
        else:
            home.append(g)
    valid = [c for c in found if is_tick_column(c, label)]
    return valid if len(valid) >= 4 else []


def is_tick_column(column: list[Glyph], label: tuple[float, float, float, float]) -> bool:
    """Four to seven glyphs, higher than wide, that read as a number of four or five digits or one with a point behind the first."""
    x1, y1, x2, y2 = around(column)
    if not 4 <= len(column) <= 7 or y2 - y1 < 10.0 or y2 - y1 < (x2 - x1) * 1.8 or y1 < label[3] - 1.0 or y2 > label[3] + 36.0:
        return False
    text = "".join(unicodedata.normalize("NFKC", "".join(g.ch for g in upward(column))).replace("−", "-").split())
    text = text[1:] if text[:1] in ("+", "-") else text
    whole, point, part = text.partition(".")
    if point:
        return len(whole) == 1 and whole.isdecimal() and part.isdecimal() and 2 <= len(part) <= 4
    return text.isdecimal() and 4 <= len(text) <= 5


# ---- on tables -----------------------------------------------------------------------------

GLYPH = ["idx", "ch", "x1", "y1", "x2", "y2", "font", "size", "xobj"]
GROUPS = "first long, glyphs int, text string, x1 double, y1 double, x2 double, y2 double, rejected string"


def axis_labels(glyphs: DataFrame) -> DataFrame:
    """Runs of every page with their texts, boxes and why they aren't labels (null: a label)."""

    def rule(rows: list[tuple]) -> list[tuple]:
        found = label_groups([Glyph(*r) for r in rows])
        return [(min(g.idx for g in run), len(run), "".join(g.ch for g in upward(run)), *around(run), why) for run, why in found]

    return by_page(glyphs, GLYPH, rule, GROUPS)


def axis_ticks(glyphs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, label, column, text): tick numbers of every scale; ``labels`` are (page, idx, text, x1, y1, x2, y2, xobj).

    Glyphs and labels of a page meet as rows of one relation. A column that two labels
    of one xobject claim is the first's.
    """
    from pyspark.sql import functions as F

    texts = labels.select("page", "idx", F.col("text").alias("ch"), "x1", "y1", "x2", "y2", F.lit(None).cast("string").alias("font"), F.lit(-1.0).alias("size"), "xobj")

    def rule(rows: list[tuple]) -> list[tuple]:
        every = [Glyph(*r) for r in rows]
        marks, seen, out = [g for g in every if g.size >= 0], set(), []
        for label in sorted((g for g in every if g.size < 0 and is_horizontal_label(g.ch)), key=lambda g: g.idx):
            for column in tick_columns(marks, tuple(label[2:6]), label.xobj):
                key = (label.xobj, *sorted(g.idx for g in column))
                if key not in seen:
                    seen.add(key)
                    out.append((label.idx, min(g.idx for g in column), "".join(g.ch for g in upward(column))))
        return out

    return by_page(glyphs.select("page", *GLYPH).unionByName(texts), GLYPH, rule, "label long, first long, text string")


def is_horizontal_label(text: str) -> bool:
    s = unicodedata.normalize("NFKC", text or "").strip()
    return 3 <= len(s) <= 80 and "\n" not in s and any(map(str.isalpha, s)) and is_measure(s)
