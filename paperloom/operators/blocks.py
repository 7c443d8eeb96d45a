"""Lines put into blocks, and paragraphs whose first line belongs to another: both with why, and with ids that lead back.

y grows upward. A page's rows are all that a rule sees at once.
"""

from __future__ import annotations

import re
from statistics import median
from typing import NamedTuple

from pyspark.sql import DataFrame

from paperloom.operators.folds import by_page
from paperloom.operators.merging import is_prose

#: A block has fewer lines than this when one more opens the next, and is at most so high (fixed values).
MOST_LINES, MOST_HEIGHT = 4, 64.0
#: Least gap that opens a block, its share of the step between lines, and the least step.
LEAST_GAP, GAP_SHARE, LEAST_STEP = 5.0, 0.8, 7.0
LIST_ITEM = re.compile(r"\s*(?:\(\d{1,3}\)|\d{1,3}[.)]|[•‣▪*-])\s+")


class Line(NamedTuple):
    idx: int
    x1: float
    y1: float
    x2: float
    y2: float
    text: str


def line_step(lines: list[Line]) -> float:
    """The largest of the median step from line to line, the median height and 7."""
    tops = [r.y2 for r in lines]
    steps = [a - b for a, b in zip(tops, tops[1:]) if a - b > 0]
    return max(median(steps) if steps else 0.0, median(r.y2 - r.y1 for r in lines), LEAST_STEP)


def opens(block: list[Line], line: Line, gap: float) -> str | None:
    """Why a line opens a new block behind this one; None if it goes on with it."""
    last, left = block[-1], min(r.x1 for r in block)
    if LIST_ITEM.match(line.text):
        return "list_item"
    if last.y1 - line.y2 > gap:
        return "gap"
    if len(block) >= MOST_LINES:
        return "lines"
    if max(r.y2 for r in (*block, line)) - min(r.y1 for r in (*block, line)) > MOST_HEIGHT:
        return "height"
    return "indent" if last.x1 - left >= 8.0 and line.x1 - left <= 2.0 else None


def blocks_of(lines: list[Line]) -> list[tuple[list[Line], str]]:
    """Blocks from the top, with what opened each."""
    ordered = sorted(lines, key=lambda r: (-r.y2, r.x1, r.idx))
    if not ordered:
        return []
    gap = max(LEAST_GAP, line_step(ordered) * GAP_SHARE)
    out = [([ordered[0]], "first")]
    for line in ordered[1:]:
        why = opens(out[-1][0], line, gap)
        if why is None:
            out[-1][0].append(line)
        else:
            out.append(([line], why))
    return out


def line_blocks(lines: DataFrame) -> DataFrame:
    """(page, block, lines, opened, first, x1, y1, x2, y2): blocks of each page's lines (idx, x1, y1, x2, y2, text)."""

    def rule(rows: list[tuple]) -> list[tuple]:
        found = blocks_of([Line(*r[:5], r[5] or "") for r in rows])
        return [(k, len(b), why, b[0].idx, min(r.x1 for r in b), min(r.y1 for r in b), max(r.x2 for r in b), max(r.y2 for r in b)) for k, (b, why) in enumerate(found)]

    return by_page(lines, ["idx", "x1", "y1", "x2", "y2", "text"], rule, "block long, lines long, opened string, first long, x1 double, y1 double, x2 double, y2 double")


# ---- paragraphs whose first line is the end of another's ------------------------------------


def _level(a: list[float], b: list[float]) -> bool:
    ha, hb = max(a[3] - a[1], 1.0), max(b[3] - b[1], 1.0)
    return (min(a[3], b[3]) - max(a[1], b[1])) / min(ha, hb) >= 0.45 or abs((a[1] + a[3]) - (b[1] + b[3])) / 2 <= max(ha, hb) * 0.55


def _box(items: list[Line]) -> list[float]:
    return [min(r.x1 for r in items), min(r.y1 for r in items), max(r.x2 for r in items), max(r.y2 for r in items)]


def visual_lines(items: list[Line]) -> list[list[Line]]:
    """A paragraph's items as lines from the top, each against the box of the line so far; items of a line from the left."""
    out: list[list[Line]] = []
    for r in sorted(items, key=lambda r: (-r.y2, r.x1, -r.y1)):
        if out and _level(_box(out[-1]), list(r[1:5])):
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(line, key=lambda r: r.x1) for line in out]


def is_wrapped(items: list[Line]) -> bool:
    """Whether the first line begins well to the right, above a second one that begins at the paragraph's left edge."""
    lines = visual_lines(items)
    if len(lines) < 2 or not is_prose("".join(r.text for r in items)):
        return False
    first, second, left = _box(lines[0]), _box(lines[1]), _box(items)[0]
    h1, h2 = max(first[3] - first[1], 1.0), max(second[3] - second[1], 1.0)
    texts = all("".join(r.text for r in line).strip() for line in lines[:2])
    return texts and first[1] > second[1] + max(h1, h2) * 0.45 and first[0] > left + max(10.0, h1 * 1.2) and abs(second[0] - left) <= max(8.0, h2 * 0.8)


def split_tails(items: DataFrame) -> DataFrame:
    """(page, paragraph, part, place, text, x1, y1, x2, y2, items): wrapped paragraphs line by line, the others whole.

    ``items`` are (page, paragraph, idx, x1, y1, x2, y2, text). A part's id names its paragraph.
    """

    def rule(rows: list[tuple]) -> list[tuple]:
        paragraphs: dict[int, list[Line]] = {}
        for paragraph, *r in rows:
            paragraphs.setdefault(paragraph, []).append(Line(*r[:5], r[5] or ""))
        out = []
        for paragraph, found in sorted(paragraphs.items()):
            found.sort()
            parts = visual_lines(found) if is_wrapped(found) else [found]
            for k, part in enumerate(parts, 1):
                name = f"{paragraph}:wrapped_tail:{k}" if len(parts) > 1 else str(paragraph)
                out.append((paragraph, name, k, "".join(r.text for r in part), *_box(part), [r.idx for r in part]))
        return out

    return by_page(items, ["paragraph", "idx", "x1", "y1", "x2", "y2", "text"], rule, "paragraph long, part string, place long, text string, x1 double, y1 double, x2 double, y2 double, items array<long>")
