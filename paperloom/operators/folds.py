"""Order-dependent operators that no expression can state.

Each runs in Arrow batches: texts one by one, boxes page by page as the pages of a
sorted partition pass (``by_page``). State never leaves a page or a text. A page's
rows are bounded by what fits on a page, so no group grows with the data; pages are
what is distributed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.tokens import by_part

PAGE_BATCH = 10_000


def by_page(df: DataFrame, columns: list[str], rule: Callable[[list[tuple]], list[tuple]], out: str, together: bool = False) -> DataFrame:
    """``rule`` on the rows of each page; its tuples stand behind the page in the result.

    Pages follow each other in sorted partitions, so small pages cost no call of
    their own and a worker holds one page at a time. ``together``: the rows come so
    already, as those of ``sources.fragments`` do, and aren't shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(f"page long, {out}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        rows: list[tuple] = []
        page: tuple = ()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != (key,):
                    done.extend((*page, *x) for x in (rule(rows) if rows else ()))
                    page, rows = (key,), []
                    if len(done) >= PAGE_BATCH:
                        yield packed()
                        done.clear()
                rows.append(tuple(row))
        done.extend((*page, *x) for x in (rule(rows) if rows else ()))
        if done:
            yield packed()

    rows = df.select("page", *columns)
    return (rows if together else rows.repartition("page").sortWithinPartitions("page")).mapInArrow(run, schema)


def close_pairs(df: DataFrame, columns: list[str], reach: float) -> DataFrame:
    """Ordered pairs of different rows of a page whose vertical centers are at most ``reach`` larger heights (1 at least) apart: page, a_*, b_*.

    The rows come page by page, as in :func:`by_page`. They are sorted by their centers, so only rows near each other meet.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ["page", *columns]
    base = df.select(*names)
    fields = [T.StructField("page", T.LongType()), *(T.StructField(f"{side}_{c}", base.schema[c].dataType) for side in "ab" for c in columns)]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        page, y1, y2 = (table.column(c).to_numpy() for c in ("page", "y1", "y2"))
        center, height = (y1 + y2) / 2, np.maximum(y2 - y1, 1.0)
        order = np.lexsort((center, page))
        page, center, height = page[order], center[order], height[order]
        limit, first, second = reach * height.max(), [], []
        here = np.arange(len(order))
        for step in range(1, len(order)):
            here = here[here + step < len(order)]
            # A row that is too far away from one is so for all behind it.
            here = here[(page[here] == page[here + step]) & (center[here + step] - center[here] <= limit)]
            if not len(here):
                break
            there = here + step
            near = center[there] - center[here] <= reach * np.maximum(height[here], height[there])
            first += [here[near], there[near]]
            second += [there[near], here[near]]
        a, b = (order[np.concatenate([np.empty(0, np.int64), *x])] for x in (first, second))
        for at in range(0, len(a), PAGE_BATCH):
            left, right = table.take(a[at : at + PAGE_BATCH]), table.take(b[at : at + PAGE_BATCH])
            both = [left.column("page"), *(t.column(c) for t in (left, right) for c in columns)]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(both, arrow, strict=True)], schema=arrow).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last page may go on in the next batch.
            changes = np.flatnonzero(np.diff(batch.column(0).to_numpy()))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from met(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                if held and held[-1].column(0)[-1] != batch.column(0)[0]:
                    yield from met(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
        if held:
            yield from met(pa.Table.from_batches(held))

    return base.mapInArrow(run, schema)


BOX = ["idx", "x1", "y1", "x2", "y2"]


def _adjacent(a, b) -> bool:
    """The adjacency test of :func:`paperloom.functions.geometry.adjacent`, on tuples."""
    width, height = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, width) * max(0.0, height)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    if shared > 0 and union > 0 and shared / union > 0.3:
        return True
    lane = max(0.0, width) / max(min(a[2] - a[0], b[2] - b[0]), 1.0) >= 0.2 or max(-width, 0.0) <= 18
    return max(-height, 0.0) <= 5 and lane


def page_components(nodes: DataFrame) -> DataFrame:
    """(page, idx, component): boxes of a page that hang together; the smallest idx names them."""

    def rule(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r[2])
        parent = list(range(len(rows)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        # Sorted by y1, only boxes whose gap may still be 5 or less are met.
        open_boxes: list[int] = []
        for k, (_, *box) in enumerate(rows):
            open_boxes = [o for o in open_boxes if rows[o][4] + 5 >= box[1]]
            for o in open_boxes:
                if _adjacent(rows[o][1:], box):
                    parent[find(o)] = find(k)
            open_boxes.append(k)
        least: dict[int, int] = {}
        for k, row in enumerate(rows):
            root = find(k)
            least[root] = min(least.get(root, row[0]), row[0])
        return [(row[0], least[find(k)]) for k, row in enumerate(rows)]

    return by_page(nodes, BOX, rule, "idx long, component long")


def running_mean_segments(df: DataFrame, value: str, limit: float | None = None) -> DataFrame:
    """(page, idx, segment): a value joins the segment whose running mean is within ``limit``.

    Without a limit it is 0.28 of the page's median height, between 2.5 and 4.
    """

    def rule(rows: list[tuple]) -> list[tuple]:
        heights = [r[4] - r[2] for r in rows if r[4] > r[2]]
        reach = limit if limit is not None else min(max(median(heights) * 0.28 if heights else 0.0, 2.5), 4.0)
        segment, out, total, n = 0, [], 0.0, 0
        for v, _, idx in sorted((r[5], r[1], r[0]) for r in rows):
            if n and abs(v - total / n) > reach:
                segment, total, n = segment + 1, 0.0, 0
            total, n = total + v, n + 1
            out.append((idx, segment))
        return out

    return by_page(df, [*BOX, value], rule, "idx long, segment long")


def growing_lines(df: DataFrame) -> DataFrame:
    """(page, idx, line): visual lines against a growing box; y grows upward.

    A box joins the last line if they overlap by 45 % of the smaller height, or
    their centers are within 0.55 of the larger one.
    """

    def rule(rows: list[tuple]) -> list[tuple]:
        line, low, high, out = -1, 0.0, 0.0, []
        for idx, _, y1, _, y2 in sorted(rows, key=lambda r: (-r[4], r[1], -r[2], r[0])):
            ha, hb = max(high - low, 1.0), max(y2 - y1, 1.0)
            if line >= 0 and ((min(high, y2) - max(low, y1)) / min(ha, hb) >= 0.45 or abs((low + high) / 2 - (y1 + y2) / 2) <= 0.55 * max(ha, hb)):
                low, high = min(low, y1), max(high, y2)
            else:
                line, low, high = line + 1, y1, y2
            out.append((idx, line))
        return out

    return by_page(df, BOX, rule, "idx long, line long")


def greedy_line_merge(df: DataFrame, horizontal: bool) -> DataFrame:
    """Merge boxes greedily: the left item grows, and later tests see the grown box.

    horizontal: right neighbours on one baseline (gap -1 to max(4, 0.55 h)), else
    the next line below in the same lane (gap -2 to 0.9 h). Returns the merged
    boxes with the first member's idx, the number of members and their idxs.
    """

    def rule(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (-r[4], r[1], -r[2], r[0]))
        tallest = max(max(r[4] - r[2], 1.0) for r in rows)
        waits = [True] * len(rows)
        out = []
        for first, (idx, *box) in enumerate(rows):
            if not waits[first]:
                continue
            waits[first], members = False, [idx]
            while True:
                # Rows come by their upper edge: those behind the reach can't follow.
                reach = box[1] if horizontal else box[1] - 0.9 * max(tallest, box[3] - box[1])
                best = None
                for k in range(first + 1, len(rows)):
                    if rows[k][4] < reach:
                        break
                    if waits[k] and (rank := _follows(box, rows[k][1:], horizontal)) is not None and (best is None or (rank, k) < best):
                        best = rank, k
                if best is None:
                    break
                other = rows[best[1]]
                waits[best[1]] = False
                members.append(other[0])
                box = [min(box[0], other[1]), min(box[1], other[2]), max(box[2], other[3]), max(box[3], other[4])]
            out.append((idx, *box, len(members), members))
        return out

    return by_page(df, BOX, rule, "idx long, x1 double, y1 double, x2 double, y2 double, members long, merged array<long>")


def _follows(a, b, horizontal: bool) -> tuple | None:
    """Rank of b as the continuation of a, or None."""
    ha, hb = max(a[3] - a[1], 1.0), max(b[3] - b[1], 1.0)
    if horizontal:
        gap = b[0] - a[2]
        level = (min(a[3], b[3]) - max(a[1], b[1])) / min(ha, hb) >= 0.62 and abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) <= max(ha, hb) * 0.45
        return (gap, b[0]) if b[0] >= a[0] and level and -1 <= gap <= max(4.0, min(ha, hb) * 0.55) else None
    gap = a[1] - b[3]
    lane = min(a[2], b[2]) - max(a[0], b[0]) >= 0.5 * min(a[2] - a[0], b[2] - b[0])
    return (abs(gap), b[0]) if b[1] < a[1] and lane and -2 <= gap <= 0.9 * max(ha, hb) else None


def overlap_clusters(df: DataFrame, least: int = 3) -> DataFrame:
    """(page, anchor, members): fragments that overlap on one baseline, with a growing anchor; y grows upward."""

    def rule(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (-r[4], r[1], r[0]))
        used, out = set(), []
        for k, (idx, *box) in enumerate(rows):
            if k in used:
                continue
            members = 1
            for j in range(k + 1, len(rows)):
                _, *other = rows[j]
                if other[3] < box[1]:
                    break  # rows come by their upper edge
                ha, hb = max(box[3] - box[1], 1.0), max(other[3] - other[1], 1.0)
                level = (min(box[3], other[3]) - max(box[1], other[1])) / min(ha, hb) >= 0.62
                if j not in used and level and min(box[2], other[2]) - max(box[0], other[0]) > 0:
                    members += 1
                    used.add(j)
                    box = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])]
            if members >= least:
                out.append((idx, members))
        return out

    return by_page(df, BOX, rule, "anchor long, members long")


def scale_lanes(df: DataFrame) -> DataFrame:
    """(page, idx, lane): greedy lanes of similar left edge and width; the first that fits takes a box."""

    def rule(rows: list[tuple]) -> list[tuple]:
        lanes: list[tuple[float, float]] = []
        out = []
        for _, x1, idx, x2 in sorted((r[2], r[1], r[0], r[3]) for r in rows):
            lane = next((k for k, (a, w) in enumerate(lanes) if abs(a - x1) <= 18 and abs(w - (x2 - x1)) <= 24), None)
            if lane is None:
                lane = len(lanes)
                lanes.append((x1, x2 - x1))
            out.append((idx, lane))
        return out

    return by_page(df, BOX, rule, "idx long, lane long")


# ---- texts ---------------------------------------------------------------------------------

# Character classes of readable text (fixed values).
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"
ZERO_WIDTH = r"[\u200b\u200c\u200d\ufeff]+"
ODD_SPACES = r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+"
GLYPH_BLOCKS = r"[\u25a0-\u25ff\u2610\u2751\u2b1a\u2b1c\ufffd]+"
TIMES_BETWEEN_DIGITS = r"(?<=\d)\s*[xX\u2715\u2716\u2573\u2a2f*\uff0a]\s*(?=\d)"
LINE_ALIKE = 0.85
LONG_LINE = 8


@F.arrow_udf(T.StringType())
def canonical(texts: pa.Array) -> pa.Array:
    """NFKC, case folded, without zero-width characters and white space; null stays null."""

    def one(s):
        return None if s is None else "".join(re.sub("[\u200b\ufeff]", "", unicodedata.normalize("NFKC", s).casefold()).split())

    return by_part(texts, one, pa.string())


@F.arrow_udf(T.StringType())
def sanitized(texts: pa.Array) -> pa.Array:
    """Readable text, as :func:`sanitize`; null stays null."""
    return by_part(texts, lambda s: None if s is None else sanitize(s), pa.string())


#: Rewrites of a text in order. A glyph block inside a word becomes a hyphen, any other a blank.
REWRITES = [
    (re.compile("\r\n"), "\n"),
    (re.compile(CONTROLS), ""),
    (re.compile(ZERO_WIDTH), ""),
    (re.compile(ODD_SPACES), " "),
    (re.compile(rf"(?<=\S){GLYPH_BLOCKS}(?=\S)"), "-"),
    (re.compile(GLYPH_BLOCKS), " "),
    (re.compile(TIMES_BETWEEN_DIGITS), " \u00d7 "),
    (re.compile(r"[ \t]{2,}"), " "),
    (re.compile(r"(?m)^[^\S\n]+|[^\S\n]+$"), ""),
]


def sanitize(text: str) -> str:
    """NFKC, then the rewrites; lines and the whole text are stripped."""
    out = unicodedata.normalize("NFKC", text)
    for pattern, new in REWRITES:
        out = pattern.sub(new, out)
    return out.strip()


def distinct_lines(text: str) -> str:
    """Lines without repeats.

    A line goes if, white space aside, it equals the last kept one, or is long and
    is two of the last three kept ones joined in order, or was kept before. A long
    line that is alike to a kept long one takes its place if it is longer, else goes.
    """
    lines: list[str] = []
    bares: list[str] = []
    held: Counter = Counter()
    twins: list[_Twin | None] = []
    for line in sanitize(text).split("\n"):
        bare = re.sub(r"\s+", "", line)
        long = len(bare) >= LONG_LINE
        recent = bares[-3:]
        repeated = bool(bares) and bare == bares[-1]
        joined = long and any(bare == x + y for k, x in enumerate(recent) for y in recent[k + 1 :])
        if repeated or joined or long and held[bare]:
            continue
        counts = Counter(bare) if long else None
        twin = next((k for k, t in enumerate(twins) if t is not None and t.alike(bare, counts)), None) if long else None
        if twin is None:
            lines.append(line)
            bares.append(bare)
            held[bare] += 1
            twins.append(_Twin(bare) if long else None)
        elif len(bare) > len(bares[twin]):
            held[bares[twin]] -= 1
            held[bare] += 1
            lines[twin], bares[twin], twins[twin] = line, bare, _Twin(bare)
    return "\n".join(lines).strip()


class _Twin:
    """A kept long line, ready to be compared with many others."""

    def __init__(self, bare: str):
        self.bare, self.counts, self.matcher, self.places = bare, Counter(bare), None, None

    def alike(self, bare: str, counts: Counter) -> bool:
        """Whether the ratio of matching characters is ``LINE_ALIKE`` or more; three upper bounds of it come first, the cheapest one first."""
        least = LINE_ALIKE * (len(bare) + len(self.bare))
        if 2 * min(len(bare), len(self.bare)) < least or 2 * (counts & self.counts).total() < least or 2 * self.subsequence(bare) < least:
            return False
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", self.bare)
        self.matcher.set_seq1(bare)
        return self.matcher.ratio() >= LINE_ALIKE

    def subsequence(self, other: str) -> int:
        """Length of the longest common subsequence, which matching blocks are one of: a row of the usual table as the bits of one number."""
        if self.places is None:
            self.places = {}
            for k, c in enumerate(self.bare):
                self.places[c] = self.places.get(c, 0) | 1 << k
        full = (1 << len(self.bare)) - 1
        row = full
        for c in other:
            hit = row & self.places.get(c, 0)
            row = (row + hit | row - hit) & full
        return len(self.bare) - row.bit_count()


@F.pandas_udf(T.StringType())
def without_repeated_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else distinct_lines(s))


def is_block_noise(text: str) -> bool:
    """Whether the letters of a text are one short block over and over, as a table's rules read as text.

    NFKC, white space aside, 10 characters and 10 letters or more. Up to four
    letters at the end may be left over; what is before them is in capitals, has 8
    letters or more and is a block of two to four letters three times or more.
    """
    bare = "".join(unicodedata.normalize("NFKC", text).split())
    letters = "".join(filter(str.isalpha, bare))
    if len(bare) < 10 or len(letters) < 10:
        return False
    bodies = (letters[: len(letters) - tail] for tail in range(5))
    return any(len(b) % size == 0 and len(b) >= max(8, 3 * size) and b[size:] == b[:-size] for b in bodies if b.isupper() for size in (2, 3, 4))


@F.pandas_udf(T.BooleanType())
def block_noise(texts: pd.Series) -> pd.Series:
    """As :func:`is_block_noise`; null stays null."""
    return texts.map(lambda s: None if s is None else is_block_noise(s))


@F.pandas_udf(T.IntegerType())
def display_width(texts: pd.Series) -> pd.Series:
    """Columns a text takes: full-width characters count twice; null stays null."""
    return texts.map(lambda s: None if s is None else sum(1 if c.isspace() else 2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in s)).astype("Int32")


def chunks(text: Column, limit: int) -> Column:
    """Pieces of whole lines up to ``limit`` characters; a longer line is a piece of its own. Native fold."""
    lines = F.filter(F.split(text, "(?<=\n)"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, line):
        full = (F.length(acc["open"]) > 0) & (F.length(acc["open"]) + F.length(line) > limit)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, line).otherwise(F.concat(acc["open"], line)).alias("open"))

    return F.aggregate(lines, start, step, lambda acc: F.when(F.length(acc["open"]) > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def sections(df: DataFrame, most: int = 8, chars: int = 2200) -> DataFrame:
    """(doc_id, section, paragraphs, size): paragraphs in order, flushed at so many or so many characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, lengths in zip(pdf.doc_id, pdf.lengths, strict=True):
                n = size = section = 0
                for length in lengths:
                    n, size = n + 1, size + int(length)
                    if n >= most or size >= chars:
                        out.append((doc_id, section, n, size))
                        section, n, size = section + 1, 0, 0
                if n:
                    out.append((doc_id, section, n, size))
            yield pd.DataFrame(out, columns=["doc_id", "section", "paragraphs", "size"])

    lengths = df.select("doc_id", F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.length).alias("lengths"))
    return lengths.mapInPandas(run, "doc_id long, section long, paragraphs long, size long")


def overlap_join(a: str, b: str, least: int = 2) -> str:
    """b appended to a without their longest common border."""
    for n in range(min(len(a), len(b)), least - 1, -1):
        if a.endswith(b[:n]):
            return a + b[n:]
    return a + b
