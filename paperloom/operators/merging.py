"""Merging text fragments of a page: plan, guard, apply.

A rule walks through the fragments in reading order. Each grows by the best of those
that may continue it, and later tests see the grown text and box. The plan is that
walk with every pair it took and what the guard says to it; applying walks again and
stops growing a fragment at the first pair that isn't among the allowed ones. What a
guard says depends on the records, that is on what was known of both fragments before
any of them grew; a grown fragment keeps the record of its first part.

Rules (names are fixed values):

* ``merge_same_line_fragment_bridge``: punctuation, the rest of a number or a word, and
  very short pieces go to the fragment on their left. Guarded before they are taken.
* ``merge_contiguous_body_lines``: the next line of a paragraph. The walk stops where
  the guard rejects.
* ``merge_same_line``: whatever continues a line, else the wrapped rest of a number.
  Here the plan goes on where the guard rejects, so that it can list more pairs than
  applying it takes.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.folds import by_page

Box = tuple[float, float, float, float]

#: Roles that are never merged, and words that go on with a sentence (fixed values).
APART = frozenset({"toc_entry", "vertical_label", "running_edge_text"})
GOES_ON = frozenset("and or of to for with in on by from unless that which as so".split())
#: Marks that end a sentence, and what may close behind them; marks of a small piece (fixed values).
STOPS, CLOSING = frozenset(".!?。！？:：;；"), frozenset("])}）】\"'”’")
SMALL_MARKS, LINE_MARKS = frozenset(".。,:;!?-"), frozenset(".,:;/%+-–±()")
UNIT_SIGNS = frozenset("%\u00b0\u03a9\u2126\u00b5\u03bc")
WORD = re.compile(r"\w+")
THREE_LETTERS, SMALL_OR_BLANK = re.compile("[A-Za-z](?:[^A-Za-z]*[A-Za-z]){2}"), re.compile(r"[a-z\s]")
NO_LETTER, SMALL_RUN = re.compile("[^A-Za-z]+"), re.compile("[a-z]*")
SCRIPT_LETTER = re.compile("[A-Za-z一-鿿぀-ヿ가-힯]")


class Record(NamedTuple):
    """What is known of a fragment before any grows."""

    idx: int
    role: str
    region: str | None
    column: str | None
    label: str
    xobj: int | None
    edge: bool
    size: float


class Fragment:
    __slots__ = ("_ends", "_number", "_plain", "_prose", "_script", "box", "height", "members", "record", "text")

    def __init__(self, record: Record, text: str, box: Box, members: list[int]):
        self.record, self.text, self.box, self.members = record, text, box, members
        tall = box[3] - box[1]
        self.height = tall if tall > 1.0 else 1.0
        self._plain = self._prose = self._ends = self._script = self._number = None

    # What is asked of a text is worked out once, and only if the places fit.

    @property
    def plain(self) -> str:
        if self._plain is None:
            text = self.text
            self._plain = (text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()
        return self._plain

    @property
    def prose(self) -> bool:
        if self._prose is None:
            self._prose = is_prose(self.plain)
        return self._prose

    @property
    def ends(self) -> bool:
        if self._ends is None:
            self._ends = ends_sentence(self.plain)
        return self._ends

    @property
    def script(self) -> bool:
        if self._script is None:
            self._script = _letters_of_script(self.plain)
        return self._script

    @property
    def number(self) -> bool:
        if self._number is None:
            self._number = self.plain[-1:].isdecimal() and is_page_number(self.plain)
        return self._number

    def grown(self, other: Fragment, separator: str) -> Fragment:
        (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = self.box, other.box
        box = (bx1 if bx1 < ax1 else ax1, by1 if by1 < ay1 else ay1, bx2 if bx2 > ax2 else ax2, by2 if by2 > ay2 else ay2)
        return Fragment(self.record, self.text + separator + other.text, box, self.members + other.members)


class Found(NamedTuple):
    """A pair that may merge: the lowest rank is taken first."""

    rank: tuple
    reason: str
    separator: str


# ---- texts ---------------------------------------------------------------------------------


def is_prose(text: str) -> bool:
    """Three letters or more, and a lower-case a to z or white space among the text."""
    if text.isascii():
        return THREE_LETTERS.search(text) is not None and SMALL_OR_BLANK.search(text) is not None
    letters, small = 0, False
    for c in text:
        letters += c.isalpha()
        small = small or "a" <= c <= "z" or c.isspace()
        if small and letters >= 3:
            return True
    return False


def is_page_number(text: str) -> bool:
    """Up to four digits, or two such numbers around a slash, after ``page`` or not."""
    if not text[-1:].isdecimal():
        return False
    bare = text[4:].lstrip() if text[:4].lower() == "page" else text
    parts = [p.strip() for p in bare.split("/")]
    return len(parts) <= 2 and bare == bare.strip() and all(p.isdecimal() and len(p) <= 4 for p in parts)


def breaks_word(left: str, right: str) -> bool:
    """Letters on both sides of the cut, one of them in lower case."""
    a, b = left[-1:], right[:1]
    return a.isalpha() and b.isalpha() and (a.islower() or b.islower())


def ends_sentence(text: str) -> bool:
    end = len(text.rstrip())
    while end and text[end - 1] in CLOSING:
        end -= 1
    return text[:end].rstrip()[-1:] in STOPS if text[:end].rstrip() else False


def continues_sentence(text: str) -> bool:
    first = text[:1]
    word = WORD.match(text)
    return bool(first) and (first.islower() or first.isdigit() or first in "([{（" or word is not None and word.group().lower() in GOES_ON)


def _letters_of_script(text: str) -> bool:
    """Whether a Latin, Han, Kana or Hangul letter is in the text."""
    return SCRIPT_LETTER.search(text) is not None


def may_share_text(left: str, right: str) -> bool:
    """Whether two texts may be parts of one line."""
    both = left + right
    if not left or not right or len(both) < 8 or not any(map(str.isalpha, both)) or is_page_number(left) or is_page_number(right):
        return False
    return (_letters_of_script(left) or _letters_of_script(right)) and (breaks_word(left, right) or is_prose(left) or is_prose(right))


def may_share(a: Fragment, b: Fragment) -> bool:
    """:func:`may_share_text` of two fragments' texts, by what is known of each."""
    left, right = a.plain, b.plain
    if not left or not right or len(left) + len(right) < 8 or a.number or b.number:
        return False
    # A broken word and prose have letters.
    return (a.script or b.script) and (breaks_word(left, right) or a.prose or b.prose)


def is_dot_leader(text: str) -> bool:
    return len(text) >= 8 and (text[0] in ".·…" or text[0].isspace()) and all(c in ".·…" or c.isspace() for c in text)


def is_mark(text: str) -> bool:
    return 1 <= len(text) <= 2 and all(c in LINE_MARKS for c in text)


def is_small(text: str) -> bool:
    """At most 18 characters with a letter, or nothing but marks; white space aside."""
    bare = "".join(text.split())
    return 0 < len(bare) <= 18 and (any(map(str.isalpha, bare)) or all(c in SMALL_MARKS for c in bare))


def number_is_cut(left: str, right: str, alone: bool) -> bool:
    """The left text ends with digits and a point; the right one begins with digits and a unit, or with digits only if ``alone``."""
    if not (left[-1:] == "." and left[-2:-1].isdecimal()):
        return False
    rest = right.lstrip("0123456789")
    if rest == right:
        return False
    return alone if not rest else rest[0] in UNIT_SIGNS or rest[0].isascii() and rest[0].isalpha()


# ---- places --------------------------------------------------------------------------------


def level_reason(a: Fragment, b: Fragment) -> str:
    """'ok' if b stands on a's line right behind it; else the first test that says no."""
    (ax1, ay1, ax2, ay2), (bx1, by1, _, by2) = a.box, b.box
    small, large = min(a.height, b.height), max(a.height, b.height)
    if bx1 < ax1:
        return "right_before_left"
    if (min(ay2, by2) - max(ay1, by1)) / small < 0.62:
        return "low_vertical_overlap"
    if abs((ay1 + ay2) / 2 - (by1 + by2) / 2) > large * 0.45:
        return "centerline_delta_too_large"
    return "ok" if -1.0 <= bx1 - ax2 <= max(4.0, small * 0.55) else "gap_out_of_range"


def is_level(a: Fragment, b: Fragment) -> bool:
    """Whether b stands on a's line right behind it; the gap says no to most."""
    left, right = a.box, b.box
    small = a.height if a.height < b.height else b.height
    between = right[0] - left[2]
    if between < -1.0 or between > 4.0 and between > small * 0.55 or right[0] < left[0]:
        return False
    if left[1] == right[1] and left[3] == right[3]:
        return left[3] - left[1] >= small * 0.62
    return level_reason(a, b) == "ok"


def gap(a: Fragment, b: Fragment) -> float:
    return b.box[0] - a.box[2]


def close(a: Fragment, b: Fragment, low: float, least: float, share: float) -> bool:
    """Whether the gap is between ``low`` and the larger of ``least`` and ``share`` of the smaller height."""
    return low <= gap(a, b) <= max(least, min(a.height, b.height) * share)


def takes_mark(a: Fragment, b: Fragment) -> bool:
    """Whether b, on a's line, is a mark that a takes."""
    if len(b.plain) > 2 or not is_mark(b.plain):
        return False
    x, y = a.record, b.record
    return not (x.role in APART or y.role in APART or x.edge or y.edge) and x.xobj == y.xobj


def broken_word(a: Fragment, b: Fragment) -> bool:
    """A word goes on in lower case right behind the cut."""
    left, right = a.plain, b.plain
    if not close(a, b, -0.5, 2.0, 0.25) or not left or not right or not left[-1].isalpha() or not right[0].islower():
        return False
    run = len(SMALL_RUN.match(NO_LETTER.sub("", right)).group())
    # A run of up to 12 small letters ends there or at a capital.
    return 1 <= run <= 12


def small_piece(a: Fragment, b: Fragment) -> bool:
    left, right = a.plain, b.plain
    return (
        level_reason(a, b) == "ok"
        and close(a, b, -0.75, 3.0, 0.42)
        and bool(left and right)
        and not a.number
        and not b.number
        and (is_small(left) or is_small(right))
        and is_prose(left + right)
    )


def text_goes_on(a: Fragment, b: Fragment) -> bool:
    return may_share(a, b) and level_reason(a, b) == "ok" and (breaks_word(a.plain, b.plain) or not a.ends and continues_sentence(b.plain))


def is_block(a: Fragment) -> bool:
    """Prose of several lines."""
    return a.height / (a.record.size or 10.0) >= 2.6 and len(a.plain) >= 40 and a.prose


# ---- guards --------------------------------------------------------------------------------


def guard(a: Fragment, b: Fragment) -> tuple[str, str]:
    """(decision, reason) of merging two records of one page."""
    x, y = a.record, b.record
    if x.region is None or y.region is None:
        return "rejected", "missing_layout_region"
    if x.region == "unknown" or y.region == "unknown":
        return "rejected", "unknown_region"
    if x.region != "body_column" or y.region != "body_column":
        return "rejected", "non_body_region"
    return ("allowed", "same_body_column") if x.column == y.column else ("rejected", "cross_column")


MIXED = frozenset({"body_column", "table", "unknown"})


def bridge_guard(a: Fragment, b: Fragment, reason: str) -> tuple[str, str]:
    """The guard with what a bridge on one line may cross all the same."""
    decision, why = guard(a, b)
    x, y = a.record, b.record
    if decision == "allowed" or x.region is None or y.region is None or level_reason(a, b) != "ok":
        return decision, why
    if why == "unknown_region" and (x.region, y.region) == ("body_column", "unknown") and y.role in ("body", "preserved_token"):
        return "allowed", "same_body_column_inline_bridge"
    if why == "cross_column" and reason == "broken_word_continuation" and close(a, b, -0.5, 1.2, 0.12):
        return "allowed", "tight_inline_column_boundary_bridge"
    if why in ("non_body_region", "unknown_region") and {x.region, y.region} <= MIXED and small_piece(a, b):
        return "allowed", "dense_same_line_micro_fragment_bridge"
    if x.role == y.role == "body" and {x.region, y.region} == {"body_column", "table"} and x.xobj == y.xobj and text_goes_on(a, b):
        return "allowed", "mixed_region_same_line_text_continuation"
    return decision, why


# ---- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``find``: how the second continues the first; ``fallback``: tried if no fragment does.
    ``judge``: the guard. ``only_allowed``: rejected pairs aren't found at all; ``stops``: the plan stops at one.
    ``reach``, ``fallback_reach``: lowest and highest upper edge, lowest and highest left edge of what may
    continue a fragment, given the largest height of any, or null if nothing may; what they leave out isn't found."""

    name: str
    find: Callable[[Fragment, Fragment], Found | None]
    judge: Callable[[Fragment, Fragment, str], tuple[str, str]]
    reach: Callable[[Fragment, float], tuple[float, float, float, float] | None]
    fallback: Callable[[Fragment, Fragment], Found | None] | None = None
    fallback_reach: Callable[[Fragment, float], tuple[float, float, float, float] | None] = lambda a, tall: None
    only_allowed: bool = False
    stops: bool = False


def find_bridge(a: Fragment, b: Fragment) -> Found | None:
    if not is_level(a, b) or a.record.xobj != b.record.xobj:
        return None
    if takes_mark(a, b):
        order, reason = 0.0, "inline_punctuation"
    elif number_is_cut(a.plain, b.plain, True):
        order, reason = 0.1, "inline_decimal_continuation"
    elif broken_word(a, b):
        order, reason = 1.0, "broken_word_continuation"
    elif a.record.region in MIXED and b.record.region in MIXED and not a.record.region == b.record.region == "body_column" and small_piece(a, b):
        order, reason = 1.0, "inline_micro_fragment_continuation"
    else:
        return None
    return None if is_dot_leader(b.plain) else Found((order, max(gap(a, b), -1.0), b.box[0]), reason, "")


def find_body_line(a: Fragment, b: Fragment) -> Found | None:
    below = a.box[1] - b.box[3]
    if below < -2.0:
        return None
    wide, other = a.box[2] - a.box[0], b.box[2] - b.box[0]
    least = wide if wide < other else other
    if least < 48.0 or not (below <= max(6.0, min(a.height, b.height) * 0.72) and abs(a.box[0] - b.box[0]) <= max(8.0, least * 0.08)):
        return None
    x, y = a.record, b.record
    same = x.role == y.role == "body" and x.label == y.label == "plain text" and x.xobj == y.xobj and x.region == y.region == "body_column" and x.column == y.column
    if not same or a.ends or not a.prose or not b.prose or not (breaks_word(a.plain, b.plain) or continues_sentence(b.plain)):
        return None
    return Found((abs(below), b.box[0]), "contiguous_body_line", " ")


def kept_apart(a: Fragment, b: Fragment) -> str | None:
    """The first test, but for their places on the line, that says the texts aren't parts of one line."""
    x, y = a.record, b.record
    if x.role in APART:
        return f"left_role:{x.role}"
    if y.role in APART:
        return f"right_role:{y.role}"
    if x.edge or y.edge:
        return "edge_band"
    if x.xobj != y.xobj:
        return "different_xobj"
    if not may_share(a, b):
        return "text_not_mergeable"
    return "multi_line_blocks" if is_block(a) and is_block(b) else None


def same_line_reason(a: Fragment, b: Fragment) -> str:
    """'ok' if the texts may be parts of one line; else the first test that says no."""
    return kept_apart(a, b) or level_reason(a, b)


def find_same_line(a: Fragment, b: Fragment) -> Found | None:
    if not is_level(a, b):
        return None
    between = b.box[0] - a.box[2]
    if takes_mark(a, b):
        return Found((0.0, max(between, -1.0), b.box[0]), "inline_punctuation", "")
    return Found((1.0, max(between, -1.0), b.box[0]), "ok", " " if between > 1.5 else "") if kept_apart(a, b) is None else None


def find_wrapped_number(a: Fragment, b: Fragment) -> Found | None:
    if not a.plain.endswith(".") or a.record.xobj != b.record.xobj or not number_is_cut(a.plain, b.plain, False):
        return None
    lower = b.box[1] < a.box[1] - max(2.0, a.height * 0.2)
    if not lower or b.box[0] > a.box[0] + max(8.0, a.height * 0.6) or abs(b.box[3] - a.box[3]) > max(a.height, b.height) * 0.35:
        return None
    return Found((a.box[1] - b.box[1], abs(b.box[0] - a.box[0])), same_line_reason(a, b), "")


def may_be_neighbours(a: Fragment, b: Fragment) -> bool:
    if abs((a.box[1] + a.box[3]) / 2 - (b.box[1] + b.box[3]) / 2) > max(a.height, b.height) * 0.8:
        return False
    return gap(a, b) <= max(18.0, min(a.height, b.height) * 2.0) and bool(a.text.strip() and b.text.strip())


# The slack of 0.01 is for rounding: the rules themselves say what fits.
def _line(a: Fragment, tall: float) -> tuple[float, float, float, float]:
    """What shares a line's height reaches above its lower edge."""
    _, y1, x2, y2 = a.box
    far = a.height * 0.55
    return y1, y2 + tall, x2 - 1.01, x2 + (far if far > 4.0 else 4.0) + 0.01


def _below(a: Fragment, tall: float) -> tuple[float, float, float, float] | None:
    """What stands right below the lower edge and begins where a does, if a is prose that may go on."""
    x1, y1, x2, _ = a.box
    if a.record.role != "body" or a.record.region != "body_column" or x2 - x1 < 48.0 or a.ends or not a.prose:
        return None
    aside = max(8.0, (x2 - x1) * 0.08) + 0.01
    return y1 - max(6.0, tall * 0.72) - 0.01, y1 + 2.01, x1 - aside, x1 + aside


def _wrapped(a: Fragment, tall: float) -> tuple[float, float, float, float] | None:
    """A wrapped number's upper edge is at most 0.35 heights away; the text before it ends with a point."""
    if a.plain[-1:] != ".":
        return None
    away = max(tall, a.height) * 0.35 + 0.01
    return a.box[3] - away, a.box[3] + away, float("-inf"), a.box[0] + max(8.0, a.height * 0.6) + 0.01


BRIDGE = Rule("merge_same_line_fragment_bridge", find_bridge, bridge_guard, _line, only_allowed=True)
BODY_LINES = Rule("merge_contiguous_body_lines", find_body_line, lambda a, b, _: guard(a, b), _below, stops=True)
SAME_LINE = Rule("merge_same_line", find_same_line, lambda a, b, _: guard(a, b), _line, fallback=find_wrapped_number, fallback_reach=_wrapped)
RULES = {r.name: r for r in (BRIDGE, BODY_LINES, SAME_LINE)}


# ---- the walk ------------------------------------------------------------------------------


class Walk:
    """One page's fragments in reading order, and how far they were merged.

    Fragments with one upper edge follow each other by their left edges, so those in reach
    are looked up instead of tried one by one.
    """

    def __init__(self, fragments: list[Fragment], rule: Rule):
        self.rule = rule
        self.items = sorted(fragments, key=lambda f: (-f.box[3], f.box[0], -f.box[1], f.record.idx))
        self.lefts = [f.box[0] for f in self.items]
        self.tops: list[float] = []
        self.starts: list[int] = []
        for k, f in enumerate(self.items):
            top = -f.box[3]
            if not self.tops or self.tops[-1] != top:
                self.tops.append(top)
                self.starts.append(k)
        self.starts.append(len(self.items))
        self.tallest = max((f.height for f in fragments), default=1.0)
        self.taken: set[int] = set()
        self.rows: list[Fragment] = []

    def _first(self, current: Fragment, at: int, find: Callable[[Fragment, Fragment], Found | None], reach: tuple[float, float, float, float] | None) -> tuple[int, Found] | None:
        """The best of those in reach that ``find`` says may continue the fragment; the earlier of equals."""
        if reach is None:
            return None
        low, high, left, right = reach
        tops, starts, lefts = self.tops, self.starts, self.lefts
        best: tuple[int, Found] | None = None
        row, last = bisect_left(tops, -high), -low
        while row < len(tops) and tops[row] <= last:
            end = starts[row + 1]
            k = bisect_left(lefts, left, starts[row], end)
            while k < end and lefts[k] <= right:
                if k != at and k not in self.taken:
                    found = find(current, self.items[k])
                    if found is not None and (best is None or found.rank < best[1].rank) and (not self.rule.only_allowed or self.rule.judge(current, self.items[k], found.reason)[0] == "allowed"):
                        best = k, found
                k += 1
            row += 1
        return best

    def best(self, current: Fragment, at: int) -> tuple[int, Found] | None:
        rule = self.rule
        found = self._first(current, at, rule.find, rule.reach(current, self.tallest))
        if found is None and rule.fallback is not None:
            found = self._first(current, at, rule.fallback, rule.fallback_reach(current, self.tallest))
        return found

    def plan(self) -> Iterator[tuple]:
        """(left, right, left role, right role, reason, decision, guard reason) of every pair that the walk takes or stops at."""
        for at, current in enumerate(self.items):
            if at in self.taken:
                continue
            while (best := self.best(current, at)) is not None:
                k, found = best
                right = self.items[k]
                decision, why = self.rule.judge(current, right, found.reason)
                yield current.record.idx, right.record.idx, current.record.role, right.record.role, found.reason, decision, why
                if self.rule.stops and decision == "rejected":
                    break
                current = current.grown(right, found.separator)
                self.taken.add(k)
            self.rows.append(current)
            if self.rule.name == SAME_LINE.name and best is None:
                k = next((k for k in range(at + 1, len(self.items)) if k not in self.taken), None)
                if k is not None and may_be_neighbours(current, self.items[k]):
                    right = self.items[k]
                    yield current.record.idx, right.record.idx, current.record.role, right.record.role, same_line_reason(current, right), "skipped", guard(current, right)[1]

    def apply(self, allowed: set[tuple[int, int]]) -> tuple[list[Fragment], list[tuple[int, int, str]]]:
        """Rows in the order of their first members' numbers, and the pairs that were merged.

        A fragment that stood as a row before a later one took it stays a row, too.
        """
        rows, merged = [], []
        for at, current in enumerate(self.items):
            if at in self.taken:
                continue
            while (best := self.best(current, at)) is not None:
                k, found = best
                right = self.items[k]
                if (current.record.idx, right.record.idx) not in allowed:
                    break
                merged.append((current.record.idx, right.record.idx, found.reason))
                current = current.grown(right, found.separator)
                self.taken.add(k)
            rows.append(current)
        return sorted(rows, key=lambda f: min(f.members)), merged


# ---- on tables -----------------------------------------------------------------------------

COLUMNS = ["idx", "x1", "y1", "x2", "y2", "text", "role", "region", "column_id", "label", "xobj", "edge", "size"]
ROWS = "idx long, x1 double, y1 double, x2 double, y2 double, text string, role string, region string, column_id string, label string, xobj long, edge boolean, size double"
PLAN = "left long, right long, left_role string, right_role string, reason string, decision string, guard_reason string"


def _fragment(row: tuple) -> Fragment:
    idx, x1, y1, x2, y2, text, role, region, column, label, xobj, edge, size = row
    return Fragment(Record(idx, role, region, column, label, xobj, edge, size), text or "", (x1, y1, x2, y2), [idx])


def fragments_of(rows: list[tuple]) -> list[Fragment]:
    return [_fragment(r) for r in rows]


def plan(fragments: DataFrame, rule: Rule, together: bool = False) -> DataFrame:
    """(page, left, right, left_role, right_role, reason, decision, guard_reason): nothing is changed.

    ``skipped`` are neighbours that the walk came to and didn't take.
    """
    return by_page(fragments, COLUMNS, lambda rows: list(Walk([_fragment(r) for r in rows], rule).plan()), PLAN, together)


def allowed_pairs(planned: DataFrame) -> DataFrame:
    return planned.where("decision = 'allowed'").select("page", "left", "right").distinct()


def _merged(fragments: list[Fragment], rule: Rule) -> tuple[list[Fragment], list[tuple[int, int, str]]]:
    """A page's rows after the pairs that its plan allows, and the merges.

    The plan's walk is the one of applying it, unless it went on behind a pair that the guard rejects.
    """
    walk = Walk(fragments, rule)
    pairs = list(walk.plan())
    if rule.stops or all(p[5] != "rejected" for p in pairs):
        return sorted(walk.rows, key=lambda f: min(f.members)), [(p[0], p[1], p[4]) for p in pairs if p[5] == "allowed"]
    return Walk(fragments, rule).apply({(p[0], p[1]) for p in pairs if p[5] == "allowed"})


def planned_and_applied(fragments: DataFrame, rule: Rule, together: bool = False) -> DataFrame:
    """(page, place, columns of fragments, members): :func:`apply` with all that the plan allows, page by page in one pass."""

    def run(rows: list[tuple]) -> list[tuple]:
        by_idx = {r[0]: r for r in rows}
        kept, _ = _merged([_fragment(r) for r in rows], rule)
        return [(k, f.record.idx, *f.box, f.text, *by_idx[f.record.idx][6:], f.members) for k, f in enumerate(kept)]

    return by_page(fragments, COLUMNS, run, f"place long, {ROWS}, members array<long>", together)


def merge_events(fragments: DataFrame, rule: Rule, together: bool = False) -> DataFrame:
    """(page, left, right, reason) of the merges in :func:`planned_and_applied`."""
    return by_page(fragments, COLUMNS, lambda rows: _merged([_fragment(r) for r in rows], rule)[1], "left long, right long, reason string", together)


def chain(fragments: list[Fragment], rules: list[Rule]) -> list[Fragment]:
    """A page's fragments after the rules in their order; each starts from the rows that the one before left."""
    for rule in rules:
        fragments = [f if len(f.members) == 1 else Fragment(f.record, f.text, f.box, [f.record.idx]) for f in _merged(fragments, rule)[0]]
    return fragments


def apply(fragments: DataFrame, pairs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The page's rows after merging the allowed ``pairs`` (page, left, right), and the merges as events.

    Both inputs meet page by page. Rows have the columns of fragments, ``members``
    (numbers of the fragments in them, in order) and ``place`` (their order on the
    page). Pages without a pair pass through it as well, as rows. Two outputs come out
    of one pass: an event is a row without a place.
    """
    out = T._parse_datatype_string(f"page long, place long, {ROWS}, members array<long>, right long, reason string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def replay(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        page = key[0].as_py()
        rows = list(zip(*(left.column(c).to_pylist() for c in COLUMNS), strict=True))
        held = set(zip(right.column("left").to_pylist(), right.column("right").to_pylist(), strict=True))
        by_idx = {r[0]: r for r in rows}
        kept, merged = Walk([_fragment(r) for r in rows], rule).apply(held)
        made = [(page, k, f.record.idx, *f.box, f.text, *by_idx[f.record.idx][6:], f.members, None, None) for k, f in enumerate(kept)]
        made += [(page, None, a, *[None] * 12, None, b, why) for a, b, why in merged]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow) if made else arrow.empty_table()

    both = fragments.select("page", *COLUMNS).groupBy("page").cogroup(pairs.select("page", "left", "right").groupBy("page")).applyInArrow(replay, out)
    rows = both.where("place IS NOT NULL").drop("right", "reason")
    return rows, both.where("place IS NULL").select("page", F.col("idx").alias("left"), "right", "reason")
