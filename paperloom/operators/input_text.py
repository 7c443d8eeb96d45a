"""The text that a translator is given: the parser's, the paragraph's own, or one rebuilt from its glyphs.

The parser puts a placeholder where it takes something for a formula. Where that cut
through a number or a name, the paragraph's text is better; where the parser ran words
together, the text rebuilt from the glyphs of its items is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.label_lines import Glyph, around, implied_space, run_text

#: Words that a parser runs together, by which such a text is known (fixed values).
RUN_TOGETHER = (r"(?<![A-Za-z])COMP(?:QUE|MODE)(?=\s+bit)", "theConfigregister", "bitscanalso", r"\btheCOMP\b", r"\bandCOMP\b")
UNITS = frozenset("%\u00b0\u03a9\u2126\u00b5\u03bc")
FORMULA = "formula"


class Placeholder(NamedTuple):
    token: str
    kind: str
    formula: str
    composition: str

    @property
    def fragment(self) -> str:
        return self.composition or self.formula


# ---- rebuilding ----------------------------------------------------------------------------


def _capitals_at_end(text: str) -> bool:
    """Two capitals or more at the end."""
    return len(text) - len(text.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) >= 2


def _capitals_at_start(text: str) -> bool:
    """Two to ten capitals at the start, with no letter behind them; longer runs and names in small letters don't count."""
    n = len(text) - len(text.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    after = text[n : n + 1]
    return 2 <= n <= 10 and not (after.isascii() and after.isalpha())


def connects(a: Sequence[Glyph], b: Sequence[Glyph]) -> bool:
    """Whether two runs are parts of one name whose low line was lost: capitals on both sides and a small gap."""
    left, right = run_text(a).rstrip(), run_text(b).lstrip()
    if not left or not right or left.endswith("_") or right.startswith("_") or not _capitals_at_end(left) or not _capitals_at_start(right):
        return False
    sizes = [g.size for g in (a[0], a[-1], b[0], b[-1]) if g.size > 0]
    gap = around(b).x1 - around(a).x2
    return -1.0 <= gap <= max(8.0, min(sizes) * 0.85 if sizes else 8.0)


def rebuilt(items: Sequence[Sequence[Glyph]]) -> str | None:
    """The items' texts with what the glyphs at their borders say stands between them."""
    out: list[str] = []
    earlier: Sequence[Glyph] = ()
    last: Sequence[Glyph] | None = None
    for item in items:
        text = run_text(item)
        if text and last:
            if connects(last, item):
                out.append("_")
            elif implied_space(earlier[-1] if earlier else None, last[-1], item[0]):
                out.append(" ")
        if text:
            out.append(text)
        earlier, last = last or (), item
    return "".join(out).strip() or None


def without_loose_lines(text: str) -> str:
    """Low lines only inside names, one at a place; among other marks they stay."""
    alnum = lambda c: c.isascii() and c.isalnum()
    s = text.strip()

    def kept(m: re.Match) -> str:
        left, right = s[m.start() - 1 : m.start()] if m.start() else "", s[m.end() : m.end() + 1]
        if alnum(left) or alnum(right):
            return "_" if alnum(left) and alnum(right) else ""
        loose = not right or right.isspace() or right in ".,;:!?)" or not left or left.isspace() or left == "("
        return "" if loose else m.group()

    return re.sub("_+", kept, s)


# ---- choosing ------------------------------------------------------------------------------


def number_cut(fragment: str, source: str) -> str | None:
    """Where a fragment is the whole part of a number that goes on in the source, that part as it stands there.

    One behind an equals sign is looked for first, then one by itself, then any.
    """
    head = "".join(fragment.split()).removeprefix("=")
    digits = head[1:] if head[:1] in ("+", "-", "±") else head
    if not digits.isdecimal():
        return None
    places = [m for m in re.finditer(re.escape(head), source) if re.match(r"[.,]\d", source[m.end() :])]
    for m in places:
        before = source[: m.start()].rstrip()
        if before.endswith("="):
            return source[len(before) - 1 : m.end()]
    alone = [m for m in places if not (m.start() and source[m.start() - 1].isascii() and source[m.start() - 1].isalnum())]
    return head if alone or places else None


def aligned(source: str, placeholders: Sequence[Placeholder]) -> str:
    """The source with each formula's placeholder at the first of its fragments that none has taken."""
    out = source
    for p in placeholders:
        if p.kind == FORMULA and p.token and p.fragment:
            out = out.replace(number_cut(p.fragment, out) or p.fragment, p.token, 1)
    return out


def is_literal(source: str, placeholders: Sequence[Placeholder]) -> bool:
    """Whether a formula is none: a low line, a part of a number, or a number with a sign."""
    for p in placeholders:
        bare = unicodedata.normalize("NFKC", p.fragment).strip() if p.kind == FORMULA else ""
        rest = bare[1:].lstrip() if bare[:1] in ("+", "-", "±") else ""
        if bare and source and (bare == "_" or number_cut(bare, source) is not None or re.fullmatch(r"\d+(?:[.,]\d+)?", rest)):
            return True
    return False


def _marks(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\{[^{}\s]+\}", text)]


def is_mismatch(source: str, current: str) -> bool:
    """Whether a placeholder next to a word or number hides a part of a name or number of the source, which has none itself."""
    if not source or not current or _marks(source):
        return False
    alnum = lambda s: s[:1].isascii() and s[:1].isalnum()
    if not any(alnum(current[:a].rstrip()[-1:]) or alnum(current[b:].lstrip()) for a, b in _marks(current)):
        return False
    signed = any(alnum(source[:k].rstrip()[-1:]) and source[k + 1 :].lstrip()[:1].isdecimal() for k, c in enumerate(source) if c in "+-±")
    measured = any(m.end() < len(source) and (source[m.end()] in UNITS or source[m.end()].isascii() and source[m.end()].isalpha()) for m in re.finditer(r"\d+[.,]\d+", source))
    return "_" in source or signed or measured


def prefers_rebuilt(source: str, current: str, made: str | None) -> bool:
    return bool(made) and made != current and any(re.search(p, s) for p in RUN_TOGETHER for s in (current, source) if s)


def choose(source: str | None, current: str | None, placeholders: Sequence[Placeholder], items: Sequence[Sequence[Glyph]]) -> tuple[str, str]:
    """(text, branch): what the translator gets, and why.

    ``composition_rebuilt``, ``literal_source`` and ``repair`` where there are formulas,
    else ``composition``; ``as_is`` where nothing had to be decided.
    """
    source, current = source or "", current or ""
    if not source:
        return current, "as_is"
    made = rebuilt(items)
    made = without_loose_lines(made) if made else None
    chosen = source if is_mismatch(source, current) else current
    if made and prefers_rebuilt(source, chosen, made):
        chosen = made
    if any(p.kind == FORMULA for p in placeholders):
        if made and chosen == made:
            return made, "composition_rebuilt"
        if chosen == source or is_literal(source, placeholders):
            return source, "literal_source"
        return aligned(source, placeholders) if chosen else source, "repair"
    return (chosen, "composition") if made and chosen == made and made != current else (chosen, "as_is")


CHOSEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("branch", T.StringType())])


@F.arrow_udf(CHOSEN)
def _chosen(rows: pa.Array) -> pa.Array:
    out = []
    for r in rows.to_pylist():
        runs = [[Glyph(g["ch"], g["x1"], g["y1"], g["x2"], g["y2"], g["size"], False) for g in item] for item in r["items"] or ()]
        marks = [Placeholder(p["token"] or "", p["kind"] or "", p["formula"] or "", p["composition"] or "") for p in r["placeholders"] or ()]
        text, branch = choose(r["source"], r["current"], marks, runs)
        out.append({"text": text, "branch": branch})
    return pa.array(out, pa.struct([("text", pa.string()), ("branch", pa.string())]))


def chosen(source: str, current: str, placeholders: str, items: str) -> Column:
    """Struct (text, branch) from a paragraph's text, the parser's, its placeholders and its items of glyphs."""
    return _chosen(F.struct(F.col(source).alias("source"), F.col(current).alias("current"), F.col(placeholders).alias("placeholders"), F.col(items).alias("items")))

