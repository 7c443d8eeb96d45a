"""``sources.fragments`` and what the merge rules ask of them, made in the process that walks through a page.

The same pages, fragments, regions and roles as ``plans.merging.records`` states on
columns, for walks that go from texts to their results: rows of fragments cost more on
their way into Python than being made there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from paperloom.sources.fragments import MARKS, PIECE, ROW, ROWS

_ROW = re.compile(f"[^\n]{{1,{ROW}}}")
_MARK = re.compile(f"[{MARKS[2:]}")
#: As ``plans.merging.TOC_TAIL`` in Java: white space is ASCII's, and a line's end may follow.
_TOC_TAIL = re.compile("[.\xb7\u2026 \t\n\x0b\f\r]{4,}[0-9]{1,4}[ \t\n\x0b\f\r]*[\x85\u2028\u2029]?\\Z")
_TAIL_ENDS = frozenset("0123456789 \t\n\x0b\f\r\x85\u2028\u2029")
_LETTER = re.compile(r"[^\W\d_]")


def laid(text: str) -> Iterator[list[tuple]]:
    """The pages of a text, each a list of (idx, x1, y1, x2, y2, text, label) in order; a page at a time."""
    rows = (m.group() for m in _ROW.finditer(text))
    per_row = ROW // PIECE
    while page := list(islice(rows, 2 * ROWS)):
        out = []
        for j, row in enumerate(page):
            x0, y2 = 60.0 if j < ROWS else 330.0, 715.0 - 12.0 * (j % ROWS)
            label = "table_text" if len(_MARK.findall(row)) >= 6 else "plain text"
            for k in range(0, len(row), PIECE):
                piece = row[k : k + PIECE]
                bare = piece.strip(" ")
                if not bare:
                    continue
                first = k if bare[0] == piece[0] else k + len(piece) - len(piece.lstrip(" "))
                x1 = x0 + 5.0 * first
                out.append((j * per_row + k // PIECE, x1, y2 - 10.0, x1 + 5.0 * len(bare), y2, bare, label))
        yield out


def columns_of(body: list[tuple[float, int, float, float]]) -> list[tuple[str, float, float]]:
    """(column, low, high) of a page's (center, idx, x1, x2) away from its edges: where centers belong to a column, as in ``plans.layout.regions_of_pages``."""
    n = len(body)
    if n < 3:
        return []
    body = sorted(body)
    gaps = [b[0] - a[0] for a, b in zip(body, body[1:])]
    widest = max(gaps)
    cut = gaps.index(widest) + 1
    sides = [("left", body[:cut]), ("right", body[cut:])] if n >= 6 and widest >= 97.92 and cut >= 3 and n - cut >= 3 else [("single", body)]
    out = []
    for name, side in sides:
        low, high = min(b[2] for b in side), max(b[3] for b in side)
        slack = max(6.0, (high - low) * 0.08)
        out.append((name, low - slack, high + slack))
    return out


def role_of(text: str) -> str:
    if text[-1] in _TAIL_ENDS and _TOC_TAIL.search(text):
        return "toc_entry"
    if _LETTER.search(text) and (text.isascii() or any(map(str.isalpha, text))):
        return "body"
    return "preserved_token"


def recorded(items: list[tuple]) -> list[tuple]:
    """A page of ``laid`` with role, region, column, label, xobj, edge and size, in the order of ``operators.merging.COLUMNS``."""
    # The band of ``functions.geometry.edge_band`` on a page of 612 x 792.
    bottom, top, left, right = 792.0 * 0.1, 792.0 - 792.0 * 0.1, 612.0 * 0.06, 612.0 - 612.0 * 0.06
    body, edges = [], []
    for idx, x1, y1, x2, y2, _, _ in items:
        edge = y1 <= bottom or y2 >= top or x1 <= left or x2 >= right
        edges.append(edge)
        if not edge:
            body.append(((x1 + x2) / 2, idx, x1, x2))
    columns = columns_of(body)
    out = []
    for (idx, x1, y1, x2, y2, text, label), edge in zip(items, edges):
        region, column = "edge" if edge else "unknown", None
        if not edge:
            if label != "plain text":
                region = "table"
            else:
                center = (x1 + x2) / 2
                for name, low, high in columns:
                    if low <= center <= high:
                        region, column = "body_column", name
                        break
        out.append((idx, x1, y1, x2, y2, text, role_of(text), region, column, label, 0, edge, 10.0))
    return out


def pages_of(doc_id: int, text: str) -> Iterator[tuple[int, list[tuple]]]:
    """(page, rows of :func:`recorded`) of a document's pages that have fragments."""
    for p, items in enumerate(laid(text)):
        if items:
            yield doc_id * 1_000_000 + p, recorded(items)
