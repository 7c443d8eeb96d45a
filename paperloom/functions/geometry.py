"""Rectangle arithmetic as Column expressions.

A rectangle is a prefix of four columns: ``<prefix>x1, y1, x2, y2``. Two axis
conventions exist side by side and must not be mixed: layout records have y
growing upward, preview fragments downward. Each function says which it takes;
most don't care.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Corners:
    """The four columns of a rectangle by index; made on use, as columns need a session."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def __getitem__(self, k: int) -> Column:
        return F.col(self.prefix + ("x1", "y1", "x2", "y2")[k])


def corners(prefix: str = "") -> Corners:
    return Corners(prefix)


def zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def intersection(a, b) -> Column:
    return zero(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * zero(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area(a) -> Column:
    return zero(a[2] - a[0]) * zero(a[3] - a[1])


def iou(a, b) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def overlap_ratio(a, b) -> Column:
    """Share of a's area inside b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def vertical_gap(a, b) -> Column:
    return F.when(a[3] < b[1], b[1] - a[3]).when(b[3] < a[1], a[1] - b[3]).otherwise(0.0)


def horizontal_gap(a, b) -> Column:
    return F.when(a[2] < b[0], b[0] - a[2]).when(b[2] < a[0], a[0] - b[2]).otherwise(0.0)


def horizontal_overlap(a, b) -> Column:
    """Shared width over the smaller width, which counts as 1 at least."""
    return zero(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))


def adjacent(a, b) -> Column:
    """Two fragments belong together: IoU over 0.3, or at most 5 apart in the same reading lane."""
    lane = (horizontal_overlap(a, b) >= 0.2) | (horizontal_gap(a, b) <= 18.0)
    return (iou(a, b) > 0.3) | ((vertical_gap(a, b) <= 5.0) & lane)


def edge_band(a, width: float = 612.0, height: float = 792.0) -> Column:
    """Within a tenth of the page's top or bottom, or 6 % of its sides; y grows upward."""
    return (a[1] <= height * 0.1) | (a[3] >= height - height * 0.1) | (a[0] <= width * 0.06) | (a[2] >= width - width * 0.06)


def contains_point(a, x: Column, y: Column, padding: float = 0.0) -> Column:
    return x.between(a[0] - padding, a[2] + padding) & y.between(a[1] - padding, a[3] + padding)


def contains(a, b, tolerance: float) -> Column:
    """b lies inside a, give or take the tolerance."""
    return (b[0] >= a[0] - tolerance) & (b[1] >= a[1] - tolerance) & (b[2] <= a[2] + tolerance) & (b[3] <= a[3] + tolerance)


def close(a, b, tolerance: float) -> Column:
    return (F.abs(a[0] - b[0]) <= tolerance) & (F.abs(a[1] - b[1]) <= tolerance) & (F.abs(a[2] - b[2]) <= tolerance) & (F.abs(a[3] - b[3]) <= tolerance)


def baseline_reason(a, b) -> Column:
    """'ok' if b continues a's line, else why not; the first failing test names the reason."""
    ha, hb = F.greatest(a[3] - a[1], F.lit(1.0)), F.greatest(b[3] - b[1], F.lit(1.0))
    overlap = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shift = F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    gap = b[0] - a[2]
    limit = F.greatest(F.lit(4.0), F.least(ha, hb) * 0.55)
    return (
        F.when(b[0] < a[0], "right_before_left")
        .when(overlap / F.least(ha, hb) < 0.62, "low_vertical_overlap")
        .when(shift > F.greatest(ha, hb) * 0.45, "centerline_delta_too_large")
        .when(~gap.between(F.lit(-1.0), limit), "gap_out_of_range")
        .otherwise("ok")
    )


def alignment(a, width: float) -> Column:
    """CENTER if the middle is within 5 of the page's, else null."""
    return F.when((F.lit(width) > 0) & (F.abs((a[0] + a[2]) / 2 - width / 2) <= 5), "CENTER")


def toc_column(a, width: float = 612.0) -> Column:
    middle = width / 2
    return F.when((a[0] <= middle) & (a[2] >= middle), "full").when((a[0] + a[2]) / 2 < middle, "left").otherwise("right")


def column_domain(a, width: float = 612.0) -> Column:
    """left or right of the midline, or null for what crosses it by more than 18."""
    middle, center = width / 2, (a[0] + a[2]) / 2
    return F.when((center < middle) & (a[2] <= middle + 18.0), "left").when((center > middle) & (a[0] >= middle - 18.0), "right")


def rotation(dx: Column, dy: Column, tolerance: float = 0.2) -> Column:
    """90 or 270 for vertical writing directions, else null."""
    return F.when((F.abs(dx) <= tolerance) & (dy < -(1 - tolerance)), 90).when((F.abs(dx) <= tolerance) & (dy > 1 - tolerance), 270)


def merge_guard(left_page, right_page, left_region, right_region, left_column, right_column, left_known, right_known) -> Column:
    """(decision, reason) of merging two records; tests in order of precedence."""
    reason = (
        F.when(~left_known | ~right_known, "missing_record")
        .when(left_page != right_page, "cross_page")
        .when(left_region.isNull() | right_region.isNull(), "missing_layout_region")
        .when((left_region == "unknown") | (right_region == "unknown"), "unknown_region")
        .when((left_region != "body_column") | (right_region != "body_column"), "non_body_region")
        .when(~left_column.eqNullSafe(right_column), "cross_column")
        .otherwise("same_body_column")
    )
    return F.struct(F.when(reason == "same_body_column", "allowed").otherwise("rejected").alias("decision"), reason.alias("reason"))


def split_guard(region: Column, reason: Column, known: Column, technical: Column) -> Column:
    why = (
        F.when(~known, "missing_record")
        .when(reason == "multiline_body_block", "multiline_body_block")
        .when((reason == "fallback_line_visual_split") & technical, "fallback_line_technical_label")
        .when(region.isNull() | (region == "unknown"), "unknown_region")
        .when((reason == "inline_numbered_markers") & (region == "body_column"), "numbered_marker_same_region")
        .otherwise("ordinary_body_split")
    )
    return F.struct(F.when(why.isin("fallback_line_technical_label", "numbered_marker_same_region"), "allowed").otherwise("rejected").alias("decision"), why.alias("reason"))


def center_apart(a, b) -> Column:
    """Distance of the two vertical centers."""
    return F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def height(a) -> Column:
    return F.greatest(a[3] - a[1], F.lit(1.0))


def may_share_line(a, b) -> Column:
    """Whether b may be a fragment of a's line: centers within 0.8 of the larger height, not far to the right."""
    return (center_apart(a, b) <= F.greatest(height(a), height(b)) * 0.8) & (b[0] - a[2] <= F.greatest(F.lit(18.0), F.least(height(a), height(b)) * 2.0))


def below_and_left(a, b) -> Column:
    """Whether b reaches lower than a, starts no further right and ends at about the same height; y grows upward."""
    lower = b[1] < a[1] - F.greatest(F.lit(2.0), height(a) * 0.2)
    return lower & (b[0] <= a[0] + F.greatest(F.lit(8.0), height(a) * 0.6)) & (F.abs(b[3] - a[3]) <= F.greatest(height(a), height(b)) * 0.35)
