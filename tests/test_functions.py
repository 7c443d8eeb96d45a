"""Fixtures worked out by hand, and properties of the order-dependent operators."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import geometry as geo
from paperloom.functions import labels
from paperloom.operators import folds, tokens


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize("value, want", [("", ""), ("abcd", "****"), ("sk-12345", "****2345"), (None, "")])
def test_mask(spark, value, want):
    assert one(spark, value, labels.mask_secret(F.col("c"))) == want


@pytest.mark.parametrize("value, want", [("Straße\u00a0\uff21\uff22\u200b 1", "strasseab1"), (" A\tb ", "ab"), ("", ""), (None, None)])
def test_canonical(spark, value, want):
    assert one(spark, value, folds.canonical("c")) == want


@pytest.mark.parametrize("value, want", [("电压 (V)", 8), ("ab c", 4), ("", 0), (None, None)])
def test_display_width(spark, value, want):
    assert one(spark, value, folds.display_width("c")) == want


@pytest.mark.parametrize("value, want", [("3x4", "3 × 4"), ("a\x00b\u200bc", "abc"), ("a\u00a0b", "a b"), ("l\u25a0r", "l-r"), (" x \r\n  y  z ", "x\ny z"), ("l \u25a0 r", "l r")])
def test_sanitize(value, want):
    assert folds.sanitize(value) == want


@pytest.mark.parametrize("bytes_, want", [(0, "0 B"), (None, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (102400, "100 KB"), (1048576, "1.0 MB"), (5 * 1024**3, "5.0 GB")])
def test_byte_label(spark, bytes_, want):
    assert one(spark, bytes_, labels.byte_label(F.col("c")), "long") == want


@pytest.mark.parametrize("ms, want", [(0, "0s"), (-5, "0s"), (None, "0s"), (61_000, "1m 1s"), (3_723_999, "1h 2m 3s")])
def test_duration_label(spark, ms, want):
    assert one(spark, ms, labels.duration_label(F.col("c")), "long") == want


@pytest.mark.parametrize(
    "a, b, want",
    [((0, 0, 50, 10), (52, 0, 90, 10), "ok"), ((0, 0, 50, 10), (60, 0, 90, 10), "gap_out_of_range"), ((0, 0, 50, 10), (52, 8, 90, 18), "low_vertical_overlap"), ((20, 0, 50, 10), (10, 0, 19, 10), "right_before_left")],
)
def test_baseline_reason(spark, a, b, want):
    schema = ", ".join(f"{p}{c} double" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2"))
    row = spark.createDataFrame([tuple(map(float, a + b))], schema)
    assert row.select(geo.baseline_reason(geo.corners("a_"), geo.corners("b_")).alias("r")).first().r == want


@pytest.mark.parametrize("width, mid, want", [(612.0, 304.0, "CENTER"), (612.0, 300.0, None), (0.0, 0.0, None)])
def test_alignment(spark, width, mid, want):
    row = spark.createDataFrame([(mid - 5, 0.0, mid + 5, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert row.select(geo.alignment(geo.corners(), width).alias("r")).first().r == want


def test_chunk_lengths(spark):
    text = "a" * 1000 + "\n" + "b" * 900 + "\n" + "c" * 2500 + "\n"
    assert [len(p) for p in one(spark, text, folds.chunks(F.col("c"), 1800))] == [1001, 901, 2501]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab \n", max_size=12), max_size=8))
def test_chunks_join_to_the_text(spark, parts):
    text = "\n".join(parts)
    got = one(spark, text, folds.chunks(F.col("c"), 10))
    assert "".join(got) == text and all(len(p) <= 10 or p.count("\n") <= 1 for p in got)


def slow_lines(text):
    """The four rules, written out over a plain list."""
    kept = []
    bare = lambda s: "".join(s.split())
    for line in folds.sanitize(text).split("\n"):
        b = bare(line)
        if kept and b == bare(kept[-1]):
            continue
        last = [bare(k) for k in kept[-3:]]
        if len(b) >= 8:
            if len(kept) >= 2 and any(b == last[i] + last[j] for i in range(len(last)) for j in range(i + 1, len(last))):
                continue
            if b in [bare(k) for k in kept if len(bare(k)) >= 8]:
                continue
            twin = [k for k, other in enumerate(kept) if len(bare(other)) >= 8 and SequenceMatcher(None, b, bare(other)).ratio() >= 0.85]
            if twin:
                if len(b) > len(bare(kept[twin[0]])):
                    kept[twin[0]] = line
                continue
        kept.append(line)
    return "\n".join(kept).strip()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta gamma", "alpha beta gamna", "alphabeta", "gamma", "alphabetagamma", "x", "", "alpha  beta gamma delta", "delta"]), max_size=9))
def test_distinct_lines(lines):
    text = "\n".join(lines)
    once = folds.distinct_lines(text)
    assert once == slow_lines(text)


def test_tokens_round_trip(spark):
    rows = [("Set I2C_CTRL to 0x1F at 5 mV",), ("costs $1 and C:\\x_Y 0x2",), ("none",), ("",)]
    df = spark.createDataFrame(rows, "s string").select("s", tokens.protect("s").alias("p"))
    for r in df.select("s", "p.text", "p.tokens", tokens.restored("p").alias("back")).collect():
        assert r.back == r.s and all(t.name in r.text for t in r.tokens)
    _, pairs = tokens.protect_text("Set VDD_IO to 5 mV")
    assert [t for _, t in pairs] == ["VDD_IO", "5 mV"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("10 \u00b5F at 85 \u00b0C", ["10 \u00b5F", "85 \u00b0C"]),
        ("vdd or GND", ["vdd", "GND"]),
        ("4 k\u03a9, 4 k\u2126 and 3 MHz", ["4 k\u03a9", "4 k\u2126", "3 MHz"]),
        ("2 ppm/\u00b0C of 860 SPS", ["ppm/\u00b0C", "860 SPS"]),
        ("VIN = 3.3 V now", ["VIN = 3.3 V"]),
        ("2 mm x 3 mm \u00d7 4,5 mm", ["2 mm x 3 mm \u00d7 4,5 mm"]),
        ("2mm{v1}3mm", ["2mm{v1}3mm"]),
        ("V{v2}DD1 {VDD} <b12>R</b12>", ["V{v2}DD1", "R"]),
        ("ADC_DATA_12 adc_data", ["ADC_DATA_12"]),
        ("RA and C, Car", ["RA", "C"]),
        ("per cent % of LSB", ["%", "LSB"]),
        ("-5 mA/ms, .5 in, -7 mA", ["mA/ms", ".5 in", "-7 mA"]),
        ("12 months, 7 a", []),
    ],
)
def test_token_shapes(text, want):
    protected, pairs = tokens.protect_text(text)
    assert [t for _, t in pairs] == want
    for name, token in pairs:
        protected = protected.replace(name, token)
    assert protected == text


@pytest.mark.parametrize(
    ("text", "want"),
    [("ABABABABAB", True), ("ABAB AB AB\nAB", True), ("VCCVCCVCCVCC12", True), ("ABCDABCDABCDxyz", True), ("AAAAAAAAAA", True), ("\uff21\uff22" * 5, True), ("VCC VCC VCC VCC", True), ("ABABAB", False), ("VCCVCCVCC12", False), ("AAAAAA", False), ("abababababab", False), ("ABABABABCDEFGHI", False), ("", False)],
)
def test_block_noise(text, want):
    assert folds.is_block_noise(text) is want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ABb1 ", max_size=26))
def test_block_noise_equals_its_definition(text):
    letters = [c for c in text if c.isalpha()]
    want = False
    if len(text.replace(" ", "")) >= 10 and len(letters) >= 10:
        for tail in range(5):
            body = "".join(letters[: len(letters) - tail])
            for size in (2, 3, 4):
                times = len(body) // size
                want = want or len(body) >= 8 and body == body.upper() and times >= 3 and body == body[:size] * times
    assert folds.is_block_noise(text) is want


def test_paths_inside(spark):
    import posixpath

    paths = ["a/b", "a/../b", "../b", "a/../../b", "./a//b", "/etc/x", "a/..", "", ".", "..", "a/./../../a/b"]
    from paperloom.operators import relational

    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", relational.inside(F.col("p")).alias("ok")).collect()}
    for p in paths:
        depth, out = 0, False
        for part in p.split("/"):
            depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
            out = out or depth < 0
        assert got[p] == (not p.startswith("/") and not out and posixpath.normpath(p) not in (".", "..")), p


def test_jdbc_reader_asks_for_ranges():
    from unittest.mock import MagicMock

    from paperloom.sources.tables import read_jdbc

    spark = MagicMock()
    read_jdbc(spark, "jdbc:x", "jobs", "id", 0, 100, 8, driver="org.x.Driver")
    given = spark.read.format.return_value.options.call_args.kwargs
    assert spark.read.format.call_args.args == ("jdbc",) and given["partitionColumn"] == "id" and given["numPartitions"] == 8 and given["driver"] == "org.x.Driver"


def boxes(spark, n=60, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = rng.randrange(0, 300), rng.randrange(0, 300)
        rows.append((k % 3, k, float(x), float(y), float(x + rng.randrange(5, 60)), float(y + rng.randrange(6, 14))))
    return rows


SCHEMA = "page long, idx long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("operator", [folds.page_components, folds.growing_lines, folds.overlap_clusters, folds.scale_lanes, lambda d: folds.greedy_line_merge(d, True), lambda d: folds.greedy_line_merge(d, False)])
def test_folds_ignore_row_order_and_partitions(spark, operator):
    rows = boxes(spark, 300)
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    a = operator(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()
    b = operator(spark.createDataFrame(mixed, SCHEMA).repartition(5)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and a


def by_pages(rows):
    return {page: [r[1:] for r in rows if r[0] == page] for page in sorted({r[0] for r in rows})}


def naive_means(rows, limit):
    out = []
    for page, own in by_pages(rows).items():
        heights = sorted(r[4] - r[2] for r in own)
        middle = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
        reach = limit or min(max(0.28 * middle, 2.5), 4.0)
        segments = [[]]
        for cy, _, idx in sorted(((r[2] + r[4]) / 2 if limit is None else (r[1] + r[3]) / 2, r[1], r[0]) for r in own):
            held = [v for v, _ in segments[-1]]
            if held and abs(cy - sum(held) / len(held)) > reach:
                segments.append([])
            segments[-1].append((cy, idx))
        out += [(page, idx, k) for k, s in enumerate(segments) for _, idx in s]
    return sorted(out)


def test_running_means_equal_naive(spark):
    rows = boxes(spark, 200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    assert sorted(map(tuple, folds.running_mean_segments(df.withColumn("cy", middle("y1", "y2")), "cy").collect())) == naive_means(rows, None)
    assert sorted(map(tuple, folds.running_mean_segments(df.withColumn("cx", middle("x1", "x2")), "cx", 7.0).collect())) == naive_means(rows, 7.0)


def test_growing_lines_equal_naive(spark):
    rows, want = boxes(spark, 200, 9), []
    for page, own in by_pages(rows).items():
        lines = []
        for idx, _, y1, _, y2 in sorted(own, key=lambda r: (-r[4], r[1], -r[2], r[0])):
            fits = False
            if lines:
                low, high = min(b[0] for b in lines[-1][0]), max(b[1] for b in lines[-1][0])
                small, large = sorted((max(high - low, 1), max(y2 - y1, 1)))
                fits = (min(high, y2) - max(low, y1)) / small >= 0.45 or abs(low + high - y1 - y2) / 2 <= 0.55 * large
            if not fits:
                lines.append(([], []))
            lines[-1][0].append((y1, y2))
            lines[-1][1].append(idx)
        want += [(page, idx, k) for k, (_, ids) in enumerate(lines) for idx in ids]
    assert sorted(map(tuple, folds.growing_lines(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(want)


@pytest.mark.parametrize("horizontal", [True, False])
def test_greedy_merge_equals_naive(spark, horizontal):
    rows, want = boxes(spark, 240, 10), []
    for page, own in by_pages(rows).items():
        left = sorted(own, key=lambda r: (-r[4], r[1], -r[2], r[0]))
        while left:
            idx, *box = left.pop(0)
            members = [idx]
            while ranks := [(folds._follows(box, r[1:], horizontal), k) for k, r in enumerate(left) if folds._follows(box, r[1:], horizontal) is not None]:
                other = left.pop(min(ranks)[1])
                members.append(other[0])
                box = [min(box[0], other[1]), min(box[1], other[2]), max(box[2], other[3]), max(box[3], other[4])]
            want.append((page, idx, *box, len(members), members))
    got = [tuple(r) for r in folds.greedy_line_merge(spark.createDataFrame(rows, SCHEMA), horizontal).collect()]
    assert sorted(got) == sorted(want) and any(r[6] > 1 for r in want)


def test_overlap_clusters_equal_naive(spark):
    rows, want = boxes(spark, 300, 11), []
    for page, own in by_pages(rows).items():
        left = sorted(own, key=lambda r: (-r[4], r[1], r[0]))
        while left:
            idx, *box = left.pop(0)
            members, rest = 1, []
            for r in left:
                low = min(max(box[3] - box[1], 1), max(r[4] - r[2], 1))
                if (min(box[3], r[4]) - max(box[1], r[2])) / low >= 0.62 and min(box[2], r[3]) > max(box[0], r[1]):
                    members += 1
                    box = [min(box[0], r[1]), min(box[1], r[2]), max(box[2], r[3]), max(box[3], r[4])]
                else:
                    rest.append(r)
            left = rest
            if members >= 2:
                want.append((page, idx, members))
    assert sorted(map(tuple, folds.overlap_clusters(spark.createDataFrame(rows, SCHEMA), 2).collect())) == sorted(want) and want


def test_scale_lanes_equal_naive(spark):
    rows, want = boxes(spark, 200, 12), []
    for page, own in by_pages(rows).items():
        lanes = []
        for idx, x1, _, x2, _ in sorted(own, key=lambda r: (r[2], r[1], r[0])):
            fits = [k for k, (a, w) in enumerate(lanes) if abs(a - x1) <= 18 and abs(w - x2 + x1) <= 24]
            if not fits:
                lanes.append((x1, x2 - x1))
            want.append((page, idx, fits[0] if fits else len(lanes) - 1))
    assert sorted(map(tuple, folds.scale_lanes(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(want)


def test_by_page_takes_empty_tables_and_null_pages(spark):
    assert folds.scale_lanes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 1, 0.0, 0.0, 5.0, 5.0), (None, 2, 100.0, 0.0, 105.0, 5.0), (0, 3, 0.0, 0.0, 5.0, 5.0)]
    assert sorted(map(repr, map(tuple, folds.scale_lanes(spark.createDataFrame(rows, SCHEMA)).collect()))) == ["(0, 3, 0)", "(None, 1, 0)", "(None, 2, 1)"]


def test_components_equal_closure(spark):
    rows = boxes(spark, 90, 2)
    got = {(r.page, r.idx): r.component for r in folds.page_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    for page in range(3):
        own = [r for r in rows if r[0] == page]
        name = {r[1]: r[1] for r in own}
        moved = True
        while moved:
            moved = False
            for a in own:
                for b in own:
                    if folds._adjacent(a[2:], b[2:]) and name[a[1]] > name[b[1]]:
                        name[a[1]], moved = name[b[1]], True
        assert {i: got[page, i] for i in name} == name


def test_merge_covers_its_members(spark):
    rows = {(r[0], r[1]): r[2:] for r in boxes(spark, 120, 4)}
    merged = folds.greedy_line_merge(spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA), True).collect()
    assert sorted((r.page, i) for r in merged for i in r.merged) == sorted(rows)
    for r in merged:
        own = [rows[r.page, i] for i in r.merged]
        assert (r.x1, r.y1, r.x2, r.y2) == (min(o[0] for o in own), min(o[1] for o in own), max(o[2] for o in own), max(o[3] for o in own))


def test_overlap_join():
    assert folds.overlap_join("abcdef", "defgh") == "abcdefgh" and folds.overlap_join("abc", "cde") == "abccde" and folds.overlap_join("", "x") == "x"


def test_session_limit(spark):
    from paperloom.operators.windows import failure_sessions

    base = 1_700_000_000
    rows = [("a", base + s) for s in (0, 100, 350, 640, 900)] + [("b", base), ("b", base + 301)]
    events = spark.createDataFrame(rows, "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.who, r.n, r.limited) for r in failure_sessions(events, "who", "ts", "300 seconds", 5).collect())
    assert got == [("a", 5, True), ("b", 1, False), ("b", 1, False)]


def test_model_calls_retry_what_may_pass():
    from paperloom.operators import model

    for codes, want, waits in (([], ("ok", 1, None), []), ([503, 429], ("ok", 3, None), [1.0, 2.0]), ([400], (None, 1, 400), []), ([500] * 9, (None, 4, 500), [1.0, 2.0, 4.0])):
        left, slept = list(codes), []

        def ask(text):
            if left:
                raise model.CallError(left.pop(0))
            return "ok"

        assert model.call(ask, "x", slept.append) == want and slept == waits


def test_glyph_texts(spark):
    from paperloom.operators import glyphs
    rows = []
    for page, line, text, font, x in [(1, 1, "10 mF", "Symbol", 0.0), (1, 2, "4k W max", "Symbol", 0.0), (1, 3, "3 .5 V , ok", "Arial", 0.0), (2, 1, "plain text", "Arial", 3.0)]:
        for k, ch in enumerate(text):  # 5 wide, a blank moves on by 4
            if ch != " ":
                rows.append((page, line, k, ch, x, 0.0, x + 5.0, 8.0, 8.0, font))
            x += 4.0 if ch == " " else 5.0

    df = spark.createDataFrame(rows, "page long, line long, idx long, ch string, x1 double, y1 double, x2 double, y2 double, size double, font string")
    assert {(r.page, r.line): r.text for r in glyphs.line_texts(df).collect()} == {(1, 1): "10 mF", (1, 2): "4k W max", (1, 3): "3.5 V, ok", (2, 1): "plain text"}
    fixed = glyphs.with_units(df, F.contains(F.lower("font"), F.lit("symbol")))
    # The blank of 4 is wider than 0.32 of the size, so W stays; m touches F and is micro.
    assert {(r.page, r.line): r.text for r in glyphs.line_texts(fixed).collect()}[1, 1] == "10 µF"


@given(st.text("abcd", max_size=30), st.text("abcde", min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_subsequence_bound(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            row[k], before = (before + 1 if x == y else max(row[k], row[k - 1])), row[k]
    assert folds._Twin(b).subsequence(a) == row[-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_joins_of_aggregates_can_be_split(spark):
    """Null and repeated keys meet, and both sides are dealt out for the join itself."""
    from paperloom.operators import dedup

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None), (5, "c")], "id long, k string")
    groups = rows.where("id < 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = dedup.apart(rows, groups, ["k"], "left")
        assert sorted((r.id, r.n) for r in joined.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, None)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ENSURE_REQUIREMENTS") >= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_taken_part_by_part():
    """No more than a part's Python values are held at once; nulls and empty batches pass."""
    import pyarrow as pa

    held, most = set(), []

    class Value(str):
        def __init__(self, _):
            held.add(id(self))
            most.append(len(held))

        def __del__(self):
            held.discard(id(self))

    texts = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(1000)]).slice(3)
    got = tokens.by_part(texts, lambda s: None if s is None else Value(s + "!"), pa.string())
    assert got.to_pylist() == [None if s is None else s + "!" for s in texts.to_pylist()]
    assert max(most) <= 2 * tokens.PART
    assert len(tokens.by_part(pa.array([], pa.string()), str, pa.string())) == 0


def test_lines_of_glyphs_without_windows(spark):
    """A line's texts from its array are those from glyph rows, for decimals, units, closing marks and glyphs out of order."""
    from pyspark.sql import functions as F

    from paperloom.operators import glyphs

    rng = np.random.default_rng(4)
    rows = []
    for line in range(300):
        x = 0.0
        for idx in range(int(rng.integers(1, 9))):
            ch = str(rng.choice(list("m W F A 3 . , ) k x".split())))
            x += float(rng.choice([-1.0, 0.0, 1.0, 1.8, 2.0, 5.0]))
            rows.append((1, line, idx, ch, x, x + 4, 7.0, ch in "mW"))
            x += 4
    each = spark.createDataFrame(rows, "page long, line long, idx long, ch string, x1 double, x2 double, size double, symbol boolean")
    held = each.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("x1", "idx", "x2", "size", "ch", "symbol"))).alias("glyphs"))
    for new, old in ((held, each), (glyphs.with_units_of_lines(held), glyphs.with_units(each, F.col("symbol")))):
        assert sorted(glyphs.texts_of_lines(new).collect()) == sorted(glyphs.line_texts(old).collect())


@pytest.mark.parametrize("name, shuffles", [("src2_text_spans", 1), ("src3_page_words", 1), ("spl1_implied_spaces", 1), ("str19_symbol_units", 1)])
def test_pages_and_lines_are_shuffled_once(spark, small, name, shuffles):
    from paperloom.plans import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == shuffles and "Window" not in plan
