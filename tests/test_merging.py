"""Plan, guard and apply of the merge rules: worked cases, and a naive walk over all pairs."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.operators import merging as m
from paperloom.plans import QUERIES
from paperloom.plans import merging as plans
from paperloom.sources.tables import Tables


def frag(idx, x1, text, y2=700.0, x2=None, region="body_column", column="single", role="body", label="plain text", xobj=0, edge=False, height=10.0, size=10.0):
    return m.Fragment(m.Record(idx, role, region, column, label, xobj, edge, size), text, (x1, y2 - height, x1 + 5.0 * len(text) if x2 is None else x2, y2), [idx])


def plan(fragments, rule):
    return [(a, b, why, decision, guard) for a, b, _, _, why, decision, guard in m.Walk(fragments, rule).plan()]


def applied(fragments, rule):
    allowed = {(a, b) for a, b, _, d, _ in plan(fragments, rule) if d == "allowed"}
    rows, merged = m.Walk(fragments, rule).apply(allowed)
    return [(f.record.idx, f.text) for f in rows], merged


def test_bridges():
    word = [frag(0, 100, "transl"), frag(1, 130.5, "ation works"), frag(2, 186, ".")]
    assert plan(word, m.BRIDGE) == [(0, 1, "broken_word_continuation", "allowed", "same_body_column"), (0, 2, "inline_punctuation", "allowed", "same_body_column")]
    assert applied(word, m.BRIDGE)[0] == [(0, "translation works.")]
    number = [frag(0, 100, "at 12."), frag(1, 130, "5V"), frag(2, 130, "5V", xobj=3)]
    assert plan(number, m.BRIDGE) == [(0, 1, "inline_decimal_continuation", "allowed", "same_body_column")]
    assert not plan([frag(0, 100, "title"), frag(1, 125, ". . . . . . .")], m.BRIDGE)
    assert not plan([frag(0, 100, "word", edge=True), frag(1, 120, ".")], m.BRIDGE)


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        (dict(), dict(region="unknown", column=None), "same_body_column_inline_bridge"),
        (dict(column="left"), dict(column="right"), "tight_inline_column_boundary_bridge"),
        (dict(region="table", column=None), dict(region="table", column=None), "dense_same_line_micro_fragment_bridge"),
        (dict(), dict(region="table", column=None, text="ation 12345678901234567"), "mixed_region_same_line_text_continuation"),
    ],
)
def test_what_a_bridge_may_cross(left, right, want):
    text = right.pop("text", "ation")
    first = "the transformation of long texts and transl" if want.startswith("mixed") else "transl"
    a = frag(0, 100, first, **left)
    found = plan([a, frag(1, a.box[2], text, **right)], m.BRIDGE)
    assert [(x[3], x[4]) for x in found] == [("allowed", want)]


def test_rejected_bridges_are_not_planned():
    assert plan([frag(0, 100, "transl", region="figure", column=None), frag(1, 130, "ation")], m.BRIDGE) == []


def test_body_lines_join_with_a_blank_and_stop_at_a_sentence():
    lines = [frag(0, 100, "the first line of a text"), frag(1, 100, "and its second one ends.", y2=688.0), frag(2, 100, "and the third line is new", y2=676.0)]
    assert applied(lines, m.BODY_LINES) == ([(0, "the first line of a text and its second one ends."), (2, "and the third line is new")], [(0, 1, "contiguous_body_line")])
    assert plan([frag(0, 100, "the first line of a TEXT"), frag(1, 100, "Other words begin here", y2=688.0)], m.BODY_LINES) == []
    assert plan([lines[0], frag(1, 140, "and far to the right too", y2=688.0)], m.BODY_LINES) == []


def test_the_observed_plan_is_longer_than_what_is_applied():
    """The plan of same-line merges goes on behind a rejected pair; applying stops there."""
    parts = [frag(0, 100, "some words and"), frag(1, 172, "a table cell", region="table", column=None), frag(2, 236, "more words")]
    planned = plan(parts, m.SAME_LINE)
    assert [x[:2] + x[3:] for x in planned if x[3] != "skipped"] == [(0, 1, "rejected", "non_body_region"), (0, 2, "allowed", "same_body_column")]
    rows, merged = applied(parts, m.SAME_LINE)
    assert merged == [] and [t for _, t in rows] == ["some words and", "a table cell", "more words"]


def test_same_line_texts_and_wrapped_numbers():
    rows, _ = applied([frag(0, 100, "some words"), frag(1, 150, "here"), frag(2, 175, "and there")], m.SAME_LINE)
    assert rows == [(0, "some wordshere and there")]
    wrapped = [frag(0, 100, "at 12.", height=30.0), frag(1, 90, "5V", y2=699.0, height=60.0)]
    assert [x[2:4] for x in plan(wrapped, m.SAME_LINE)] == [("text_not_mergeable", "allowed")] and applied(wrapped, m.SAME_LINE)[0] == [(0, "at 12.5V")]
    assert plan([frag(0, 100, "some words"), frag(1, 158, "and there")], m.SAME_LINE) == [(0, 1, "gap_out_of_range", "skipped", "same_body_column")]
    for why, kind in (("left_role:toc_entry", dict(role="toc_entry")), ("edge_band", dict(edge=True)), ("different_xobj", dict(xobj=1))):
        assert plan([frag(0, 100, "some words", **kind), frag(1, 150, "and there")], m.SAME_LINE)[0][2] == why


def test_texts():
    assert m.is_page_number("Page 12 / 40") and m.is_page_number("7") and not m.is_page_number("12345") and not m.is_page_number("1/2/3") and not m.is_page_number("")
    assert m.ends_sentence("done.\") ") and not m.ends_sentence("done,") and not m.ends_sentence("") and not m.ends_sentence(")")
    assert m.continues_sentence("Unless so") and m.continues_sentence("(a") and m.continues_sentence("5 of") and not m.continues_sentence("Order") and not m.continues_sentence("")
    assert m.is_small("a b") and m.is_small("...") and not m.is_small("") and not m.is_small("12") and not m.is_small("x" * 19)
    assert m.number_is_cut("to -3.", "5", True) and not m.number_is_cut("to -3.", "5", False) and m.number_is_cut("3.", "5Ω", False) and not m.number_is_cut("3,", "5V", True)
    assert m.may_share_text("hello wor", "ld") and not m.may_share_text("1234567", "8901") and not m.may_share_text("hello world", "12") and not m.may_share_text("a", "b")


# ---- whole tables --------------------------------------------------------------------------


def naive(items, rule, allowed=None):
    """The walk, with every other fragment tried at each step; pairs in order and rows."""
    items = sorted(items, key=lambda f: (-f.box[3], f.box[0], -f.box[1], f.record.idx))
    taken, pairs, rows = set(), [], []
    for at, current in enumerate(items):
        if at in taken:
            continue
        while True:
            best = None
            for find in (rule.find, rule.fallback):
                for k, other in enumerate(items):
                    if find is None or k == at or k in taken or (f := find(current, other)) is None:
                        continue
                    if rule.only_allowed and rule.judge(current, other, f.reason)[0] != "allowed":
                        continue
                    if best is None or f.rank < best[1].rank:
                        best = k, f
                if best is not None:
                    break
            if best is None or allowed is not None and (current.record.idx, items[best[0]].record.idx) not in allowed:
                break
            k, f = best
            decision = rule.judge(current, items[k], f.reason)
            pairs.append((current.record.idx, items[k].record.idx, f.reason, *decision))
            if allowed is None and rule.stops and decision[0] == "rejected":
                break
            current = current.grown(items[k], f.separator)
            taken.add(k)
        rows.append(current)
    return pairs, rows


@pytest.fixture(scope="module")
def pages(spark, small):
    out = defaultdict(list)
    for r in plans.records(Tables(spark, small)).select("page", *m.COLUMNS).collect():
        out[r.page].append(m._fragment(tuple(r)[1:]))
    return out


@pytest.mark.parametrize(("name", "rule"), [("rw4", m.BRIDGE), ("rw5", m.BODY_LINES), ("rw8", m.SAME_LINE)])
def test_queries_equal_the_naive_walk(spark, small, pages, name, rule):
    planned, rows, events = [], [], []
    # Trying all fragments of a page at each step is slow: one page in four.
    some = [p for p in sorted(pages) if p // 1_000_000 % 4 == 1]
    for page in some:
        items = pages[page]
        pairs, _ = naive(items, rule)
        planned += [(page, *p) for p in pairs]
        merged, left = naive(items, rule, {p[:2] for p in pairs if p[3] == "allowed"})
        events += [(page, *p[:3]) for p in merged]
        rows += [(page, f.record.idx, f.text, len(f.members), *f.box) for f in left]
    held = F.floor(F.col("page") / 1_000_000) % 4 == 1
    got = QUERIES[f"{name}_plan"](spark, small).where(held & (F.col("decision") != "skipped")).select("page", "left", "right", "reason", "decision", "guard_reason")
    assert planned and Counter(map(tuple, got.collect())) == Counter(planned)
    got = QUERIES[f"{name}_apply"](spark, small).where(held)
    assert Counter(map(tuple, got.select("page", "idx", "text", "members", "x1", "y1", "x2", "y2").collect())) == Counter(rows)
    assert Counter(map(tuple, QUERIES[f"{name}_events"](spark, small).where(held).collect())) == Counter(events)


def test_decision_counts_are_those_of_the_plans(spark, small):
    counts = QUERIES["rw458_decision_counts"](spark, small).where("rule = 'merge_same_line'").groupBy("decision").agg(F.sum("n").alias("n")).collect()
    planned = QUERIES["rw8_plan"](spark, small).groupBy("decision").count().collect()
    assert {r.decision: r.n for r in counts} == {r.decision: r["count"] for r in planned}


def test_the_chain_loses_no_text(spark, small):
    """Blanks aside, a page has all characters of its fragments; a row that a later one took may be there twice."""
    bare = lambda rows: {p: Counter("".join(t.split())) for p, t in rows}
    text = lambda df: bare((r.page, r.t) for r in df.groupBy("page").agg(F.array_join(F.collect_list("text"), "").alias("t")).collect())
    got, want = text(QUERIES["rw458_chain"](spark, small)), text(plans.records(Tables(spark, small)))
    assert set(got) == set(want) and all(want[p] <= got[p] for p in want)


def test_pages_without_rows(spark):
    from paperloom.operators.merging import ROWS as schema

    none = spark.createDataFrame([], f"page long, {schema}")
    assert m.plan(none, m.BRIDGE).collect() == []
    rows, events = m.apply(none, m.allowed_pairs(m.plan(none, m.BRIDGE)), m.BRIDGE)
    assert rows.collect() == events.collect() == []


def test_queries_list_the_neighbours_that_were_skipped(spark, small, pages):
    """Workers get a copy of the rule, so it is known by its name."""
    some = [p for p in sorted(pages) if p // 1_000_000 % 4 == 1]
    want = [(page, *p[:2], p[4]) for page in some for p in m.Walk(pages[page], m.SAME_LINE).plan() if p[5] == "skipped"]
    got = QUERIES["rw8_plan"](spark, small).where((F.floor(F.col("page") / 1_000_000) % 4 == 1) & (F.col("decision") == "skipped")).select("page", "left", "right", "reason")
    assert want and Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("name", ["rw_fragment_records", "grd5_pair_reasons", "rw4_plan", "rw4_apply", "rw5_events", "rw8_apply", "rw458_chain"])
def test_pages_are_not_shuffled(spark, small, name):
    """A page comes whole from its document: only the texts are dealt out, and no rows of fragments."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1


def test_one_pass_is_plan_and_apply(spark, small):
    records = plans.records(Tables(spark, small)).where("page % 1000000 < 2").cache()
    for rule in m.RULES.values():
        rows, events = m.apply(records, m.allowed_pairs(m.plan(records, rule)), rule)
        for got, want in ((m.planned_and_applied(records, rule), rows), (m.merge_events(records, rule, together=True), events)):
            cells = lambda df: Counter(tuple(map(str, r)) for r in df.select(*want.columns).collect())  # noqa: E731, B023
            assert cells(got) == cells(want)
    records.unpersist()


def test_regions_of_pages_are_those_of_boxes(spark):
    import random

    from paperloom.plans.layout import regions_of, regions_of_pages

    random.seed(3)
    boxes = [(page, k, x := random.choice([20.0, 60.0, 61.5, 330.0, 400.0]), y := random.uniform(60, 720), x + random.choice([10.0, 90.0, 200.0]), y + 10) for page in range(60) for k in range(page % 12 + 1)]
    flat = spark.createDataFrame(boxes, "page long, idx long, x1 double, y1 double, x2 double, y2 double")
    nested = flat.groupBy("page").agg(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2")).alias("items"))
    columns = ["page", "idx", "x1", "region", "column_id", "confidence"]
    got, want = (Counter(map(tuple, df.select(columns).collect())) for df in (regions_of_pages(nested), regions_of(flat)))
    assert got == want and {r[4] for r in want} == {None, "left", "right", "single"}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_close_pairs_where_batches_cut_pages(spark, size):
    import random

    from paperloom.operators import folds

    random.seed(size)
    rows = [(page, k, y := float(random.randrange(60)), y + random.choice([0.0, 4.0, 10.0]), f"t{page}-{k}") for page in range(9) for k in range(page % 5 * 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = folds.close_pairs(spark.createDataFrame(rows, "page long, idx long, y1 double, y2 double, text string").coalesce(1), ["idx", "y1", "y2", "text"], 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = lambda a, b: abs((a[2] + a[3]) / 2 - (b[2] + b[3]) / 2) <= 0.8 * max(a[3] - a[2], b[3] - b[2], 1.0)
    want = [(a[0], *a[1:], *b[1:]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and near(a, b)]
    assert want and Counter(map(tuple, got)) == Counter(want)


def test_walks_start_from_the_records(spark, small):
    """Pages made where they are walked through have the rows that ``records`` states on columns."""
    from paperloom.sources import page_rows

    columns = ["page", *m.COLUMNS]
    odd = "x....... 12\n\n  two  blanks   %*$&#% %*$&#%\n" + "Grüße ②③ 𝔸𝔹 " * 40 + "\n · · · · 7 \n...... 3\t\n\x85\u2028 .... 9\u2028\n½½\n" + "words go on and " * 900
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(900_001, odd), (900_002, ""), (900_003, " \n "), (900_004, None)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    tables = Tables(spark, small)
    tables.documents = documents
    want = Counter(map(tuple, plans.records(tables).select(columns).collect()))
    got = Counter((page, *row) for doc_id, text in texts if text is not None for page, rows in page_rows.pages_of(doc_id, text) for row in rows)
    assert got == want and {"toc_entry", "preserved_token", "body"} == {r[7] for r in want} and {"table", "edge", "body_column"} <= {r[8] for r in want}


@pytest.mark.parametrize("rule", list(m.RULES.values()), ids=lambda r: r.name)
def test_what_is_in_reach_is_all_that_is_found(rule):
    """Boxes of many heights and places: looking up those in reach finds what trying all of them does."""
    import random

    words = ["transl", "ation", "at 12.", "5V", ".", "and so on it goes", "Some words here end.", "page 3", "x", "THE END", "größe", "the first line of a text"]
    found = 0
    for seed in range(150):
        random.seed(seed)
        items = []
        for k in range(random.randrange(1, 25)):
            x1 = random.choice([60.0, 64.0, 90.0, 110.5, 140.0, 330.0]) + random.choice([0.0, 0.1, 4.9])
            items.append(frag(k, x1, random.choice(words), y2=700.0 - random.choice([0.0, 0.3, 3.0, 8.0, 11.0, 12.0, 24.0, 36.0]), x2=x1 + random.choice([0.5, 20.0, 50.0, 80.0]), height=random.choice([0.5, 8.0, 10.0, 10.0, 30.0, 60.0]), column=random.choice(["single", "single", "left"]), region=random.choice(["body_column", "body_column", "table", "unknown"])))
        pairs, _ = naive(items, rule)
        assert [p for p in plan(items, rule) if p[3] != "skipped"] == pairs
        allowed = {p[:2] for p in pairs if p[3] == "allowed"}
        merged, rows = naive(items, rule, allowed)
        kept, events = m._merged(items, rule)
        assert events == [p[:3] for p in merged] and [(f.record.idx, f.text, f.box, f.members) for f in kept] == [(f.record.idx, f.text, f.box, f.members) for f in sorted(rows, key=lambda f: min(f.members))]
        found += len(pairs)
    assert found > 5


@pytest.mark.parametrize("name", ["rw4_plan", "rw4_apply", "rw4_events", "rw5_plan", "rw5_apply", "rw5_events", "rw8_plan", "rw8_apply", "rw8_events", "rw458_decision_counts", "rw458_chain"])
def test_pages_are_made_where_they_are_walked_through(spark, small, name):
    """Python gets texts: rows of fragments cost more on their way there than being made."""
    executed = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("MapInArrow") == 1 and "Generate" not in executed
