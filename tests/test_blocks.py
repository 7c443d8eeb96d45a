"""Blocks of lines, wrapped paragraphs and stored previews: worked cases and whole tables page by page."""

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.operators import blocks as b
from paperloom.operators import sidecar
from paperloom.plans import QUERIES, repair
from paperloom.sources.tables import Tables


def line(idx, y2, text="words", x1=50.0, height=10.0):
    return b.Line(idx, x1, y2 - height, x1 + 100, y2, text)


def opened(lines):
    return [([r.idx for r in block], why) for block, why in b.blocks_of(lines)]


def test_each_reason():
    step = [line(k, 700.0 - 12 * k) for k in range(4)]
    assert opened(step) == [([0, 1, 2, 3], "first")]
    assert opened([*step, line(4, 652.0)]) == [([0, 1, 2, 3], "first"), ([4], "lines")]
    assert opened([step[0], line(1, 688.0, "2) item"), line(2, 676.0)]) == [([0], "first"), ([1, 2], "list_item")]
    assert opened([step[0], step[1], line(2, 656.0)]) == [([0, 1], "first"), ([2], "gap")]
    assert opened([line(0, 700.0, height=30.0), line(1, 668.0, height=30.0), line(2, 636.0, height=30.0)]) == [([0, 1], "first"), ([2], "height")]
    assert opened([step[0], line(1, 688.0, x1=62.0), line(2, 676.0)]) == [([0, 1], "first"), ([2], "indent")]
    assert b.blocks_of([]) == [] and b.line_step(step) == 12.0 and b.line_step([line(0, 700.0, height=3.0)]) == 7.0


def test_blocks_of_all_pages(spark, small):
    pages = defaultdict(list)
    for r in repair.page_lines(Tables(spark, small)).collect():
        pages[r.page].append(b.Line(*tuple(r)[1:]))
    want = [(p, k, len(rows), why, rows[0].idx) for p, lines in pages.items() for k, (rows, why) in enumerate(b.blocks_of(lines))]
    got = QUERIES["win12_block_split"](spark, small)
    assert Counter(map(tuple, got.select("page", "block", "lines", "opened", "first").collect())) == Counter(want)
    reasons = {r.opened: (r.blocks, r.lines) for r in QUERIES["win12_block_reasons"](spark, small).collect()}
    assert {"first", "gap", "list_item", "indent"} <= set(reasons) and sum(n for _, n in reasons.values()) == sum(map(len, pages.values()))


def test_wrapped():
    tail, first, second = b.Line(0, 200, 90, 300, 100, "end of it"), b.Line(1, 50, 78, 120, 88, "another "), b.Line(2, 125, 78, 300, 88, "line")
    assert b.is_wrapped([tail, first, second]) and [[r.idx for r in x] for x in b.visual_lines([second, tail, first])] == [[0], [1, 2]]
    assert not b.is_wrapped([first, second]) and not b.is_wrapped([tail._replace(x1=55), first]) and not b.is_wrapped([tail, first._replace(x1=80), second._replace(x1=125), b.Line(3, 50, 66, 200, 76, "third")])
    assert not b.is_wrapped([tail._replace(text="1"), first._replace(text="2"), second._replace(text="3")])


def test_tails_of_all_pages(spark, small):
    paragraphs = defaultdict(list)
    for r in repair.parsed_paragraphs(Tables(spark, small)).collect():
        paragraphs[r.page, r.paragraph].append(b.Line(*tuple(r)[2:]))
    want = []
    for (page, paragraph), items in paragraphs.items():
        items.sort()
        rows = defaultdict(list)  # the layout's rows are 12 apart
        for r in items:
            rows[-r.y2].append(r)
        parts = [sorted(x, key=lambda r: r.x1) for _, x in sorted(rows.items())] if b.is_wrapped(items) else [items]
        for k, part in enumerate(parts, 1):
            want.append((page, paragraph, f"{paragraph}:wrapped_tail:{k}" if len(parts) > 1 else str(paragraph), "".join(r.text for r in part), [r.idx for r in part]))
    got = [(r.page, r.paragraph, r.part, r.text, r["items"]) for r in QUERIES["rw6_wrapped_tails"](spark, small).collect()]
    assert sorted(got) == sorted(want) and any(":" in r[2] for r in got) and any(":" not in r[2] for r in got)


def test_previews_end_in_one_schema(spark):
    ok = {"schema_version": 10, "document_kind": "pdf", "granularity": "block", "created_at": "d", "blocks": [{"font_name": "F1", "original": 9.0, "current": 9.0, "ref": 1}]}
    three = [{"font_name": f, "original": s, "current": 8.0, "ref": None} for f, s in (("A", 9.0), ("A", 9.0), ("", 9.0))]
    rows = [(1, None), (2, "{"), (3, "[]"), (4, json.dumps(ok)), (5, json.dumps(ok | {"schema_version": 9})), (6, json.dumps(ok | {"granularity": "line", "blocks": three})), (7, json.dumps(ok | {"document_kind": "docx", "blocks": three})), (8, json.dumps({k: v for k, v in ok.items() if k != "blocks"}))]
    built = F.array(F.struct(F.lit("new").alias("font_name"), F.lit(1.0).alias("original"), F.lit(1.0).alias("current"), F.lit(0).alias("ref")))
    df = spark.createDataFrame(rows, "id long, p string").withColumn("blocks_seen", F.lit(0))
    kind = F.when(F.col("id") == 7, "docx").otherwise("pdf")
    got = {r.id: r for r in sidecar.loaded(df, "p", kind, built, F.lit("now")).collect()}
    assert {i: r.steps for i, r in got.items()} == {1: ["rebuild"], 2: ["rebuild"], 3: ["rebuild"], 4: [], 5: ["rebuild"], 6: ["migrate", "clean", "fonts"], 7: ["refs"], 8: ["rebuild"]}
    assert [tuple(x) for x in got[6].blocks] == [("A", 9.0, 9.0, None), ("A", 9.0, 9.0, None)] and [x.ref for x in got[7].blocks] == [0, 1, 2]
    assert {r.version for r in got.values()} == {10} and {r.granularity for r in got.values()} == {"block"} and (got[5].created_at, got[2].created_at) == ("d", "now")
