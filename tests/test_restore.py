"""Placeholders given back to their neighbours, against a plain matching."""

import hashlib
import re
from collections import defaultdict

from paperloom.operators import restore
from paperloom.plans import QUERIES, preview
from paperloom.sources.tables import Tables

MARK = re.compile(r"\bDTX[A-F0-9]{10}Q\b", re.I)


def naive(texts, owned):
    """Nearest owners, and the matching in which each owner's placeholder is given out once."""
    own, pairs, near = defaultdict(set), [], {}
    for (p, i), held in owned.items():
        own[p, i] = {name for name, _ in held}
    for (p, i), text in texts.items():
        marks = list(dict.fromkeys(MARK.findall(text)))
        for nth, mark in enumerate(marks):
            if mark in own[p, i]:
                continue
            for away in (1, 2):
                for j in (i - away, i + away):
                    for place, (name, token) in enumerate(owned.get((p, j), ())):
                        if name.lower() == mark.lower():
                            pairs.append((p, away, i, nth, j, place, mark, token))
                            near.setdefault((p, i), {}).setdefault(mark, token)
    given, taken, once = set(), set(), []
    for p, _, i, nth, j, place, mark, token in sorted(pairs):
        if (p, i, nth) not in given and (p, j, place) not in taken:
            given.add((p, i, nth))
            taken.add((p, j, place))
            once.append((p, i, mark, j, token))
    return near, sorted(once)


def test_whole_tables(spark, small):
    moved, holds = preview.moved_placeholders(Tables(spark, small))
    texts = {(r.page, r.idx): r.text for r in moved.collect()}
    owned = defaultdict(list)
    for r in sorted(holds.collect(), key=lambda r: r.place):
        owned[r.page, r.idx].append((r.placeholder, r.token))
    near, once = naive(texts, owned)
    got = {(r.page, r.idx): (r.restored, r.text_sha256) for r in QUERIES["rw14_neighbor_placeholders"](spark, small).collect()}
    assert set(got) == set(texts) and near
    for key, text in texts.items():
        for mark, token in near.get(key, {}).items():
            text = re.sub(mark, lambda _, t=token: t, text, flags=re.I)
        assert got[key] == (len(near.get(key, {})), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(map(tuple, QUERIES["rw14_placeholders_once"](spark, small).collect())) == once and once


def test_each_is_taken_once(spark):
    a, b = "DTX" + "A" * 10 + "Q", "DTX" + "B" * 10 + "Q"
    texts = spark.createDataFrame([(1, 0, f"x {a.lower()} {a}"), (1, 1, f"{b}"), (1, 2, f"{a}"), (1, 5, f"{a}"), (2, 1, a)], "page long, idx long, text string")
    owned = spark.createDataFrame([(1, 1, 0, a, "5 mV"), (1, 1, 1, b, "$1\\"), (1, 3, 0, a, "7 V")], "page long, idx long, place int, placeholder string, token string")
    assert sorted(map(tuple, restore.taken_once(texts, owned).collect())) == [(1, 0, a.lower(), 1, "5 mV"), (1, 2, a, 3, "7 V")]
    near = {(r.page, r.idx): r.text for r in restore.restored(texts, restore.nearest(texts, owned)).collect()}
    assert near == {(1, 0): "x 5 mV 5 mV", (1, 1): b, (1, 2): "5 mV", (1, 5): "7 V", (2, 1): a}


def test_pages_stay_whole(spark, small):
    """Owners are looked for in the page's own row: nothing is shuffled but the texts, once, and each text is scanned once."""
    for name in ("rw14_neighbor_placeholders", "rw14_placeholders_once"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.count("ArrowEvalPython ") == 1 and "Join" not in plan


def test_pages_equal_tables(spark):
    """Repeated marks, owners in any case, gaps between places, rows that own nothing, null texts."""
    a, b = "DTX" + "A" * 10 + "Q", "DTX" + "B" * 10 + "Q"
    lines = [
        (1, [(0, f"x {a.lower()} {a}", []), (1, b, [(a, "5 mV"), (b, "$1\\")]), (2, a, []), (3, None, [(a, "7 V")]), (5, f"{a} {b}", [])]),
        (2, [(1, a, [])]), (3, []), (4, [(7, a, [(a.lower(), "1 V")]), (9, f"{b}{a} {a}", [(a.lower(), "2 V"), (a, "3 V")]), (10, a, [])]),
    ]
    pages = spark.createDataFrame(lines, "page long, lines array<struct<idx:long,text:string,own:array<struct<placeholder:string,token:string>>>>")
    flat = [(p, *x) for p, found in lines for x in found]
    texts = spark.createDataFrame([(p, i, t) for p, i, t, _ in flat], "page long, idx long, text string")
    owned = spark.createDataFrame([(p, i, k, *o) for p, i, _, own in flat for k, o in enumerate(own)], "page long, idx long, place int, placeholder string, token string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    want = rows(restore.restored(texts, restore.nearest(texts, owned)))
    assert rows(restore.restored_of_pages(pages)) == want and sum(r[3] for r in want) > 3
    once = rows(restore.taken_once(texts, owned))
    assert rows(restore.taken_once_of_pages(pages)) == once and len(once) > 2


def test_lines_are_whole(spark, small):
    """What isn't moved reads, tokens put back, as the document's whole line and what was set behind it."""
    moved, holds = preview.moved_placeholders(Tables(spark, small))
    texts, owned = {(r.page, r.idx): r.text for r in moved.collect()}, defaultdict(dict)
    for r in holds.collect():
        owned[r.page, r.idx][r.placeholder] = r.token
    documents = spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    lines = {(d.doc_id, k): line for d in documents for k, line in enumerate(x for x in d.text.split("\n") if x.strip(" "))}
    assert set(texts) == set(lines)
    plain = [key for key in lines if key[1] % 3 == 2]
    for page, k in plain:
        text = texts[page, k]
        for name, token in owned[page, k].items():
            text = text.replace(name, token)
        assert text == f"{lines[page, k]} VDD_IO {k % 7} mV at {k % 4 + 1} kHz"
    assert any(len(lines[key]) > 16 for key in plain)
