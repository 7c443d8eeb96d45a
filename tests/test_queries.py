"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from paperloom.plans import ORACLE, QUERIES
from paperloom.sources.tables import NAMES


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for name in NAMES:
        if os.path.exists(f"{small}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, small, name):
    assert QUERIES[name](spark, small).collect()


def lines_of(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()


def test_noise_and_tokens_equal_plain_python(spark, small):
    from collections import Counter

    from paperloom.operators import folds, tokens

    rows = lines_of(small)
    noise = {i: (len((t or "").split("\n")), sum(folds.is_block_noise(x) for x in (t or "").split("\n"))) for i, t in rows}
    assert {r.doc_id: (r.lines, r.noise) for r in QUERIES["dup8_block_noise"](spark, small).collect()} == noise
    found = {i: tokens.protect_text(t or "")[1] for i, t in rows}
    got = QUERIES["str6_str7_protect_tokens"](spark, small).collect()
    assert {r.doc_id: r.tokens for r in got} == {i: len(x) for i, x in found.items()} and all(r.restored for r in got)
    want = Counter(token for pairs in found.values() for _, token in pairs)
    assert {r.token: r.n for r in QUERIES["rw16_protected_tokens"](spark, small).collect()} == want


def test_sections_and_chunks_equal_plain_python(spark, small):
    sections, pieces = [], []
    for i, t in lines_of(small):
        held, k = [], 0
        paragraphs = [p for p in t.split("\n") if p.strip(" ")]
        for n, p in enumerate(paragraphs):
            held.append(len(p))
            if len(held) == 8 or sum(held) >= 2200 or n == len(paragraphs) - 1:
                sections.append((i, k, len(held), sum(held)))
                held, k = [], k + 1
        text, k, open_ = t, 0, ""
        for line in [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]:
            if open_ and len(open_) + len(line) > 1800:
                pieces.append((i, k, open_))
                open_, k = "", k + 1
            open_ += line
        if open_:
            pieces.append((i, k, open_))
    assert sorted(map(tuple, QUERIES["win11_sections"](spark, small).collect())) == sorted(sections)
    assert sorted(map(tuple, QUERIES["str4_win10_chunks"](spark, small).collect())) == sorted(pieces)


def test_blocks_are_the_boxes_of_components(spark, small):
    from collections import defaultdict

    boxes = defaultdict(list)
    nodes = {(r.page, r.idx): r for r in __import__("paperloom.plans.layout", fromlist=["nodes"]).nodes(__import__("paperloom.sources.tables", fromlist=["Tables"]).Tables(spark, small)).collect()}
    for r in QUERIES["geo3_components"](spark, small).collect():
        boxes[r.page, r.component].append(nodes[r.page, r.idx])
    want = sorted((p, c, len(b), min(x.x1 for x in b), min(x.y1 for x in b), max(x.x2 for x in b), max(x.y2 for x in b)) for (p, c), b in boxes.items())
    assert sorted(map(tuple, QUERIES["txt4_block_assembly"](spark, small).collect())) == want


def test_entry(spark, monkeypatch):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", [("paperloom.llm",), ("zstandard",)])
def test_entry_without_the_training_data_operators(missing):
    """The other queries import and register where that subpackage, or what it needs, isn't there."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        f"missing = {missing!r}\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in missing:\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert names and e.oracle_sql() and not any(n.startswith('op1_') or n == 'pipeline' for n in names)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
