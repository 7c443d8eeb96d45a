"""Office files made by hand: every scenario of runs, tables, links, notes and shared strings."""

import io
import zipfile

import pytest

from paperloom.sources import office

WN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
AN = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
SN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def run(text, bold=False, extra=""):
    return f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{text}</w:t>{extra}</w:r>'


@pytest.fixture
def docx():
    body = [
        f"<w:p>{run('single')}</w:p>",
        f"<w:p>{run('uni')}{run('form')}</w:p>",
        f"<w:p>{run('bold ', True)}{run('normal')}</w:p>",
        f"<w:tbl><w:tr><w:tc><w:p>{run('cell one')}</w:p></w:tc><w:tc><w:p>{run('cell two')}</w:p></w:tc></w:tr></w:tbl>",
        f"<w:p>{run('after table')}</w:p>",
        f"<w:p>{run('see ')}<w:hyperlink>{run('link')}</w:hyperlink></w:p>",
        f"<w:p>{run('a', extra='<w:tab/>')}{run('b')}</w:p>",
        "<w:p/>",
    ]
    return packed({"word/document.xml": f"<w:document {WN}><w:body>{''.join(body)}</w:body></w:document>", "other.bin": "kept"})


@pytest.fixture
def pptx():
    slide = lambda *t: f"<p {AN}>" + "".join(f"<a:p>{''.join(f'<a:r><a:t>{x}</a:t></a:r>' for x in ts)}</a:p>" for ts in t) + "</p>"
    return packed({"ppt/slides/slide10.xml": slide(["ten"]), "ppt/slides/slide2.xml": slide(["t", "wo"], [" "]), "ppt/notesSlides/notesSlide1.xml": slide(["note"])})


@pytest.fixture
def xlsx():
    sheet = f'<worksheet {SN}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="C1"><v>5</v></c><c r="D1" t="str"><f>A1</f><v>x</v></c><c r="E1" t="inlineStr"><is><t>inline</t></is></c><c r="F1" t="s"><v>1</v></c></row></sheetData></worksheet>'
    return packed({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {SN}><si><t>shared</t></si><si><t> </t></si></sst>"})


def test_docx_spans(docx):
    got = [(item, text) for _, item, _, text, _ in office.file_units("a.docx", docx)]
    assert got == [(0, "single"), (1, "uniform"), (2, "bold "), (2, "normal"), (3, "after table"), (4, "see "), (4, "link"), (5, "a"), (5, "b"), (7, "cell one"), (8, "cell two")]


def test_pptx_order(pptx):
    assert [(part.rpartition("/")[2], text) for part, _, _, text, _ in office.file_units("a.pptx", pptx)] == [("slide2.xml", "two"), ("slide10.xml", "ten"), ("notesSlide1.xml", "note")]


def test_xlsx_cells(xlsx):
    assert [(text, where) for _, _, _, text, where in office.file_units("a.xlsx", xlsx)] == [("shared", "A1"), ("inline", "E1")]


def test_units_and_errors(spark, docx, pptx, xlsx):
    rows = [("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", b"junk"), ("e.docx", None), ("f.odt", docx), ("g.docx", packed({"word/document.xml": "<!DOCTYPE x><x/>"}))]
    got = office.units(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sum(r.path == "a.docx" for r in got) == 11 and sum(r.path == "b.pptx" for r in got) == 3 and sum(r.path == "c.xlsx" for r in got) == 2
    assert {r.path for r in got if r.error} == {"d.docx", "e.docx", "f.odt", "g.docx"}


def test_read_from_folder(spark, tmp_path, docx, xlsx):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.docx").write_bytes(docx)
    (tmp_path / "b.xlsx").write_bytes(xlsx)
    (tmp_path / "c.txt").write_text("no")
    assert office.read_units(spark, str(tmp_path)).count() == 13


def test_translate(spark, docx, pptx, xlsx):
    files = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", b"junk")], "path string, content binary")
    got = {r.path: r for r in office.translate(files, lambda texts: [f"[T]{t.strip()}" for t in texts]).collect()}
    for path, original in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx)):
        assert got[path].error is None
        before = [u for u in office.file_units(path, original) if u[3].strip()]
        after = [u for u in office.file_units(path, bytes(got[path].content)) if u[3].strip()]
        assert [(a[:3], a[4]) for a in before] == [(b[:3], b[4]) for b in after]
        assert [b[3].strip() for b in after] == [f"[T]{a[3].strip()}" for a in before]
    assert zipfile.ZipFile(io.BytesIO(bytes(got["a.docx"].content))).read("other.bin") == b"kept"
    assert got["d.docx"].content is None and got["d.docx"].error
    short = {r.path: r for r in office.translate(files, lambda texts: texts[1:]).collect()}
    assert all(r.content is None and r.error for r in short.values())


def test_results_come_in_batches_and_texts_are_dealt_out(spark):
    """Many small files are no frame each, a file that fails keeps its row, and one partition of texts becomes many."""
    docs = spark.createDataFrame([(k, f"a {k}\nb") for k in range(200)], "doc_id long, text string").coalesce(1)
    for kind in ("docx", "pptx", "xlsx"):
        files = office.make_files(docs, "doc_id", "text", kind)
        assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        bad = spark.createDataFrame([(f"x.{kind}", b"no zip"), (f"y.{kind}", None)], "path string, content binary")
        both = office.translate(files.unionByName(bad), lambda texts: [t.upper() for t in texts])
        assert {r.path: r.replaced for r in both.collect()} == {f"{k}.{kind}": 2 for k in range(200)} | {f"x.{kind}": 0, f"y.{kind}": 0}
        got = office.units(both).collect()
        assert sorted(r.text for r in got if r.error is None) == sorted([f"A {k}" for k in range(200)] + ["B"] * 200)
        assert sum(r.error is not None for r in got) == 2
