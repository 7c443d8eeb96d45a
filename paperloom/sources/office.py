"""Office documents as tables: DOCX spans, PPTX paragraphs, XLSX text cells, and writing texts back.

Files are read by Spark's ``binaryFile`` source and opened in Arrow batches with
the standard library's zip and XML readers, one file at a time. A file that is
damaged or holds a document type declaration gives one row with its error, so no
file disappears.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paperloom.sources.tables import dealt

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
SCHEMA = "path string, part string, item long, place long, text string, format string, error string"


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, item, place, text, format, error) of all .docx, .pptx and .xlsx files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(folder)
    return units(files.select("path", "content"))


def units(files: DataFrame) -> DataFrame:
    """The text units of (path, content) rows; null contents give an error row."""

    def run(path: str | None, content: bytes | None) -> list[tuple]:
        try:
            return [(path, *u, None) for u in file_units(path, content)]
        except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, TypeError) as e:
            return [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]

    return _each(files.select("path", "content"), run, SCHEMA)


#: Rows of a result's batch, and bytes of files in one.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def _each(df: DataFrame, rule: Callable[..., list[tuple]], out: str) -> DataFrame:
    """``rule(*row)`` gives rows; one input row's Python values are held at a time, and small batches of results."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(out)
    arrow = to_arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                made = rule(*(x.as_py() for x in row))
                done += made
                size += sum(len(x) for r in made for x in r if isinstance(x, bytes))
                if len(done) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield packed(done)
                    done, size = [], 0
        if done:
            yield packed(done)

    return df.mapInArrow(run, schema)


def file_units(path: str, content: bytes) -> list[tuple]:
    """(part, item, place, text, format) of one file."""
    return [(u.part, u.item, u.place, u.text, u.format) for u in Document(path, content).units]


class Unit:
    """A run of text with one format: elements whose texts join to it."""

    def __init__(self, part: str, item: int, place: int, format_key: str, elements: list):
        self.part, self.item, self.place, self.format, self.elements = part, item, place, format_key, elements

    @property
    def text(self) -> str:
        return "".join(e.text or "" for e in self.elements)

    def put(self, text: str) -> None:
        """The new text goes to the first element, with the old blanks around it; the others are emptied."""
        old = self.text
        if not old.strip():
            return
        head, tail = old[: len(old) - len(old.lstrip())], old[len(old.rstrip()) :]
        for k, e in enumerate(self.elements):
            e.text = head + text.strip() + tail if k == 0 else ""
            if e.text != e.text.strip():
                e.set(XML_SPACE, "preserve")


class Document:
    """A file whose text units can be replaced and written again."""

    def __init__(self, path: str, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.trees: dict[str, ET.Element] = {}
        kind = path.rpartition(".")[2].lower()
        self.units: list[Unit] = {"docx": self._docx, "pptx": self._pptx, "xlsx": self._xlsx}[kind]()

    def _tree(self, part: str) -> ET.Element:
        data = self.zip.read(part)
        if b"<!DOCTYPE" in data:
            raise ValueError("document type declarations are refused")
        self.trees[part] = ET.fromstring(data)
        return self.trees[part]

    def _docx(self) -> list[Unit]:
        body = self._tree("word/document.xml").find(f"{W}body")
        inside = {p for cell in body.iter(f"{W}tc") for p in cell.iter(f"{W}p")}
        every = list(body.iter(f"{W}p"))
        # Body paragraphs come first, then those of table cells; each element once.
        paragraphs = [p for p in every if p not in inside] + [p for p in every if p in inside]
        out = []
        for k, p in enumerate(paragraphs):
            spans: list[tuple[str, list]] = []
            for owner in [p, *p.iter(f"{W}hyperlink")]:
                key = None
                for run in owner.findall(f"{W}r"):
                    style = run.find(f"{W}rPr")
                    own = ("" if owner is p else "link:") + ("" if style is None else ET.tostring(style, encoding="unicode"))
                    for child in run:
                        if child.tag == f"{W}t":
                            if own == key:
                                spans[-1][1].append(child)
                            else:
                                spans.append((own, [child]))
                            key = own
                        elif child.tag != f"{W}rPr":
                            key = None  # a tab, break, field or image ends the span
            out += [Unit("word/document.xml", k, n, key, found) for n, (key, found) in enumerate(spans)]
        return out

    def _pptx(self) -> list[Unit]:
        order = []
        for name in self.zip.namelist():
            m = re.fullmatch(r"ppt/(slides|notesSlides)/\w*?(\d+)\.xml", name)
            if m:
                order.append((m[1] != "slides", int(m[2]), name))
        out = []
        for _, _, name in sorted(order):
            for k, p in enumerate(self._tree(name).iter(f"{A}p")):
                found = list(p.iter(f"{A}t"))
                if "".join(t.text or "" for t in found).strip():
                    out.append(Unit(name, k, 0, "", found))
        return out

    def _xlsx(self) -> list[Unit]:
        names = sorted((int(m[1]), n) for n in self.zip.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        shared = [list(si.iter(f"{S}t")) for si in self._tree("xl/sharedStrings.xml").iter(f"{S}si")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        out, used = [], set()
        for number, name in names:
            for k, cell in enumerate(self._tree(name).iter(f"{S}c")):
                value = cell.find(f"{S}v")
                if cell.find(f"{S}f") is not None:
                    continue
                if cell.get("t") == "inlineStr":
                    found = list(cell.iter(f"{S}t"))
                elif cell.get("t") == "s" and value is not None and int(value.text) not in used:
                    used.add(int(value.text))  # a shared string is one unit, however many cells show it
                    found = shared[int(value.text)]
                else:
                    continue
                if "".join(t.text or "" for t in found).strip():
                    out.append(Unit(name, number, k, cell.get("r", ""), found))
        return out

    def save(self) -> bytes:
        """The file with changed parts; other parts are copied. It is opened again before it is returned."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.zip.infolist():
                tree = self.trees.get(info.filename)
                z.writestr(info.filename, self.zip.read(info) if tree is None else ET.tostring(tree, encoding="utf-8", xml_declaration=True))
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
            if bad := z.testzip():
                raise zipfile.BadZipFile(bad)
        return out.getvalue()


def translate(files: DataFrame, segments: Callable[[list[str]], list[str]]) -> DataFrame:
    """(path, content, replaced, error): files with every unit's text replaced by ``segments(texts)``.

    ``segments`` gets a file's texts that aren't blank, in order, and must return
    as many; else the file has an error and no content, never half of one.
    """

    def run(path: str | None, content: bytes | None) -> list[tuple]:
        try:
            document = Document(path, content)
            todo = [u for u in document.units if u.text.strip()]
            new = segments([u.text for u in todo])
            if len(new) != len(todo):
                raise ValueError(f"{len(todo)} segments gave {len(new)} translations")
            for unit, text in zip(todo, new, strict=True):
                unit.put(text)
            return [(path, document.save(), len(todo), None)]
        except Exception as e:  # noqa: BLE001  one file's failure is that file's error
            return [(path, None, 0, f"{type(e).__name__}: {e}"[:200])]

    return _each(files.select("path", "content"), run, "path string, content binary, replaced long, error string")


def make(kind: str, lines: list[str]) -> bytes:
    """A small file with one paragraph, slide paragraph or cell for each line; characters XML refuses are left out."""
    from xml.sax.saxutils import escape

    clean = [escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", x)) for x in lines]
    if kind == "docx":
        parts = {"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>' + "".join(f'<w:p><w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for x in clean) + "</w:body></w:document>"}
    elif kind == "pptx":
        parts = {"ppt/slides/slide1.xml": f'<p xmlns:a="{A[1:-1]}">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in clean) + "</p>"}
    elif kind == "xlsx":
        cells = "".join(f'<row><c r="A{k + 1}" t="inlineStr"><is><t xml:space="preserve">{x}</t></is></c></row>' for k, x in enumerate(clean))
        parts = {"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S[1:-1]}"><sheetData>{cells}</sheetData></worksheet>'}
    else:
        raise ValueError(f"no writer for {kind}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def make_files(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(path, content): a file of one kind for each text, a unit for each of its lines."""

    def run(k: int | None, t: str | None) -> list[tuple]:
        return [(f"{k}.{kind}", make(kind, (t or "").split("\n")))]

    return _each(dealt(df.selectExpr(f"CAST({id_col} AS BIGINT) AS k", f"CAST({text_col} AS STRING) AS t"), "k"), run, "path string, content binary")
