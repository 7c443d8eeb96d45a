"""String rules without SQL, on whole tables, against plain Python."""

import hashlib
import re
import unicodedata

import pytest

from paperloom.operators import folds
from paperloom.plans import QUERIES
from paperloom.sources.tables import Tables


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in Tables(spark, small).documents.collect()}


def got(spark, small, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in QUERIES[name](spark, small).collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def odd(s):
    return s.replace("th", "T\u200bH").replace(", ", "\u00a0\uff21\u25a0 3x4 ").replace("es", "e\u25a0s")


def test_canonical_and_clean_texts(spark, small, texts):
    canonical = lambda s: "".join(re.sub("[\u200b\ufeff]", "", unicodedata.normalize("NFKC", s).casefold()).split())
    assert got(spark, small, "str1_canonical", "canonical_sha256") == {i: (sha(canonical(odd(t))),) for i, t in texts.items()}
    clean = got(spark, small, "str2_sanitize", "clean_sha256")
    for i, t in texts.items():
        s = unicodedata.normalize("NFKC", odd(t)).replace("\r\n", "\n").replace("\u200b", "").replace("\u00a0", " ")
        s = re.sub("(?<=\\S)\u25a0+(?=\\S)", "-", s)
        s = re.sub("\u25a0+", " ", s)
        s = re.sub(r"(?<=\d)\s*[xX*]\s*(?=\d)", " \u00d7 ", s)
        lines = [re.sub(r"[ \t]{2,}", " ", x) for x in s.split("\n")]
        assert clean[i] == (sha("\n".join(x.strip() for x in lines).strip()),) == (sha(folds.sanitize(odd(t))),)


def words_spaced(s):
    out = ""
    for k, c in enumerate(s):
        before, after = s[k - 1 : k], s[k + 1 : k + 2]
        capital = "A" <= c <= "Z"
        if capital and (re.match("[a-z0-9]", before) or re.match("[A-Z0-9]", before) and re.match("[a-z]", after)):
            out += " "
        out += c
    return out


def test_names_are_spaced(spark, small):
    for s, spaced in got(spark, small, "str9_camel_split", "s", "spaced").values():
        assert spaced == words_spaced(s)


def test_widths(spark, small, texts):
    for i, (width,) in got(spark, small, "str11_display_width", "width").items():
        s = re.sub("(?i)the", "\u7535\u538b", texts[i])
        assert width == sum(2 if not c.isspace() and unicodedata.east_asian_width(c) in "FW" else 1 for c in s)


MARKER = r"(?:\d{1,2}[.)]|\(\d{1,2}\))"


def test_lists(spark, small):
    rows = got(spark, small, "str12_marker_breaks", "s", "markers", "broken")
    parts = {}
    for r in QUERIES["rw9_split_numbered"](spark, small).collect():
        parts.setdefault(r.doc_id, {})[r.part] = r.line
    for i, (s, markers, broken) in rows.items():
        lines = re.sub(rf"(\S)[ \t]+(?={MARKER}\s)", "\\1\x01", s).split("\x01")
        assert markers == len(re.findall(rf"(?:^|(?<=\s)){MARKER}\s", s)) and broken == "\n".join(lines)
        assert [x for _, x in sorted(parts[i].items())] == (lines if markers >= 2 else [s])
    assert max(map(len, parts.values())) > 1


def test_fonts(spark, small):
    found = {}
    for r in QUERIES["str13_font_tokens"](spark, small).collect():
        found[r.name] = (r.tokens, r.bold, r.italic, r.mono, r.serif)
    assert found["ABCDEF+Arial-BoldMT"] == ("arial bold mt", True, False, False, False)
    assert found["CourierNew"] == ("courier new", False, False, True, False) and found["Times-Roman"] == ("times roman", False, False, False, True)
    assert found["Georgia,BoldItalic"] == ("georgia bold italic", True, True, False, True) and found[""] == ("", False, False, False, False) and found[None][0] in (None, "")


def test_thai(spark, small, texts):
    rows = got(spark, small, "str15_thai_wrap", "wrapped_sha256", "breaks")
    for i, t in texts.items():
        s = t.replace(" the ", " กข คง ").replace(" de ", " ก ค ")
        out = "".join(c + "\u200b" if c == " " and "\u0e00" <= s[k - 1 : k] <= "\u0e7f" and "\u0e00" <= s[k + 1 : k + 2] <= "\u0e7f" else c for k, c in enumerate(s))
        assert rows[i] == (sha(out), out.count("\u200b"))
    assert any(n for _, n in rows.values())
