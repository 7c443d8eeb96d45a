"""What a translator is given: worked cases, and all documents' sentences in one process."""

import pytest

from paperloom.operators import input_text as it
from paperloom.operators.label_lines import Glyph
from paperloom.plans import QUERIES
from paperloom.sources.fragments import translator_inputs
from paperloom.sources.tables import Tables


def run(text, x=0.0, size=8.0):
    return [Glyph(c, x + 5.0 * k, 0.0, x + 5.0 * k + 5, 8.0, size, False) for k, c in enumerate(text)]


def formula(fragment, token="{v1}", kind="formula"):
    return it.Placeholder(token, kind, fragment, "")


def test_rebuilding():
    assert it.rebuilt([run("the ADC"), run("MODE bit", 40.0)]) == "the ADC_MODE bit"
    assert it.rebuilt([run("the adc"), run("mode", 40.0)]) == "the adc mode" and it.rebuilt([run("the adc"), run("mode", 35.0)]) == "the adcmode"
    assert it.rebuilt([run("ADC"), run("MODE", 30.0)]) == "ADC MODE"  # too far apart for a name
    assert it.rebuilt([run("ADC_"), run("MODE", 21.0)]) == "ADC_MODE" and it.rebuilt([run("ADC"), run("MODEs", 18.0)]) == "ADC MODEs"
    assert it.rebuilt([run("at 3."), run("5", 28.0)]) == "at 3. 5" and it.rebuilt([run("3"), run(".", 5.0), run("5", 15.0)]) == "3.5"
    assert it.rebuilt([]) is None and it.rebuilt([[], run("a"), []]) == "a"


@pytest.mark.parametrize(("text", "want"), [("a_b", "a_b"), ("a__b", "a_b"), ("_a b_", "a b"), ("a _ b", "a  b"), ("(_x", "(x"), ("+_+", "+_+"), ("a_, b", "a, b"), ("", "")])
def test_loose_lines(text, want):
    assert it.without_loose_lines(text) == want


def test_numbers():
    assert it.number_cut("= 12", "at x = 12.5 V") == "= 12" and it.number_cut("12", "x 12.5") == "12" and it.number_cut("12", "x12.5") == "12"
    assert it.number_cut("12", "x 12 V") is None and it.number_cut("a", "a.5") is None and it.number_cut("-3", "to -3,5") == "-3"
    assert it.number_cut("12", "112.5 = 12.5") == "= 12"


def test_alignment_takes_the_first_unused_match():
    source = "a + b and a + b"
    assert it.aligned(source, [formula("a + b"), formula("a + b", "{v2}")]) == "{v1} and {v2}"
    assert it.aligned(source, [formula("a + b", kind="style"), formula("")]) == source
    assert it.aligned("x = 12.5 V", [formula("= 12")]) == "x {v1}.5 V"


def test_choosing():
    no_items = []
    assert it.choose(None, "x", [], no_items) == ("x", "as_is") and it.choose("s", "c", [], no_items) == ("c", "as_is")
    assert it.choose("set A_B now", "set A{v1}B now", [formula("_")], no_items) == ("set A_B now", "literal_source")
    assert it.choose("f of x*y now", "f of {v1} now", [formula("x*y")], no_items) == ("f of {v1} now", "repair")
    assert it.choose("to x = 12.5 V", "to x {v1}.5 V", [formula("= 12")], no_items) == ("to x = 12.5 V", "literal_source")
    assert it.choose("f of +5 and", "f of ( {v1} ) and", [formula("+5")], no_items) == ("f of +5 and", "literal_source")
    items = [run("the Config"), run("register", 55.0)]
    assert it.choose("theConfigregister", "theConfigregister", [], items) == ("the Config register", "composition")
    assert it.choose("theConfigregister", "theConfigregister", [formula("x")], items) == ("the Config register", "composition_rebuilt")
    assert it.choose("the Config register", "another text", [], items) == ("another text", "as_is")


def test_query_equals_one_process(spark, small):
    want = {}
    for r in translator_inputs(Tables(spark, small).documents).collect():
        marks = [it.Placeholder(*p) for p in r.placeholders]
        items = [[Glyph(g.ch, g.x1, g.y1, g.x2, g.y2, g.size, False) for g in item] for item in r["items"]]
        want[r.doc_id] = (r.current, *it.choose(r.source, r.current, marks, items))
    got = {r.doc_id: (r.current, r.text, r.branch) for r in QUERIES["str23_txt5_choose_input"](spark, small).collect()}
    assert got == want and len(got) > 100
    counts = {r.branch: r.n for r in QUERIES["str23_branches"](spark, small).collect()}
    assert {"repair", "literal_source", "composition", "as_is"} <= set(counts) and sum(counts.values()) == len(want)
