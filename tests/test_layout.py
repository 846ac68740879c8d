import json
import re

import pytest

from lectern.operators import layout

FONTS = {"var": "QWERTY+CMMI10", "sym": "QWERTY+CMSY7", "text": "QWERTY+CMR10"}


def run(text, x, y, size, font="text", width=None):
    return {"str": text, "transform": [size, 0, 0, size, x, y], "width": len(text) * size * 0.5 if width is None else width, "font": font}


def page(*items, page_no=2):
    return layout.extract_page(items, FONTS, page_no)


def test_a_raised_pair_becomes_one_exponent():
    out = page(run("Take the group ", 40, 600, 10), run("cdc", 115, 600, 10, "var", 18), run("−", 133, 603.5, 7, "sym", 5), run("2", 138, 603.5, 7, "text", 4), run(" as it is.", 146, 600, 10))
    assert out["mmd"] == r"Take the group \(c d c ^{-2}\) as it is."  # variables are read one by one


def test_a_raised_number_after_a_word_is_the_mark_of_a_note():
    out = page(run("as we saw above.", 40, 600, 10, width=80), run("7", 120, 603.5, 7, width=4), run("The next sentence.", 130, 600, 10, width=90))
    assert out["mmd"] == "as we saw above.7 The next sentence."
    low = page(run("the log", 40, 600, 10, width=35), run("2", 75, 597, 7, width=4), run("of it.", 85, 600, 10, width=30))
    assert low["mmd"] == r"the \(log_{2}\) of it."


def test_symbols_and_letters_become_commands():
    out = page(run("for some ", 40, 600, 10), run("β ≥ γ", 90, 600, 10, "var", 30), run(" it holds", 122, 600, 10))
    assert out["mmd"] == r"for some \( \beta \geq \gamma\) it holds"
    assert out["confidence"] == 1 and 0 < out["math_ratio"] < 0.3


def test_scripts_of_scripts_nest():
    out = page(run("x", 40, 600, 10, "var", 6), run("2", 46, 604, 7, "text", 4), run("n", 50, 607, 5, "var", 3), run("+1", 60, 600, 10))
    assert out["mmd"] == r"\(x ^{2^{n}}\) +1"


def test_letters_of_mathematical_alphabets_are_folded():
    out = page(run("the set \U0001d400\U0001d44e\U0001d7d9 and more", 40, 600, 10))
    assert "A a 1" in out["mmd"] and out["confidence"] == 1
    unknown = page(run("the sign ⊰ and more", 40, 600, 10))
    assert "⊰" not in unknown["mmd"] and unknown["confidence"] == pytest.approx(1 - min(0.4, 30 / 19))


def test_what_is_drawn_as_two_glyphs_is_one_sign():
    assert page(run("x ̸= y and z", 40, 600, 10))["mmd"] == r"\(x \neq y and z\)"
    assert page(run("we have a ", 40, 600, 10), run("̸", 92, 600, 10, "sym", 1), run("∈ S", 93, 600, 10, "sym", 15))["mmd"].endswith(r"\( \notin S\)")
    assert "□" not in page(run("This ends the proof. □ ", 40, 600, 10))["mmd"]
    assert page(run("f maps x 7", 40, 600, 10), run("→", 90, 600, 10, "sym", 8), run(" y", 99, 600, 10, "var", 8))["mmd"] == r"f maps x \(\mapsto y\)"
    assert page(run("the root ", 40, 600, 10), run("√", 85, 600, 10, "sym", 8), run("5", 93, 600, 10, "var", 5), run(" of it", 100, 600, 10))["mmd"].startswith(r"the root \( \sqrt{5}\)")


def test_turned_runs_go():
    out = page({"str": "stamp", "transform": [0, 9, -9, 0, 20, 300], "width": 60, "font": "text"}, run("The only line of prose.", 40, 600, 10))
    assert out["mmd"] == "The only line of prose."


def test_running_heads_go_on_later_pages():
    items = [run("ON THE OTHER MATTER", 200, 770, 10, width=110), run("The body goes on with a sentence.", 40, 700, 10, width=170), run("Another line of the body is here.", 40, 688, 10, width=170), run("12", 300, 40, 10)]
    later, first = page(*items), page(*items, page_no=1)
    assert later["mmd"] == "The body goes on with a sentence. Another line of the body is here."
    assert "ON THE OTHER MATTER" in first["mmd"] and "12" not in first["mmd"].split()


def test_title_sections_and_paragraphs():
    out = page(
        run("A SMALL RESULT", 150, 760, 14, width=120), run("The first para-", 40, 700, 10, width=250), run("graph of the text is here.", 40, 688, 10, width=250), run("Indented, a new one starts", 55, 676, 10, width=240),
        run("and goes on.", 40, 664, 10, width=60), run("2.1 Details", 40, 640, 10, width=60), run("More of it here now.", 40, 616, 10, width=200), run("References", 40, 604, 10, width=50), run("One entry of the list.", 40, 592, 10, width=200), page_no=1,
    )
    assert out["mmd"].split("\n\n") == ["# A SMALL RESULT", "The first paragraph of the text is here.", "Indented, a new one starts and goes on.", "## 2.1 Details", "More of it here now.", "## References", "One entry of the list."]


def test_scripts_beyond_the_line_come_back():
    out = page(run("K", 40, 600, 10, "var", 6), run("=", 50, 600, 10, "text", 5), run("3", 60, 600, 10, "text", 5), run("3m", 66, 607, 7, "var", 7), run("= y", 80, 600, 10, "text", 15), run("4", 96, 607, 7, "text", 4))
    assert re.search(r"3\^\{\s?3\s?m\s?\}", out["mmd"]) and "\n" not in out["mmd"]


def test_stacked_small_runs_become_a_fraction():
    out = page(run("goes to (", 40, 600, 10, width=45), run("3", 86, 603.9, 7, width=4), run("4", 86, 596.6, 7, width=4), run(", 1) as said.", 92, 600, 10, width=80))
    assert r"\frac{3}{4}" in out["mmd"] and "34" not in out["mmd"]


def test_stacked_lines_lower_the_confidence():
    stacked = page(run("The sum is", 40, 600, 10, width=60), run("y + 2", 110, 603, 10, "var", 25), run("x3", 118, 593.5, 10, "text", 10), run("as the text says.", 160, 600, 10, width=130))
    assert stacked["confidence"] < page(run("Plain prose and nothing else here.", 40, 600, 10))["confidence"] == 1


def test_pages_without_text():
    assert page() == page(run("  ", 1, 1, 10)) == page(run("—", 40, 600, 10)) == {"mmd": "", "confidence": 0.0, "math_ratio": 0.0, "has_text": False}


def test_pages_of_a_table(spark):
    rows = [(1, 1, 0, "A page of prose.", [10.0, 0.0, 0.0, 10.0, 40.0, 600.0], 80.0, "f"), (1, 2, 0, " ", [10.0, 0.0, 0.0, 10.0, 40.0, 600.0], 80.0, "f")]
    glyphs = spark.createDataFrame(rows, "doc_id long, page_no int, item_no int, str string, transform array<double>, width double, font string")
    fonts = spark.createDataFrame([("f", "ABC+CMR10")], "font string, ps_name string")
    pages = layout.extract_pages(glyphs, fonts)
    served, rest = layout.route(pages)
    assert [(r.page_no, r.mmd) for r in served.collect()] == [(1, "A page of prose.")] and [r.page_no for r in rest.collect()] == [2]


def test_pages_are_read_from_json(spark, tmp_path):
    item = {"str": "A page of prose.", "transform": [10, 0, 0, 10, 40, 600], "width": 80, "fontName": "f"}
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"doc_id": 1, "page_no": n, "items": [item] * n}) for n in (0, 1, 2)))
    glyphs = layout.read_pages(spark, str(tmp_path))
    assert glyphs.count() == 3
    assert {(r.page_no, r.mmd) for r in layout.extract_pages(glyphs).collect()} == {(1, "A page of prose."), (2, "A page of prose.A page of prose.")}
