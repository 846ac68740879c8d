import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import markdown, rewrite
from lectern.plans import statements


@pytest.mark.parametrize(("latex", "spoken"), [(a.replace("@n", "17").replace("@k", "5"), b.replace("@n", "17").replace("@k", "5")) for a, b in statements.NOTATION])
def test_notation_is_spoken_as_written_down(latex, spoken):
    assert rewrite.speak_math(latex) == spoken


@pytest.mark.parametrize(("latex", "spoken"), [(a.replace("@n", "17"), b.replace("@n", "17")) for a, b in statements.NOTATION_DESKTOP])
def test_the_desktop_dialect_speaks_notation_its_own_way(latex, spoken):
    assert rewrite.speak_math(latex, "desktop") == spoken


def test_every_command_of_the_tables_is_spoken_by_itself():
    tables = (rewrite.CALCULUS, rewrite.RELATIONS_WEB, rewrite.RELATIONS, rewrite.LOGIC, rewrite.GREEK, rewrite.TRIG, rewrite.SETS)
    # a shorter command that comes before speaks the start of a longer one
    split = {"subseteq": None, "infty": None}
    for names in tables:
        for name, words in names.items():
            if name not in split or split[name]:
                assert rewrite.speak_math(f"a \\{name} b") == f"a {words} b", name


def test_rules_as_functions_equal_plain_substitution():
    draw = random.Random(1)
    parts = [r"\frac", r"\sqrt", "{", "}", "[3]", "[5]", "x", "^", "2", "^{-1}", "_", r"\alpha", r"\left", r"\rightarrow", r"\not", r"\in", r"\tag", "3", r"\log_{", r"\big", r"\hat{", "log_{", "+", "|", r"\;", " ", r"\cdot", r"\Biggl"]
    for dialect in ("web", "desktop"):
        for _ in range(1500):
            text = "".join(draw.choices(parts, k=draw.randrange(1, 12)))
            want, before = text, None
            while dialect == "web" and want != before:
                before = want
                for pattern, words in rewrite.NESTED:
                    want = rewrite.compiled(pattern).sub(f" {words} ", want)
            for pattern, words in rewrite.math_rules(dialect):
                want = rewrite.compiled(pattern, dialect).sub(f" {words} ", want)
            assert rewrite.speak_math(text, dialect) == rewrite.collapse(want, dialect), text


def test_prose_is_rewritten_as_written_down(spark):
    for dialect, pairs in (("web", statements.CLAUSES), ("desktop", statements.CLAUSES_DESKTOP)):
        assert [rewrite.prose_text(a, dialect) for a, _ in pairs] == [b for _, b in pairs]
        df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, t string").select("i", rewrite.prose(F.col("t"), dialect).alias("s"))
        assert {r.i: r.s for r in df.collect()} == {i: b for i, (_, b) in enumerate(pairs)}


def test_both_engines_rewrite_prose_alike(spark):
    draw = random.Random(4)
    parts = ["Fig.", " et al.", " (2020)", "[1, 2]", "[Bau69", "]", "(", ")", ", 1999", "\u00a0", "\n", "\ufeff", "é", "_", "http://a.b/c", ".", " ", "w.r.t.", "iid", "3.14", "## ", "1.2", "*", "i.e.", "-", "–", "\u2028", "\x85", "x"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(1500)]
    for dialect in ("web", "desktop"):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rewrite.prose(F.col("t"), dialect).alias("s"))
        for r in df.collect():
            assert r.s == rewrite.prose_text(texts[r.i], dialect), repr(texts[r.i])


def test_own_rules_can_be_added(spark):
    assert rewrite.speak_math(r"\foo x", extra=((r"\\foo", "bar of"),)) == "bar of x"
    one = spark.createDataFrame([("a qed b",)], "t string").select(rewrite.prose(F.col("t"), extra=(("qed", "done"),)).alias("s")).first()
    assert one.s == rewrite.prose_text("a qed b", extra=(("qed", "done"),)) == "a done b"


def test_spans():
    for a, b in statements.SPANS:
        assert rewrite.speak_spans(a.replace("@n", "4")) == b.replace("@n", "4")
    assert rewrite.speak_spans(r"$x^2$ and \(y\)", "desktop") == "$x^2$ and  y "


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("# A *b* c #\n\none\ntwo **x _y_** `c*d`", "<h1>A <em>b</em> c</h1>\n<p>one\ntwo <strong>x <em>y</em></strong> <code>c*d</code></p>"),
        ("T\n===\nU\n---", "<h1>T</h1>\n<h2>U</h2>"),
        ("- a\n- b\n  - c", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul></li>\n</ul>"),
        ("1. x\n\n2. y", "<ol>\n<li><p>x</p></li>\n<li><p>y</p></li>\n</ol>"),
        ("> q\nlazy", "<blockquote>\n<p>q\nlazy</p>\n</blockquote>"),
        ("```\na <b\n```\n\n    code", "<pre><code>a &lt;b\n</code></pre>\n<pre><code>code\n</code></pre>"),
        ("[l](u \"t\") ![i](z) [r] [n] <b> a\\*b\n\n[r]: http://x", "<p><a>l</a> <img> <a>r</a> [n] &lt;b&gt; a*b</p>"),
        ("***a** b* a_b_c 2 * 3", "<p><em><strong>a</strong> b</em> a_b_c 2 * 3</p>"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"),
        ("a & b &amp; c  \nd", "<p>a &amp; b &amp; c<br>\nd</p>"),
        ("", ""),
    ],
)
def test_markdown(text, html):
    assert markdown.to_html(text) == html


def test_markdown_of_the_desktop_dialect():
    html = markdown.to_html("---\na: b\n---\n# T {#id}\n\nSee[^n] \\(x^2\\) <i>k</i>\n\n\\[ y \\]\n\n[^n]: the note\n\n- [x] done\n\nterm\n: meaning", "desktop")
    assert html.startswith("<h1>T</h1>\n<p>See<sup><a>[1]</a></sup> <eq>x^2</eq> <i>k</i></p>\n<section>\n<eqn> y </eqn>\n</section>")
    assert "<li>done</li>" in html and "<dl><dt>term</dt><dd>meaning</dd></dl>" in html and html.count("the note") == 1
