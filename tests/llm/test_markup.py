import pytest

from folioscale.llm.markup import clean_markup, convert, densities, parse
from folioscale.session import local_session

MARKUP = ["<b>x</b>", "a<!-- c -->", "A &amp; B", "# Title", "== Title ==", "**bold** x", "an *old* one", "[a](b)", "![p](f.jpg)",
          "[[page|x]]", "use `code`", "- one\n- two", "1. a\n2. b", "> said", "| a | b |", "{{cite|A}}", "''x''", "\\emph{x}", "$K_d = 8$"]
PROSE = ["x > 3 but y < 2", "p < 0.05", "cost $12 and $15", "About ~5 mM", "R&D batch #7 had <5% water", "run_04_b gave 1.2 x 10^3 nM",
         "[3, 4]", "α-treated (Fig. 2b)", "", "two words\n\nand a line"]
PAGE = """<html><head><title>x</title><script>var a = 1;</script></head><body>
<div id=menu><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a> <a href=4>Contact</a></div>
<div class=main><h1>Kinase assay</h1><p>The kinase was purified by affinity chromatography and kept cold until use in all of the assays.</p>
<ul><li>wash <b>twice</b></li><li>elute<ul><li>slowly</li></ul></li></ul>
<p>A second paragraph with a <a href=x>link</a> and plenty of further text to raise its density above that of the menu.</p>
<pre><code>for x in y:\n    print(x &lt; 3)</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></div>
<div><p><a href=1>Read more</a> <a href=2>Related one</a> <a href=3>Related two</a></p></div><footer>copyright</footer></body></html>"""


@pytest.mark.parametrize("text", MARKUP)
def test_markup_is_met(text):
    assert convert(text)[1]


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_left_as_it_is(text):
    assert convert(text)[:2] == (text, [])


def test_the_densest_subtree_is_kept_with_its_structure():
    clean, kinds, blocks = convert(PAGE)
    assert kinds == ["html"]
    assert [(k, n) for k, n, _ in blocks] == [
        ("heading", 1), ("text", 0), ("item", 1), ("item", 1), ("item", 2), ("text", 0), ("code", 0), ("row", 0), ("row", 0),
    ]
    assert "for x in y:\n    print(x < 3)" in clean and "a\tb\n1\t2" in clean
    for lost in ("Home", "Read more", "copyright", "var a"):
        assert lost not in clean
    _, best, least = densities(parse(PAGE))
    assert best.tag == "div" and least > 0


def test_latex_wiki_and_markdown_keep_headings_lists_tables_and_formulas():
    text = "\\section{Set-up}\n\\begin{itemize}\n\\item wash\n\\item elute\n\\end{itemize}\nso \\[ \\frac{a}{b} \\] holds \\emph{for \\textbf{all}} \\alpha\n"
    assert convert(text)[2] == [("heading", 1, "Set-up"), ("item", 1, "wash"), ("item", 1, "elute"), ("text", 0, "so"), ("formula", 0, "\\frac{a}{b}"), ("text", 0, "holds for all α")]
    text = "== Cells ==\n{| class=x\n! A !! B\n|-\n| 1 || 2\n|}\n* one\n* two\nthe [[page|name]]{{cite|K}} is ''so''"
    assert convert(text)[2] == [("heading", 2, "Cells"), ("row", 0, "A\tB"), ("row", 0, "1\t2"), ("item", 1, "one"), ("item", 1, "two"), ("text", 0, "the name is so")]
    text = "## T\n```\n# no <b>heading</b>\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n- x\n  - **y**\n> said"
    assert convert(text)[2] == [("heading", 2, "T"), ("code", 0, "# no <b>heading</b>"), ("row", 0, "a\tb"), ("row", 0, "1\t2"), ("item", 1, "x"), ("item", 2, "y"), ("quote", 0, "said")]


def test_broken_and_long_markup_ends():
    for text in ("<<<>>> &&& ]] [[ }} {{", "<div>" * 3000 + "x", "**a " * 20000, "\\[ a " * 20000, "$a\\" * 20000, "{{" * 20000, "<a>only</a> <a>links</a>"):
        assert convert(text)[0] is not None
    assert convert("<a href=1>only</a> <a href=2>links</a>")[0] == "only links"


def test_nulls_empty_tables_and_other_columns():
    spark = local_session(2, 2, "1g")
    schema = "id string, text string, kinds string, clean string"
    rows = [("a", None, "k", "c"), ("b", "", "k", "c"), (None, "# T", None, None), ("c", "x **y**", "k", "c"), ("c", "x **y**", "k", "c")]
    got = sorted((r.id or "", r.clean, list(r.kinds), len(r.blocks)) for r in clean_markup(spark.createDataFrame(rows, schema), ["id"], "text").collect())
    assert got == [("", "T", ["markdown"], 1), ("a", None, [], 0), ("b", "", [], 0), ("c", "x y", ["markdown"], 1), ("c", "x y", ["markdown"], 1)]
    assert clean_markup(spark.createDataFrame([], schema), ["id"], "text").count() == 0
