import random
import time

import pytest

from curricle.llm.html_layout import extract_text, render_page

CASES = [
    ("<p>One\n two<p>Three", "One two\n\nThree"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>after", "- a\n- b\n  - c\n\nafter"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
    ("<table><tr><th colspan=2>head<th>z<tr><td>1<td>2<td>3</table>", "head |   | z\n1    | 2 | 3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td>x<br>y<td>z</table>", "x | z\ny |"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        | b\n         |\nin | ner |"),
    ("<head><title>t</title><style>p{}</style></head><body>b<script>if(a<b)x('</p>')</script>", "b"),
    ("<p style='display: none'>no</p><p hidden>no</p><p>yes", "yes"),
    ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<pre>a\n  b\tc</pre>", "a\n  b     c"),
    ("a &amp; b&nbsp;&copy; <!-- no > no -->c", "a & b © c"),
    ("a < b and <3 <a title='>'>link</a>", "a < b and <3 link"),
    ("<a title=\"unclosed>text</a> more", "text more"),
    ("<nav>menu</nav><footer>foot</footer>", "menu\nfoot"),
    ("<b>bo<i>th</b>x</i>", "bothx"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<input type=hidden value=x>v<textarea>a<b</textarea>", "va<b"),
    ("", ""),
    ("<td>stray</td></div></p>text", "straytext"),
    ("<p>" * 5000 + "deep", "deep"),
    ("<div>" * 20000 + "deep", "deep"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert render_page(html) == text


def test_visible_words_survive_any_tag_soup():
    random.seed(3)
    tags = "div p b i ul li ol table tr td th span h1 section blockquote pre dl dt dd option select".split()
    for _ in range(300):
        parts, words = [], []
        for k in range(40):
            tag = random.choice(tags)
            parts.append(random.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class='x'>", "<br>"]))
            if random.random() < 0.4:
                parts.append(f"<span>word{k}</span>")
                words.append(f"word{k}")
        text = render_page("".join(parts))
        assert all(word in text for word in words), "".join(parts)


def test_query_over_rows(spark):
    rows = [(1, "<p>a", "x"), (2, None, None), (None, "", "x"), (1, "<p>a", "x"), (3, "plain " * 50_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in extract_text(pages).collect()), key=str)
    want = [(1, "a"), (1, "a"), (2, ""), (3, ("plain " * 50_000).strip()), (None, "")]
    assert got == sorted(want, key=str)
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table>one<tr>two<td>a</td>three<tbody>four</tbody></table>", "onetwothreefour\n\na"),
        ("before<table> <thead> x <tr> y <th>h</thead> <tfoot>z</table>after", "before\n\nx y z\n\nh\n\nafter"),
        ("<table><tr><td>a<table>in<tr><td>b</table></table>", "a\nin\nb"),
        ("<table hidden>no<tr>no</table><table style='visibility:hidden'>no</table>yes", "yes"),
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
        ("<math><semantics><mi>x</mi><annotation>TeX</annotation></semantics></math>", "x"),
        ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3<mtd>4</mtable></math>", "1 2\n3 4"),
        ("<math><mi/><mphantom>no</mphantom><mtext>if <b>so</b></mtext></math>", "if so"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><style>s{}</style><script>f()</script>"
         "<text>one <tspan>label</tspan></text><text>two</text></svg>", "one label\ntwo"),
        ("<svg><title/><desc/><style/><defs/><text>label</text></svg>after", "label\nafter"),
        ("<svg><text><![CDATA[a > b]]></text><text display=none>no</text></svg>", "a > b"),
        ("<svg><foreignObject><div>a</div><div/>b</div></foreignObject></svg>c", "a\nb\nc"),
        ("<svg/>a<svg><defs><p>b", "a\n\nb"),
        ("<table><tr><td><svg><text>s</text></svg><td>t</table>", "s | t"),
        ("a <map name=m><area href=x>in <a>map</a></map> b", "a in map b"),
    ],
)
def test_text_of_table_parts_formulas_drawings_and_maps(html, text):
    assert render_page(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td colspan=" + "9" * 5000 + ">a<td rowspan=" + "0" * 5000 + "1>b</table>", "a | b"),
    ("<ol start=" + "8" * 5000 + "><li>a</ol>", "10000000000. a"),
    ("a&#" + "6" * 5000 + ";b &#" + "0" * 5000 + "65;", "a\ufffdb A"),
    ("<p style='backface-visibility:hidden'>a</p><p style='color:red;visibility: hidden'>b</p>", "a"),
    ("a<!-->b<!--->c<!-- x --!>d<!-- y -->e", "abcde"),
    ("a<!-- never ends", "a"),
])
def test_odd_numbers_styles_and_comments(html, text):
    assert render_page(html) == text


@pytest.mark.parametrize("html", [
    "<div>" * 40_000, "<p><button>" + "<div>" * 40_000, "<div>x</b>" * 20_000, "<ul><li>" * 3_000, "<a href='" * 20_001,
    "<p title=\"x>text " * 20_001, "<a " * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "&#" * 40_000, "<!-->" * 40_000,
])
def test_time_grows_with_the_page(html):
    began = time.perf_counter()
    render_page(html)
    assert time.perf_counter() - began < 5
