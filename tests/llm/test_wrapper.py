import html
import os
import random
import re

import pytest

from sieveworks.llm import wrapper as W

SF = "/root/testdata/sf0.01"


def text_of(page):
    return "\n\n".join(t for _, t in W.blocks(W.parse(page)))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four", "A & B\n\none two three\n\nfour"),
        ("<nav><a>x</a></nav><p>body</p><footer>f</footer>", "body"),
        ("<main><header><h1>T</h1><span>by me</span></header><p>x</p><aside>no</aside></main><p>out</p>", "T\n\nx"),
        ("<div class='cookie-notice'>no</div><div id='sideBar'>no</div><div>yes</div>", "yes"),
        ("<article><p>a</p><div class='comments'><p>reader</p></div><form><p>f</p></form></article>", "a"),
        ("<article><script>if (a < b) '</p>'</script><style>p{}</style><p>x &lt;y&gt; &nbsp; z</p><!-- <p>no</p> -->", "x <y> z"),
        ("<article><p title='a>b'>t</p><ul><li>i<li>j</ul><table><tr><td>c<td>d</table>", "t\n\ni\n\nj\n\nc\n\nd"),
        ("<article><p>cut <b>off</b> <a hre", "cut off"),
        ("a < b and c", "a < b and c"),
        ("<article>one</article><p>no</p><article>two</article>", "one\n\ntwo"),
        ("<p hidden>no</p><p style='display:none'>no</p><p>yes</p>", "yes"),
        ("<article><p>x" + "<i>" * 3000 + "deep", "xdeep"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body class='home has-sidebar'><article><p>text</article>", "text"),
        ("<div class='layout with-sidebar'><article><p>text</article></div>", "text"),
        ("<article class='post comments-open'><p>text</article>", "text"),
        ("<body class='sidebar' hidden><p>text", "text"),
        ("<p>site</p><div class='widget'><article class='post'><p>text</article></div>", "text"),
        ("<article class='sponsored'><p>text</article>", "text"),
        ("<article><p>text<article class='comment'><p>reader</article></article>", "text"),
        ("<div><p>text</div><div id='comments'><article><p>reader</article></div>", "text"),
        ("<article><p>text<div class='cookie-banner-2'><p>no</div><div class='post sidebar'><p>no</div></article>", "text"),
    ],
)
def test_marks_drop_no_article(page, want):
    assert text_of(page) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in W.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def random_tree(rng, depth=3):
    node = W.Node(rng.choice("ab"), None)
    if depth:
        node.children = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return node


def best(a, b):
    """The most matching nodes, by trying all."""
    if a.name != b.name:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x, y))
    return m[-1][-1] + 1


def test_tree_matching_is_the_best():
    rng = random.Random(0)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        want = best(a, b)
        assert len(W.align(a, b)) == want


def test_constant_slots_are_template(spark):
    page = lambda i: f"<html><body><div><p>Our house rules apply.</p><p>Text {i} is {i * 7}.</p></div></body></html>"
    rows = [(i, "http://h/x", page(i), "t") for i in range(12)] + [(i, "http://few/x", page(i), "t") for i in range(20, 23)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in W.extract(pages).collect()}
    assert got[3] == "Text 3 is 21." and got[21] == "Our house rules apply.\n\nText 21 is 147."


def test_every_layout_has_its_template(spark):
    """Neither an empty, a cut off nor another page as the host's first turns induction off; each layout counts by itself."""
    one = lambda i: f"<html><body><div><p>Our house rules apply.</p><p>Text {i} is {i * 7}.</p></div></body></html>"
    two = lambda i: f"<html><body><section class='shop'><table><tr><td>Item {i} of {i * 3}</td></tr></table><ul><li>Free delivery.</li></ul></section></body></html>"
    odd = ["", "<html><body><h1>Not found", "<html><body><div><p>Our hou"]
    rows = [(k, "http://h/x", page) for k, page in enumerate([*odd, *map(one, range(12)), *map(two, range(12))])]
    got = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "", 1: "Not found", 2: "Our hou"} | {3 + i: f"Text {i} is {i * 7}." for i in range(12)} | {15 + i: f"Item {i} of {i * 3}" for i in range(12)}


def test_copies_are_no_template(spark):
    rows = [(i, "http://h/x", "<article><p>Same text on all.</p></article>") for i in range(30)]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Same text on all."}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h", ""), (2, "http://h", ""), (None, "http://h/é", "<p>" + "x " * 200_000)]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 399_999]
    assert W.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_induction_without_marks(spark):
    """With neither element names nor words to go by, induction finds the article of the hosts' pages and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    kept = lost = left = away = 0
    for r in W.extract(pages, marks=False).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        want, got = {p for p in parts if p}, set(r["text"].split("\n\n"))
        around = {t for _, t in W.blocks(W.parse(r["html"]), None, False)} - want
        kept, lost, left, away = kept + len(want & got), lost + len(want - got), left + len(around & got), away + len(around - got)
    assert kept > 20_000 and lost <= 0.01 * kept and away > 15_000 and left <= 0.01 * away


def test_varying_slots_are_content(spark):
    """A frame whose words differ on every page, a list of links of any length, and the text, none of them marked."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        texts = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 7))]
        links = "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(rng.randint(1, 5)))
        rows.append((i, "http://h/x", f"<html><body><div><p>{word()} {word()}</p></div><div class=l><ul>{links}</ul></div><div class=t>{''.join(f'<p>{t}</p>' for t in texts)}</div><div class=e><p>{word()}</p></div></body></html>"))
        want[i] = "\n\n".join(texts)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for marks in (False, True):
        assert {r["page_id"]: r["text"] for r in W.extract(pages, marks=marks).collect()} == want


def test_large_references_are_joined(spark, monkeypatch):
    """Beyond the bound of what is broadcast the rows are joined, with the same result."""
    page = lambda i: f"<html><body><div><p>Our house rules apply.</p><p>Text {i} is {i * 7}.</p></div></body></html>"
    pages = spark.createDataFrame([(i, "http://h/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    want = sorted(map(tuple, W.extract(pages).collect()))
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, W.extract(pages).collect())) == want and want[1][2] == "Text 1 is 7."


def test_regions_decide_only_with_most_of_the_text():
    reference = W.Reference("html(body(div()ul(li()li())div(p()p())))")
    number = {n.name + str(k): k for n, k in ((reference_node(reference, k), k) for k in range(9))}
    ul, div = 3, 6
    assert reference.regions([(ul, 10), (div, 900)], 1000) == [div]
    assert reference.regions([(ul, 400), (div, 500)], 1000) == [ul, div]
    assert reference.regions([(ul, 100)], 1000) == [] and reference.regions([], 10) == [] and reference.regions([(0, 10)], 10) == []
    assert reference.regions([(1, 900), (div, 900)], 1000) == [1] and number["ul3"] == ul


def reference_node(reference, number):
    todo = [reference.root]
    while todo:
        n = todo.pop()
        if reference.number[id(n)] == number:
            return n
        todo += W._elements(n)
