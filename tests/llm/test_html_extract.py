import random

import pytest

from lodestone.llm import html_extract as H
from lodestone.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>one<br><p>two \n three</p></article>", "A & B\none\ntwo three"),
        ('<nav>menu</nav><main><p>x</p><aside>no</aside><div class="ad">no</div><p>y</p></main><footer>f</footer>', "x\ny"),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->', "yes"),
        ("<body><header>site</header><article><header><h1>T</h1></header><p>x</p></article></body>", "T\nx"),
        ('<article><p>x</p><section id="comments"><p>reader</p></section></article>', "x"),
        ("<ul><li>a<li>b</ul>tail", "a\nb\ntail"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("no markup at all  &lt;", "no markup at all <"),
        ('<p>a <span class="ad">buy</span> b</p>', "a b"),
        ("<p hidden>x</p><p style='display: none'>y</p><p title='a > b'>z</p>", "z"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>unclosed <a href='x", "unclosed <a href='x"),
        ("<form><input value=q>go</form><noscript>n</noscript><p>x", "x"),
        ("", ""),
    ],
)
def test_extract(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p data-x=it's>Hello world</p><p>don't stop</p><p>end</p>", "Hello world\ndon't stop\nend"),
        ("<p title=\"open>one</p><p>two</p>", "one\ntwo"),
        ("<p title='a > b' id=x>one</p><p title = \"c > d\">two</p>", "one\ntwo"),
        ("<p it's odd \"quoted\">one</p><script data-x=it's>no</script><p>two's</p>", "one\ntwo's"),
    ],
)
def test_quotes_count_at_the_start_of_a_value_only(page, text):
    assert H.extract(page) == text


def _page(n):
    return f"<html><body><div><p>Site slogan</p></div><div><p>Story {n} begins here.</p><p>Again and again.</p></div><div><p>Terms of this site</p></div><div><p>{n}</p></div></body></html>"


def _by(pages, page):
    pivot, constant, linked = H.induce(pages)
    return H.extract(page, (H.parse(pivot), constant, linked), len(set(pages)) >= H.ZONE_PAGES)


def test_template_is_what_pages_share():
    assert _by([_page(i) for i in range(4)], _page(9)) == "Story 9 begins here.\n9"
    assert H.induce([_page(1), _page(2)]) is None
    inside = [f"<article><p>same</p><p>{i}</p></article><div>foot</div>" for i in range(4)]
    assert _by(inside, inside[0]) == "same\n0"


def _bare(n):
    """A page whose tags and names say nothing, or mislead."""
    menu = "".join(f"<div><a href=x>Entry {n * k % 7}</a></div>" for k in range(1, 2 + n % 4))
    return f"<div><div>{menu}</div><div class=nav><div>Story {n}</div><div>It goes on and on for {n} more lines of text, as stories do.</div></div><div>Made by us</div></div>"


def test_only_alignment_tells():
    pages = [_bare(i) for i in range(20)]
    assert [_by(pages, p) for p in pages] == [f"Story {n}\nIt goes on and on for {n} more lines of text, as stories do." for n in range(20)]


def test_names_that_mislead():
    assert H.extract('<article class="post ad-free"><p>x</p></article>') == "x"
    assert H.extract('<div class="related-work"><p>long text here</p></div><div>y</div>') == "long text here\ny"
    assert H.extract('<div class="social"><article><p>the whole of it</p></article></div><div class=ad-slot>z</div>') == "the whole of it"
    assert H.extract('<p>text of the page</p><div class="cookie-notice">no</div><div class="share-buttons">no</div>') == "text of the page"


def _size(a, b):
    """Simple tree matching by its recursion."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + _size(x, y))
    return m[-1][-1] + 1


def _tree(draw, depth=0):
    inner = "".join(_tree(draw, depth + 1) for _ in range(draw.randint(0, 4 if depth < 3 else 0)))
    tag = draw.choice(["div", "section", "ul"])
    return f"<{tag}>{draw.choice('abc')}{inner}</{tag}>"


@pytest.mark.parametrize(("table", "few"), [(1 << 22, 2048), (1 << 22, 0), (4, 0)])
def test_tree_matching_against_its_recursion(monkeypatch, table, few):
    monkeypatch.setattr(H, "TABLE", table)
    monkeypatch.setattr(H, "FEW", few)
    draw = random.Random(4)
    for _ in range(150):
        a, b = H.parse(_tree(draw))[0], H.parse(_tree(draw))[0]
        pairs = H.tree_match(a, b)
        assert len(pairs) == _size(a, b)
        up = {id(x): y for x, y in pairs}
        for x, y in pairs[1:]:
            assert x.label == y.label and up[id(x.parent)] is y.parent  # parents are paired, and siblings keep their order
        for x, y in pairs:
            at = [y.children.index(up[id(c)]) for c in x.children if id(c) in up]
            assert at == sorted(set(at))


def test_tree_matching_aligns_inserted_nodes():
    a, b = H.parse("<div><p>1</p><p>2</p><ul><li>x</li></ul></div>")[0], H.parse("<div><p>0</p><p>1</p><p>2</p><ul><li>x</li></ul></div>")[0]
    pairs = H.tree_match(a, b)
    assert len(pairs) == 6
    assert [(x.blocks[0].text, y.blocks[0].text) for x, y in sorted(pairs, key=lambda p: p[0].blocks[0].text if p[0].blocks else "") if x.tag == "p"] == [("1", "1"), ("2", "2")]


def test_long_and_deep_pages_are_matched_whole():
    rows = "".join(f"<tr><td>{i}<td>{i * i}" for i in range(3000))
    pages = [f"<table>{rows}</table><p>{n}</p><div>foot</div>" for n in range(12)]
    assert _by(pages, pages[5]) == "5"
    deep = [f"{'<div>' * 3000}<nav>menu</nav><p>{n}</p><p>foot</p>" for n in range(12)]
    assert _by(deep, deep[3]) == "3"
    assert H.extract("<div>" * 160 + "<nav>menu</nav><p>t</p>") == "t"


def test_deep_and_broken_pages():
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.extract("<p " + 'a="' * 3000) .startswith("<p ")
    assert H.extract("</p></div><p>x</article>") == "x"


def test_on_spark(spark):
    pages = [(i, f"https://H.example.com/{i}", _page(i), "t", "h") for i in range(40)] + [(100, None, _page(5), "", ""), (101, "https://one.org/", None, "", ""), (3, "https://h.example.com/3", _page(3), "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, host string")
    rows = H.extract_pages(df).collect()
    assert len(rows) == len(pages)
    assert {r["page_id"]: r["text"] for r in rows if r["page_id"] < 40} == {i: f"Story {i} begins here.\n{i}" for i in range(40)}
    assert {r["text"] for r in rows if r["page_id"] == 101} == {""}
    assert H.extract_pages(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extract"](spark, sf_dir).collect():
        article = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        import html as h
        import re

        expected = "\n".join(x for x in (" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", article)) if x)
        assert r["text"] == expected and r["n_chars"] == len(expected)


def _article(n):
    return f"<body><article><p>Story {n} goes on.</p><p>Follow us everywhere</p><div><p>Ann wrote this for us</p></div></article><section><p>Postscript {n}</p></section><div>foot</div></body>"


def _texts(spark, pages):
    df = spark.createDataFrame([(i, f"https://h.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in H.extract_pages(df).orderBy("page_id").collect()]


def test_alignment_decides_inside_articles_and_outside(spark):
    assert _texts(spark, [_article(i) for i in range(30)]) == [f"Story {i} goes on.\nPostscript {i}" for i in range(30)]
    few = [f"Story {i} goes on.\nFollow us everywhere\nAnn wrote this for us" for i in range(5)]
    assert _texts(spark, [_article(i) for i in range(5)]) == few


def test_odd_pages_and_layouts_leave_a_template_and_equal_pages_count_once(spark):
    odd = ["", "<h1>Error</h1>", " "] * 2
    other = [f"<section><div><h2>Menu two</h2><p>Other {i}</p></div></section>" for i in range(12)]
    found = _texts(spark, [_page(i) for i in range(40)] + odd + other)
    assert found == [f"Story {i} begins here.\n{i}" for i in range(40)] + ["", "Error", ""] * 2 + [f"Other {i}" for i in range(12)]
    assert set(_texts(spark, ["<p>the only text</p>"] * 8)) == {"the only text"}
