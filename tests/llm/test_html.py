"""Main text of pages: single constructs, wrappers over several pages, odd rows."""

import json

import pytest

from folioflux.llm import html_extract as H


def text(page):
    blocks = H.blocks_of(H.parse(page))
    return H.text_of(blocks, H.chosen(H.stats_of([b for b in blocks if not b.hidden])))


@pytest.mark.parametrize(
    "inner, expected",
    [
        ("<p>one<p>two", "one\ntwo"),
        ("<p>a <b>b</b>c<br>d&nbsp;&amp;&#233;\n\t e</p>", "a bc d &é e"),
        ("<h1>T</h1><ul><li>x<li>y</ul><p>z", "T\nx\ny\nz"),
        ("<p>a<script>if (a < b) '</p>'</script>b</p><style>p{}</style>", "ab"),
        ("<p>a</p><!-- <p>no</p> --><p>b</p>", "a\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p title='1 > 0' lang=\"x\">a</p>", "a"),
        ("<p>3 < 4 and 5 > 4</p>", "3 < 4 and 5 > 4"),
        ("<div class='share-buttons'>s</div><p>a</p><aside>x</aside><form><input>f</form>", "a"),
        ("<header><h1>Title</h1></header><p>a</p><section id='comments'><p>c</p></section>", "Title\na"),
        ("<p>a <span class='ad'>buy</span> b</p><p hidden>no</p><p style='display: none'>no</p>", "a b"),
        ("<nav><p>menu</p></nav><p>a</p><div role='complementary'>x</div>", "a"),
        ("<blockquote><p>q</p></blockquote><pre>x\n  y</pre>", "q\nx y"),
        ("<p>unclosed <i>a</p><p>b</i></p>", "unclosed a\nb"),
    ],
)
def test_inside_an_article(inner, expected):
    page = f"<html><body><nav>menu</nav><header>Site</header><article>{inner}</article><footer>f</footer></body></html>"
    assert text(page) == expected


def test_without_an_article_the_densest_container_is_taken():
    page = (
        "<body><div class='top-menu'><a href=/>Home</a></div><div id=page><div class=has-sidebar>"
        "<h2>Head</h2><p>First long paragraph of the page.</p><p>Second long paragraph.</p></div>"
        "<div class=sidebar><p>About the author of it all</p></div></div><div class=cookie-consent>OK</div>"
    )
    assert text(page) == "Head\nFirst long paragraph of the page.\nSecond long paragraph."


def test_nothing_and_broken_pages():
    assert text("") == "" and text("   ") == "" and text("<") == "<" and text("plain & simple") == "plain & simple"
    assert text("<article><p>a</p>") == "a"
    assert text("<article><p>a</p><!-- open <p>b</p>") == "a"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_long_pages_stay_linear_and_whole():
    page = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>" + "<x " * 50_000
    assert text(page) == "\n".join(["word & word"] * 50_000)


def shape(page):
    return H.shape_of(H.blocks_of(H.parse(page)))


def test_shapes_fold_repeats_and_alignment_finds_options():
    one = shape("<body><h1>t</h1><p>a</p><p>b</p><p>c</p><ul><li>x</ul></body>")
    two = shape("<body><h1>u</h1><div class=note>n</div><p>a</p></body>")
    assert H.written_out(one) == "<html><body><h1>TEXT(<p>TEXT)+<ul><li>TEXT"
    merged = json.loads(H.aligned([json.dumps(one), json.dumps(two)]))
    assert H.written_out(merged) == "<html><body><h1>TEXT(<div|note>TEXT)?(<p>TEXT)+(<ul><li>TEXT)?"
    assert H.slots_of(one) | H.slots_of(two) == H.slots_of(merged)
    again = H.aligned([json.dumps(merged), json.dumps(one), json.dumps(two)])
    assert json.loads(again) == merged
    pairs = shape("<dl>" + "<dt>a</dt><dd>b</dd>" * 4 + "</dl>")
    assert H.written_out(pairs) == "<html><dl>(<dt>TEXT)+(<dd>TEXT)+"


def test_pages_of_a_host_share_a_wrapper(spark):
    def page(i):
        body = "".join(f"<p>Sentence {n} of page {i} about something.</p>" for n in range(i + 2))
        # No mark says that the claim is not part of the text; that it never changes does.
        return (
            f"<body><div class=a><div class=claim><p>The same long claim stands on each of our pages, always.</p></div>"
            f"<div class=b>{body}</div></div></body>"
        )

    rows = [(i, f"https://www.Host.example:80/p{i}", page(i), "x") for i in range(6)]
    rows += [(6, None, "<article><p>alone</p></article>", "x"), (7, "no address", None, "x"), (7, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {(r["page_id"], r["url"]): r["text"] for r in H.extract(pages).collect()}
    assert len(found) == len(rows)
    for i in range(6):
        expected = "\n".join(f"Sentence {n} of page {i} about something." for n in range(i + 2))
        assert found[i, rows[i][1]] == expected
    assert found[6, None] == "alone" and found[7, "no address"] == "" and found[7, "u"] == ""
    assert H.extract(pages.where("false")).count() == 0
    assert H.extract(pages.union(pages)).count() == 2 * len(rows)


def test_what_only_one_page_has_is_not_fixed(spark):
    def page(i, inner, name="b"):
        head = f"<h2>Heading number {i} of many</h2>"
        claim = "<div class=claim><p>The same long claim stands on each of our pages, always.</p></div>"
        return f"<body><div class=a>{claim}<div class='{name}'>{head}{inner}</div></div></body>"

    inner = [f"<p>Sentence of page {i} about something of its own.</p>" for i in range(4)]
    inner[2] += "<ul><li>first point</li><li>second point</li></ul><blockquote>quoted once</blockquote>"
    rows = [(i, "https://one.example/p", page(i, inner[i])) for i in range(4)]
    # Numbers of posts in class names, short and long.
    rows += [(10 + i, "https://two.example/p", page(i, inner[i], f"post-{i}")) for i in range(4)]
    rows += [(20 + i, "https://three.example/p", page(i, inner[i], f"x{1000 + i}")) for i in range(4)]
    # Names that no rule knows: each slot of the body has one page.
    rows += [(30 + i, "https://four.example/p", page(i, inner[i], f"{'abcd'[i]}")) for i in range(4)]
    found = {r["page_id"]: r["text"] for r in H.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        expected = f"Heading number {i} of many\nSentence of page {i} about something of its own."
        if i == 2:
            expected += "\nfirst point\nsecond point\nquoted once"
        for first in (0, 10, 20, 30):
            assert found[first + i] == expected


def test_columns_of_a_grid_stay_apart():
    assert H._opened("div", " class='col-9'") != H._opened("div", " class='col-3'")
    assert H._opened("div", " class='post-9'") == H._opened("div", " class='post-123'")
