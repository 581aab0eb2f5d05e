"""Pages are walked once, one row a page, and alike by both readers."""

import random

import pytest

from folioflux.sources import pages

PIECES = [
    "<div>", "</div>", '<div class="product--box" data-ordernumber="SW1">', '<a class="product--title" href="/x/7/t" title="T">',
    "</a>", "text", " ", "<br>", "<br/>", '<p CLASS="listing" data-pages="3">', "</p>", "</P>", '<script>var x = "<p>";</script>',
    "<script>", "</script>", "&amp;", "&uuml", "<", ">", "a < b", "<!-- c -->", "<!doctype html>", "<style>p > a</style>",
    "<title>x<b></title>", "<textarea><p>", "<A HREF='y'>", '<a href="x>y">', '<img src="u"><img data-srcset="v, w">', "\n", '<p a="1"b="2">',
    '<span class="price--default">1,20 €</span>', "<x-y>", "</x-y>", "<span", "<script>a<!-- </script>", "<style>a</script>b</style>",
]


def by_parser(html):
    walker = pages._Walker(pages.LISTING)
    walker.feed(html)
    walker.close()
    return walker


def test_plain_markup_is_read_as_by_the_parser():
    draw, walker, plain = random.Random(3), pages._Walker(pages.LISTING), 0
    for _ in range(6000):
        html = "".join(draw.choices(PIECES, k=draw.randint(0, 9)))
        walker.read(html)
        other = by_parser(html)
        assert (walker.rows, walker.text) == (other.rows, other.text), html
        plain += walker._plain(html) if html else 0
        walker.start()
    assert plain > 500


TILE = '<div class="product--box" data-ordernumber="{}"><a class="product--title" href="/x/{}/t">{}</a></div>'
FRAME = [
    (1, TILE.format("A", 1, "eins") + TILE.format("A", 2, "zwei") + TILE.format("B", 3, "drei")),
    (2, TILE.format("A", 1, "eins") + TILE.format("C", "y", "ohne Nummer") + TILE.format("D", "z", "auch")),
    (3, None),
]


@pytest.mark.parametrize("part", [0, 1])
def test_listing_is_read_once_and_without_a_shuffle(spark, part):
    frame = spark.createDataFrame(FRAME, "page_id int, html string")
    plan = pages.listing_tiles(frame)[part]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Exchange" not in plan


def test_tiles_and_errors_of_a_page(spark):
    tiles, errors = pages.listing_tiles(spark.createDataFrame(FRAME, "page_id int, html string"))
    assert sorted((r.page_id, r.order_number, r.title) for r in tiles.collect()) == [(1, "A", "eins"), (1, "B", "drei")]
    assert sorted((r.page_id, r.error) for r in errors.collect()) == [
        (2, "tile without title, link or id"), (2, "tile without title, link or id"), (3, "no tiles and no empty answer"),
    ]


def test_hits_and_errors_are_those_of_the_cards(spark):
    card = '<div test-id="mediaCard"><h3 test-id="cardTitle">{}</h3><a test-id="mediaInfoLink" href="{}">m</a></div>'
    frame = spark.createDataFrame(
        [(1, "<p>12 Titeltreffer</p>" + card.format("a", "u") + card.format("", "v")), (2, "keine Titeltreffer"),
         (3, "Ihre Sitzung ist abgelaufen" + card.format("a", "u")), (4, "umgebaut"), (5, None)],
        "page_id int, html string",
    )
    cards, hits, errors = pages.result_cards(frame)
    assert [(r.page_id, r.title) for r in cards.collect()] == [(1, "a")]
    joined = hits.join(errors, "page_id", "left").collect()
    read = pages.hits_and_errors(frame)
    assert sorted(map(str, read.collect())) == sorted(map(str, joined)) and len(joined) == 5
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and "Exchange" not in plan
