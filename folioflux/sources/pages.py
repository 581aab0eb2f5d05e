"""Catalogue web pages to rows: tiles, product details, library details and result cards.

Python only walks the markup and emits the elements a rule names. What the fields
mean (prices, identifiers, first-wins, structure errors) is decided by DataFrame
expressions afterwards.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue


@dataclass(frozen=True)
class Rule:
    """An element to emit: by tag, class and attribute; a container opens a scope."""

    field: str
    tag: str | None = None
    cls: str | None = None
    attr: str | None = None
    value: str | None = None
    container: bool = False

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        if self.cls and not set(self.cls.split()) <= set(attrs.get("class", "").split()):
            return False
        if self.attr and self.attr not in attrs:
            return False
        return self.value is None or self.value in attrs.get(self.attr, "")


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}

_ATTRS = r'((?:[\t\n\r\f ]+[a-zA-Z][a-zA-Z0-9_:-]*="[^"<>&]*")*)'
#: Markup that means the same to every reader: quoted values, no references, no oddities.
_PLAIN = re.compile(
    rf"<(script|style){_ATTRS}>(?:(?!</|<!--).)*</(?:script|style)>"
    rf"|<([a-zA-Z][a-zA-Z0-9]*){_ATTRS}>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<&]+)",
    re.DOTALL,
)
_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9_:-]*)="([^"]*)"')
#: Elements whose content is no markup to some reader.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class _Walker(HTMLParser):
    def __init__(self, rules: Sequence[Rule], fitting: dict | None = None):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.seen = sorted({r.attr for r in rules if r.attr and r.value is not None})
        self.there = sorted({r.attr for r in rules if r.attr and r.value is None})
        #: Rules by what they look at, shared by the pages of a task.
        self.fitting = {} if fitting is None else fitting
        self.start()

    def start(self) -> None:
        self.open: list[tuple[str, list[tuple], bool]] = []
        self.rows: list[tuple] = []
        self.text: list[str] = []
        self.scopes: list[int] = []
        self.count = 0
        self.muted = 0

    def read(self, html: str) -> None:
        """Walk a whole page: plain markup directly, any other by the parser."""
        self.start()
        if not self._plain(html):
            self.start()
            self.reset()
            self.feed(html)
            self.close()

    def _plain(self, html: str) -> bool:
        at = 0
        for token in _PLAIN.finditer(html):
            if token.start() != at:
                return False
            at = token.end()
            raw, of_raw, tag, of_tag, end, data = token.groups()
            if data is not None:
                self.handle_data(data)
            elif end is not None:
                self.handle_endtag(end.lower())
            elif tag is not None:
                tag = tag.lower()
                if tag in _RAW:
                    return False
                self.handle_starttag(tag, _ATTR.findall(of_tag) if of_tag else ())
            else:
                if not token.group().endswith(f"</{raw}>"):
                    return False
                self.handle_starttag(raw, _ATTR.findall(of_raw))
                self.handle_endtag(raw)
        return at == len(html)

    def _hits(self, tag: str, named: dict[str, str]) -> tuple[list[str], bool]:
        key = (tag, named.get("class"), *[named.get(a) for a in self.seen], *[a in named for a in self.there])
        found = self.fitting.get(key)
        if found is None:
            hits = [r for r in self.rules if r.fits(tag, named)]
            found = [r.field for r in hits], any(r.container for r in hits) and tag not in VOID
            if len(self.fitting) >= 1 << 12:
                self.fitting.clear()
            self.fitting[key] = found
        return found

    def handle_starttag(self, tag, attrs):
        named = {k.lower(): v or "" for k, v in attrs}
        self.count += 1
        fields, opens = self._hits(tag, named)
        if opens:
            self.scopes.append(self.count)
        scope = self.scopes[-1] if self.scopes else 0
        rows = [(scope, field, self.count, named, []) for field in fields]
        self.rows.extend(rows)
        if tag not in VOID:
            self.muted += tag in ("script", "style")
            self.open.append((tag, rows, opens))

    def handle_endtag(self, tag):
        # An end tag closes everything inside it; one without a start is ignored.
        if not any(name == tag for name, _, _ in reversed(self.open)):
            return
        while self.open:
            name, _, opens = self.open.pop()
            self.muted -= name in ("script", "style")
            if opens:
                self.scopes.pop()
            if name == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.muted:
            self.text.append(text)
            for _, rows, _ in self.open:
                for row in rows:
                    row[4].append(text)


ELEMENT = "struct<scope: int, field: string, pos: int, attrs: map<string,string>, text: string>"
_ELEMENT = pa.struct(
    [("scope", pa.int32()), ("field", pa.string()), ("pos", pa.int32()),
     ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
)


def _column(rows: list[list[tuple]]) -> pa.Array:
    """The elements of each page as an array of lists."""
    flat = [r for page in rows for r in page]
    ends = [0, *itertools.accumulate(map(len, rows))]
    named = [r[3] for r in flat]
    attrs = pa.MapArray.from_arrays(
        pa.array([0, *itertools.accumulate(map(len, named))], pa.int32()),
        pa.array([k for n in named for k in n], pa.string()),
        pa.array([v for n in named for v in n.values()], pa.string()),
    )
    columns = [
        pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.string()),
        pa.array([r[2] for r in flat], pa.int32()), attrs, pa.array([" ".join(r[4]) for r in flat], pa.string()),
    ]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_ELEMENT)))


#: Pages that are held as Python objects at once.
_AT_ONCE = 256


def walked(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id") -> DataFrame:
    """``(key, whole, found)``: the text of each page, and its elements that a rule names, in order.

    One row a page, so what a page says is worked out without a shuffle.
    """
    wanted = list(rules)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker(wanted)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                rows, texts = [], []
                for html in part["html"].to_pylist():
                    walker.read(html or "")
                    rows.append(walker.rows)
                    texts.append(" ".join(walker.text))
                yield pa.RecordBatch.from_arrays(
                    [part[key], pa.array(texts, pa.string()), _column(rows)], names=[key, "whole", "found"]
                )

    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col("html").cast("string").alias("html")).mapInArrow(
        walk, f"{key} {key_type}, whole string, found array<{ELEMENT}>"
    )


def elements(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id") -> DataFrame:
    """One row per element a rule names, plus one ``page`` row with the page's text."""
    page = F.struct(
        F.lit(0).alias("scope"), F.lit("page").alias("field"), F.lit(0).alias("pos"),
        F.create_map().cast("map<string,string>").alias("attrs"), F.col("whole").alias("text"),
    )
    return walked(pages, rules, key).select(key, F.inline(F.concat("found", F.array(page))))


def _first(of: Column, field: str) -> Column:
    """The first element of a field among some."""
    return F.try_element_at(F.filter(of, lambda x: x["field"] == field), F.lit(1))


def _text(of: Column, field: str) -> Column:
    return catalogue.empty_to_null(_first(of, field)["text"])


def _attr(of: Column, field: str, name: str) -> Column:
    return catalogue.empty_to_null(F.trim(F.try_element_at(_first(of, field)["attrs"], F.lit(name))))


def _number(of: Column, field: str) -> Column:
    return F.regexp_extract(_first(of, field)["text"], "[0-9]+", 0).try_cast("int")


def _count(of: Column, field: str) -> Column:
    return F.size(F.filter(of, lambda x: x["field"] == field))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is worked out once a row: a generator is not merged into what is made from it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _scoped(found: DataFrame) -> DataFrame:
    """``scopes``: the elements of each container of a page, with its number."""
    numbers = F.array_distinct(F.transform(F.filter("found", lambda x: x["scope"] > 0), lambda x: x["scope"]))
    of = F.transform(
        numbers,
        lambda n: F.struct(n.alias("scope"), F.filter("found", lambda x: x["scope"] == n).alias("of")),
    )
    return _once(found, "scopes", of)


# ---------------------------------------------------------------- fixed values
# Marks of the shop's and the library's pages.
LISTING = [
    Rule("tile", cls="product--box", attr="data-ordernumber", container=True),
    Rule("title", tag="a", cls="product--title"),
    Rule("subtitle", cls="product--subtitle"),
    Rule("author", tag="a", cls="product--author"),
    Rule("price", cls="price--default"),
    Rule("note", attr="data-note-article"),
    Rule("badge", cls="product--badge"),
    Rule("description", cls="product--description"),
    Rule("image", tag="img"),
    Rule("listing", cls="listing"),
]
NOTHING_FOUND = "keine Artikel gefunden"
AUTHOR_PREFIX = "von "
PRODUCT = [
    Rule("scope", cls="product--details"),
    Rule("title", cls="product--title"),
    Rule("price", tag="meta", attr="itemprop", value="price"),
    Rule("order", tag="input", attr="name", value="sAdd"),
    Rule("author", tag="a", attr="href", value="saltFieldLimitation=author"),
    Rule("canonical", tag="link", attr="rel", value="canonical"),
    Rule("description", attr="itemprop", value="description"),
    Rule("full", cls="description--full"),
    Rule("preview", cls="description--preview"),
]
LIBRARY = [
    Rule("copies", cls="exemplar-count"),
    Rule("available", cls="availability-count"),
    Rule("reservations", cls="reservation-count"),
    Rule("title", attr="test-id", value="cardTitle"),
    Rule("row", tag="p", cls="horizontalDescription"),
    Rule("star", cls="ic_star"),
    Rule("filled", cls="ic_star active"),
    Rule("votes", tag="dt", cls="user-vote"),
    Rule("abstract", tag="dt", cls="abstract"),
    Rule("dd", tag="dd"),
]
CARDS = [
    Rule("card", attr="test-id", value="mediaCard", container=True),
    Rule("title", attr="test-id", value="cardTitle"),
    Rule("subtitle", attr="test-id", value="cardSubTitle"),
    Rule("author", attr="test-id", value="cardAuthor"),
    Rule("link", tag="a", attr="test-id", value="mediaInfoLink"),
    Rule("medium", tag="svg", attr="test-id", value="ic_"),
    Rule("abstract", attr="test-id", value="cardAbstract"),
]
HITS, NO_HITS, EXPIRED = "Titeltreffer", "keine Titeltreffer", "Ihre Sitzung ist abgelaufen"
LABEL_FROM, LABEL_AUTHOR = "Voraussichtlich verfügbar ab:", "Autor*in:"
LABEL_SERIES, LABEL_ISBN = "Reihe:", "ISBN:"
# ------------------------------------------------------------------------------


def listing_tiles(
    pages: DataFrame, rules: Sequence[Rule] = LISTING, base: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tiles of listing pages, once per order number, and pages with a broken structure.

    A page with a broken tile is an error and yields none of its tiles. Relative links
    are joined with the base address, if there is one.
    """
    def tile(s: Column) -> Column:
        of = s["of"]
        url = catalogue.canonical_url(_attr(of, "title", "href"), base)
        return F.struct(
            s["scope"].alias("scope"),
            _attr(of, "tile", "data-ordernumber").alias("order_number"),
            F.coalesce(_attr(of, "title", "title"), _text(of, "title")).alias("title"),
            _text(of, "subtitle").alias("subtitle"),
            _text(of, "author").alias("_author"),
            catalogue.parse_price(_text(of, "price")).alias("price_cents"),
            url.alias("url"),
            _attr(of, "note", "data-note-article").alias("_note"),
            _text(of, "description").alias("blurb"),
            F.coalesce(_attr(of, "image", "data-srcset"), _attr(of, "image", "srcset"), _attr(of, "image", "src"))
            .alias("_image"),
            F.array_sort(
                F.array_distinct(F.transform(F.filter(of, lambda x: x["field"] == "badge"), lambda x: x["text"]))
            ).alias("badges"),
        )

    def typed(t: Column) -> Column:
        number = F.regexp_extract(t["url"], r"/(\d+)/[^/]*$", 1)
        image = F.split(F.trim(F.get(F.split(t["_image"], ","), F.lit(0))), " ")[0]
        kept = ["scope", "order_number", "title", "subtitle", "price_cents", "url", "blurb", "badges"]
        return F.struct(
            *[t[n].alias(n) for n in kept],
            catalogue.empty_to_null(F.regexp_replace(t["_author"], f"^{AUTHOR_PREFIX}", "")).alias("author"),
            F.coalesce(t["_note"], catalogue.empty_to_null(number)).alias("product_id"),
            catalogue.isbn_of_order_number(t["order_number"]).alias("isbn"),
            F.when(image.startswith("http"), image).alias("cover_url"),
        )

    def broken(t: Column) -> Column:
        return t["title"].isNull() | t["url"].isNull() | t["product_id"].isNull()

    read = _once(_scoped(walked(pages, rules)), "_read", F.transform("scopes", tile))
    tiles = _once(read, "tiles", F.transform("_read", typed))

    # A page has few tiles: the first one of each order number.
    numbers = F.transform("tiles", lambda t: F.coalesce(t["order_number"], F.lit("")))
    first = F.filter(
        "tiles",
        lambda t, i: F.array_position(numbers, F.coalesce(t["order_number"], F.lit(""))) == i + 1,
    )
    names = ["scope", "title", "subtitle", "price_cents", "url", "blurb", "badges", "author", "product_id", "isbn", "cover_url"]
    good = tiles.filter(~F.exists("tiles", broken)).select("page_id", F.inline(first)).select(
        "page_id", "order_number", *names
    )
    none = F.when(
        (_count(F.col("found"), "tile") == 0) & ~F.col("whole").contains(NOTHING_FOUND),
        F.array(F.lit("no tiles and no empty answer")),
    ).otherwise(F.array().cast("array<string>"))
    bad = F.transform(F.filter("tiles", broken), lambda t: F.lit("tile without title, link or id"))
    return good, tiles.select("page_id", F.explode(F.concat(none, bad)).alias("error"))


def page_counts(pages: DataFrame) -> DataFrame:
    """Number of pages a listing announces."""
    first = _first(F.col("found"), "listing")["attrs"]
    return walked(pages, [r for r in LISTING if r.field == "listing"]).select(
        "page_id", F.try_element_at(first, F.lit("data-pages")).try_cast("int").alias("total_pages")
    )


def product_details(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price, identifiers and full description of product pages; pages without a price."""
    of = F.col("found")
    price = _attr(of, "price", "content").try_cast("double") * 100
    found = walked(pages, PRODUCT).select(
        "page_id",
        (_count(of, "scope") > 0).alias("_scope"),
        _text(of, "title").alias("title"),
        catalogue.isbn_of_order_number(_attr(of, "order", "value")).alias("isbn"),
        _text(of, "author").alias("author"),
        catalogue.canonical_url(_attr(of, "canonical", "href")).alias("url"),
        catalogue.without_teaser(
            F.coalesce(_text(of, "full"), _text(of, "preview"), _text(of, "description"))
        ).alias("blurb"),
        F.bround(price, 0).cast("int").alias("price_cents"),
    )
    good = F.col("_scope") & F.col("price_cents").isNotNull()
    return (
        found.filter(good).drop("_scope"),
        found.filter(~good).select("page_id", F.lit("no readable price").alias("error")),
    )


def library_details(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies, reservations, labelled values, stars and abstract of library pages."""
    of = F.col("found")

    def labelled(label: str) -> Column:
        mine = F.filter(of, lambda x: (x["field"] == "row") & x["text"].startswith(label))
        value = F.trim(F.substr(F.try_element_at(mine, F.lit(1))["text"], F.lit(len(label) + 1)))
        return catalogue.empty_to_null(F.trim(F.regexp_replace(value, r";+$", "")))

    def after(field: str) -> Column:
        """Text of the first ``dd`` behind the first element of the field."""
        # The elements are in the order of the page.
        later = F.filter(of, lambda d: (d["field"] == "dd") & (d["pos"] > _first(of, field)["pos"]))
        return F.try_element_at(later, F.lit(1))["text"]

    stars = _count(of, "star")
    rows = walked(pages, LIBRARY).select(
        "page_id",
        _number(of, "copies").alias("copies"),
        _number(of, "available").alias("available_copies"),
        F.coalesce(_number(of, "reservations"), F.lit(0)).alias("reservations"),
        _text(of, "title").alias("title"),
        labelled(LABEL_AUTHOR).alias("author"),
        labelled(LABEL_SERIES).alias("series"),
        catalogue.isbn_in_text(labelled(LABEL_ISBN)).alias("isbn"),
        catalogue.empty_to_null(
            F.regexp_extract(labelled(LABEL_FROM), r"\b(\d{2}\.\d{2}\.\d{4})\b", 1)
        ).alias("available_from"),
        F.when(stars > 0, _count(of, "filled")).alias("rating"),
        catalogue.empty_to_null(after("abstract")).alias("blurb"),
        F.regexp_replace(after("votes"), "[^0-9]", "").try_cast("int").alias("votes"),
    )
    good = F.col("copies").isNotNull() & F.col("available_copies").isNotNull()
    typed = rows.withColumn(
        "availability", catalogue.library_availability(F.col("available_copies"))
    )
    return typed.filter(good), rows.filter(~good).select(
        "page_id", F.lit("no copies or availability").alias("error")
    )


def _result_pages(pages: DataFrame) -> DataFrame:
    """(page_id, total_hits, cards, errors) of result pages, each read once."""
    def card(s: Column) -> Column:
        of = s["of"]
        return F.struct(
            s["scope"].alias("scope"),
            _text(of, "title").alias("title"), _text(of, "subtitle").alias("subtitle"),
            _text(of, "author").alias("author"), _text(of, "abstract").alias("blurb"),
            _attr(of, "medium", "test-id").alias("medium"), _attr(of, "link", "href").alias("url"),
        )

    def complete(x: Column) -> Column:
        return x["title"].isNotNull() & x["url"].isNotNull()

    whole = F.col("whole")
    none, expired = whole.contains(NO_HITS), whole.contains(EXPIRED)
    read = _once(_scoped(walked(pages, CARDS)), "_read", F.transform("scopes", card))
    # A page of an expired session yields no candidates, whatever it shows.
    cards = F.when(expired, F.slice("_read", 1, 0)).otherwise(F.col("_read"))
    trouble = F.when(expired, "session expired").when(
        (_count(F.col("found"), "card") == 0) & ~none, "no cards and no empty answer"
    )
    bad = F.transform(F.filter(cards, lambda x: ~complete(x)), lambda x: F.lit("card without title or link"))
    return read.select(
        "page_id",
        F.when(none, 0).otherwise(F.regexp_extract(whole, rf"([0-9]+)\s+{HITS}", 1).try_cast("int")).alias("total_hits"),
        F.filter(cards, complete).alias("cards"),
        F.concat(F.array_compact(F.array(trouble)), bad).alias("errors"),
    )


def result_cards(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, announced hits per page, and pages that are no answer.

    A page of an expired session yields no candidates, whatever it shows.
    """
    read = _result_pages(pages)
    return (
        read.select("page_id", F.inline("cards")),
        read.select("page_id", "total_hits"),
        read.select("page_id", F.explode("errors").alias("error")),
    )


def hits_and_errors(pages: DataFrame) -> DataFrame:
    """Announced hits of each result page beside what is wrong with it, in one reading."""
    return _result_pages(pages).select("page_id", "total_hits", F.explode_outer("errors").alias("error"))


#: Links of any page, as tiles of its navigation.
LINKS = [Rule("tile", tag="li", container=True), Rule("title", tag="a", attr="href")]


def page_links(pages: DataFrame) -> DataFrame:
    """Links inside list items of a page, the first of each address."""
    found = elements(pages, LINKS).filter("field = 'title' and scope > 0")
    return found.groupBy("page_id", F.col("attrs")["href"].alias("href")).agg(
        F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos")
    )
