"""Bibliographic records in MARC-21 XML: one row per answer, and contained volumes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from xml.etree.ElementTree import Element, ParseError, TreeBuilder, XMLParser
from xml.parsers.expat import errors

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue
from folioflux.session import ship_package

# ---------------------------------------------------------------- fixed values
#: Sort marks around articles.
SORT_MARKS = "&#15[26];|[\u0098\u009c]"
#: Where an answer holds its fields, below its root.
PLACE = ["records", "record", "recordData", "record", "datafield"]
PARSED = (
    "title string, subtitle string, author string, series string, series_index string, language string, "
    "volumes array<string>"
)
# ------------------------------------------------------------------------------

NAMES = ["title", "subtitle", "author", "series", "series_index", "language", "volumes"]
_MARKS, _VOLUME = re.compile(SORT_MARKS), re.compile(catalogue.ISBN13, re.ASCII)
_BLANK = "".join(map(chr, range(33)))


@lru_cache(1024)
def _name(tag: str) -> str:
    """An element's name without its name space, which answers declare in many ways."""
    return tag.rpartition("}")[2]


def _clean(value: str) -> str:
    if value.isascii() and "&" not in value:
        return value.strip(_BLANK)
    return _MARKS.sub("", _MARKS.sub("", value).strip(_BLANK)).strip(" ")


def _root(xml: str | None) -> Element | None:
    """The answer as a tree, whatever follows its end; none if it is no XML."""
    builder = TreeBuilder()
    parser = XMLParser(target=builder)
    try:
        parser.feed(xml or "")
        return parser.close()
    except ParseError as error:
        return builder.close() if error.code == errors.codes[errors.XML_ERROR_JUNK_AFTER_DOC_ELEMENT] else None


def fields_of(xml: str | None) -> dict[str, list[Element]]:
    """The fields of all records of an answer by tag, in order; none if it counts no record."""
    root = _root(xml)
    if root is None:
        return {}
    counts = [_clean("".join(x.itertext())) for x in root if _name(x.tag) == "numberOfRecords"]
    if not counts or counts[-1] == "0":
        return {}
    level = [root]
    for name in PLACE:
        level = [x for above in level for x in above if _name(x.tag) == name]
    by_tag: dict[str, list[Element]] = {}
    for x in level:
        by_tag.setdefault(x.get("tag", "").strip(_BLANK), []).append(x)
    return by_tag


def _values(field: Element, code: str) -> Iterator[str]:
    """The subfields of a code."""
    for x in field:
        if x.get("code", "").strip(_BLANK) == code and _name(x.tag) == "subfield":
            yield _clean("".join(x.itertext()) if len(x) else x.text or "")


def record_of(xml: str | None) -> tuple:
    """The columns of ``PARSED`` of one answer."""
    by_tag = fields_of(xml)

    def every(tag: str, code: str) -> list[str]:
        return [value for value in (next(_values(x, code), None) for x in by_tag.get(tag, ())) if value]

    def first(tag: str, code: str) -> str | None:
        return next(iter(every(tag, code)), None)

    volumes = dict.fromkeys(
        value
        for x in by_tag.get("770", ())
        if next(_values(x, "i"), "").lower().startswith("enth")
        for value in _values(x, "z")
        if _VOLUME.fullmatch(value)
    )
    persons = every("100", "a")
    return (
        first("245", "a"), first("245", "b"),
        # The person of field 100 is the author; the credit of 245 stands in.
        persons[-1] if persons else first("245", "c"),
        first("490", "a"), first("245", "n") or first("490", "v"), first("041", "a"), list(volumes),
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.string()] * 6, pa.list_(pa.string())]
    for batch in batches:
        found = list(zip(*map(record_of, batch["_xml"].to_pylist()))) or [()] * len(kinds)
        columns = [pa.array(values, kind) for values, kind in zip(found, kinds)]
        yield pa.RecordBatch.from_arrays([batch["isbn"], *columns], names=["isbn", *NAMES])


def records(answers: DataFrame, column: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Records ``(isbn, found, …)`` and edges ``(isbn, contained)`` of answers ``(isbn, xml)``.

    An answer is read once, in the workers: a parser a row costs more than the row.
    """
    ship_package(answers.sparkSession)
    isbn = answers.schema["isbn"].dataType.simpleString()
    rows = answers.select("isbn", F.col(column).alias("_xml")).mapInArrow(_read, f"isbn {isbn}, {PARSED}")
    known = F.coalesce("title", "subtitle", "author", "series", "language").isNotNull() | (F.size("volumes") > 0)
    return (
        rows.withColumn("found", known).drop("volumes"),
        rows.select("isbn", F.explode("volumes").alias("contained")),
    )
