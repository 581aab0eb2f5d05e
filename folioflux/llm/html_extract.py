"""Main text of web pages through wrappers learned from the pages of a host.

A page's tokens become a tree of elements, named by tag, with ``class``, ``id`` and
``role``, and text slots. Its *shape* is a union-free regular expression over them:
neighbouring elements of one name fold into one repeated group whose content is aligned
in turn. The shapes of a host's pages are aligned one after the other, as token streams:
equal names match; what only one side has becomes an optional group; what one side
repeats becomes a repeated group; texts become slots. The result is the host's wrapper.

Each slot of the wrapper has statistics over all pages of the host: characters,
characters in links, and whether it is fixed: two different pages or more have it, and all
show the same text there. What a single page has is never taken for fixed. They choose
where the main text is: an ``article`` or ``main`` element if the wrapper has one, else
the innermost element that holds most of the text of slots that change from page to page.
Below it, slots in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are left out. A page is read through the slots so chosen; one on which they are
empty, though it has text, is read by the same rule applied to the page alone.

Shapes are few however many pages there are, as repeats are folded and texts left out:
different shapes of a host are aligned in ``SHARES`` groups first and their results after
that. Statistics are sums, built before the shuffle. A page meets only its host's one
choice in a join that can be split.

Defined cases: null and empty pages give an empty text; pages without a host, or with a
broken address, form a host of their own; rows with the same id are read one by one; an
empty table gives no row; other columns are ignored. Unclosed and stray tags are closed
as browsers do in the plain cases. Nothing is cut, however long.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import pick, shipped, slices, written

#: Groups in which a host's shapes are aligned first.
SHARES = 16
#: Part of the changing text that the chosen element must hold.
MOST = 0.75
#: Slots with a larger part of their characters in links are lists of links.
LINK_SHARE = 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

#: Digits of a class that count pages or posts; those of a grid (col-9) tell columns apart.
NUMBER = re.compile(
    r"[0-9]{3,}|(?:(?<=post-)|(?<=page-)|(?<=node-)|(?<=item-)|(?<=entry-)|(?<=article-)|(?<=id-))[0-9]+", re.I
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas noembed".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the other names ends.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: What a search for an open element of these kinds does not leave.
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
SCOPES |= {t: frozenset(["table"]) for t in ("td", "th", "tr")}
SCOPES |= {"option": frozenset(["select"]), "p": frozenset(["td", "th", "button", "table", "object"])}

ASIDE_TAGS = frozenset("nav aside footer form button select menu dialog fieldset label".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar "
    "tablist tooltip status".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner promo promotion promoted sponsor sponsored "
    "sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommend recommended recommendations comment comments commentlist reply replies respond disqus login search "
    "pagination pager pagenav widget toolbar skip copyright legal alert trending toc hidden offscreen "
    "paywall".split()
)
#: Those that an article may have for its headline.
HEADER_WORDS = frozenset("header masthead topbar".split())
#: A class that starts so speaks of something else on the page.
ABOUT_OTHERS = ("has-", "with-", "no-", "without-", "is-", "not-")
MAIN_TAGS, MAIN_ROLES = ("article", "main"), ("article", "main")

SLOT = "#"


@dataclass
class Element:
    """An element; ``parts`` holds elements and text, and line breaks as spaces."""

    tag: str
    name: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)


@lru_cache(maxsize=1 << 16)
def _opened(tag: str, rest: str) -> tuple[str, bool]:
    """An element's name and whether it is not shown."""
    found = {}
    for key, value in ATTRIBUTE.findall(rest):
        found.setdefault(key.lower(), value.strip("\"'"))
    classes = ".".join(sorted(NUMBER.sub("0", found.get("class", "")).split()))
    role, own = found.get("role", "").lower(), re.sub(r"[0-9]+", "0", found.get("id", ""))
    if "articlebody" in found.get("itemprop", "").lower():
        role = "article"
    style = found.get("style", "").replace(" ", "").lower()
    hidden = (
        "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )
    return f"{tag}|{classes}|{own}|{role}", hidden


def parse(page: str) -> Element:
    """The page as a tree. Raw elements (scripts, styles, …) are left out."""
    root = Element("html", "html|||")
    # Past the last ">" there is only text.
    stack, at, last = [root], 0, page.rfind(">") + 1
    while at < len(page):
        match = TOKEN.search(page, at, last)
        if match is None:
            stack[-1].parts.append(page[at:])
            break
        if match[0].startswith("<!--") and not match[0].endswith("-->"):
            stack[-1].parts.append(page[at : match.start()])
            break
        if match.start() > at:
            stack[-1].parts.append(page[at : match.start()])
        at = match.end()
        if match["tag"] is None:
            continue
        tag = match["tag"].lower()
        if match["close"]:
            _close(stack, tag)
        elif tag in RAW:
            end = None if match["rest"].endswith("/") and tag in ("svg", "math") else _raw_end(tag).search(page, at)
            at = end.end() if end else (at if match["rest"].endswith("/") else len(page))
        elif tag == "html":
            continue
        else:
            _end_implied(stack, tag)
            if tag in VOID:
                stack[-1].parts.append(Element(tag, f"{tag}|||") if tag == "hr" else " " if tag == "br" else "")
                continue
            element = Element(tag, *_opened(tag, match["rest"].rstrip("/")))
            stack[-1].parts.append(element)
            stack.append(element)
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def _close(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        # A stray end tag of a phrase does not close the block around it.
        if tag not in BLOCKS and stack[i].tag in BLOCKS:
            return


def _end_implied(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if tag in ENDED_BY.get(open_tag, ()):
            del stack[i:]
        elif open_tag in BLOCKS and open_tag not in ENDED_BY or open_tag in SCOPES.get(tag, ()):
            return


@dataclass
class Block:
    """A run of text between block borders: its place and its text.

    ``path`` names the elements around it, ``elements`` tells those of one name apart.
    """

    path: tuple[str, ...]
    elements: tuple[int, ...]
    text: str
    link_chars: int
    hidden: bool


def blocks_of(root: Element) -> list[Block]:
    """The page's blocks with text, in order. White space inside one is one space."""
    found: list[Block] = []
    run: list[str] = []
    links = [0]
    where: list[tuple[tuple[str, ...], tuple[int, ...], bool]] = []
    count = 0

    def flush() -> None:
        # References are decoded after joining, as a text may be cut within one.
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            path, elements, hidden = where[0]
            found.append(Block(path, elements, text, min(links[0], len(text)), hidden))
        run.clear()
        where.clear()
        links[0] = 0

    # An explicit stack, so that deep nesting is no trap.
    todo: list = [(root, (), (), False, False)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        node, path, elements, hidden, in_link = item
        if isinstance(node, str):
            if node and not node.isspace() and not where:
                where.append((path, elements, hidden))
            run.append(node)
            links[0] += len(node) if in_link else 0
            continue
        is_block = node.tag in BLOCKS
        if not is_block and is_aside(node.name):
            continue
        if is_block and node is not root:
            count += 1
            path, elements = path + (node.name,), elements + (count,)
        if is_block:
            flush()
            todo.append(None)
        for part in reversed(node.parts):
            todo.append((part, path, elements, hidden or node.hidden, in_link or node.tag == "a"))
    flush()
    return found


# Shapes and wrappers: [name, optional, repeated, parts]; a slot has the name "#".


def shape_of(blocks: list[Block]) -> list:
    """The union-free expression of a page: its block structure, repeats folded."""
    tree: list = ["html", 0, 0, []]
    stack, before = [tree], ()
    for block in blocks:
        depth, now = 0, block.elements
        while depth < min(len(now), len(before)) and now[depth] == before[depth]:
            depth += 1
        before = now
        del stack[depth + 1 :]
        for name in block.path[depth:]:
            node = [name, 0, 0, []]
            stack[-1][3].append(node)
            stack.append(node)
        stack[-1][3].append([SLOT, 0, 0, []])
    return _folded(tree)


def _folded(node: list) -> list:
    """Neighbours of one name become one repeated group."""
    parts: list = []
    for part in map(_folded, node[3]):
        if parts and parts[-1][0] == part[0]:
            parts[-1] = _aligned(parts[-1], part)
            parts[-1][2] = 1
        else:
            parts.append(part)
    return [node[0], node[1], node[2], _squares(parts)]


def _squares(parts: list) -> list:
    """A sequence that a part of it repeats as a whole is folded: a b a b -> (a b)+."""
    names = [p[0] for p in parts]
    for size in range(2, min(4, len(parts) // 2) + 1):
        at = 0
        while at + 2 * size <= len(parts):
            if names[at : at + size] == names[at + size : at + 2 * size]:
                for i in range(size):
                    merged = _aligned(parts[at + i], parts[at + size + i])
                    merged[2] = 1
                    parts[at + i] = merged
                del parts[at + size : at + 2 * size], names[at + size : at + 2 * size]
            else:
                at += 1
    return parts


def _aligned(a: list, b: list) -> list:
    """The least expression that covers both; a and b have the same name."""
    left, right = [p[0] for p in a[3]], [p[0] for p in b[3]]
    parts: list = []
    if left == right:
        parts = [_aligned(x, y) for x, y in zip(a[3], b[3])]
    else:
        for what, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if what == "equal":
                parts += [_aligned(x, y) for x, y in zip(a[3][i:j], b[3][k:m])]
            else:
                parts += [[p[0], 1, p[2], p[3]] for p in a[3][i:j] + b[3][k:m]]
        folded: list = []
        for part in parts:
            if folded and folded[-1][0] == part[0]:
                folded[-1] = _aligned(folded[-1], part)
                folded[-1][2] = 1
            else:
                folded.append(part)
        parts = folded
    return [a[0], a[1] | b[1], a[2] | b[2], parts]


def aligned(shapes: list[str]) -> str:
    """One expression for all of these, aligned one after the other."""
    wrapper = json.loads(shapes[0])
    for shape in shapes[1:]:
        wrapper = _aligned(wrapper, json.loads(shape))
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def written_out(wrapper: list) -> str:
    """The wrapper as a regular expression, for people."""
    name, optional, repeated, parts = wrapper
    text = "TEXT" if name == SLOT else f"<{name.rstrip('|')}>{''.join(map(written_out, parts))}"
    mark = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
    return f"({text}){mark}" if mark else text


def slots_of(wrapper: list) -> set[tuple[str, ...]]:
    """Paths of the wrapper's slots."""
    found, todo = set(), [(part, ()) for part in wrapper[3]]
    while todo:
        (name, _, _, parts), path = todo.pop()
        if name == SLOT:
            found.add(path)
        else:
            todo += [(part, path + (name,)) for part in parts]
    return found


@lru_cache(maxsize=1 << 16)
def is_aside(name: str) -> bool:
    tag, classes, own, role = (name.split("|") + ["", "", ""])[:4]
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        return True
    if tag in ("html", "body") or tag in MAIN_TAGS and not classes and not own:
        return False
    return not ASIDE_WORDS.isdisjoint(_words(classes, own))


def _words(classes: str, own: str) -> list[str]:
    """The words of an element's classes and id."""
    spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", classes.replace(".", " ") + " " + own).lower()
    names = [n for n in spaced.split() if not n.startswith(ABOUT_OTHERS)]
    return re.split(r"[^a-z0-9]+", " ".join(names))


@lru_cache(maxsize=1 << 16)
def is_header(name: str) -> bool:
    tag, classes, own, _ = (name.split("|") + ["", "", ""])[:4]
    return tag == "header" or tag not in ("html", "body") and not HEADER_WORDS.isdisjoint(_words(classes, own))


def is_main(name: str) -> bool:
    tag, _, _, role = (name.split("|") + ["", "", ""])[:4]
    return (tag in MAIN_TAGS or role in MAIN_ROLES) and not is_aside(name)


def left_out(path: tuple[str, ...]) -> bool:
    """Whether a place belongs to the page's apparatus.

    A page header is left out; the header inside an article carries its headline and stays.
    """
    inside = False
    for name in path:
        if is_aside(name) or is_header(name) and not inside:
            return True
        inside = inside or name.startswith("article|")
    return False


#: Characters, characters in links, whether the text changes from page to page or has one page only.
Stats = dict[tuple[str, ...], tuple[int, int, bool]]


def chosen(stats: Stats) -> set[tuple[str, ...]]:
    """The slots that hold the main text."""
    kept = {p: s for p, s in stats.items() if not left_out(p)}
    articles = {p: s for p, s in kept.items() if any(n.startswith("article|") and is_main(n) for n in p)}
    mains = articles or {p: s for p, s in kept.items() if any(map(is_main, p))}
    if mains:
        return set(mains)
    texts = {p: s for p, s in kept.items() if s[1] <= LINK_SHARE * s[0]}
    changing = {p: s for p, s in texts.items() if s[2]} or texts
    total, inner = sum(s[0] for s in changing.values()), ()
    while True:
        sums: dict[tuple[str, ...], int] = {}
        for path, s in changing.items():
            if path[: len(inner)] == inner and len(path) > len(inner):
                sums[path[: len(inner) + 1]] = sums.get(path[: len(inner) + 1], 0) + s[0]
        best = max(sums, key=lambda p: (sums[p], p), default=None)
        # A paragraph or a heading is no container of its own.
        if best is None or sums[best] < MOST * total or best[-1].split("|")[0] in ("p", "h1", "h2", "h3", "pre"):
            break
        inner = best
    return {p for p in changing if p[: len(inner)] == inner}


def stats_of(blocks: list[Block]) -> Stats:
    found: Stats = {}
    for block in blocks:
        chars, links, _ = found.get(block.path, (0, 0, True))
        found[block.path] = (chars + len(block.text), links + block.link_chars, True)
    return found


def text_of(blocks: list[Block], slots: set[tuple[str, ...]]) -> str:
    """The text of the blocks in these slots, joined by line ends."""
    shown = [b for b in blocks if not b.hidden]
    lines = [b.text for b in shown if b.path in slots]
    if not lines and shown:
        alone = chosen(stats_of(shown))
        lines = [b.text for b in shown if b.path in alone]
    return "\n".join(lines)


PATH_SPLIT = "\x1f"
PARSED = (
    "host string, shape string, slots array<struct<path: string, chars: long, links: long, least: long, most: long>>, "
    "page: long"
)
SLOTS_TYPE = pa.list_(
    pa.struct([(n, pa.string() if n == "path" else pa.int64()) for n in ("path", "chars", "links", "least", "most")])
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        shapes, slots, marks = [], [], []
        for page in batch["html"].to_pylist():
            marks.append(zlib.crc32(page.encode("utf-8", "surrogatepass")))
            blocks = [b for b in blocks_of(parse(page)) if not b.hidden]
            shapes.append(json.dumps(shape_of(blocks), ensure_ascii=False, separators=(",", ":")))
            found: dict[tuple[str, ...], list] = {}
            for b in blocks:
                slot = found.setdefault(b.path, [0, 0, 0])
                slot[0] += len(b.text)
                slot[1] += b.link_chars
                slot[2] = zlib.crc32(b.text.encode("utf-8", "surrogatepass"), slot[2])
            slots.append(
                [
                    {"path": PATH_SPLIT.join(p), "chars": c, "links": n, "least": h, "most": h}
                    for p, (c, n, h) in found.items()
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [batch["host"], pa.array(shapes, pa.string()), pa.array(slots, SLOTS_TYPE), pa.array(marks, pa.int64())],
            names=["host", "shape", "slots", "page"],
        )


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, host and html of every row."""
    rows = pick(pages, page_id="page_id", url="url", html="html")
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        host.alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def _merge_shapes(keys: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        merged = aligned(sorted(group["shape"]))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "shape": [merged]})

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), slots: array<struct<path, chars, links, changes>>."""
    shipped(pages.sparkSession)
    parsed = hosted(pages).select("host", "html").mapInArrow(_parsed, PARSED)
    different = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"))
    shared = different.select("host", "shape", F.pmod(F.xxhash64("shape"), F.lit(SHARES)).alias("share"))
    parts = shared.groupBy("host", "share").applyInPandas(
        _merge_shapes(["host", "share"]), "host string, share long, shape string"
    )
    merged = parts.select("host", "shape").groupBy("host").applyInPandas(
        _merge_shapes(["host"]), "host string, shape string"
    )
    sums = (
        parsed.select("host", "page", F.explode("slots").alias("slot"))
        .groupBy("host", "slot.path")
        .agg(
            F.sum("slot.chars").alias("chars"),
            F.sum("slot.links").alias("links"),
            ((F.min("slot.least") < F.max("slot.most")) | (F.min("page") == F.max("page"))).alias("changes"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("path", "chars", "links", "changes")).alias("slots"))
    )
    return merged.join(sums, "host", "left").select("host", F.col("shape").alias("wrapper"), "slots")


def _choose(wrapper: str, slots: list) -> str:
    """The chosen slots of a host as text."""
    known = slots_of(json.loads(wrapper))
    stats: Stats = {}
    for slot in slots if slots is not None else ():
        path = tuple(slot["path"].split(PATH_SPLIT)) if slot["path"] else ()
        if path in known:
            stats[path] = (slot["chars"], slot["links"], slot["changes"])
    return json.dumps(sorted(chosen(stats)), ensure_ascii=False)


def choices(found: DataFrame) -> DataFrame:
    """host and the slots of its main text."""

    def run(wrapper: pd.Series, slots: pd.Series) -> pd.Series:
        return pd.Series([_choose(w, s) for w, s in zip(wrapper, slots)])

    choose = F.pandas_udf(run, "string")
    return found.select("host", choose("wrapper", "slots").alias("chosen"))


@lru_cache(maxsize=4096)
def _slots(text: str | None) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(path) for path in json.loads(text or "[]"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        texts = [
            text_of(blocks_of(parse(page)), _slots(slots))
            for page, slots in zip(batch["html"].to_pylist(), batch["chosen"].to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = hosted(pages)
    # Written, so that both sides of the join come from a shuffle of their own and a host
    # with very many pages can be split.
    joined = rows.join(written(choices(wrappers(pages)), "html-choices"), "host", "left")
    return joined.select("page_id", F.col("url").cast("string").alias("url"), "html", "chosen").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
