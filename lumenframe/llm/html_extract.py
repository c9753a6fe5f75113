"""Main text of web pages, with site templates found as element subtrees that recur on a host.

A page is read once into blocks: runs of text that no block element interrupts, each with the hashes of the elements
that hold it (tag, class and id names, and all text below). Spark counts on how many pages of a host each subtree
hash occurs; subtrees on many of them are template. Their hashes, as a mapped set in the shared folder, go back to the
pages, which are read once more; template subtrees go, with everything below. What is left of the main element,
without navigation, notices, forms, adverts and reader comments, is the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .shared import HashSet, hash_set, keep

MIN_PAGES = 5  # pages of a host that hold a subtree before it counts as template ...
MIN_SHARE = 0.2  # ... and their share of the host's pages,
MAIN_SHARE = 0.8  # for pages that mark their main element, in which only what nearly every page repeats is template
RAW = ("script", "style", "textarea", "title")  # no tags inside: text up to the closing tag, as browsers read them
EMBEDDED = {"noscript", "template", "iframe", "svg", "canvas", "object", "math"}  # dropped without ending a line
DROPPED = {*RAW, *EMBEDDED, "head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "input"}
BLOCKS = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *DROPPED} - {"input", "button", "select", *EMBEDDED}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = BLOCKS - {"html", "body", "head"}
#: Words of class, id and role names that mark what is not the article ...
MARKS = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|skip|skiplink|social|"
    r"sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search")
#: ... if all others say where or which it is; a layout modifier such as with-sidebar or search-results is no block.
BESIDE = set("""area articles bar blog block body bottom box button buttons col column container entry field footer form global
    group icons inner item items left links link list main media mobile nav page panel policy post posts primary reader
    right secondary section sign signup site slot story the thread top unit up user wrap wrapper article""".split())
TITLED = {"article", "blog", "entry", "page", "post", "story"}  # their headers hold the title
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, as in browsers."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(
        NO_DISPLAY.search(html.unescape(attributes.get("style", ""))))


@lru_cache(65_536)
def _marks_block(kind: str, name: str) -> bool:
    """Whether a whole class, id or role name denotes a block that is not the article."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w and not w.isdigit()]
    if words == ["search"]:
        return kind == "role"
    if "header" in words and not TITLED.isdisjoint(words):
        return False
    marks = [bool(MARKS.fullmatch(w)) for w in words]
    return any(marks) and all(m or w in BESIDE for m, w in zip(marks, words, strict=True))


class _Element:
    __slots__ = ("digest", "index", "name", "out", "parent")

    def __init__(self, name: str, names: str, out: bool, parent: int, index: int):
        self.name, self.out, self.parent, self.index = name, out, parent, index
        self.digest = xxhash.xxh64(f"<{name} {names}>")


def page_blocks(page: str) -> tuple[list[str], list[int], list[int], list[int], bool]:
    """Blocks of a page outside dropped elements, and its element subtrees.

    Returns the block texts, the element that holds each, for every element its parent (-1: none) and subtree hash,
    and whether the page marks its main element (article, else main); if so, only what lies in it counts.
    """
    elements: list[_Element] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    texts: list[str] = []
    holders: list[int] = []
    within: list[bool] = []
    piece: list[str] = []
    main = "article" if re.search(r"<article[\s>]", page, re.I) else "main" if re.search(
        r"<main[\s>]", page, re.I) else None
    depth_main = 0

    def flush() -> None:
        if stack and stack[-1].out:
            return
        text = SPACE.sub(" ", html.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            if stack:
                stack[-1].digest.update(text)
            texts.append(text)
            holders.append(stack[-1].index if stack else -1)
            within.append(not main or depth_main > 0)

    def close() -> None:
        nonlocal depth_main
        top = stack.pop()
        opened[top.name] -= 1
        depth_main -= top.name == main
        if stack:
            stack[-1].digest.update(top.digest.digest())

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        outside = not stack or not stack[-1].out
        end = found.start() if found else size
        if end > at and outside:
            piece.append(page[at:end])
        if not found:
            break
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                while stack[-1].name != name:
                    close()
                close()
            elif name == "br":
                piece.append(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name == "br":
            piece.append(" ")
            continue
        closed = found[3].endswith("/")
        if closed and name in ("svg", "math"):
            continue
        attributes = _attributes(found[3]) if found[3] else {}
        named = {kind: attributes[kind] for kind in ("class", "id", "role") if kind in attributes}
        names = " ".join(f"{kind}={value}" for kind, value in named.items())
        marked = bool(named) and name not in ("html", "body", "article", "main") and any(
            _marks_block(kind, part) for kind, value in named.items() for part in value.split())
        dropped = name != main and (name in DROPPED or marked or _hidden(attributes))
        if name not in BLOCKS and not dropped and not (stack and stack[-1].out):
            continue  # inline: its text belongs to the block around it
        if name in BLOCKS:
            flush()
        if name in CLOSES_P and opened["p"]:
            while stack[-1].name != "p":
                close()
            close()
        for peer, limits in (("li", ("ul", "ol", "menu")), ("dd", ("dl",)), ("dt", ("dl",)), ("td", ("tr", "table")),
                             ("th", ("tr", "table")), ("tr", ("table", "tbody", "thead"))):
            if opened[peer] and (name == peer or {name, peer} == {"dd", "dt"} or {name, peer} == {"td", "th"}):
                open_ = next((e for e in reversed(stack) if e.name == peer or e.name in limits), None)
                if open_ is not None and open_.name == peer:
                    while stack[-1] is not open_:
                        close()
                    close()
        if name in VOID or closed and name not in BLOCKS:
            continue
        parent = stack[-1] if stack else None
        out = dropped or bool(parent and parent.out and (name != main or any(opened[e] for e in EMBEDDED)))
        element = _Element(name, names, out, parent.index if parent else -1, len(elements))
        elements.append(element)
        stack.append(element)
        opened[name] += 1
        depth_main += name == main
    flush()
    while stack:
        close()
    blocks = [(t, h) for t, h, inside in zip(texts, holders, within, strict=True) if inside]
    return ([t for t, _ in blocks], [h for _, h in blocks], [e.parent for e in elements],
            [int.from_bytes(e.digest.digest(), "little", signed=True) for e in elements], bool(main))


def _subtree_names(hashes: list[int], host: str, main: bool) -> np.ndarray:
    """Subtree hashes told apart by site, that is by host and by whether its pages mark their main element."""
    site = xxhash.xxh64_intdigest(f"{host} {main}")
    return np.array([xxhash.xxh64_intdigest((h & _FULL).to_bytes(8, "little"), site) for h in hashes],
                    np.uint64).view(np.int64)


_FULL = (1 << 64) - 1


def _holding(holders: list[int], parents: list[int]) -> list[int]:
    """Elements that hold any block, directly or further in."""
    found: set[int] = set()
    for element in holders:
        while element >= 0 and element not in found:
            found.add(element)
            element = parents[element]
    return sorted(found)


def _inherited(flags: np.ndarray, parents: list[int]) -> list[bool]:
    """Whether an element or one that holds it is flagged; parents come before their children."""
    out: list[bool] = []
    for flag, parent in zip(flags.tolist(), parents, strict=True):
        out.append(flag or parent >= 0 and out[parent])
    return out


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its site, a digest of its text, and the subtrees that hold any of it."""
    for batch in batches:
        sites, contents, subtrees, mains = [], [], [], []
        for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
            texts, holders, parents, hashes, main = page_blocks(page or "")
            used = _holding(holders, parents)
            sites.append(_signed(xxhash.xxh64_intdigest(f"{host} {main}")))
            contents.append(_signed(xxhash.xxh64_intdigest("\n".join(texts))))
            subtrees.append(np.unique(_subtree_names([hashes[e] for e in used], host, main)))
            mains.append(main)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sites, pa.int64()), pa.array(mains, pa.bool_()), pa.array(contents, pa.int64()),
             pa.array(subtrees, pa.list_(pa.int64()))], ["site", "main", "content", "subtrees"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _text_rows(template: HashSet):
    """Text of each page without its site's template."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = template.reader()
        for batch in batches:
            out = []
            for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
                texts, holders, parents, hashes, main = page_blocks(page or "")
                left = texts
                if host and hashes:
                    gone = _inherited(template.contains(reader, _subtree_names(hashes, host, main)), parents)
                    left = [t for t, h in zip(texts, holders, strict=True) if h < 0 or not gone[h]]
                out.append("\n".join(left or texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])
    return run


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user and port; addresses without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def extract_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, main_share: float = MAIN_SHARE,
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page; empty where there is none.

    Blocks are joined by one line feed, white space inside a block becomes one space, character references are
    decoded. Subtrees on at least ``min_pages`` different pages of a host and ``min_share`` of them (``main_share``
    where pages mark their main element) are taken out; pages with equal text count as one. A page that would lose
    all its text keeps it, being a copy and not a template. Null and broken html give what can be read; repeated
    rows are pages of their own; pages without a host are never compared. Other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    seen = keep(named.where("host <> ''").select("html", "host").mapInArrow(
        _subtree_rows, "site long, main boolean, content long, subtrees array<bigint>"), "subtrees")
    counts = seen.select("site", "main", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy(
        "site", "main", "subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    sizes = seen.select("site", "content").distinct().groupBy("site").agg(F.count("*").alias("of"))
    share = F.when(F.col("main"), main_share).otherwise(min_share)
    template = counts.join(sizes, "site").where(F.col("pages") >= share * F.col("of"))
    texts = named.mapInArrow(_text_rows(hash_set(template, "subtree", "template")),
                             f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
