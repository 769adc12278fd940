"""Main text of web pages: site templates are found by counting element subtrees per host, and deleted.

Each page is read as a tree. Elements whose tag, role or class says that they are no article (menus, forms, adverts ...) go
first, whatever their text. Every other element with text is hashed with all that is in it, and Spark counts on how many
different pages of its host each subtree stands: those on half of them or more, and on five at least, are the site's
template and are deleted wherever they stand on that host. Pages with the same longest block are one page for these
counts, so that copies of an article make no template of it. What is inside the <article>, else <main>, is then the text,
and all that is left where a page has neither.

A host's template subtrees stand on half of its pages each, so there are at most twice as many as a page has elements: the
table that is joined back is bounded per host by the size of pages, not by their number. Subtree hashes are the keys of
the counts, so that a host with a third of all pages is counted in many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.html import BLOCK, Element, parse
from tessella.llm.shared import drop_stored, stored
from tessella.llm.url_filters import host_of

SHARE, PAGES, MOST = 0.5, 5, 0.5
# What is never article text, by tag, role and words of class or id.
TAGS = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map form button select input textarea datalist "
    "nav footer aside menu dialog search".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
COMMENTS = frozenset("comment comments commentlist commentform disqus respond replies discussion".split())
CHROME = frozenset(
    "ad ads adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion promoted related "
    "recommended recommendations search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT_ITSELF = frozenset("has with no without hide show is".split())
_HINT = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)


@dataclass
class Page:
    """A page without what is no article by its marks. lengths, hashes: of the text in each element, by its id()."""

    root: Element
    lengths: dict[int, int] = field(default_factory=dict)
    hashes: dict[int, int] = field(default_factory=dict)
    longest: int = 0


def _names(value: str) -> set[str]:
    """Words of a class or id, but for those that say what something else is or has (has-sidebar)."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _NAMES.findall(name)]
        if not _NOT_ITSELF & set(words):
            out.update(words)
    return out


def marks(e: Element) -> str:
    """'gone' for what is no article by tag, role or visibility, 'comment' and 'chrome' by words of class or id, else ''."""
    if e.tag in TAGS:
        return "gone"
    if not _HINT.search(e.written):
        return ""
    a = e.attributes
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) or ROLES & set(a.get("role", "").lower().split()):
        return "gone"
    words = _names(a.get("class", "")) | _names(a.get("id", ""))
    return "comment" if words & COMMENTS else "chrome" if words & CHROME else ""


def _size(e: Element) -> int:
    return len("".join(e.text().split()))


def _holds_article(e: Element) -> bool:
    return any(x.tag in ("article", "main") and not marks(x) for x in e.walk())


def clear(root: Element) -> Element:
    """The page without marked elements.

    The word of a class or id does not count on html, body and main, nor around an article; those of CHROME do not where a
    page without an article has more than half of its text in the element. A header inside an article keeps its headings.
    """
    left, doubtful = [(root, False)], []
    while left:
        here, inside = left.pop()
        kept = []
        for c in here.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            says = marks(c)
            if says and says != "gone" and (c.tag in ("html", "body", "main") or _holds_article(c)):
                says = ""
            if c.tag == "header" and not says:
                if not inside:
                    says = "gone"
                else:
                    c.children = [x for x in c.walk() if x.tag in HEADINGS and not marks(x)]
            if says in ("gone", "comment"):
                kept.append(Element("hr", parent=here) if c.tag in BLOCK else "")
                continue
            if says == "chrome":
                doubtful.append((here, c))
            kept.append(c)
            left.append((c, inside or c.tag in ("article", "main")))
        here.children = kept
    if doubtful:
        all_ = None if _holds_article(root) else _size(root)
        for parent, c in doubtful:
            if all_ is None or _size(c) <= MOST * all_:
                parent.children = [Element("hr", parent=parent) if x is c and c.tag in BLOCK else "" if x is c else x for x in parent.children]
    return root


def _order(root: Element) -> list[Element]:
    """Elements so that children come before their parents."""
    out, left = [], [root]
    while left:
        here = left.pop()
        out.append(here)
        left.extend(c for c in here.children if not isinstance(c, str))
    return out[::-1]


def read(page: str | None, hashed: bool = True) -> Page:
    """A cleared page with the hash of every element that has text, of tags and of words; the longest block's hash."""
    out = Page(clear(parse(page)))
    if not hashed:
        return out
    most = 0
    for e in _order(out.root):
        parts, own, length = [e.tag], [], 0
        for c in e.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                length += len(text)
                parts.append(text)
                own.append(text)
            elif c.tag != "br" and id(c) in out.hashes:
                n = out.lengths[id(c)]
                length += n
                parts.append(f"\x00{out.hashes[id(c)]:x}")
                if c.tag not in BLOCK:
                    own.append(parts[-1])
        if length:
            out.hashes[id(e)] = xxhash.xxh64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
            out.lengths[id(e)] = length
            if e.tag in BLOCK and (mine := sum(map(len, own))) > most:
                most, out.longest = mine, xxhash.xxh64_intdigest("\x01".join(own).encode("utf-8", "surrogatepass")) - (1 << 63)
    return out


def _text(parts: list[Element], hashes: dict[int, int], templates: set[int]) -> str:
    """Texts of the elements, blocks parted by a space, without templates."""
    out, left = [], list(reversed(parts))
    while left:
        here = left.pop()
        if isinstance(here, str):
            out.append(here)
            continue
        block = here.tag in BLOCK
        if block:
            out.append(" ")
        if hashes.get(id(here)) in templates:
            continue
        if block:
            left.append(" ")
        left.extend(reversed(here.children))
    return " ".join("".join(out).split())


def _outermost(root: Element, tag: str) -> list[Element]:
    out, left = [], [root]
    while left:
        here = left.pop()
        if here.tag == tag:
            out.append(here)
        else:
            left.extend(c for c in reversed(here.children) if not isinstance(c, str))
    return out


def article(page: Page, templates: set[int]) -> str:
    """The main text: of the one <article>; of several where they hold most of what is left; else of <main>; else of all."""
    inside = _outermost(page.root, "article")
    text = _text(inside, page.hashes, templates)
    if text and len(inside) == 1:
        return text
    if not (main := _text(_outermost(page.root, "main"), page.hashes, templates)):
        main = _text([page.root], page.hashes, templates)
    return text if inside and 2 * len(text) >= len(main) else main


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash of its longest block), subtree: one row for every different subtree of every page (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read_ = [read(h) for h in batch.column("html").to_pylist()]
            found = [sorted(set(p.hashes.values())) for p in read_]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p.longest for p in read_], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "subtrees"])

    return pages.select("host", "html").mapInArrow(run, "host string, page long, subtrees array<long>").select("host", "page", F.explode("subtrees").alias("subtree"))


def templates(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """host, subtrees (array): those on `share` of the different pages of their host or more, and on `least` or more."""
    found = stored(subtrees(pages).distinct(), "page-subtrees")
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = counts.join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    out = stored(often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "site-templates")
    drop_stored(found)
    return out


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    White space is what str.split() takes for it. Null and empty html have the empty text. A null url, or one without a
    host, counts as a host of the empty name. Repeated rows are one page to the counts and give one row each. A host with
    fewer than `least` different pages has no template. An empty table gives no rows; other columns are not read.
    """
    docs = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = templates(docs, share, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, set[int]] = {}
            texts = []
            for html, host, subtrees_ in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("subtrees"), strict=True):
                if host not in known:
                    known[host] = set(subtrees_.as_py() or ())
                texts.append(article(read(html, bool(known[host])), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.join(found, "host", "left").select("page_id", "url", "html", "host", "subtrees").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
