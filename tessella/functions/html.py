"""HTML as a tree: tags, quoted and unquoted attributes, comments, raw text, implied and missing end tags.

A small reader for use inside a task, one page at a time. It never fails: what is no markup is text, what is never closed
ends with its parent.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Names of elements as HTML groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select "
    "summary table tbody td textarea tfoot th thead title tr ul xmp".split()
)
CLOSES_P = BLOCK - frozenset("body br caption frameset head html legend optgroup option tbody td textarea tfoot th thead title tr".split())
#: An element of the key's kind ends open ones of the value's kinds, up to the nearest of its own parents.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Where the search for an open element to end stops.
SCOPE = frozenset("html table td th caption button object".split())

_MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""  # a comment
    r"""|<[!?][^>]*(?:>|\Z)"""  # a declaration
    r"""|</(?![a-zA-Z])[^>]*(?:>|\Z)"""  # an end tag of no name
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Element:
    """tag, attributes (as written), parent, children (elements and decoded texts)."""

    __slots__ = ("tag", "written", "parent", "children")

    def __init__(self, tag: str, written: str = "", parent: Element | None = None):
        self.tag, self.written, self.parent, self.children = tag, written, parent, []

    @property
    def attributes(self) -> dict[str, str]:
        """Names in small letters; of equal names the first."""
        out: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(self.written):
            out.setdefault(name.lower(), html.unescape("".join(values)))
        return out

    def walk(self) -> Iterator[Element]:
        """The elements inside, in page order."""
        left = [c for c in reversed(self.children) if not isinstance(c, str)]
        while left:
            here = left.pop()
            yield here
            left.extend(c for c in reversed(here.children) if not isinstance(c, str))

    def text(self, without: tuple[str, ...] = ()) -> str:
        """All text inside, white space as it is, but for elements of some tags."""
        out, left = [], [self]
        while left:
            here = left.pop()
            if isinstance(here, str):
                out.append(here)
            elif here.tag not in without:
                left.extend(reversed(here.children))
        return "".join(out)


def _open(stack: list[Element], tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> int:
    """Place in the stack of the last open element among tags before any of barrier; 0 if there is none."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            return i
        if stack[i].tag in barrier:
            return 0
    return 0


def _end(stack: list[Element], tag: str) -> None:
    if tag in BLOCK:
        at = _open(stack, {tag}, SCOPE - {tag})
    else:  # the end of an inline element does not end blocks that began inside it
        at = _open(stack, {tag}, BLOCK - {"br"})
    if at:
        del stack[at:]
    elif tag in ("p", "br"):
        stack[-1].children.append(Element(tag, parent=stack[-1]))


def parse(page: str | None) -> Element:
    """The root (tag '') of a page; null is an empty page."""
    root = Element("")
    if not page:
        return root
    stack, at = [root], 0

    def write(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while (m := _MARKUP.search(page, at)) is not None:
        write(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            _end(stack, tag)
            continue
        if tag in CLOSES_P and (i := _open(stack, {"p"}, SCOPE)):
            del stack[i:]
        if tag in SIBLINGS:
            closed, parents = SIBLINGS[tag]
            while i := _open(stack, closed, parents):
                del stack[i:]
        element = Element(tag, m["attributes"], stack[-1])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            element.children.append(html.unescape(inside) if tag in ESCAPABLE else inside)
            at = page.find(">", end.start()) + 1 if end else len(page)
            at = at or len(page)
        elif tag not in VOID:
            stack.append(element)
    write(page[at:])
    return root
