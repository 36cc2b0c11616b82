"""Leaf blocks of an HTML page: runs of text between block-level marks, with their tag paths.

The reader takes any markup: unclosed and unmatched tags, comments and raw elements that never end, stray angle
brackets. Scripts, styles, titles and other elements without page text leave no block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(/?)([a-zA-Z][^\s/>]*+)([^>]*+)> | <[!?][^>]*+>""",
    re.S | re.X,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select object noframes xmp".split())
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    """An open element: its parent and its own tokens. Blocks share the nodes of their path, however deep it is."""

    __slots__ = ("parent", "tokens", "number", "outer")

    def __init__(self, parent: Node | None, tokens: tuple[str, ...]) -> None:
        self.parent, self.tokens, self.number = parent, tokens, -1
        #: the nearest element that is not inline: this one or one around it
        self.outer = (parent.outer if parent else None) if tokens[0] in INLINE else self

    def container(self) -> Node | None:
        """The element around the nearest one that is not inline."""
        around = self.outer.parent if self.outer else None
        return around.outer if around else None


@dataclass
class Block:
    """A text, its innermost open element and the share of characters in links."""

    text: str
    node: Node | None
    linked: float

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of the open elements (names and parts of class, id and role), outermost first."""
        found, at = [], self.node
        while at is not None:
            found.append(at.tokens)
            at = at.parent
        return tuple(t for tokens in reversed(found) for t in tokens)


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    found = [name]
    if "=" in attributes:
        for groups in _NAMES.findall(attributes):
            found += [f".{p.lower()}" for p in _PARTS.findall("".join(groups))]
    return tuple(found)


class _Open:
    """The open elements, with the places of every name, so that each question takes constant time."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of elements that are not inline

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def add(self, name: str, tokens: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.outer.append(len(self.names))
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, tokens))
        self.names.append(name)

    def cut(self, place: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.outer.pop()


def blocks(page: str | None) -> list[Block]:
    """In time linear in the page, whatever is left open."""
    page = page or ""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    node: Node | None = None
    linked, at, final = 0, 0, page.rfind(">")

    def take(text: str) -> None:
        nonlocal node, linked
        if not parts and not text.strip():
            return
        if not parts:
            node = open_.nodes[-1] if open_.nodes else None
        text = html.unescape(text)
        parts.append(text)
        if open_.places.get("a"):
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, node, min(linked / len(text), 1.0)))
            parts.clear()
        linked = 0

    while True:
        mark = _MARK.search(page, at) if at <= final else None
        if mark is None:
            rest = page.find("<!--", at)
            take(page[at:] if rest < 0 else page[at:rest])
            break
        if mark.start() > at:
            take(page[at : mark.start()])
        at = mark.end()
        end, name, attributes = (mark[1], mark[2], mark[3]) if mark[2] else (mark[4], mark[5], mark[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            take(" ")
            continue
        if name not in INLINE:
            flush()
        if end:
            place = open_.last(name)
            if place >= 0 and (name not in INLINE or not open_.outer or place > open_.outer[-1]):
                open_.cut(place)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = close.start() if close else len(page)
            continue
        if name in _ENDS:
            ended, stop = _ENDS[name]
            place = open_.last(*ended.split())
            if place > open_.last(*stop):
                open_.cut(place)
        elif name not in INLINE and open_.outer and open_.names[open_.outer[-1]] == "p":
            open_.cut(open_.outer[-1])
        if name not in VOID and not (attributes.endswith("/") and name in INLINE):
            open_.add(name, _tokens(name, attributes))
    flush()
    return out
