"""A few lines of HTML tree for the page jobs: blocks, texts, links and simple selectors.

Selectors: tag, .class, [attr], [attr=x], [attr*=x], [attr^=x], descendants, comma alternatives.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(["script", "style", "template"])
SAME_LEVEL = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}}
PART = re.compile(r"\[([\w-]+)(?:([*^]?=)['\"]?([^'\"\]]*)['\"]?)?\]|\.([\w-]+)|([\w-]+)")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self) -> str:
        parts = []
        for child in self.children:
            if isinstance(child, str):
                parts.append(child.strip())
            elif child.tag not in HIDDEN:
                parts.append(child.text())
        return " ".join(p for p in parts if p)

    def links(self) -> list[str]:
        own = [self.attrs["href"]] if self.tag == "a" and self.attrs.get("href") else []
        return own + [n.attrs["href"] for n in self.walk() if n.tag == "a" and n.attrs.get("href")]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("root")

    def handle_starttag(self, tag, attrs):
        if self.here.tag in SAME_LEVEL.get(tag, ()):
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_parts = lru_cache(maxsize=4096)(PART.findall)


@lru_cache(maxsize=4096)
def _chains(selector: str) -> list[list[str]]:
    return [part.split() for part in selector.split(",") if part.strip()]


def _fits(node: Node, simple: str) -> bool:
    for attr, op, want, cls, tag in _parts(simple):
        if tag and node.tag != tag:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None or op == "=" and have != want or op == "*=" and want not in have:
                return False
            if op == "^=" and not have.startswith(want):
                return False
    return True


def _fits_chain(node: Node, chain: list[str]) -> bool:
    if not _fits(node, chain[-1]):
        return False
    rest, up = chain[:-1], node.parent
    while rest and up is not None:
        if _fits(up, rest[-1]):
            rest = rest[:-1]
        up = up.parent
    return not rest


def select(node: Node, selector: str) -> list[Node]:
    chains = _chains(selector)
    return [n for n in node.walk() if any(_fits_chain(n, c) for c in chains)]


def select_one(node: Node, selector: str | None) -> Node | None:
    if not selector:
        return None
    return next(iter(select(node, selector)), None)


def sections(root: Node, heading_tags: tuple[str, ...]) -> list[tuple[str, str, list[str]]]:
    """(heading, text, links) per heading: its following siblings up to the next heading."""
    out = []
    for node in root.walk():
        if node.tag not in heading_tags or not node.text():
            continue
        siblings = node.parent.children
        texts, links = [], []
        for sib in siblings[siblings.index(node) + 1 :]:
            if not isinstance(sib, Node):
                continue
            if sib.tag in heading_tags or any(n.tag in heading_tags for n in sib.walk()):
                break
            texts.append(sib.text())
            links += sib.links()
        out.append((node.text(), " ".join(t for t in texts if t), links))
    return out
