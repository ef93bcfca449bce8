"""Lenient trees of web pages: ``Node`` with a key (tag and normalised class), children and text pieces."""

from __future__ import annotations

import html
import re

# fixed values: element groups of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
               "header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
              "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
              "option": ({"option"}, {"select"})}

#: nesting beyond which elements become siblings, so that no page is too deep to walk
MAX_DEPTH = 200

TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "key", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        name = re.sub(r"\d+", "", " ".join((attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()))
        self.key = f"{tag}.{name}" if name else tag

    @property
    def inline(self) -> bool:
        return self.tag in INLINE


def parse(page: str) -> Node:
    """Root of the tree; whatever is not closed ends with its parent, stray end tags are left out."""
    root = Node("#root", {})
    stack, at = [root], 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    while True:
        found = TOKEN.search(page, at)
        if not found:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^<]*$", rest)  # a tag that the end of the page cuts off
            text(rest[:cut.start()] if cut else rest)
            return root
        text(page[at:found.start()])
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif found[2]:
            tag = found[2].lower()
            if found[1]:
                if any(n.tag == tag for n in stack[1:]):
                    while stack.pop().tag != tag:
                        pass
                continue
            _imply(stack, tag)
            attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(found[3])}
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if end is None:
                    return root
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            elif tag not in VOID and not (found[3].endswith("/") and tag not in ("p", "div", "a")) and len(stack) < MAX_DEPTH:
                stack.append(node)


def _imply(stack: list[Node], tag: str) -> None:
    """Closes what a start tag ends by the rules for omitted end tags."""
    if tag in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if not stack[i].inline:
                break
    if tag in SAME_LEVEL:
        ends, walls = SAME_LEVEL[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                if tag == "tr":
                    return _imply(stack, tag)
                break
            if stack[i].tag in walls:
                break


def squeezed(text: str) -> str:
    return " ".join(text.split())
