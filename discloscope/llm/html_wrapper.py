"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of elements and texts. Equal neighbours, and equal neighbouring groups, fold into repeated
groups; pages of a host are aligned one after the other, elements that only one side has become optional, and texts
that differ become slots. Each page is then aligned with the wrapper again, in an article or not, and every element
judged by its own place in it: outside of articles, text that all pages repeat there and repeated groups of links go;
inside, a heading or a sentence that pages share is text, and only groups of links that they share go. The names of
elements only weigh in: what holds most of the slot text is never dropped for its name.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import without
from discloscope.llm.markup import Node, parse, squeezed
from discloscope.session import materialize

# fixed values: elements that never hold text of an article, and elements and class tokens that seldom do
NO_TEXT = set("head script style noscript template select option textarea iframe object svg canvas audio video map title".split())
SKIP_TAGS = set("nav footer aside form button input dialog menu".split())
SKIP_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                 "notices alert popup modal overlay newsletter subscribe subscription signup sidebar side aside widget widgets nav navbar "
                 "navigation menu breadcrumb breadcrumbs pagination pager header masthead footer copyright comment comments commentlist "
                 "respond disqus reply replies discussion share sharing social related recommended recommendations login search toolbar".split())
#: compounds that are tokens of their own
SKIP_WORDS |= set("cookie-notice cookie-banner cookie-bar cookie-consent ad-banner ad-slot ad-container site-header page-header site-footer "
                  "page-footer site-nav site-navigation main-nav main-navigation main-menu primary-menu nav-menu top-nav nav-bar menu-bar side-bar "
                  "left-sidebar right-sidebar widget-area share-buttons sharing-buttons social-share social-links related-posts related-articles "
                  "related-links newsletter-signup newsletter-form comments-area comment-list comments-section search-form login-form".split())
#: words that an article may use for its own parts
INSIDE_WORDS = {"header", "page-header", "side", "discussion", "search"}
#: what text counts for under a seldom name, and as the text of a link
LIGHT = 0.05
#: part of link text from which an element is a menu
MENU_LINKS = 0.6
MENU_TAGS = set("ul ol dl div section table p td".split())
#: distinct pages from which equal text counts as template
TEMPLATE_PAGES = 3
#: wrappers up to which they are broadcast, in bytes of JSON
BROADCAST_BYTES = 32 << 20
#: longest group looked for in repetitions
GROUP = 4
#: alignments of child lists remembered a host
ALIGNMENTS = 10_000
# TEXT: ids of the texts that all pages have in this place; SAID: the same of an element's own text; PAGES: the least
# ids of the distinct pages that have it, TEMPLATE_PAGES at most; CHARS and LINKS: characters of text and link text
KEY, REPEATED, OPTIONAL, CHARS, LINKS, PAGES, TEXT, SAID, CHILDREN = range(9)


def unseen(node: Node) -> bool:
    """Whether the attributes of an element hide it or give it a part beside the article."""
    attrs = node.attrs
    if not attrs:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))) or (
        attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))


def seldom(tag: str, names: str, inside: bool) -> bool:
    """Whether tag, class and id speak against an element, by whole tokens; ``inside`` an article fewer do."""
    if tag in SKIP_TAGS or (tag == "header" and not inside):
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    tokens = {re.sub(r"[-\d]+$", "", t.replace("_", "-")) for t in names.lower().split()}
    return bool(tokens & (SKIP_WORDS - INSIDE_WORDS if inside else SKIP_WORDS))


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether the names of an element alone rule it out."""
    return node.tag in NO_TEXT or unseen(node) or seldom(node.tag, node.attrs.get("class", "") + " " + node.attrs.get("id", "") if node.attrs else "", inside)


# ---------------------------------------------------------------- inference
def _id(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def page_wrapper(node: Node) -> list:
    """Wrapper of one page: texts as lengths and ids, repetitions folded."""
    pages: list[int] = []  # shared by all elements, filled at the end

    def look(node: Node, linked: bool) -> tuple[list, str]:
        linked = linked or node.tag == "a" or unseen(node)
        pieces, own, children = [], [], []
        for c in node.children:
            if isinstance(c, Node):
                child, text = look(c, linked)
                children.append(child)
            else:
                text = squeezed(c)
                own.append(text)
            if text:
                pieces.append(text)
        said, text = " ".join(filter(None, own)), " ".join(pieces)
        chars = len(said) + sum(c[CHARS] for c in children)
        links = (len(said) if linked else 0) + sum(c[LINKS] for c in children)
        return [node.key, False, False, chars, links, pages, [_id(text)] if text else [], [_id(said)] if said else [], folded(children)], text

    out, text = look(node, False)
    pages.append(_id(text))
    return out


def folded(items: list[list]) -> list[list]:
    """Repeated neighbours as one repeated element, repeated groups as one repeated group."""
    for width in range(1, GROUP + 1):
        out: list[list] = []
        for item in items:
            out.append(item)
            if len(out) >= width + 1 and width == 1 and out[-1][KEY] == out[-2][KEY]:
                twin = out.pop()
                out[-1] = merged(out[-1], twin, same_page=True)
            elif width > 1 and len(out) >= 2 * width and [x[KEY] for x in out[-width:]] == [x[KEY] for x in out[-2 * width:-width]]:
                group = _group(out[-2 * width:-width])
                out[-2 * width:] = [merged(group, _group(out[-width:]), same_page=True)]
            elif width > 1 and len(out) > width and out[-width - 1][KEY] == _name(out[-width:]):
                group = _group(out[-width:])
                out[-width - 1:] = [merged(out[-width - 1], group, same_page=True)]
        items = out
    return items


def _name(items: list[list]) -> str:
    return "(" + "|".join(x[KEY] for x in items) + ")"


def _group(items: list[list]) -> list:
    return [_name(items), False, False, sum(x[CHARS] for x in items), sum(x[LINKS] for x in items), items[0][PAGES], [], [], items]


def merged(a: list, b: list, same_page: bool = False, repeated: bool = False) -> list:
    """One wrapper for both: children aligned by key, mismatches optional, texts that one side lacks slots.

    Of the ``same_page`` all texts count as the ones of the repeated element.
    """
    if same_page:
        pages, text, said = a[PAGES], sorted({*a[TEXT], *b[TEXT]}), sorted({*a[SAID], *b[SAID]})
    else:
        pages = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:TEMPLATE_PAGES]
        text = a[TEXT] if a[TEXT] == b[TEXT] else sorted({*a[TEXT]} & {*b[TEXT]})
        said = a[SAID] if a[SAID] == b[SAID] else sorted({*a[SAID]} & {*b[SAID]})
    left, right = _grouped(a[CHILDREN], b[CHILDREN]), _grouped(b[CHILDREN], a[CHILDREN])
    names, others = [x[KEY] for x in left], [x[KEY] for x in right]
    if names == others:
        children = [merged(x, y, same_page) for x, y in zip(left, right)]
    else:
        children = []
        for what, i, j, k, m in SequenceMatcher(None, names, others, autojunk=False).get_opcodes():
            if what == "equal":
                children += [merged(x, y, same_page) for x, y in zip(left[i:j], right[k:m])]
            else:
                children += [[*x[:OPTIONAL], True, *x[OPTIONAL + 1:]] for x in left[i:j] + right[k:m]]
        children = _united(children)
    return [a[KEY], a[REPEATED] or b[REPEATED] or same_page or repeated, a[OPTIONAL] or b[OPTIONAL], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS],
            pages, text, said, children]


def _grouped(items: list[list], other: list[list]) -> list[list]:
    """``items`` with sequences that the other side knows as a group put into that group."""
    for group in (x for x in other if x[KEY].startswith("(")):
        names, width, at = [x[KEY] for x in group[CHILDREN]], len(group[CHILDREN]), 0
        while at + width <= len(items):
            if [x[KEY] for x in items[at:at + width]] == names:
                items = items[:at] + [_group(items[at:at + width])] + items[at + width:]
            at += 1
    return items


def _united(items: list[list]) -> list[list]:
    """Optional neighbours of one key, met in different order, are one repeated optional element."""
    out: list[list] = []
    for x in items:
        if out and out[-1][KEY] == x[KEY]:
            out[-1] = merged(out[-1], x, repeated=True)  # of different pages, so only texts of both are template
        else:
            out.append(x)
    return out


# ---------------------------------------------------------------- labels
class Labels:
    """What the wrapper of a host says of each of its elements; an element is known by its place, not by its path."""

    def __init__(self, wrapper: list):
        self.root, self.own, self.whole, self.linked, self.protected, self._seen = wrapper, {}, {}, {}, set(), {}
        #: places of articles that every page repeats, if the host has no others: text all the same
        self.kept: set[int] = set()
        articles, todo = [], [wrapper]
        while todo:
            node = todo.pop()
            articles += [node] if node[KEY].partition(".")[0] in ("article", "main") else []
            todo += node[CHILDREN]
        todo = articles if all(self.constant(a) for a in articles) else []
        while todo:
            node = todo.pop()
            self.kept.add(id(node))
            todo += node[CHILDREN]
        self._weigh(wrapper, 1.0, False)
        node, half = wrapper, self.whole[id(wrapper)] / 2
        while half > 0:
            self.protected.add(id(node))
            best = max(self._leaves(node), key=lambda x: self.whole[id(x)], default=None)
            if best is None or self.whole[id(best)] < half:
                break
            node = best

    def _leaves(self, node: list) -> list[list]:
        """Elements below ``node``, those in groups too."""
        out = []
        for c in node[CHILDREN]:
            out += self._leaves(c) if c[KEY].startswith("(") else [c]
        return out

    def constant(self, node: list) -> bool:
        return bool(node[TEXT]) and not node[REPEATED] and len(node[PAGES]) >= TEMPLATE_PAGES and id(node) not in self.kept

    def _weigh(self, node: list, factor: float, inside: bool) -> None:
        """Slot text of every element, its own and with all below; seldom names, links and template text weigh less."""
        tag, _, names = node[KEY].partition(".")
        group = tag.startswith("(")
        if not group:
            if tag in NO_TEXT or self.constant(node):
                factor = 0.0
            elif seldom(tag, names, inside):
                factor *= LIGHT
            inside = inside or tag in ("article", "main")
        whole, chars, links, linked = 0.0, node[CHARS], node[LINKS], False
        for c in node[CHILDREN]:
            self._weigh(c, factor, inside)
            whole += self.whole[id(c)]
            chars, links = chars - c[CHARS], links - c[LINKS]
            linked = linked or self.linked[id(c)] or ((c[REPEATED] or (group and node[REPEATED])) and c[LINKS] > 0)
        self.own[id(node)] = 0.0 if group else factor * (chars - links + LIGHT * links)
        self.whole[id(node)] = whole + self.own[id(node)]
        self.linked[id(node)] = linked  # whether a repeated element with link text is below

    def menu(self, node: list, inside: bool) -> bool:
        if not node[CHARS] or node[LINKS] < MENU_LINKS * node[CHARS] or node[KEY].partition(".")[0] not in MENU_TAGS:
            return False
        return id(node) not in self.protected and (not inside or self.linked[id(node)])

    def align(self, node: list, keys: tuple[str, ...]) -> list[list | None]:
        """For children of these keys the elements of the wrapper, so that most have one; None for others."""
        known = (id(node), keys)
        if known not in self._seen:
            self._seen.clear() if len(self._seen) > ALIGNMENTS else None
            self._seen[known] = self._align(node, keys)
        return self._seen[known]

    def _align(self, node: list, keys: tuple[str, ...]) -> list[list | None]:
        places: list[list] = []
        reach: list[int] = []  # the last place that may come before a place: what repeats may start again

        def flat(items: list[list], loop: bool) -> None:
            for x in items:
                start, again = len(places), x[REPEATED] and not loop
                if x[KEY].startswith("("):
                    flat(x[CHILDREN], loop or x[REPEATED])
                else:
                    places.append(x)
                    reach.append(start - 1)
                if again:
                    reach[start:] = [len(places) - 1] * (len(places) - start)

        flat(node[CHILDREN], False)
        at: dict[str, list[int]] = {}
        for p, x in enumerate(places):
            at.setdefault(x[KEY], []).append(p)
        best, steps = [(-1.0, -1)] * len(places), []  # score and last child of the best way that ends in a place
        for i, key in enumerate(keys):
            if key not in at:
                steps.append({})
                continue
            top, most = [], (0.0, None)
            for p, (score, child) in enumerate(best):
                if score > most[0]:
                    most = (score, (child, p))
                top.append(most)
            step = {}
            for p in at[key]:
                score, before = top[reach[p]] if reach[p] >= 0 else (0.0, None)
                step[p] = (score + (1.0 if places[p][OPTIONAL] else 1.001), before)
            for p, (score, _) in step.items():
                if score > best[p][0]:
                    best[p] = (score, i)
            steps.append(step)
        out: list[list | None] = [None] * len(keys)
        if places:
            p = max(range(len(places)), key=lambda q: best[q][0])
            now = (best[p][1], p) if best[p][1] >= 0 else None
            while now is not None:
                out[now[0]] = places[now[1]]
                now = steps[now[0]][now[1]][1]
        return out


class _Seen:
    """An element of a page: its place in the wrapper, text id, characters and link characters."""

    __slots__ = ("place", "text", "chars", "links", "said")


def _aligned(root: Node, labels: Labels) -> dict[int, _Seen]:
    seen: dict[int, _Seen] = {}

    def look(node: Node, place: list | None, linked: bool) -> tuple[_Seen, str]:
        linked = linked or node.tag == "a" or unseen(node)
        nodes = [c for c in node.children if isinstance(c, Node)]
        places = iter(labels.align(place, tuple(c.key for c in nodes)) if place is not None and nodes else [None] * len(nodes))
        pieces, own, me = [], [], _Seen()
        me.place, me.chars, me.links = place, 0, 0
        for c in node.children:
            if isinstance(c, Node):
                child, text = look(c, next(places), linked)
                me.chars, me.links = me.chars + child.chars, me.links + child.links
            else:
                text = squeezed(c)
                own.append(text)
            if text:
                pieces.append(text)
        said, text = " ".join(filter(None, own)), " ".join(pieces)
        me.chars, me.links = me.chars + len(said), me.links + (len(said) if linked else 0)
        # ids are needed only where the wrapper has some to compare with
        template = place is not None and len(place[PAGES]) >= TEMPLATE_PAGES and id(place) not in labels.kept
        me.text = _id(text) if template and place[TEXT] and text else None
        me.said = _id(said) if template and place[SAID] and said else None
        seen[id(node)] = me
        return me, text

    look(root, labels.root, False)
    return seen


def main_text(page: str, labels: Labels | None) -> str:
    """Text of the article: its blocks in page order, white space squeezed, joined by one space.

    Without ``labels`` of its host a page is its own wrapper.
    """
    root = parse(page)
    labels = labels or Labels(page_wrapper(root))
    seen = _aligned(root, labels)

    def dropped(node: Node, inside: bool) -> bool:
        me = seen[id(node)]
        if node.tag in NO_TEXT or unseen(node):
            return True
        block = me.place is not None and not node.inline
        constant = block and me.text is not None and me.text in me.place[TEXT]
        if constant and not inside:
            return True
        if me.place is not None and id(me.place) in labels.protected:
            return False
        if boilerplate(node, inside):
            return True
        # inside an article what all pages repeat is a menu only if its text is that of links
        return block and me.links >= MENU_LINKS * me.chars > 0 and (constant or not inside) and labels.menu(me.place, inside)

    def weight(tops: list[Node], inside: bool) -> float:
        """Slot text of the places below: how much the host has there, so a short article is one all the same."""
        total, counted, todo, own = 0.0, set(), list(tops), {id(t) for t in tops}
        while todo:
            node = todo.pop()
            if id(node) not in own and dropped(node, inside):
                continue
            place = seen[id(node)].place
            if place is None:
                total += sum(len(squeezed(c)) for c in node.children if isinstance(c, str))
            elif id(place) not in counted:
                counted.add(id(place))
                total += labels.own[id(place)]
            todo += [c for c in node.children if isinstance(c, Node)]
        return total

    def topmost(tag: str) -> list[Node]:
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and dropped(node, False):
                continue
            if node.tag == tag or (tag == "main" and node.attrs.get("role", "").lower() == "main"):
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return found

    scope, inside = [root], False
    for tag in ("main", "article"):
        tops = topmost(tag)
        if tops and 2 * weight(tops, True) >= weight(scope, inside):
            scope, inside = tops, True

    starts = {id(t) for t in scope}
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        block = squeezed("".join(line))
        line.clear()
        if block:
            blocks.append(block)

    # an explicit stack: pages may nest deeper than the interpreter's own
    todo: list = list(reversed(scope))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif id(item) not in starts and dropped(item, inside):
            flush() if not item.inline else None
        elif item.tag == "br":
            line.append(" ")
        else:
            if not item.inline:
                flush()
                todo.append(None)
            children = item.children
            me = seen[id(item)]
            if not inside and me.said is not None and me.said in me.place[SAID] and not item.inline and not any(
                    isinstance(c, Node) and c.inline and seen[id(c)].chars for c in children):
                children = [c if isinstance(c, Node) else " " for c in children]
            todo += reversed(children)
    flush()
    return " ".join(blocks)


# ---------------------------------------------------------------- Spark
def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def infer_wrappers(pages: DataFrame, ways: int = 64, flush_hosts: int = 2000) -> DataFrame:
    """``host`` and ``wrapper`` (JSON), learned from every page of the host.

    Pages are aligned where they are read, to one wrapper a host and task; these meet in ``ways`` groups a host and
    then in one, so a host with a third of all pages is never gathered.
    """
    def learn(batches):
        held: dict[str, list] = {}

        def rows():
            batch = pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}, pa.schema(
                [("host", pa.string()), ("wrapper", pa.string())]))
            held.clear()
            return batch

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                one = page_wrapper(parse(page or ""))
                held[host] = merged(held[host], one) if host in held else one
            if len(held) >= flush_hosts:
                yield rows()
        yield rows()

    def join(table: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(table["wrapper"].to_pylist()):
            one = json.loads(text)
            whole = one if whole is None else merged(whole, one)
        return pa.table({"host": [table["host"][0].as_py()], "wrapper": [json.dumps(whole)]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    schema = "host string, wrapper string"
    part = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(learn, schema)
    some = part.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(ways))).applyInArrow(join, schema)
    return some.groupBy("host").applyInArrow(join, schema)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """All rows and columns of ``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    Only boilerplate goes: menus, site headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments. Outside of the article these are what the wrapper of the host shows to be text that at least
    ``TEMPLATE_PAGES`` distinct pages, and all that have the element, repeat, or repeated groups of links; inside, groups
    of links that are both; anywhere hidden elements, and elements of such names unless they hold most of the slot text. Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space. Null and empty pages have the empty text; pages without a host share the wrapper of the
    empty host; repeated pages give equal texts; an empty table gives no rows. Input columns that clash with the
    added names give way.
    """
    pages = without(pages, "text", "n_chars", "_host", "_wrapper")
    wrappers = materialize(infer_wrappers(pages)).withColumnsRenamed({"host": "_host", "wrapper": "_wrapper"})
    size = wrappers.agg(F.coalesce(F.sum(F.length("_wrapper")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers

    @F.pandas_udf("string")
    def text(htmls: pd.Series, wraps: pd.Series) -> pd.Series:
        known: dict[str, Labels | None] = {}
        out = []
        for page, wrap in zip(htmls, wraps):
            if wrap not in known:
                known.clear() if len(known) > 1000 else None
                known[wrap] = Labels(json.loads(wrap)) if wrap else None
            out.append(main_text(page or "", known[wrap]))
        return pd.Series(out, dtype=object)

    joined = pages.withColumn("_host", host_of(F.col("url"))).join(side, "_host", "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], text("html", "_wrapper").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
