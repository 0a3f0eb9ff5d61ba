"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements (inline marks are part of their block's text; `p`, `li` and the like close where HTML closes them).
Each paragraph gives points for its length and its commas to its parent in full and to its grandparent by half. A container's points are
discounted by its link density. The best container is kept, and around it, level by level, all that is mostly unlinked or scores near it: up to
what lies beside its `article` or `main`, or where it is in none, up to the lowest level that adds text. Menus, headers, footers, side columns, notices, adverts, forms, comments and anything hidden never count and are never kept.

Names are read by words: `comments` in `post-comments` marks a block, but `search` marks `search` or `search-box` and not `search-article`, and no word
marks after has-, no-, with- or without-. Of main elements, articles and first headings, the surest kind that the page has tells where its text is: if all of
that kind are marked, the first frees the forms and named blocks around it, where that brings more text than what is unmarked; without any, the largest form
is freed, if it brings four times as much. Marks inside stay,
and comments, adverts, cookie notices and newsletters are never freed so. A page that is still without text is read again without names and forms.

The text of a block: character references decoded, white space runs made one space, trimmed; blocks in page order joined by one newline. A
`br` ends a block. Null, empty or text-free pages: an empty text. Every row is extracted from its whole html; repeated rows alike.

Reading is linear in the page, broken markup included: what is known to be missing from here on (a `>`, a closing quote) isn't looked for again,
open elements are found by their names, not by climbing, and a page whose quotes never close often ends its tags at the next `>`. A `<` that
starts no tag is text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import read

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile("[>\"']")
#: Tags of a page that may end at a quoted `>` for want of a closing quote, before quotes no longer count.
UNCLOSED = 100
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are no part of an article.
OUTSIDE = set("nav footer aside form button select option dialog menu head object svg canvas audio video map fieldset input header".split())
#: Words of a class, id or role that mark a block as no part of an article, wherever they stand in a hyphenated name; the first kind for good.
NEVER = set("ads advert adverts advertisement comment comments consent cookie cookies disqus newsletter replies respond sponsored".split())
ANYWHERE = set("breadcrumb breadcrumbs footer modal nav navbar navigation popup sidebar".split())
#: Words that mark a block alone or beside words that say no more than its place or shape.
ALONE = set("ad banner complementary contentinfo header masthead menu notice notices promo related search share sharing social sponsor subscribe toolbar widget".split())
PLACE = set("area bar block bottom box btn button buttons col column container content form global group icons inner item items left link links list main message module outer overlay page panel post posts primary right secondary section site slot text top unit wrap wrapper".split())
#: Words before one of these that say that the block has or lacks such a part.
HAS = {"has", "no", "with", "without"}
PARTS = re.compile("[-_]+")
FREE, NAMED, SHUT = 0, 1, 2
#: An open element of the first kind closes where one of the second starts, up to an element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
NEAR, LINKED = 0.2, 0.25
ARTICLE = ("article", "main")
#: What tells where the article is, surest first.
ANCHORS = ("main", "article", "h1")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    mark: int  # its own: FREE, NAMED (may be freed) or SHUT
    outside: bool = False
    children: list = field(default_factory=list)  # nodes, or (text, whether in a link)
    points: float = 0.0
    chars: int = 0
    linked: int = 0


def _named(value: str) -> int:
    """The mark that a class, id or role gives."""
    mark = FREE
    for name in value.lower().split():
        parts = PARTS.split(name)
        told = [p for i, p in enumerate(parts) if not i or parts[i - 1] not in HAS]
        if not NEVER.isdisjoint(told):
            return SHUT
        if not ANYWHERE.isdisjoint(told) or not ALONE.isdisjoint(told) and all(p in ALONE or p in PLACE or p.isdigit() or not p for p in parts):
            mark = NAMED
    return mark


def _mark(tag: str, attributes: str, by_name: bool) -> int:
    """The mark of an element's own tag and attributes."""
    if tag in OUTSIDE and tag != "form":
        return SHUT
    mark = NAMED if tag == "form" and by_name else FREE
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if by_name and name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
                mark = max(mark, _named(value))
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return SHUT
    return mark


class _Tags:
    """The tags of a page in order, as (start, end, closing, name, attributes); a comment or declaration has no name."""

    def __init__(self, html: str):
        self.html, self.missing, self.unclosed = html, set(), 0

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _end(self, at: int) -> int:
        """The place of the `>` that ends a tag, quoted ones passed over; -1 if none does."""
        first = self._find(">", at)
        if first < 0 or self.unclosed > UNCLOSED:
            return first
        while (m := STOP.search(self.html, at)) is not None:
            at = m.end()
            if m[0] == ">":
                return m.start()
            closing = self._find(m[0], at)
            if closing >= 0:
                at = closing + 1
        self.unclosed += 1
        return first

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = self._find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), False, "", ""
            if html.startswith(("<!", "<?"), at):
                end = self._find(">", at)
                return at, end + 1 if end >= 0 else len(html), False, "", ""
            m = NAME.match(html, at + 1)
            end = self._end(m.end()) if m else -1
            if end >= 0:
                return at, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
            if m and ">" in self.missing:
                return None
            at += 1
        return None


class _Open:
    """The open elements, innermost last, with the places of each name."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def inner(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 (the page itself) if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Closes the element at a place and all inside it; the page stays."""
        while len(self.nodes) > max(place, 1):
            self.places[self.nodes.pop().tag].pop()


def tree(html: str, by_name: bool = True) -> Node:
    """The block elements of a page, with their texts."""
    root = Node("#page", None, FREE)
    tags, stack = _Tags(html), _Open(root)
    links, at = 0, 0
    while at < len(html):
        found = tags.after(at)
        here = stack.nodes[-1]
        text = html[at : found[0] if found else len(html)]
        if text:
            here.children.append((text, links > 0))
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE or tag in VOID or tag in RAW:
                if tag == "br":
                    here.children.append(None)
            elif place := stack.inner((tag,)):
                stack.close(place)
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag == "a":
            links += 1
        elif tag in ("br", "hr"):
            here.children.append(None)
        elif tag in ("html", "body"):
            if place := stack.inner(("head",)):
                stack.close(place)
        elif tag not in INLINE and tag not in VOID:
            if tag in CLOSES:
                kinds, stops = CLOSES[tag]
                place = stack.inner(kinds)
                if place > stack.inner(stops):
                    stack.close(place)
                    if tag == "tr" and (row := stack.inner(("tr",))) > stack.inner(("table",)):
                        stack.close(row)
            elif here.tag == "p":
                stack.close(len(stack.nodes) - 1)
            here = stack.nodes[-1]
            child = Node(tag, here, _mark(tag, attributes, by_name))
            here.children.append(child)
            stack.push(child)
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Nodes, parents first."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [c for c in reversed(node.children) if isinstance(c, Node)]


def _settle(nodes: list[Node]) -> None:
    """Sets `outside` from the marks, after freeing what holds the article; nodes: parents first."""
    shut, held = set(), set()  # in something SHUT; else in something NAMED
    text = {}  # unlinked text of a node, less what is marked inside
    for node in nodes:
        up = id(node.parent)
        if node.mark == SHUT or up in shut:
            shut.add(id(node))
        elif node.mark == NAMED or up in held:
            held.add(id(node))
        text[id(node)] = sum(len(c[0].strip()) for c in node.children if isinstance(c, tuple) and not c[1])
    for node in reversed(nodes):
        if node.parent and node.mark == FREE:
            text[id(node.parent)] += text[id(node)]
    if held:
        _free(nodes, [n for n in nodes if id(n) in held and text[id(n)]], shut | held, text)
    for node in nodes:
        node.outside = node.mark != FREE or bool(node.parent and node.parent.outside)


def _free(nodes: list[Node], held: list[Node], marked: set[int], text: dict[int, int]) -> None:
    """Frees the first held anchor of the surest kind that the page has, or a form, if that brings enough."""
    for kind in ANCHORS:
        if any(n.tag == kind and text[id(n)] and id(n) not in marked for n in nodes):
            return
        found = next((n for n in held if n.tag == kind), None)
        if found:
            times = 1
            break
    else:
        found, times = max((n for n in held if n.tag == "form"), key=lambda n: text[id(n)], default=None), 4
    around = []
    while found:
        around.append(found)
        found = found.parent
    if sum(text[id(n)] for n in around if n.mark == NAMED) > times * text[id(nodes[0])]:
        for node in around:
            node.mark = FREE


def _blocks(root: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    waiting: list = [root]
    while waiting:
        item = waiting.pop()
        if item is None:
            close()
        elif isinstance(item, Node):
            close()
            if not item.outside:
                waiting.append(None)
                waiting += reversed(item.children)
        else:
            run.append(item[0])
    close()
    return out


def main_text(html: str | None) -> str:
    """Of a page whose every text stands in a form or under a name of what is no article, that names and forms don't count."""
    return _main(tree(html or "")) or (_main(tree(html, by_name=False)) if html else "")


def _main(root: Node) -> str:
    nodes = list(_walk(root))
    _settle(nodes)
    for node in reversed(nodes):  # children first
        if node.outside:
            continue
        text = " ".join(unescape("".join(c[0] for c in node.children if isinstance(c, tuple))).split())
        own = len(text)
        node.chars += own
        node.linked += sum(len(c[0].strip()) for c in node.children if isinstance(c, tuple) and c[1])
        if node.parent and not node.parent.outside:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        if own and node.parent:
            points = 1 + text.count(",") + min(own / 100, 3)
            first, second = (node, node.parent) if node.tag in ("div", "article", "main", "section", "body", "#page", "td") else (node.parent, node.parent.parent)
            first.points += points
            if second:
                second.points += points / 2
        elif own:
            node.points += 1 + text.count(",") + min(own / 100, 3)
    score = lambda n: n.points * (1 - min(1.0, n.linked / n.chars)) if n.chars else 0.0
    kept = [n for n in nodes if not n.outside and n.chars]
    if not kept:
        return ""
    best = max(kept, key=score)
    least = NEAR * score(best)
    level, marked, around = best, best, best
    while marked and marked.tag not in ARTICLE:
        marked = marked.parent
    while level.parent:
        beside, done = _beside(level, lambda n: n.linked < LINKED * n.chars or 0 < least <= score(n)), level is marked
        around = Node("div", None, FREE, children=[around if c is level else c for c in beside])
        if done or not marked and len(beside) > 1:
            break
        level = level.parent
    return "\n".join(_blocks(around))


def _beside(level: Node, wanted: Callable[[Node], bool]) -> list:
    """The children of level's parent that stay: level, wanted blocks, and loose text where it is mostly unlinked."""
    children = level.parent.children
    loose = [(len(c[0].strip()), c[1]) for c in children if isinstance(c, tuple)]
    total = sum(n for n, _ in loose)
    text = total > 0 and sum(n for n, linked in loose if linked) < LINKED * total
    return [c for c in children if c is level or (not c.outside and c.chars and wanted(c) if isinstance(c, Node) else text)]


def extracted(pages: DataFrame) -> DataFrame:
    """pages with `text`, the main text of `html`. All other columns stay, but for one of that name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(x) for x in batch["html"]]
            yield batch.drop(columns="html")

    kept = [f for f in pages.schema.fields if f.name not in ("html", "text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return pages.select(*(f.name for f in kept), "html").mapInPandas(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
