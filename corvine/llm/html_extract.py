"""Main-text extraction by composite text density (Sun, Song and Liao, "DOM based content extraction via text density", 2011).

The page is parsed into a tree. Menus, footers, sidebars, forms, scripts, styles and the like carry no text by
their tag or role. Classes and ids are only a prior: they may name a notice, an advert or reader comments, but
also a wrapper around everything, so a named node counts unless it holds the article (see _settle_priors).

For every node that is left, the composite text density is its characters for each tag, adjusted by the
characters and tags of links within it; its density sum is the sum over its children. The node of greatest
density sum is the core of the article. The least density on its path up to the body is the threshold: the
nodes of the path, and what hangs on them with at least that density, belong to the article too, up to the
nearest article or main element if the core lies in one. Within the core, blocks that are mostly links and
below the threshold do not.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("button caption table td th html body object template".split())
LEAVES = HEADINGS | frozenset("p pre li dt dd td th figcaption caption summary address".split())
NOT_TEXT = RAW | frozenset("head nav header footer aside form button input select option menu dialog object embed applet canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside widget"
    " related recommended share sharing social cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login search form comment comments commentlist disqus respond replies"
    " reply pagination pager skip toolbar copyright"
).split()
#: A class or id that begins with such a name says what the node is; one that has it further on may be a wrapper's or a title's.
STRONG = re.compile(rf"(?:^|\s)(?:{'|'.join(NAMES)})(?:$|[\s_-])", re.I)
WEAK = re.compile(rf"[_-](?:{'|'.join(NAMES)})(?:$|[\s_-])", re.I)
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "prior", "link", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool) -> None:
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list[Node | str] = []
        self.prior = 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names(tag: str, attributes: str) -> tuple[bool, int]:
    """(hidden, prior) of a node: prior 2 if a class or id begins with a name of NAMES, 1 if it has one further on."""
    if tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes:
        return False, 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    hidden = found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    named = [found.get("class", ""), found.get("id", "")]
    if any(STRONG.search(x) for x in named):
        return hidden, 2
    return hidden, int(tag not in ("article", "main") and any(WEAK.search(x) for x in named))


def parse(page: str) -> Node:
    """The tree under a root; open paragraphs, list items and cells end where HTML lets them."""
    root = Node("#root", None, False)
    stack, at = [root], 0

    def text(piece: str) -> None:
        if piece and not stack[-1].skip:
            stack[-1].children.append(html.unescape(piece))

    def leave(tags, bounds) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    while (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if not m[2] or not m[0].endswith(">"):
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in FORMATTING and stack[k].tag not in INLINE or stack[k].tag in ("td", "th", "body") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "html"):
                    break
            continue
        if tag in CLOSES_P:
            leave({"p"}, SCOPES)
            if stack[-1].tag in HEADINGS and tag in HEADINGS:
                stack.pop()
        if tag in SAME:
            leave(*SAME[tag])
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag == "body":
            leave({"head"}, ())
        hidden, prior = _names(tag, m[3])
        # The header of an article holds its title.
        titles = tag == "header" and any(n.tag in ("article", "main") for n in stack)
        node = Node(tag, stack[-1], stack[-1].skip or hidden or tag in NOT_TEXT and not titles)
        node.prior = prior
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/>"):
            stack.append(node)
        elif tag not in VOID and tag in CLOSES_P:
            stack.append(node)
    text(page[at:])
    return root


def _settle_priors(body: Node) -> None:
    """Named nodes are skipped, but not if they hold the page's first article or main element that is not named
    itself, nor, if the name is not at the front, a heading of the first level or more than half of the text."""
    order = [body]
    for n in order:
        order += [c for c in n.children if isinstance(c, Node) and not c.skip]
    if not any(n.prior for n in order):
        return
    chars: dict[int, int] = {}
    titled = set()
    for n in reversed(order):
        own = [c for c in n.children if isinstance(c, Node) and not c.skip]
        chars[id(n)] = sum(chars[id(c)] for c in own) + sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        if n.tag == "h1" or any(id(c) in titled for c in own):
            titled.add(id(n))

    def place(n: Node) -> list[int]:
        out = []
        while n.parent is not None:
            out.append(next(k for k, c in enumerate(n.parent.children) if c is n))
            n = n.parent
        return out[::-1]

    holders = set()
    if firsts := [n for n in order if n.tag in ("article", "main") and not n.prior]:
        n = min(firsts, key=place)
        while n is not None:
            holders.add(id(n))
            n = n.parent
    for n in order:
        wrapper = n.prior == 1 and (id(n) in titled or 2 * chars[id(n)] > chars[id(body)])
        if n.parent is not None and n.parent.skip or n.prior and id(n) not in holders and not wrapper:
            n.skip = n is not body


def _count(node: Node, order: list[Node]) -> None:
    """Characters and tags of every node, children first."""
    todo = [node]
    for n in todo:
        todo += [c for c in n.children if isinstance(c, Node) and not c.skip]
    for n in reversed(todo):
        for c in n.children:
            if isinstance(c, str):
                size = len("".join(c.split()))
                n.chars += size
                n.link_chars += size if n.link else 0
            elif not c.skip:
                n.chars, n.link_chars = n.chars + c.chars, n.link_chars + c.link_chars
                n.tags, n.link_tags = n.tags + c.tags + 1, n.link_tags + c.link_tags + (c.tag == "a")
    order += todo


def _weigh(order: list[Node]) -> None:
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for n in order:
        if n.chars:
            tags, link_chars, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / tags * math.log(n.chars / link_chars * tags / link_tags + 1e-9) / math.log(base + 1e-9) if base > 1.0001 else n.chars / tags * math.log(n.chars / link_chars * tags / link_tags + 1e-9)
            n.density = max(n.density, 0.0)
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.skip)


def _blocks(node: Node, chosen) -> list[str]:
    """Text of the chosen parts below the node, cut at block elements; white space becomes one space."""
    out, line = [], []

    def end() -> None:
        if words := "".join(line).split():
            out.append(" ".join(words))
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif not n.skip and chosen(n):
            if n.tag not in INLINE:
                end()
                todo.append(None)
            todo += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    body = root
    todo = [root]
    for n in todo:
        if n.tag == "body":
            body = n
            break
        todo += [c for c in n.children if isinstance(c, Node)]
    _settle_priors(body)
    order: list[Node] = []
    _count(body, order)
    _weigh(order)
    holders = [n for n in order if n.tag not in INLINE and n.tag not in LEAVES]
    core = max(holders, key=lambda n: n.total)
    if core.total == 0:
        core = body
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top = next((n for n in path if n.tag in ("article", "main")), body)
    on_path = set(map(id, path))

    def chosen(n: Node) -> bool:
        """The path itself, short leaves beside it, other parts that are dense enough, and what the core holds but lists of links."""
        if id(n) in on_path or n.tag in INLINE or n.tag in LEAVES:
            return True
        if id(n.parent) in on_path and n.parent is not core:
            return n.density >= threshold
        return 2 * n.link_chars <= n.chars or n.density >= threshold

    return "\n\n".join(_blocks(top, chosen))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in bounded(batches, "html"):
        texts = [main_text(h) for h in frame["html"]]
        yield frame.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars; one row per input row.

    Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined
    in page order by a blank line. A null or empty page, or one without main text, gives an empty text. A null
    page_id or url stays null; repeated rows give repeated rows; further columns are ignored; an empty table
    gives an empty result. A page is processed whole, however long.
    """
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("no_id"), "url", "html")
    out = rows.mapInPandas(_rows, "page_id long, no_id boolean, url string, text string, n_chars long")
    return out.withColumn("page_id", F.when(~F.col("no_id"), F.col("page_id"))).drop("no_id")
