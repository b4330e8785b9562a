"""A page's tree of blocks, and what there is to know about each block."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

#: Fixed values of HTML: elements without content, without text, inside a line, and those that end others.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "title", "template", "svg", "annotation", "annotation-xml", "iframe", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
#: Of these, what may hold its own kind, and what holds nothing but characters.
NESTING, LITERAL = {"template", "svg"}, {"script", "style", "title", "textarea", "iframe"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A formula stands in its line.
INLINE |= set("math maction menclose mfenced mfrac mi mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What confines the end tags and implied ends inside it.
SCOPE = {"table", "ul", "ol", "dl", "body", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form", "blockquote", "td", "th"}

#: Groups of tags and of words in class, id and role attributes that stand for what a block is for.
TAGS = [
    {"article", "main"}, {"section"}, {"div", "center"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"nav", "menu"},
    {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"#text"},
    {"body", "html"}, {"address", "details", "dialog"},
]
WORDS = {
    "text": "article articlebody body content contents entry main page post prose story text copy read",
    "menu": "breadcrumb breadcrumbs crumbs links menu nav navbar navigation pager pagination tabs toc toolbar skip",
    "head": "brand head header hero logo masthead site top topbar",
    "foot": "bottom colophon copyright foot footer imprint legal",
    "side": "aside also latest more popular rail recommended recommendations related sidebar side trending widget widgets",
    "notice": "alert banner consent cookie cookies dialog disclaimer gdpr message modal newsletter notice notification overlay paywall popup privacy subscribe toast",
    "advert": "ad ads adslot advert advertisement adverts dfp promo promoted promotion sponsor sponsored",
    "comment": "comment commentlist comments discussion disqus feedback replies reply respond responses review reviews thread",
    "form": "contact form input login register search signin signup",
    "share": "follow like share sharing social tweet",
    "about": "author bio byline credit date dateline meta published tags timestamp",
}
GROUP_OF = {w: i for i, ws in enumerate(WORDS.values()) for w in ws.split()}
TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
STOPS = ".!?,;:"


class Node:
    """A block: its tag, attribute word groups, parent's index, and the runs of text in it that no inner block holds."""

    __slots__ = ("tag", "groups", "parent", "children", "text", "links", "tags")

    def __init__(self, tag: str, groups: frozenset[int], parent: int):
        self.tag, self.groups, self.parent = tag, groups, parent
        self.children: list[int] = []
        self.text: list[str] = []
        self.links = self.tags = 0


SAME = {tag: re.compile(rf"<(/?){tag}\b", re.IGNORECASE) for tag in SILENT}


class Page(HTMLParser):
    """Reads a page, however broken, into blocks in page order; nodes[0] is the root.

    What is inside silent elements is no text of the page. One that is never ended is none at all: what follows it is
    read. Others end at their end tag, or at that of an element around them. The head is no element of its own: it ends
    where something else than a title, style or script begins. What noscript and object hold is read as content.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", frozenset(), -1)]
        self.open: list[tuple[str, int]] = [("html", 0)]  # tag and block; inline elements have their block's
        self.many = Counter({"html": 1})  # open elements by tag
        self.silent: list[str] = []  # the silent element and what is open inside it
        self.ended: dict[str, None] = {}
        self.place = 0
        self.in_link = 0
        self.run = -1  # the block that text is being added to
        self.feed(html)
        self.close()

    def parse_starttag(self, i: int) -> int:
        self.place = i
        return super().parse_starttag(i)

    def _ends(self, tag: str) -> bool:
        """Whether the silent element that begins here is ended: by an end tag before the next of its kind begins."""
        if self.ended.get(tag, -1) is None:
            return False  # it was found that none of its kind ends from here on
        at, pattern = self.place + 1, SAME[tag]
        found = pattern.search(self.rawdata, at)
        while tag in NESTING and found and not found[1]:
            found = pattern.search(self.rawdata, found.end())
        if not found:
            self.ended[tag] = None
        return found is not None and found[1] == "/"

    def _begin(self, tag: str, attrs) -> None:
        words = [v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v]
        found = frozenset(GROUP_OF[t] for w in words for t in TOKEN.findall(CAMEL.sub(" ", w).lower()) if t in GROUP_OF)
        parent = self.open[-1][1]
        self.nodes.append(Node(tag, found, parent))
        self.nodes[parent].children.append(len(self.nodes) - 1)
        self._push(tag, len(self.nodes) - 1)
        self.run = -1

    def _push(self, tag: str, block: int) -> None:
        self.open.append((tag, block))
        self.many[tag] += 1

    def _close_back_to(self, tags: set[str]) -> None:
        """Ends the innermost open element among tags, and all inside it, unless a scope lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][0]
            if tag in tags:
                self._drop(i)
                return
            if tag in SCOPE:
                return

    def _drop(self, i: int) -> None:
        for tag, _ in self.open[i:]:
            self.in_link -= tag == "a"
            self.many[tag] -= 1
        del self.open[i:]
        self.run = -1

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent:
            if self.silent[0] not in LITERAL and tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if self._ends(tag):
                self.silent.append(tag)
            return
        if tag in ("html", "head", "body"):
            return  # the root stands for them
        block = self.nodes[self.open[-1][1]]
        block.tags += 1
        if tag in VOID:
            if tag == "br" and self.run >= 0:
                self.nodes[self.run].text.append(" ")
            elif tag == "hr":
                self._close_back_to({"p"})
                self.run = -1
            return
        if tag in INLINE:
            self._push(tag, self.open[-1][1])
            self.in_link += tag == "a"
            return
        if tag in ENDS_PARAGRAPH:
            self._close_back_to({"p"})
        if tag in ENDS:
            self._close_back_to(ENDS[tag])
        self._begin(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                return
            if self.silent[0] in LITERAL or tag in INLINE or not self.many[tag]:
                return
            self.silent.clear()  # an element around it ends
        if not self.many[tag] or tag == "html":
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._drop(i) if tag not in INLINE else self._end_inline(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return  # the element was ended with its block

    def _end_inline(self, i: int) -> None:
        self.in_link -= self.open[i][0] == "a"
        self.many[self.open[i][0]] -= 1
        del self.open[i]

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        at = self.open[-1][1]
        if self.run < 0:
            if not data.strip():
                return
            # a run of text is a node of its own; it stands for its block where the block holds nothing else
            self.nodes.append(Node("#text", frozenset(), at))
            self.run = len(self.nodes) - 1
            self.nodes[at].children.append(self.run)
        node = self.nodes[self.run]
        node.text.append(data)
        if self.in_link > 0:
            node.links += len(data.strip())


N_GROUPS = len(WORDS)
#: Bits of a count in the one number that holds the counts of all groups below a block.
LANE = 32
NAMES = [
    "depth", "chars", "links", "tag_density", "blocks", "paragraphs", "of_page", "of_parent", "place", "siblings", "alike", "leaf_chars", "stops", "start",
    "leaves", "only_child", "parent_links", "before_chars", "after_chars", *[f"tag{i}" for i in range(len(TAGS))], *[f"own_{g}" for g in WORDS], *[f"above_{g}" for g in WORDS],
    *[f"below_{g}" for g in WORDS], "in_article", "in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_list", "has_article", "has_h1", "said", "said_below",
]
ABOVE = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form"}, {"ul", "ol", "dl", "li"}]
IS_ABOVE = {t: sum(1 << i for i, ts in enumerate(ABOVE) if t in ts) for t in set().union(*ABOVE)}
#: Groups of words, and elements, that say that a block is none of the article's.
SAYS = sum(1 << i for i, g in enumerate(WORDS) if g not in ("text", "about"))
SAYING = {"nav", "menu", "header", "footer", "aside", "form"}
TAG_GROUP = {t: i for i, ts in enumerate(TAGS) for t in ts}


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node, columns NAMES. Nodes are in page order, parents before children."""
    n = len(nodes)
    parent = [node.parent for node in nodes]
    chars, links, tags, blocks, paras, stops, leaves, has = ([0] * n for _ in range(8))
    below, own_words = [0] * n, [sum(1 << LANE * g for g in node.groups) for node in nodes]
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text:
            text = "".join(node.text)
            chars[i] += len(text)
            links[i] += node.links
            stops[i] += sum(map(text.count, STOPS))
            leaves[i] += 1
        tags[i] += node.tags
        p = node.parent
        if p >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
            leaves[p] += leaves[i]
            tags[p] += tags[i] + 1
            blocks[p] += blocks[i] + 1
            paras[p] += paras[i] + (node.tag == "p")
            has[p] |= has[i] | (node.tag in ABOVE[0]) | (node.tag == "h1") << 1
            below[p] += below[i] + own_words[i]
    depth, start, kids, place, alike, over, within, said, said_below = ([0] * n for _ in range(9))
    own = [sum(1 << g for g in node.groups) for node in nodes]
    for i in range(n - 1, -1, -1):
        says = own[i] & SAYS > 0 or nodes[i].tag in SAYING
        said[i] = says
        said_below[i] += says * chars[i]
        if i:
            p = parent[i]
            said_below[p] = min(chars[p], said_below[p] + min(chars[i], said_below[i]))
    kids[0] = 1
    for i, node in enumerate(nodes):
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            said[i] += said[p]
            over[i] = over[p] | own[p]
            within[i] = within[p] | IS_ABOVE.get(nodes[p].tag, 0)
            kids[i] = len(nodes[p].children)
        so_far, last, same = start[i], max(1, len(node.children) - 1), {}
        for c in node.children:
            tag = nodes[c].tag
            same[tag] = same.get(tag, 0) + 1
        for at, c in enumerate(node.children):
            start[c] = so_far
            so_far += chars[c]
            place[c] = at / last
            alike[c] = same[nodes[c].tag] / len(node.children)
    arrays = (np.array(x, float) for x in (chars, links, tags, blocks, paras, stops, leaves, depth, start, kids, place, alike, said_below))
    chars_, links_, tags_, blocks_, paras_, stops_, leaves_, depth_, start_, kids_, place_, alike_, told_ = arrays
    up = np.maximum(np.array(parent), 0)
    total = max(1.0, chars_[0])
    filled = np.maximum(chars_, 1)
    in_links = links_ / filled
    head = np.stack(
        [
            depth_, np.log1p(chars_), in_links, 100 * tags_ / (chars_ + 100), np.log1p(blocks_), paras_ / (blocks_ + 1), chars_ / total, chars_ / filled[up], place_,
            np.log1p(kids_), alike_, np.log1p(chars_ / np.maximum(leaves_, 1)), 100 * stops_ / (chars_ + 20), start_ / total, np.log1p(leaves_), kids_ == 1,
            np.where(np.array(parent) >= 0, in_links[up], 0), np.log1p(start_), np.log1p(np.maximum(0, total - start_ - chars_)),
        ],
        axis=1,
    )
    kind = np.zeros((n, len(TAGS)))
    for i, node in enumerate(nodes):
        if node.tag in TAG_GROUP:
            kind[i, TAG_GROUP[node.tag]] = 1
    bits = lambda masks, k: (np.array(masks)[:, None] >> np.arange(k)) & 1
    counts = np.frombuffer(b"".join(x.to_bytes(N_GROUPS * LANE // 8, "little") for x in below), "<u4").reshape(n, N_GROUPS)
    return np.concatenate([head, kind, bits(own, N_GROUPS), bits(over, N_GROUPS), np.log1p(counts), bits(within, len(ABOVE)), bits(has, 2), np.stack([np.array(said), told_ / filled], axis=1)], axis=1).astype(np.float32)
