"""Main text of web pages by composite text density.

For every node of the page's tree: C characters, T tags, LC characters in links,
LT link tags. Composite text density is

    C/T * log_b(C/LC * T/LT),   b = ln(C*LC/(C-LC) + C*LC(body)/C(body) + e)

(zero counts become 1). A node's density sum is the sum over its children (a run
of text counts as a child of one tag). The node of greatest sum is the core of the
article. The least density on its path to the body is the threshold: on the way up
an ancestor joins whole if what it adds is not mostly links and holds a child whose
density reaches the threshold, a heading, list or table, or (in an ``article`` element around the
core) any text; the first ancestor that adds something else ends the way.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments are cut from the tree first: by element and role; by a word of class or id
(``MARKS``) unless the element is a wrapper, with half of the page's unlinked text and an
article, a page heading or paragraphs in it; and by a weaker word (``HINTS``) if the element is mostly links or short.
Blocks of links alone at the edges of the chosen subtree go too, if it is no ``article``.
Nothing else inside it is dropped or capped. Character references are
decoded, white space in a block is one space, blocks are joined by two newlines.

Null html is empty and gives an empty text; a page without tags is one block; an empty
table gives an empty result. Columns besides page_id, url and html are ignored.
Repeated rows give repeated results; each page is handled by itself. A very long or
deeply nested page takes time in proportion to its length. Of equal sums the
outermost, first node is taken.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphspark.llm import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements that never hold article text.
CUT = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object canvas audio video dialog menu noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
#: A start tag in a set ends an open element of the key.
ENDS = {
    "p": BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "caption"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option"}), "head": frozenset({"body", "div", "p", "article", "main", "section", "h1", "nav", "header", "ul", "table"}),
}
CLOSERS = {tag: [k for k, ends in ENDS.items() if tag in ends] for tag in frozenset().union(*ENDS.values())}
#: An end or start tag does not reach through these to close p, li and the like.
SCOPE = frozenset("html body article main section div table td th ul ol dl nav aside footer header form".split())
#: Words of class and id that mark page furniture.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter pagination pager".split())
#: Words that mark furniture only with a sign of it: many links or little text.
HINTS = frozenset("banner banners promo promotion subscribe subscription signup login share sharing social related recommended widget skip".split())
#: A hinted element stays with so many characters, or with a heading and a paragraph of PROSE.
LONG, PROSE, LINKED = 400, 80, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of articles whatever their density.
STRUCTURE = HEADINGS | frozenset("table ul ol dl pre blockquote figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


def furniture(tag: str, attrs: str, in_article: bool) -> int:
    """2: surely furniture; 1: by a word of MARKS; -1: by a word of HINTS; 0: not."""
    if tag in CUT or tag == "header" and not in_article:
        return 2
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name in ("class", "id"):
            words = SPLIT.split(value)
            found = 1 if found == 1 or not MARKS.isdisjoint(words) else found or -(not HINTS.isdisjoint(words))
    return found


class Node:
    __slots__ = ("tag", "parent", "children", "mark", "cut", "holds", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0, cut: bool = False):
        self.tag, self.parent, self.mark, self.cut, self.children = tag, parent, mark, cut, []


class Open:
    """The open elements, with the places of each name, so that no step walks over all of them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes, self.articles = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.articles += node.tag in ("article", "main")
        self.stack.append(node)

    def close(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.articles -= tag in ("article", "main")

    def last(self, tag: str) -> int:
        """The innermost open element of that name; 0 if none."""
        return (self.places.get(tag) or (0,))[-1]

    def start(self, tag: str) -> None:
        """A start tag closes the element that cannot hold it, but not through an element of SCOPE."""
        k = max((self.last(x) for x in CLOSERS.get(tag, ())), default=0)
        if k and k >= self.scopes[-1]:
            self.close(k)

    def end(self, tag: str) -> bool:
        k = self.last(tag)
        if not k or tag not in SCOPE and k < self.scopes[-1]:
            return False
        self.close(k)
        return True


def tree(page: str) -> Node:
    """The page's tree without what is surely furniture; children are nodes and texts."""
    root = Node("body", None)
    opened, pos = Open(root), 0
    for m in TOKEN.finditer(page):
        if m.start() < pos:
            continue
        at = opened.stack[-1]
        if m.start() > pos and not at.cut:
            at.children.append(page[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            if not at.cut:
                at.children.append(m[1].replace("&", "&amp;"))
            continue
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), (m[2] or m[5]) == "/", (m[4] or m[7] or "")
        if closing:
            if tag in ("body", "html"):
                while at.cut:  # furniture that was never closed
                    opened.close(len(opened.stack) - 1)
                    at = opened.stack[-1]
            elif not opened.end(tag) and tag in ("p", "br") and not at.cut:
                at.children.append(Node(tag, at))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(page, pos)
            close = page.find(">", end.start())
            pos = len(page) if close < 0 else close + 1
            continue
        opened.start(tag)
        if tag in ("html", "body"):
            continue
        at = opened.stack[-1]
        mark = 2 if at.cut else furniture(tag, attrs, opened.articles > 0)
        node = Node(tag, at, mark, cut=mark == 2)
        if not node.cut:
            at.children.append(node)
        elif not at.cut:
            at.children.append(gap(tag, at))
        if tag not in VOID and not (node.cut and attrs.endswith("/")):
            opened.push(node)
    if pos < len(page) and not opened.stack[-1].cut:
        opened.stack[-1].children.append(page[pos:])
    return root


def gap(tag: str, parent: Node) -> Node | str:
    """What stands where an element was cut."""
    return Node("hr", parent) if tag in BLOCK else " "


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    return order


def count(root: Node) -> list[Node]:
    """Characters, tags and their linked parts of every node; all nodes, parents first."""
    order = nodes(root)
    for node in reversed(order):
        inner = [x for x in node.children if isinstance(x, Node)]
        node.chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) + sum(x.chars for x in inner)
        node.tags = (node.tag == "a") + sum(x.tags + (x.tag != "a") for x in inner)  # a link counts itself
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars, node.link_tags = sum(x.link_chars for x in inner), sum(x.link_tags for x in inner)
    return order


def prune(root: Node) -> None:
    """Cut the elements that a word marks as furniture and whose content agrees."""
    order = nodes(root)
    for node in order:
        node.children = [(html.unescape(x) if "&" in x else x) if isinstance(x, str) else x for x in node.children]
    if not any(x.mark for x in order):
        return
    order = count(root)
    whole = root.chars - root.link_chars
    for node in reversed(order):  # (page headings and articles, headings, paragraphs of prose) inside
        inner = [x.holds for x in node.children if isinstance(x, Node)]
        own = (node.tag in ("article", "main", "h1"), node.tag in HEADINGS, node.tag == "p" and node.chars >= PROSE)
        node.holds = tuple(sum(x) for x in zip(own, *inner))
    for node in order:
        core, heads, prose = node.holds
        if node.mark == 1:
            gone = 2 * (node.chars - node.link_chars) < whole or not core and prose < 2
        elif node.mark == -1:
            gone = node.link_chars > LINKED * node.chars or node.chars < LONG and not (heads and prose)
        else:
            continue
        if gone:
            above = node.parent.children
            above[next(i for i, x in enumerate(above) if x is node)] = gap(node.tag, node.parent)


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums; all nodes, parents first."""
    order = count(root)
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        own = sum(len(x) for x in node.children if isinstance(x, str) and not x.isspace())
        node.total = own + sum(x.density for x in node.children if isinstance(x, Node))
    return order


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density of C, T, LC, LT; share: linked characters of the body."""
    t, lt = max(1, t), max(1, lt)
    base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
    inner = c / max(1, lc) * t / lt
    if not c or base > 1 and inner <= 1:
        return 0.0
    return c / t * (math.log(inner) / math.log(base) if base > 1 else 1.0)


def joins(above: Node, core: Node, threshold: float) -> bool:
    """Whether what ``above`` adds to its child ``core`` belongs to the article."""
    extra, links = above.chars - core.chars, above.link_chars - core.link_chars
    if links > LINKED * extra:
        return False
    if not extra or above.tag == "article":
        return True
    for x in above.children:
        if isinstance(x, str):
            if len(x.strip()) >= max(1.0, threshold):
                return True
        elif x is not core and x.chars and (x.density >= threshold or x.tag in STRUCTURE):
            return True
    return False


def choose(root: Node) -> Node:
    """The subtree of the article (see the module)."""
    order = measure(root)
    best = max((x for x in order if x.tag in BLOCK or x is root), key=lambda x: x.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for above in path[1:]:
        if not joins(above, best, threshold):
            break
        best = above
    if best.tag != "article":
        trim(best)
    return best


def trim(node: Node) -> None:
    """Take off blocks of several links and hardly any other text before and after all else."""
    for side in (0, -1):
        while node.children:
            x = node.children[side]
            links = isinstance(x, Node) and x.tag in BLOCK and x.link_tags > 1 and x.link_chars > 0.8 * x.chars
            if links or (not x.strip() if isinstance(x, str) else not x.chars):
                node.children.pop(side)
            else:
                break


def blocks(node: Node) -> list[str]:
    found, line = [], []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            found.append("".join(line))
            line.clear()
        elif isinstance(x, str):
            line.append(x)
        else:
            if x.tag in BLOCK:
                found.append("".join(line))
                line.clear()
                todo.append(None)
            elif x.tag in ("br", "td", "th", "wbr", "img"):
                line.append("" if x.tag == "wbr" else " ")
            todo += reversed(x.children)
    found.append("".join(line))
    return [y for y in (" ".join(x.split()) for x in found) if y]


def main_text(page: str) -> str:
    if not page:
        return ""
    root = tree(page)
    prune(root)
    return "\n\n".join(blocks(choose(root)))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text and n_chars; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for lo, hi, _, _ in common.chunks(batch, "html"):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(x or "") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(common.freed(run), "page_id bigint, url string, text string, n_chars bigint")
