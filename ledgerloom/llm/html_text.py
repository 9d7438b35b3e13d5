"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

Every element gets its characters, tags, link characters and link tags. The density is characters per tag, adjusted for
links; an element's density sum is the sum over its children. The subtree of the largest sum sets a threshold, the
smallest density on its path to the body; elements above it are searched for their own best subtree, and those subtrees
are chosen. That holds inside article and main elements too; what else such an element has comes with a chosen subtree
in it, unless links make its density fall below the threshold. Elements that never are main text (menus, asides, forms,
comments and the like) are left out before anything is counted, but by a class or id alone only if the rest of the page
has most of the text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([!?/])[^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+(?:\Z|(?=<)|>)""", re.S)
#: The same without regard to quotes, for what follows a quote that nothing closes: every tag ends at the next bracket.
PLAIN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(?:>|\Z|(?=<))|<([!?/])[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements by kind (HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend optgroup option".split())
NEVER = frozenset("nav footer aside form script style noscript iframe template svg canvas object select button menu dialog textarea title head noembed noframes input math audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Class and id words of side matter, of reader comments, and words that make a name a state of the page instead.
NAMES = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer foot colophon sidebar aside rail widget widgets ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar skip hidden copyright form search side sidenav subnav topnav topmenu leftnav rightnav mainmenu navmenu announcement announcements outbrain taboola teaser teasers".split())
REMARKS = frozenset("comment comments commentlist disqus discussion respond reply replies responses remarks guestbook".split())
STATES = frozenset("has with no not without enabled disabled open closed on off free sticky layout xs sm md lg xl".split())
#: Ids that mark side matter inside an article; there, names say nothing of elements of running text.
IDS = frozenset("comments respond disqus_thread sidebar newsletter share sharing related".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption span b i em strong a u s q cite code mark small sub sup abbr time label".split())
#: An open element of the key's name is closed by a start of one of these, up to the nearest of the second set.
CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Share of link characters from which an element whose density is below the threshold is side matter.
LINKED = 0.5


class Node:
    __slots__ = ("name", "kids", "parent", "depth", "block", "drop", "named", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, name: str, parent: Node | None) -> None:
        self.name, self.parent, self.drop, self.named = name, parent, False, ""
        self.depth = 0 if parent is None else parent.depth + 1
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.block = self if name in BLOCK or parent is None else parent.block
        self.kids: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        return (k for k in self.kids if isinstance(k, Node) and not k.drop)


def says(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id has one of the names as a word of its own, or as first or last part of one."""
    for word in value.split():
        parts = [x for x in re.split(r"[^a-z]+", word) if x]
        if parts and not STATES.intersection(parts) and (parts[0] in names or parts[-1] in names):
            return True
    return False


def judge(node: Node, attributes: str) -> None:
    """Sets drop if an element never is main text; named, if only its class or id says so (side or remark)."""
    if node.name in NEVER or node.name == "header" and not node.inside:
        node.drop = True
        return
    if not attributes or node.name in ("html", "body"):
        return
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "role" and value in ROLES or key == "style" and re.search(r"display\s*:\s*none", value):
            node.drop = True
            return
        if key not in ("class", "id") or node.inside and node.name in TEXT:
            continue
        if key == "id" and node.inside and node.name not in ("article", "main"):
            node.named = ("remark" if says(value, REMARKS) else "side") if value.strip() in IDS else node.named
        elif says(value, REMARKS):
            node.named = "remark"
        elif says(value, NAMES) and not node.named and node.name not in ("article", "main"):
            node.named = "side"
        elif node.name == "article" and says(value, frozenset(("promo", "sponsored", "ad", "advert", "related", "teaser"))) and not node.named:
            node.named = "side"


class Open:
    """The open elements: the current one, and a stack by name, so that nothing is looked for in vain."""

    def __init__(self, root: Node) -> None:
        self.node, self.by_name = root, {root.name: [root]}

    def add(self, child: Node) -> None:
        self.node = child
        self.by_name.setdefault(child.name, []).append(child)

    def close(self, last: Node) -> None:
        """Closes all elements from the current one up to `last`, which isn't the root."""
        while True:
            done = self.node
            self.by_name[done.name].pop()
            self.node = done.parent
            if done is last:
                return

    def nearest(self, names: tuple[str, ...]) -> Node | None:
        return max((s[-1] for n in names if (s := self.by_name.get(n))), key=lambda x: x.depth, default=None)

    def outermost(self, names: tuple[str, ...], below: int) -> Node | None:
        """The outermost open element of the names that is deeper than `below`."""
        found = [s[i] for n in names if (s := self.by_name.get(n)) and (i := bisect_right(s, below, key=lambda x: x.depth)) < len(s)]
        return min(found, key=lambda x: x.depth, default=None)


def parse(page: str) -> Node:
    """The page's element tree; end tags that match nothing are skipped, open elements end with their parent. Every
    step costs what it reads or closes, so that hostile pages take no longer than others of their length."""
    root = Node("html", None)
    tree, token, at, body = Open(root), TOKEN, 0, False
    while True:
        m = token.search(page, at)
        if m is None:
            tree.node.kids.append(page[at:])
            return root
        if token is TOKEN and not m[2] and not m[4] and not m[0].startswith("<!--"):
            token = PLAIN
            continue
        if m.start() > at:
            tree.node.kids.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            found = tree.by_name.get(name)
            if found and found[-1] is not root:
                tree.close(found[-1])
            elif name == "br":
                tree.node.kids.append(" ")
            continue
        if name in ENDS_P and tree.node.block.name == "p":
            tree.close(tree.node.block)
        if name in CLOSED_BY:
            names, stop = CLOSED_BY[name]
            edge = tree.nearest(stop)
            last = tree.outermost(names, edge.depth if edge else 0)
            if last is not None:
                tree.close(last)
        if name in ("html", "body"):
            if name == "body" and tree.by_name.get("head"):
                tree.close(tree.by_name["head"][0])
            if name == "html" or body:
                continue
            body = True
        elif tree.node.name == "head" and name not in RAW and name not in ("meta", "link", "base", "template"):
            tree.close(tree.node)
        child = Node(name, tree.node)
        judge(child, m[3])
        tree.node.kids.append(child)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            child.drop = True
            at = end.end() if end else len(page)
        elif name not in VOID and (not m[3].endswith("/") or name not in BLOCK and name != "svg"):
            tree.add(child)


def tree_order(root: Node) -> list[Node]:
    """The elements that count, parents first; no recursion, as pages may be nested deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(list(node.elements())))
    return order


def count(order: list[Node]) -> None:
    """Sets every element's characters, tags, link characters and link tags."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += sum(map(len, k.split()))
            elif not k.drop:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.name == "a")
        if node.name == "a":
            node.link_chars = node.chars


def drop_named(root: Node) -> None:
    """Drops elements whose class or id says that they are side matter, but for one that is the page's frame (or its
    article's): an h1, article or main element in it has more than half of the text; or it has every such element and a
    quarter of the text; or there is none, and it has more than half. Reader comments may well be longer than what they
    are about: for those only the first will do."""
    order = tree_order(root)
    count(order)
    most: dict[int, int] = {}  # characters of an element's largest article or main element; of an h1, its own
    heads: dict[int, int] = {}  # how many of these an element has, itself included
    whole: dict[int, int] = {}  # characters of the article or page that an element is in
    for node in reversed(order):
        is_head = node.name in ("h1", "article", "main") and not node.named and node.chars > 0
        most[id(node)] = max([node.chars * is_head, *(most[id(k)] for k in node.elements())])
        heads[id(node)] = is_head + sum(heads[id(k)] for k in node.elements())
    for node in order:
        up = node.parent
        whole[id(node)] = node.chars if up is None or node.name in ("article", "main") and not node.named else whole[id(up)]
        if node.named and up is not None:
            text = whole[id(up)]
            alone = node.named == "side" and heads[id(node)] == heads[id(root)]
            node.drop = not (2 * most[id(node)] > text or alone and (4 if heads[id(node)] else 2) * node.chars > text)


def weigh(order: list[Node]) -> None:
    """Sets every element's composite density, the sum over its children, and its subtree's element of the largest sum
    (the first of equal ones)."""
    count(order)
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        node.density = 0.0
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / math.log(max(base, math.e))
        node.total = sum(k.density for k in node.elements()) + (c / t if any(isinstance(k, str) and k.strip() for k in node.kids) else 0.0)
        node.best = max([node, *(k.best for k in node.elements())], key=lambda x: x.total)


def dense(start: Node) -> tuple[list[Node], float]:
    """The subtrees that the method chooses, in page order, and its threshold."""
    limit, up = start.best.density, start.best
    while up is not start:
        up = up.parent
        limit = min(limit, up.density)
    marked = {id(x.best) for x in tree_order(start) if x.chars and x.density >= limit}
    found, todo = [], [start]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            found.append(node)
        else:
            todo.extend(reversed(list(node.elements())))
    return found, limit


def chosen(root: Node) -> list[Node]:
    """The subtrees that are main text, in page order.

    A chosen subtree inside an article or main element brings that element; one that has such elements with more than
    half of its text is those of them that reach the threshold. In what comes so, elements that are mostly links and
    whose density is below the threshold are dropped.
    """
    drop_named(root)
    order = tree_order(root)
    weigh(order)
    start = next((x for x in order if x.name == "body" and x.chars), root)
    if not start.chars:
        return []
    found, limit = dense(start)
    out: list[Node] = []
    for node in found:
        holder, up = None, node
        while up is not start.parent:
            holder = up if up.name in ("article", "main") else holder
            up = up.parent
        if holder is None:
            inner = [x for x in tree_order(node) if x.name in ("article", "main") and not x.inside and x.chars]
            inner = inner if 2 * sum(x.chars for x in inner) > node.chars else []
            out += [x for x in inner if x.density >= limit] or inner[:1] or [node]
        elif holder not in out[-1:]:
            out.append(holder)
    for top in out:
        for node in tree_order(top)[1:]:
            if node.name not in TEXT and node.link_tags > 1 and node.link_chars > LINKED * node.chars and node.density < limit:
                node.drop = True
    return out


def blocks(node: Node) -> Iterator[str]:
    """A subtree's blocks, white space turned into single spaces, empty ones left out."""
    text: list[str] = []

    def close() -> Iterator[str]:
        if joined := " ".join("".join(text).split()):
            yield joined
        text.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            yield from close()  # an element's end
        elif isinstance(x, str):
            text.append(html.unescape(x))
        elif x.name == "br":
            text.append(" ")
        elif not x.drop:
            if x.name in BLOCK:
                yield from close()
                todo.append(None)
            todo.extend(reversed(x.kids))
    yield from close()


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by line feeds; empty for null, blank or text-free pages."""
    if not page or not page.strip():
        return ""
    return "\n".join(b for node in chosen(parse(page)) for b in blocks(node))


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    A null, empty or unreadable html gives an empty text; ids and urls may be null or repeated; an empty table gives
    an empty result; other columns are not read. Each page is worked on alone, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
