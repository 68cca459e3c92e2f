"""Main text of web pages by wrapper induction.

Pages are grouped by host. In a group, each page's DOM tree is aligned with the host's tree so far by
simple tree matching (equal labels, children in order); what has no partner is added to the host's tree.
Blocks that say the same on most pages of different content are constant: the template. The varying
slots are content, unless their place in the tree (navigation, header, footer, sidebar, notice, advert,
form, comments; or mostly links outside the article) says otherwise. If a page has article or main elements, the side
that holds more text, within them or outside, has the content: a teaser is often an article, too. A heading that
recurs at its place is content where it stands between kept slots, right before one of its own section. Within an
article element, names that an article's own parts may have (header, legal, widget) mark nothing; what says the same on
most pages goes all the same.

A host's pages go to groups of GROUP_PAGES pages on average, whatever their lengths, each of which induces its
own wrapper, so a host with a third of all pages is spread over many tasks, and so are the copies of one row, by
the input partition they come from. A group with fewer than LEAST pages of different content has no constant
blocks; places alone decide there. What is the same on nearly all of a site's pages at one place is taken for a
notice inside an article, too.

Nodes match by tag and class names; ids, and class names with digits in them, name single pages. A class or id
marks a place only if all its words are marks (site-footer, not social-history).

Cases: a null or empty html gives the empty text; a null or odd url is a host of its own. Repeated
rows and null ids get a row each; pages of equal content count once as evidence, so copies do not make
their own text constant. Pages are read whole, in time linear in their tags; elements nested deeper than DEPTH are
taken as children of that depth, as browsers do. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_PAGES = 64
#: Up to so many hosts, their page counts are broadcast.
MOST_HOSTS = 100_000
#: A place is constant if it occurs on so many pages of different content and so large a share of them, and this share of its texts is one.
LEAST, OFTEN, SHARE = 3, 0.3, 0.8
#: Deepest element; lists whose lengths' product is larger are matched by halves, which has the same best match in less memory.
DEPTH, CELLS = 512, 40_000

#: What begins with "<", up to its end: a comment, a declaration, or a tag, whose quoted values may hold ">". The second
#: form, in which quotes mean nothing, is for what follows a quote that is never closed.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
LOOSE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noframes")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture".split())
#: What a start tag ends, if it is open within the nearest of the elements named after it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
BARRIERS = frozenset("ul ol dl table select article section div nav aside main header footer body html td th".split())
NOT_TEXT = frozenset("head script style title textarea noscript iframe template nav footer aside form button select datalist svg math canvas object audio video menu dialog xmp noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip status".split())
MARKS = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads adbox advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager comment comments disqus reply replies widget popup modal overlay toolbar search copyright legal disclaimer skip alert".split()
)
#: Marks that an article's own parts may have as names.
WITHIN = frozenset("header masthead topbar widget legal toolbar overlay".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say nothing about a place beside a mark.
PLAIN = frozenset("form site page main top bottom left right box block wrapper container inner outer content section area list item items links bar row column col widget global primary secondary sticky fixed mobile desktop".split())


class Node:
    __slots__ = ("label", "tag", "parent", "children", "skip", "links", "partner", "article", "within", "shape", "count")

    def __init__(self, tag: str, label: str, parent: Node | None, skip: bool):
        self.tag, self.label, self.parent, self.skip = tag, label, parent, skip
        self.children: list[Node] = []
        self.links, self.partner, self.shape, self.count = 0, None, None, 1
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.within = tag == "article" or parent is not None and parent.within


def marked(attrs: dict[str, str], within: bool = False) -> bool:
    """Whether a class name or the id marks a place beside the content (of an article: within it), or an attribute hides it."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = {x for x in WORD.split(name) if x and not x.isdigit()}
        if parts & MARKS and parts <= MARKS | PLAIN and not (within and parts & MARKS <= WITHIN):
            return True
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks in page order: (element, text)."""
    root = Node("", "", None, False)
    stack, blocks, piece = [root], [], []
    inline: Counter = Counter()  # open inline elements, and those of them that are marked, by tag
    hidden: list[str] = []
    opened: Counter = Counter()  # tags on the stack

    def close(first: int) -> None:
        opened.subtract(node.tag for node in stack[first:])
        del stack[first:]

    def flush() -> None:
        nonlocal piece
        if piece and (text := " ".join("".join(piece).split())):
            blocks.append((stack[-1], text))
        piece = []

    def say(text: str) -> None:
        if text and not stack[-1].skip and not hidden:
            text = unescape(text) if "&" in text else text
            piece.append(text)
            if inline["a"]:
                stack[-1].links += len(text)

    at, last, token = 0, html.rfind(">"), TOKEN
    while (begin := html.find("<", at)) >= 0:
        m = token.match(html, begin)
        if m is None and begin <= last and token is TOKEN and html[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
            token = LOOSE  # a quote without end; from here on, quotes mean nothing, so that the page is scanned once more at most
            m = token.match(html, begin)
        if m is None:
            if begin > last and not html.startswith("<!--", begin):  # no tag ends any more
                break
            say(html[at : begin + 1])
            at = begin + 1
            continue
        say(html[at:begin])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                piece.append(" " if tag == "br" else "")
            elif not m[1]:
                inline[tag] += 1
                if hidden or "=" in m[3] and marked(attributes(m[3]), stack[-1].within):
                    hidden.append(tag)
            elif inline[tag]:
                inline[tag] -= 1
                if hidden and tag == hidden[-1]:
                    hidden.pop()
            continue
        flush()
        inline.clear()
        hidden.clear()
        if m[1]:
            if opened[tag]:
                close(max(i for i in range(1, len(stack)) if stack[i].tag == tag))
            continue
        ended = ("p", *ENDS.get(tag, ()))  # a block ends an open paragraph, an item the item before it
        if any(map(opened.__getitem__, ended)):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[i].tag in BARRIERS:
                    break
        attrs = attributes(m[3])
        skip = stack[-1].skip or tag in NOT_TEXT or tag == "header" and not stack[-1].article or bool(attrs) and marked(attrs, stack[-1].within)
        skip = skip and tag not in ("html", "body")
        names = sorted({x for x in attrs.get("class", "").lower().split() if x.isalpha() or not any(c.isdigit() for c in x)})
        node = Node(tag, f"{tag}.{'.'.join(names)}", stack[-1], skip)
        stack[-1].children.append(node)
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            opened[tag] += 1
    say(html[at:])
    flush()
    return root, blocks


def nodes_of(root: Node) -> list[Node]:
    """Each node before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.children
    return out


class Matcher:
    """Simple tree matching. Trees of one shape (labels all the way down) are told apart by nothing, so the size of a
    match is worked out once for two shapes."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], int] = {}

    def shaped(self, root: Node) -> None:
        for node in reversed(nodes_of(root)):
            node.shape = self.shapes.setdefault((node.label, *[x.shape for x in node.children]), len(self.shapes))
            node.count = 1 + sum(x.count for x in node.children)

    def size(self, x: Node, y: Node) -> int:
        """Of the best match of two nodes; 0 for unlike labels. Iterative: trees may be deep."""
        if x.label != y.label:
            return 0
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            key = (a.shape, b.shape)
            if key not in self.known:
                if a.shape == b.shape:
                    self.known[key] = a.count
                elif not a.children or not b.children:
                    self.known[key] = 1
                else:
                    i, j = ends(a.children, b.children)
                    xs, ys = ({z.shape: z for z in some}.values() for some in (a.children[i : len(a.children) - j], b.children[i : len(b.children) - j]))
                    open_pairs = [(u, v) for u in xs for v in ys if u.label == v.label and (u.shape, v.shape) not in self.known]
                    if open_pairs:
                        todo += open_pairs
                        continue
                    self.known[key] = 1 + self.children(a, b)[0]
            todo.pop()
        return self.known[(x.shape, y.shape)]

    def children(self, a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
        """The best match of two nodes' children in order: its size and pairs."""
        xs, ys = a.children, b.children
        # whatever else they could match, trees of one shape at equal ends lose nothing by matching each other
        i, j = ends(xs, ys)
        pairs = [*zip(xs[:i], ys[:i], strict=True), *zip(xs[len(xs) - j :], ys[len(ys) - j :], strict=True)]
        size = sum(x.count for x, _ in pairs)
        xs, ys = xs[i : len(xs) - j], ys[i : len(ys) - j]
        if xs and ys:
            more, middle = (by_halves if len(xs) * len(ys) > CELLS else by_table)(xs, ys, self.size)
            size, pairs = size + more, pairs + middle
        return size, pairs


def ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many at the beginning and, of the rest, at the end are of one shape."""
    most = min(len(xs), len(ys))
    i = 0
    while i < most and xs[i].shape == ys[i].shape:
        i += 1
    j = 0
    while j < most - i and xs[-1 - j].shape == ys[-1 - j].shape:
        j += 1
    return i, j


def tree_match(a: Node, b: Node, matcher: Matcher | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes of one label: the size of the best match, and its pairs of children."""
    if matcher is None:
        matcher = Matcher()
        matcher.shaped(a), matcher.shaped(b)
    size, pairs = matcher.children(a, b)
    return 1 + size, pairs


def by_table(xs: list[Node], ys: list[Node], weight_of) -> tuple[int, list[tuple[Node, Node]]]:
    weight = [[weight_of(x, y) for y in ys] for x in xs]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for p in range(len(xs)):
        for q in range(len(ys)):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + weight[p][q])
    p, q, pairs = len(xs), len(ys), []
    while p and q:
        if best[p][q] == best[p - 1][q]:
            p -= 1
        elif best[p][q] == best[p][q - 1]:
            q -= 1
        else:
            p, q = p - 1, q - 1
            pairs.append((xs[p], ys[q]))
    return best[-1][-1], pairs


def by_halves(xs: list[Node], ys: list[Node], weight_of) -> tuple[int, list[tuple[Node, Node]]]:
    """The best match of two lists in order (Hirschberg): its size and pairs. Rows of best sizes are held, and
    the sizes of matches by pair of shapes, not by pair of nodes."""
    a = [x.shape for x in xs]
    _, first, of = np.unique([y.shape for y in ys], return_index=True, return_inverse=True)
    rows = {}
    for x, kind in zip(xs, a, strict=True):
        if kind not in rows:
            rows[kind] = np.array([weight_of(x, ys[q]) for q in first])

    def best_row(some: list[int], part: np.ndarray) -> np.ndarray:
        """Sizes of the best matches of some of a with the first 0, 1, ... of a part of ys."""
        best = np.zeros(len(part) + 1, np.int64)
        for kind in some:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[kind][part]))
        return best

    todo, pairs, size = [(0, len(xs), 0, len(ys))], [], 0
    while todo:
        p, past_p, q, past_q = todo.pop()
        if p == past_p or q == past_q:
            continue
        if past_p - p == 1:
            weight = rows[a[p]][of[q:past_q]]
            if (most := int(weight.max())):
                pairs.append((xs[p], ys[q + int(weight.argmax())]))
                size += most
            continue
        half = (p + past_p) // 2
        cut = q + int((best_row(a[p:half], of[q:past_q]) + best_row(a[half:past_p][::-1], of[q:past_q][::-1])[::-1]).argmax())
        todo += [(p, half, q, cut), (half, past_p, cut, past_q)]
    return size, pairs


def align(wrapper: Node, page: Node, matcher: Matcher | None = None) -> None:
    """Gives the page's nodes their partners in the wrapper, which grows by what has none, beside its neighbours."""
    matcher = matcher or Matcher()
    matcher.shaped(wrapper), matcher.shaped(page)
    todo = [(wrapper, page)]
    while todo:
        a, b = todo.pop()
        b.partner = a
        matched = tree_match(a, b, matcher)[1] if a.children and b.children else []
        todo += matched
        have = {id(y): x for x, y in matched}
        if len(have) < len(b.children):
            after: dict[int, list[Node]] = {}  # new nodes by the partner of the node before them
            last = 0
            for y in b.children:
                if id(y) in have:
                    last = id(have[id(y)])
                else:
                    x = Node(y.tag, y.label, a, y.skip)
                    after.setdefault(last, []).append(x)
                    todo.append((x, y))
            a.children = [*after.get(0, ()), *(z for x in a.children for z in (x, *after.get(id(x), ())))]


def with_headings(blocks: list[tuple[Node, str]], kept: list[int]) -> list[int]:
    """The kept blocks, and the headings between them that stand right before a kept block of their own section."""
    have = set(kept)
    for i in range(len(blocks) - 2, min(kept, default=len(blocks)), -1):
        node = blocks[i][0]
        if i not in have and i + 1 in have and node.tag in HEADINGS and not node.skip:
            below = blocks[i + 1][0]
            while below is not None and below is not node.parent:
                below = below.parent
            if below is not None:
                have.add(i)
    return sorted(have)


def extract(pages: list[str]) -> list[str]:
    """The main texts of some pages of one host."""
    parsed = [parse(html or "") for html in pages]
    wrapper, matcher, said, seen = Node("", "", None, False), Matcher(), {}, set()
    for root, blocks in parsed:
        align(wrapper, root, matcher)
        content = hash(tuple(text for node, text in blocks if not node.skip))
        if content in seen:
            continue
        seen.add(content)
        for node, text in set((id(node.partner), text) for node, text in blocks):
            said.setdefault(node, Counter())[text] += 1
    often = max(LEAST, OFTEN * len(seen))
    constant = {(node, text) for node, texts in said.items() if (pages := texts.total()) >= often for text, n in texts.items() if n >= SHARE * pages}
    out = []
    for _, blocks in parsed:
        slots = [i for i, (node, text) in enumerate(blocks) if not node.skip and (id(node.partner), text) not in constant]
        inside = [i for i in slots if blocks[i][0].article]
        outside = [i for i in slots if not blocks[i][0].article and blocks[i][0].links < 0.5 * len(blocks[i][1])]
        size = lambda some: sum(len(blocks[i][1]) for i in some)  # noqa: E731, B023
        out.append("\n".join(blocks[i][1] for i in with_headings(blocks, inside if inside and size(inside) >= size(outside) else outside)))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    thin = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)).alias("host"),
        F.spark_partition_id().alias("from"),
    )
    sizes = thin.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).alias("groups"))
    few = sizes.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS
    grouped = thin.join(F.broadcast(sizes) if few else sizes, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "from"), F.col("groups"))).drop("groups", "from")
    if not few:  # the join dealt the pages by host; a large host's groups have to part
        grouped = grouped.repartition("host", "part")

    def induce(group: pa.Table) -> pa.Table:
        texts = extract(group["html"].to_pylist())
        return pa.table({"page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    id_type = thin.schema["page_id"].dataType.simpleString()
    return grouped.groupBy("host", "part").applyInArrow(induce, f"page_id {id_type}, url string, text string, n_chars long")
