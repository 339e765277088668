"""HTML extraction by wrapper induction.

A few pages of each host, one of each of its most frequent layouts, are its pivots. Every different page of the host is
aligned with the pivot of its layout by simple tree matching, over whole trees at any depth. A block of the pivot that a large
share of the pages aligned with it hold there too is template; so is a place where a large share of them hold nothing but
links, a menu. What varies otherwise is a slot. Extracting a page aligns it once more: blocks at template places that are
constant, or links, go; of the slots, those in menus, adverts and other furniture by the elements that hold them go; the rest is
the text. That a page's main element or article is all content is taken only of hosts with too few pages to tell.

Places are counted as rows (host, pivot, block) with partial aggregation, so a host with a third of all pages is no hot key.
Pivots are broadcast if their bytes are few (checked), else joined by host and layout, which adaptive execution can split.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches
from lodestone.llm.url_filter import host_of
from lodestone.sources.scratch import broadcast_if_small, keep

#: A host with fewer different pages has no template: what few pages share may be their text. With fewer than ZONE_PAGES, what
#: lies in the main element or the articles is content and what lies outside is not.
LEAST_PAGES, ZONE_PAGES = 3, 10
#: A template block stands in this share of the pages aligned with its place, and in this share of the host's, so that a layout
#: of some of the pages has its template and a few variants of one text are none.
SHARE, LAYOUT = 0.5, 0.1
#: Pivots of a host, for its most frequent layouts; pages of any other layout are aligned with the first.
PIVOTS = 3
#: Bytes of all pivots that are broadcast.
BROADCAST_BYTES = 16 << 20
#: Cells of the table of an alignment that is traced back at once; larger ones are halved first, to the same optimum.
TABLE = 1 << 22
#: Cells up to which plain lists are quicker than arrays.
FEW = 2048
#: Different subtrees that a task remembers.
SHAPES = 200_000

#: A quote opens a value only behind the sign; one that nothing closes is a letter.
_ATTRIBUTES = r"""(?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    rf"|<(script|style|noscript|template|title|svg|iframe|textarea)(?=[\s>/]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the second set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements in which those may open anew.
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body article main section div td".split())

FURNITURE_TAGS = frozenset("head nav footer aside form button select menu dialog input object canvas audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal"
    " overlay share sharing social comment comments respond reply replies disqus breadcrumb breadcrumbs related recommended subscribe newsletter pagination pager login signup toolbar widget".split()
)
DIGITS = re.compile(r"[0-9]+")
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Last words of a name that still say what its first one says: "ad-slot", "share-buttons".
PART_NAMES = frozenset("area list box bar wrap wrapper inner outer container slot block section left right top bottom item items links buttons unit form".split())


def odd_names(names: list[str]) -> bool:
    """Whether an id or a class names furniture: as a whole, by its last part, or by its first before a word for any part."""
    for name in names:
        parts = re.split(r"[^a-z0-9]+", name.lower().strip("-_"))
        if name.lower() in FURNITURE_NAMES or parts[-1] in FURNITURE_NAMES and len(parts) < 4 or len(parts) == 2 and parts[0] in FURNITURE_NAMES and parts[1] in PART_NAMES:
            return True
    return False


class Node:
    """An element: its label (tag, id and classes), children, own blocks, and what it is by its tag, role and names."""

    __slots__ = ("blocks", "children", "furniture", "header", "holds", "label", "mark", "named", "odd", "parent", "shape", "size", "tag", "zone", "zones")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.label, self.children, self.parent = tag, tag, [], parent
        self.blocks: list[Block] = []
        self.mark: object = None
        self.odd, self.header, self.named, self.zone = tag in FURNITURE_TAGS, tag == "header", False, tag if tag in ("main", "article") else None
        if attributes.strip(" /"):
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('id', '')} {found.get('class', '')}".split()
            self.label = " ".join([tag, *(DIGITS.sub("0", n) for n in names)])
            self.header |= any(n.lower() in ("header", "site-header", "page-header") for n in names)
            # The names of an article, but not their parts, can make it an advert or a comment.
            self.named = any(n.lower() in FURNITURE_NAMES for n in names) if self.zone else odd_names(names)
            self.odd |= found.get("role", "").lower() in FURNITURE_ROLES
            self.odd |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
            if found.get("role", "").lower() == "main":
                self.zone = "main"


class Block:
    """A text block: decoded text with single spaces, the element that holds it, and whether all of it is link text."""

    __slots__ = ("digest", "linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: bool) -> None:
        self.text, self.node, self.linked = text, node, linked
        self.digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(page: str) -> tuple[Node, list[Block]]:
    """(root, blocks in page order) of a page, however broken and deep."""
    root = Node("#root", "", None)
    nodes, stack, blocks, text = [root], [root], [], []
    inline: list[tuple[str, int]] = []  # open inline furniture, and where its text begins
    at, links, free = 0, 0, False  # depth of open links; whether the block has words outside of them

    def end_block() -> None:
        nonlocal free
        if text:
            if block := " ".join(entities.unescape("".join(text)).split()):
                blocks.append(Block(block, stack[-1], not free))
                stack[-1].blocks.append(blocks[-1])
            text.clear()
        inline.clear()
        free = False

    open_tags: dict[str, int] = {}

    def close(depth: int) -> None:
        for n in stack[depth:]:
            open_tags[n.tag] -= 1
        del stack[depth:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            free |= not links and not text[-1].isspace()
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in INLINE:  # part of the block around it
            if tag == "a":
                links = 0 if closing else 1
            if tag in ("br", "img"):
                text.append(" ")
            elif closing and inline and inline[-1][0] == tag:
                del text[inline.pop()[1] :]
            elif not closing and m[4].strip() and (odd := Node(tag, m[4], stack[-1])).odd | odd.named:
                inline.append((tag, len(text)))
            continue
        end_block()
        if closing:
            if open_tags.get(tag, 0) > 0:
                close(max(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    close(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        node = Node(tag, m[4], stack[-1])
        nodes.append(node)
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
        free |= not links
    end_block()
    # Sizes from the leaves up, then what holds for all below from the root down; parents come before their children.
    for node in nodes:
        node.size, node.holds = sum(len(b.text) for b in node.blocks), node.zone is not None
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        node.parent.holds |= node.holds
    for node in nodes:
        up = node.parent
        zones = up.zones if up else frozenset()
        # A name says little of an element with most of the page's text, if its articles are there, or if the page has none and
        # readers' comments are not what it names. The head of an article is part of it; that of a page is not.
        most = 2 * node.size > root.size and (node.holds if root.holds else not COMMENTS & set(node.label.lower().split()))
        node.furniture = (up is not None and up.furniture) or node.odd or (node.named and not most) or (node.header and not zones and not most)
        node.zones = zones | {node.zone} if node.zone and not node.furniture else zones
    return root, blocks


class Shapes:
    """Numbers for different trees of labels, so that trees of one shape are matched once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.children: list[np.ndarray] = []
        self.count: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.epoch = object()

    def number(self, root: Node) -> None:
        """Set ``shape`` of a tree's nodes."""
        if root.mark is self.epoch:
            return
        root.mark = self.epoch
        order, at = [root], 0
        while at < len(order):
            order += order[at].children
            at += 1
        for node in reversed(order):
            key = (node.label, *(c.shape for c in node.children))
            if (n := self.known.get(key)) is None:
                n = self.known[key] = len(self.label)
                self.label.append(node.label)
                self.children.append(np.array(key[1:], dtype=np.int64))
                self.count.append(1 + sum(self.count[c] for c in key[1:]))
            node.shape = n

    def size(self, a: int, b: int) -> int:
        """Nodes in the largest order-preserving match of two trees; 0 if their roots' labels differ."""
        todo, sizes = [(a, b)], self.sizes
        while todo:
            x, y = todo[-1]
            if (x, y) in sizes:
                todo.pop()
            elif self.label[x] != self.label[y] or x == y:
                sizes[x, y] = self.count[x] if x == y else 0
                todo.pop()
            else:
                left, right = self.children[x], self.children[y]
                need = [(p, q) for p in np.unique(left).tolist() for q in np.unique(right).tolist() if (p, q) not in sizes]
                if need:
                    todo += need
                else:
                    sizes[x, y] = 1 + (int(_last_row(self.weights(left, right))[-1]) if len(left) and len(right) else 0)
                    todo.pop()
        return sizes[a, b]

    def weights(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Match sizes of any two of two lists of shapes."""
        p, i = np.unique(left, return_inverse=True)
        q, j = np.unique(right, return_inverse=True)
        met = np.array([[self.size(x, y) for y in q.tolist()] for x in p.tolist()], dtype=np.int64)
        return met[i][:, j]


def _rows(weights: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table of best alignments: of the first i on the left with the first j on the right."""
    row = np.zeros(weights.shape[1] + 1, dtype=np.int64)
    yield row
    for w in weights:
        row = np.maximum.accumulate(np.maximum(row, np.r_[0, row[:-1] + w]))
        yield row


def _last_row(weights: np.ndarray) -> np.ndarray:
    for row in _rows(weights):
        pass
    return row


def align(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), rising in both, of the largest sum of weights."""
    n, m = weights.shape
    if n > 1 and n * m > TABLE:  # halved where both halves together are best, as Hirschberg did
        half = n // 2
        both = _last_row(weights[:half]) + _last_row(weights[half:][::-1, ::-1])[::-1]
        cut = int(both.argmax())
        return align(weights[:half, :cut]) + [(i + half, j + cut) for i, j in align(weights[half:, cut:])]
    best, pairs, i, j = list(_rows(weights)), [], n, m
    while i and j:
        if weights[i - 1, j - 1] and best[i][j] == best[i - 1][j - 1] + weights[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _align_few(left: list[Node], right: list[Node], shapes: Shapes) -> list[tuple[Node, Node]]:
    """``align`` for two short lists of children, without arrays."""
    if len(left) == len(right) and all(x.shape == y.shape for x, y in zip(left, right, strict=True)):
        return list(zip(left, right, strict=True))  # all of both match, in one way only
    sizes, most = shapes.sizes, min(len(left), len(right)) + 1
    others = [(y.shape, y.blocks[0].digest if y.blocks else 0) for y in right]
    row, best, weights = [0] * (len(right) + 1), [], []
    best.append(row)
    for x in left:
        shape, digest, above, at, row, ws = x.shape, x.blocks[0].digest if x.blocks else 0, row, 0, [0], []
        for j, (other, text) in enumerate(others):
            w = sizes.get((shape, other))
            if w is None:
                w = shapes.size(shape, other)
            if w:
                w = w * most + (digest == text)
            ws.append(w)
            at = max(at, above[j + 1], above[j] + w)
            row.append(at)
        best.append(row)
        weights.append(ws)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        w = weights[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def tree_match(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of nodes in a largest order-preserving match; of equally large ones, with most equal texts."""
    shapes = shapes or Shapes()
    if len(shapes.label) > SHAPES or len(shapes.sizes) > 5 * SHAPES:
        shapes.clear()
    shapes.number(a)
    shapes.number(b)
    if a.label != b.label:
        return []
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if len(x.children) * len(y.children) <= FEW:
            todo += _align_few(x.children, y.children, shapes)
        else:
            sizes = shapes.weights(np.array([c.shape for c in x.children]), np.array([c.shape for c in y.children]))
            texts = ([c.blocks[0].digest if c.blocks else 0 for c in z.children] for z in (x, y))
            same = np.equal.outer(*(np.array(t, dtype=np.int64) for t in texts))
            most = min(len(x.children), len(y.children)) + 1
            todo += [(x.children[i], y.children[j]) for i, j in align(np.where(sizes > 0, sizes * most + same, 0))]
    return pairs


def block_pairs(pivot: tuple[Node, list[Block]], page: tuple[Node, list[Block]], shapes: Shapes | None = None) -> list[tuple[int, Block]]:
    """(place, block): the blocks of a page that stand at the place of the pivot's block of that number."""
    place = {id(b): k for k, b in enumerate(pivot[1])}
    return [(place[id(p)], q) for x, y in tree_match(pivot[0], page[0], shapes) for p, q in zip(x.blocks, y.blocks, strict=False)]


def places(pivot: tuple[Node, list[Block]], page: tuple[Node, list[Block]], shapes: Shapes | None = None) -> list[tuple[int, bool, bool]]:
    """(place, whether the pivot's text stands there, whether only links do) of the aligned blocks of a page."""
    return [(k, q.digest == pivot[1][k].digest, q.linked) for k, q in block_pairs(pivot, page, shapes)]


def is_template(often: Column | int, aligned: Column | int, pages: Column | int):
    """Whether so many of a host's pages, of those aligned with a place, make it template."""
    return (often >= LEAST_PAGES) & (often >= SHARE * aligned) & (often >= LAYOUT * pages)


def induce(pages: list[str]) -> tuple[str, list[int], list[int]] | None:
    """The wrapper of one layout's pages: pivot, places of constant blocks, places of links; none of too few pages."""
    different = sorted(set(pages))
    if len(different) < LEAST_PAGES:
        return None
    shapes, pivot = Shapes(), parse(different[0])
    counts = Counter((k, kind) for page in different for k, same, linked in places(pivot, parse(page), shapes) for kind, said in (("all", True), ("same", same), ("linked", linked)) if said)
    inside = len(different) >= ZONE_PAGES
    found = [[k for k, b in enumerate(pivot[1]) if is_template(counts[k, kind], counts[k, "all"], len(different)) and (inside or not b.node.zones)] for kind in ("same", "linked")]
    return different[0], found[0], found[1]


def _among(block: Block) -> set[tuple]:
    """What a block has in common with the entries of one list: alike children of one element, or alike grandchildren."""
    node, up = block.node, block.node.parent
    found = {(node.label, id(up))} if up else set()
    return found | {(node.label, up.label, id(up.parent))} if up and up.parent else found


def extract(page: str, wrapper: tuple[tuple[Node, list[Block]], list[int], list[int]] | None = None, aligned: bool = False, shapes: Shapes | None = None) -> str:
    """The main text of one page: its content slots in page order, one line each.

    Args:
        wrapper: parsed pivot, places of constant blocks, places of links.
        aligned: whether the host's pages were enough; else what lies in the page's main element, or else in its articles, is
            the text, if it has one.
    """
    root, blocks = parse(page)
    gone = set()
    if wrapper:
        pivot, constant, linked = wrapper[0], set(wrapper[1]), set(wrapper[2])
        if constant or linked:
            menus = set()
            for k, q in block_pairs(pivot, (root, blocks), shapes):
                if k in linked and q.linked:
                    gone.add(id(q))
                    menus |= _among(q)
                elif k in constant and q.digest == pivot[1][k].digest:
                    gone.add(id(q))
            # A menu may be longer than the pivot's: its other entries stand beside those that are aligned.
            gone |= {id(q) for q in blocks if q.linked and not menus.isdisjoint(_among(q))} if menus else set()
    left = [b for b in blocks if id(b) not in gone and not b.node.furniture]
    if not aligned:
        for zone in ("main", "article"):
            if any(zone in b.node.zones for b in blocks if not b.node.furniture):
                return "\n".join(b.text for b in left if zone in b.node.zones)
    return "\n".join(b.text for b in left)


def _host() -> Column:
    return F.coalesce(host_of(F.col("url")), F.lit(""))


def _named(pages: DataFrame) -> DataFrame:
    """The host of each page; its layout: a hash of the sections it has, numbers made alike; and a hash of the page."""
    sections = F.regexp_extract_all("html", F.lit(r"(?i)<((?:div|section|nav|aside|header|footer|main|article|form|table)\b[^>]{0,200})"), F.lit(1))
    layout = F.xxhash64(F.array_sort(F.array_distinct(F.transform(sections, lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "0")))))
    return pages.select("page_id", "url", "html", _host().alias("__host"), F.coalesce(layout, F.lit(0)).alias("__layout"), F.coalesce(F.xxhash64("html"), F.lit(0)).alias("__page"))


def choose_pivots(named: DataFrame) -> DataFrame:
    """(host, layout, page, pivot, rank, pages): the page with the least hash of each of a host's most frequent layouts."""
    pages = named.filter(F.col("html").isNotNull()).select("__host", "__layout", "__page").distinct()
    layouts = pages.groupBy("__host", "__layout").agg(F.count(F.lit(1)).alias("n"), F.min("__page").alias("page"))
    totals = layouts.groupBy("__host").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    rank = F.row_number().over(Window.partitionBy("__host").orderBy(F.desc("n"), "__layout"))
    chosen = layouts.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).join(totals, "__host")
    chosen = keep(chosen.select(F.col("__host").alias("host"), F.col("__layout").alias("layout"), "page", "rank", "pages"), "chosen-pivots")
    key = (F.col("__host") == F.col("host")) & (F.col("__layout") == F.col("layout")) & (F.col("__page") == F.col("page"))
    met = named.select("__host", "__layout", "__page", "html").join(broadcast_if_small(chosen, 200_000), key)
    return keep(met.select("host", "layout", "page", F.col("html").alias("pivot"), "rank", "pages").dropDuplicates(["host", "layout"]), "pivots")


def _with_pivots(named: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pages with the pivot of their layout, or the host's first one; null for hosts without."""
    size = pivots.agg(F.sum(F.octet_length("pivot")).alias("n")).first()["n"] or 0
    side = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    wrapper = F.struct(*[c for c in pivots.columns if c not in ("host", "layout", "rank")])
    own = pivots.select(F.col("host").alias("__h1"), F.col("layout").alias("__l1"), wrapper.alias("__own"))
    first = pivots.filter(F.col("rank") == 1).select(F.col("host").alias("__h2"), wrapper.alias("__first"))
    met = named.join(side(own), (F.col("__host") == F.col("__h1")) & (F.col("__layout") == F.col("__l1")), "left")
    met = met.withColumn("__key", F.when(F.col("__own").isNull(), F.col("__host")))  # null where no other pivot is needed
    met = met.join(side(first), F.col("__key") == F.col("__h2"), "left")
    return met.withColumn("wrapper", F.coalesce("__own", "__first"))


class Pivots:
    """Parsed pivots of a task, by their hash."""

    def __init__(self, most: int = 64) -> None:
        self.parsed: dict[int, tuple[Node, list[Block]]] = {}
        self.most = most

    def of(self, page: int, html: str) -> tuple[Node, list[Block]]:
        if page not in self.parsed:
            if len(self.parsed) >= self.most:
                self.parsed.clear()
            self.parsed[page] = parse(html)
        return self.parsed[page]


def induce_wrappers(named: DataFrame) -> DataFrame:
    """``choose_pivots`` with ``constant`` and ``linked``, arrays of places; all pages count, equal ones of a host once."""
    pivots = choose_pivots(named)
    met = _with_pivots(named.filter(F.col("html").isNotNull()), pivots).filter(F.col("wrapper").isNotNull())
    met = met.select(F.xxhash64("__host").alias("host"), "__page", "html", F.col("wrapper.page").alias("page"), F.col("wrapper.pivot").alias("pivot"))
    schema = pa.schema([("host", pa.int64()), ("seen", pa.int64()), ("page", pa.int64()), ("place", pa.int32()), ("zone", pa.bool_()), ("same", pa.bool_()), ("linked", pa.bool_())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, known, given = Shapes(), Pivots(), set()
        for batch in batches:
            rows = []
            for host, seen, html, page, pivot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, seen) in given:
                    continue
                if len(given) > 1 << 18:
                    given.clear()
                given.add((host, seen))
                tree = known.of(page, pivot)
                rows += [(host, seen, page, k, bool(tree[1][k].node.zones), same, linked) for k, same, linked in places(tree, parse(html), shapes)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    key = ["host", "page", "place", "zone"]
    once = met.mapInArrow(placed, "host long, seen long, page long, place int, zone boolean, same boolean, linked boolean").groupBy(*key, "seen").agg(F.first("same").alias("same"), F.first("linked").alias("linked"))
    counts = once.groupBy(*key).agg(F.count(F.lit(1)).alias("aligned"), F.count_if("same").alias("same"), F.count_if("linked").alias("linked"))
    counts = keep(counts.filter(F.greatest("same", "linked") >= LEAST_PAGES), "place-counts").withColumnRenamed("page", "pivot_page")
    hosts = pivots.select(F.xxhash64("host").alias("__host"), F.col("page").alias("__page"), "pages").distinct()
    judged = counts.join(hosts, (F.col("host") == F.col("__host")) & (F.col("pivot_page") == F.col("__page"))).filter(~F.col("zone") | (F.col("pages") >= ZONE_PAGES))
    kinds = [F.collect_set(F.when(is_template(F.col(kind), F.col("aligned"), F.col("pages")), F.col("place"))).alias(name) for kind, name in (("same", "constant"), ("linked", "links"))]
    found = judged.groupBy(F.col("host").alias("__host"), F.col("pivot_page").alias("__page")).agg(*kinds)
    met = pivots.join(found, (F.xxhash64("host") == F.col("__host")) & (F.col("page") == F.col("__page")), "left")
    return keep(met.select(*pivots.columns, F.coalesce("constant", F.array()).alias("constant"), F.coalesce("links", F.array()).alias("links")), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``.

    A null html is empty and gives an empty text; a null url belongs to the host without a name. Other columns are
    ignored; repeated rows are extracted alike.
    """
    text_batches(pages.sparkSession)
    named = _named(pages)
    wrappers = induce_wrappers(named)
    met = _with_pivots(named, wrappers).select("page_id", "url", "html", *[F.col(f"wrapper.{c}").alias(f"__{c}") for c in ("page", "pivot", "constant", "links", "pages")])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, known = Shapes(), Pivots()
        for batch in batches:
            texts = []
            for html, page, pivot, constant, links, n in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                wrapper = (known.of(page, pivot), constant, links) if n else None
                texts.append(extract(html or "", wrapper, bool(n) and n >= ZONE_PAGES, shapes))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(extracted, f"page_id {kind}, url string, text string")
