"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

A page becomes a small tree of its block elements. Trees score each node from its own tag and attribute tokens, those
of its ancestors, subtree text, link and tag density, depth and siblings. Decoding picks the best consistent states:
outside, inside the article, cut out of it; below something cut out nothing is inside again. The model learns from a
bounded sample of the pages themselves: landmark elements label it, and variants of the same pages, with landmarks
renamed and notices, forms, comments or side columns put in, teach it the rest.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import query, slices, table

#: Pages that learning sees, about, and the longest among them in characters.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 40_000
VARIANTS = 3
BLOCK_PAGES = 200
# element names and attribute tokens, as web pages use them (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe svg math object".split())
DROPPED = frozenset("head title meta link base select option button textarea input canvas audio video".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSE_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
GOOD = frozenset("article articlebody body content entry main page paragraph post story text prose".split())
BAD = frozenset("ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs byline comment comments consent cookie cookies footer form header login "
                "masthead menu meta nav navbar navigation newsletter notice pagination popup promo promoted related reply respond search share sharing sidebar "
                "signup social sponsor sponsored subscribe tags toolbar widget".split())
TAGS = ("article", "main", "section", "div", "p", "nav", "footer", "header", "aside", "form", "ul", "li", "h1", "h2", "h3", "table", "blockquote", "pre", "figure")
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-y|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"[a-z]+")
MARKED = ("main", "article", "nav", "footer", "header", "aside", "form")


class Node:
    __slots__ = ("tag", "parent", "children", "pieces", "depth", "tokens", "label", "chars", "links", "tags", "marks", "own", "paragraphs", "size")

    def __init__(self, tag: str, parent: "Node | None", attributes: str):
        self.tag, self.parent, self.children, self.pieces = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.label = parent.label if parent else 0
        self.chars = self.links = self.tags = self.marks = self.own = self.paragraphs = self.size = 0
        found = ATTRIBUTE.findall(attributes) if "=" in attributes else ()
        self.tokens = set()
        for name, *values in found:
            value = "".join(values)
            if name == "data-y":
                self.label = int(value == "1")
            elif name == "aria-hidden":
                continue
            else:
                self.tokens.update(TOKEN.findall(value.lower()))


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only add text, and link characters, to their block.

    Open paragraphs end at the next block, list items and cells at the next of their kind; a page that breaks off
    simply ends. ``pieces`` holds text strings and child nodes in page order.
    """
    root = Node("html", None, "")
    open_nodes, links = [root], 0
    at = 0
    while m := MARKUP.search(page, at):
        if m.start() > at:
            _text(open_nodes[-1], page[at:m.start()], links)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, name, attributes = (m[1] or m[4]) == "/", name.lower(), m[3] or m[6] or ""
        node = open_nodes[-1]
        node.tags += 1
        if name in RAW or name == "title":
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in INLINE or name in VOID:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            elif name in ("br", "hr", "wbr", "img"):
                node.pieces.append(" ")
            if name == "hr":
                _close(open_nodes, "p", CLOSED_BY_BLOCK - {"p"})
            continue
        if closing:
            if name not in ("html", "body"):
                _close(open_nodes, name, frozenset())
            links = 0
            continue
        if name in ("html", "body"):
            node.tokens.discard("")
            continue
        if name in CLOSED_BY_BLOCK:
            _close(open_nodes, "p", CLOSED_BY_BLOCK - {"p"})
        if name in CLOSE_SAME:
            _close(open_nodes, name, frozenset(CLOSE_SAME[name].split()))
        if not attributes.endswith("/") or name not in VOID:
            child = Node(name, open_nodes[-1], attributes)
            open_nodes[-1].children.append(child)
            open_nodes[-1].pieces.append(child)
            open_nodes.append(child)
            links = 0
    if at < len(page):
        _text(open_nodes[-1], page[at:], links)
    return root


def _text(node: Node, text: str, links: int) -> None:
    node.pieces.append(text)
    n = len(text) - text.count(" ") - text.count("\n")
    node.own += n
    if links:
        node.links += n
    node.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")


def _close(open_nodes: list[Node], name: str, stop: frozenset) -> None:
    """Close the innermost open ``name``, unless an element of ``stop`` or none is met first."""
    for i in range(len(open_nodes) - 1, 0, -1):
        if open_nodes[i].tag == name:
            del open_nodes[i:]
            return
        if open_nodes[i].tag in stop:
            return


def in_order(root: Node) -> list[Node]:
    """Nodes, parents before children; subtree sums filled in."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in order:
        node.chars, node.size = node.own, 1
        node.paragraphs = int(node.tag == "p")
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
            up.marks += node.marks
            up.size += node.size
            up.paragraphs += node.paragraphs
    return order


def features(order: list[Node]) -> np.ndarray:
    """One row per node of a page."""
    total = max(1, order[0].chars)
    rows, path = [], {}
    places = {id(child): k for node in order for k, child in enumerate(node.children)}
    for node in order:
        up = node.parent
        above = path[id(up)] if up else (0,) * (len(MARKED) + 2)
        good, bad = len(node.tokens & GOOD), len(node.tokens & BAD)
        here = tuple(int(a or node.tag == t) for a, t in zip(above, MARKED)) + (above[-2] + good, above[-1] + bad)
        path[id(node)] = here
        siblings = up.children if up else [node]
        place = places.get(id(node), 0)
        before = siblings[place - 1].chars if place and place - 1 < len(siblings) else 0
        after = siblings[place + 1].chars if place + 1 < len(siblings) else 0
        chars = max(1, node.chars)
        rows.append([np.log1p(node.chars), np.log1p(node.own), node.links / chars, node.tags / chars, node.marks / chars, node.chars / total,
                     node.chars / max(1, up.chars) if up else 1.0, node.depth, len(siblings), place / len(siblings), np.log1p(before), np.log1p(after),
                     len(node.children), node.paragraphs, np.log1p(up.chars) if up else 0.0, up.links / max(1, up.chars) if up else 0.0,
                     good, bad, *here, *[node.tag == t for t in TAGS], node.tag in DROPPED])
    return np.array(rows, np.float32)


def decode(order: list[Node], prob: np.ndarray) -> set[int]:
    """Ids of the nodes whose own text is article text, by the best consistent states over the whole tree."""
    p = np.clip(prob, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    place = {id(node): i for i, node in enumerate(order)}
    best = np.zeros((len(order), 3))  # outside, inside, cut out
    for i in range(len(order) - 1, -1, -1):
        kids = [place[id(c)] for c in order[i].children]
        below = best[kids] if kids else np.zeros((0, 3))
        best[i] = (no[i] + below[:, :2].max(axis=1).sum(), yes[i] + below[:, 1:].max(axis=1).sum(), no[i] + below[:, 2].sum())
        if order[i].tag in DROPPED:
            best[i, 1] = -1e9
    state = np.zeros(len(order), np.int64)
    inside = set()
    for i, node in enumerate(order):
        if node.parent is None:
            state[i] = int(best[i, 1] > best[i, 0])
        else:
            above = state[place[id(node.parent)]]
            state[i] = (int(best[i, 1] > best[i, 0]), 1 + int(best[i, 2] > best[i, 1]), 2)[above]
        if state[i] == 1:
            inside.add(id(node))
    return inside


def text_of(root: Node, inside: set[int]) -> str:
    """Article text: character references decoded, one space for white space within a block, blocks joined by a line feed."""
    blocks: list[str] = []
    stack: list[tuple[Node, int, list[str]]] = [(root, 0, [])]

    def flush(parts: list[str]) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    while stack:
        node, i, parts = stack.pop()
        if i == len(node.pieces):
            flush(parts)
            continue
        piece = node.pieces[i]
        stack.append((node, i + 1, parts))
        if isinstance(piece, Node):
            flush(parts)
            stack.append((piece, 0, []))
        elif id(node) in inside:
            parts.append(piece)
    return "\n".join(blocks)


def variant(page: str, spare: list[str], rng: np.random.Generator) -> str:
    """A labelled copy of a page: landmarks carry ``data-y``, some renamed, with unwanted blocks put in around and inside."""
    def pick(options):
        return options[int(rng.integers(len(options)))]

    def say(n: int) -> str:
        return "".join(f"<p>{pick(spare)}</p>" for _ in range(n))

    rename = rng.random() < 0.6
    article = pick(['div class="post-content"', 'div id="content"', 'main', 'section class="story-body"', 'div class="article-text"', 'article class="entry"']) if rename else "article"
    menu = pick(['div class="menu"', 'div id="navigation"', 'ul class="nav"', 'nav']) if rename else "nav"
    bottom = pick(['div class="footer"', 'div id="site-footer"', 'footer']) if rename else "footer"
    advert = pick(['div class="advert"', 'div class="promo banner"', 'aside class="sponsored"', 'div class="ads"']) if rename else 'div class="ad"'

    def swap(text: str, tag: str, new: str, label: int) -> str:
        opened = re.compile(rf"<{tag}\b[^>]*>")
        text = opened.sub(f'<{new} data-y="{label}">', text)
        return text.replace(f"</{tag}>", f"</{new.split()[0]}>") if tag != "div" else text

    page = re.sub(r'<div class="ad">(.*?)</div>', lambda m: f'<{advert} data-y="0">{m[1]}</{advert.split()[0]}>', page, flags=re.DOTALL)
    for tag, new, label in (("article", article, 1), ("main", article, 1), ("nav", menu, 0), ("footer", bottom, 0), ("aside", "aside", 0), ("header", "header", 0), ("form", "form", 0)):
        page = swap(page, tag, new, label)
    links = "".join(f'<li><a href="/{k}">{pick(spare)[:30]}</a></li>' for k in range(int(rng.integers(2, 7))))
    extras = [f'<header class="site-header" data-y="0"><h1>{pick(spare)[:40]}</h1></header>', f'<aside class="sidebar" data-y="0"><h3>{pick(spare)[:20]}</h3><ul>{links}</ul>{say(1)}</aside>',
              f'<div class="cookie-notice" data-y="0">{say(1)}<button>OK</button></div>', f'<section class="comments" data-y="0"><h3>Comments</h3><div class="comment">{say(2)}</div><div class="comment">{say(1)}</div></section>',
              f'<form action="/s" data-y="0"><label>{pick(spare)[:20]}</label><input name="q"></form>', f'<div class="related" data-y="0"><ul>{links}</ul></div>', f'<{advert} data-y="0">{say(1)}</{advert.split()[0]}>',
              f'<div id="comments" data-y="0"><ol><li>{say(1)}</li><li>{say(2)}</li></ol></div>', f'<div class="newsletter signup" data-y="0">{say(1)}</div>', f'<div role="navigation" data-y="0"><ul>{links}</ul></div>']
    for _ in range(int(rng.integers(0, 5))):
        extra = pick(extras)
        places = [m.end() for m in re.finditer(r"</p>|<body>|</h1>|</nav>", page)] or [len(page)]
        at = pick(places)
        page = page[:at] + extra + page[at:]
    if rng.random() < 0.3 and "<body>" in page:
        page = page.replace("<body>", f'<body><div class="{pick(["wrapper", "container", "page", "layout"])}"><div>').replace("</body>", "</div></div></body>")
    return page


def learn(pages: DataFrame, rows: int = SAMPLE_PAGES) -> BoostedTrees | None:
    """The node model from a bounded sample of pages; none without a labelled article node."""
    total = pages.count()
    share = min(1 << 30, (1 << 30) * rows // max(1, total))
    sample = pages.filter(F.pmod(F.xxhash64("page_id", F.lit(29)), F.lit(1 << 30)) < share).filter(F.length("html") <= SAMPLE_CHARS)
    found = sorted((r["html"] for r in sample.select("html").collect()))
    spare = [p for page in found for p in re.findall(r"<p>([^<]{3,400})</p>", page)] or ["text"]
    rng, x, y = np.random.default_rng(3), [], []
    for page in found:
        for _ in range(VARIANTS):
            order = in_order(parse(variant(page, spare, rng)))
            x.append(features(order))
            y += [node.label for node in order]
    if not x or len(set(y)) < 2:
        return None
    return BoostedTrees().fit(np.concatenate(x).astype(np.float64), np.array(y, np.float64))


def extract(pages: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    Null and empty pages have an empty text. Without a model, everything outside dropped elements counts as inside.
    Repeated rows repeat; an empty table gives no row.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for block in slices(batches, BLOCK_PAGES):
            orders = [in_order(parse(page)) if page else None for page in block.column("html").to_pylist()]
            full = [o for o in orders if o]
            x = np.concatenate([features(o) for o in full]) if full else np.zeros((0, 1))
            prob = trees.predict(x.astype(np.float64)) if trees is not None and len(x) else np.ones(len(x))
            texts, at = [], 0
            for order in orders:
                if not order:
                    texts.append("")
                    continue
                texts.append(text_of(order[0], decode(order, prob[at:at + len(order)])))
                at += len(order)
            yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op3_extraction")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
