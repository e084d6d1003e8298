"""Main text of web pages by tag-path ratios.

1. A lenient parse gives the text nodes of a page in order, each with its root-to-leaf tag path. Elements that
   never hold article text (scripts, forms, navigation, footers, and such by class or id) are left out.
2. For each tag path: root of the text length per node, and punctuation per character. Each node carries its path's
   two ratios; they are smoothed over neighbours in page order and fused by their product.
3. Paths whose fused ratio reaches half of the text-weighted median path's are content paths. The content root is the
   deepest element that holds all text on content paths. The text is all blocks under it, as short paragraphs and
   headings of an article stay whatever their own ratio, but for blocks of links alone on paths that are not content
   paths, and the headings right before it. Where the root is or lies in an article or main, that element is
   taken whole and paths decide nothing within.

Plan: one Arrow map over the pages, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")

# Element names of HTML, by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext iframe".split())
LEFT_OUT = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav aside footer form button select textarea input label fieldset menu dialog title xmp noembed noframes plaintext".split())
BLOCK = frozenset("html body address article blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote q figcaption figure pre".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",)}
# Words in a class, an id or a role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsor promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar side-bar sidebars aside footer foot masthead topbar toolbar header site-header page-header cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager skip widget widgets "
    "contentinfo complementary search banner".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")
# First parts of names that tell of a layout with or without such a part, and of an article's own header.
WITH = frozenset("no has with without not is".split())
OF_ARTICLE = frozenset("post entry article story".split())
SIGN_WEIGHT = 25.0
HINT = re.compile(r"[a-z]+|\d+")


class Node:
    """An element: its name, parent, path key, whether it is left out, and the elements around it (itself included) whose names speak against them."""

    __slots__ = ("name", "parent", "path", "depth", "out", "block", "weight", "around", "link", "head")

    def __init__(self, name: str, parent: Node | None, mark: str, out: bool, around: bool = False):
        above = parent.around if parent else ()
        self.around = (self, *above) if around else above
        self.name, self.parent, self.out = name, parent, out or bool(parent and parent.out)
        self.path = f"{parent.path}/{name}{mark}" if parent else name
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if name in BLOCK or parent is None else parent.block
        self.link = name == "a" or bool(parent and parent.link)
        self.head = name in HEADINGS or bool(parent and parent.head)
        self.weight = 0.0


def surrounds(name: str, of_text: bool = False) -> bool:
    """Whether a class, id or role marks what surrounds an article: by the whole name, or its first or last part.

    Of a block of text the first part only qualifies the last: a banner-quote is a quote.
    """
    parts = HINT.findall(name.replace("_", "-"))
    if not parts or parts[0] in WITH or parts[0] in OF_ARTICLE and parts[-1] == "header":
        return False
    return name in AROUND or parts[-1] in AROUND or not of_text and parts[0] in AROUND


def marks(attributes: str, of_text: bool = False) -> tuple[str, bool, bool]:
    """A short mark of class for the path, whether the element is hidden, and whether its names speak against it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "", False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    out = bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes))) or found.get("aria-hidden") == "true"
    out = out or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    around = any(surrounds(name, of_text) for key in ("class", "id", "role") for name in found.get(key, "").lower().split())
    return f".{found['class'].split()[0]}" if found.get("class", "").strip() else "", out, around


def text_nodes(page: str) -> list[tuple[Node, Node, str]]:
    """(element, serial block, raw text) of each text node that is not left out, in page order."""
    root = Node("", None, "", False)
    stack, out, at, size = [root], [], 0, len(page)
    brk = [0]
    holders: list[Node] = []

    def text(part: str) -> None:
        if part and not stack[-1].out:
            out.append((stack[-1], brk[0], part))

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                brk[0] += 1
                return
            if stack[i].name in stop:
                return

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if any(x.name in BLOCK for x in stack[i:]):
                        brk[0] += 1
                    del stack[i:]
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            continue
        if name in CLOSES_P:
            close(("p",), ("table", "td", "th", "div", "article", "section", "main", "body", "li", "blockquote", "button"))
        if name in SAME_LEVEL:
            close(SAME_LEVEL[name], BARRIER[name])
        if name in BLOCK:
            brk[0] += 1
        if name == "br":
            text("\n")
        if name in VOID:
            continue
        mark, hidden, around = marks(m[3] or "", name in TEXT_BLOCKS)
        inside = any(x.name in ("article", "main") for x in stack)
        node = Node(name, stack[-1], mark, name in LEFT_OUT or hidden and name not in ("html", "body", "article", "main") or name == "header" and not inside, around and name not in ("html", "body", "article", "main"))
        if (m[3] or "").rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
        if name in ("article", "main") and not node.out:
            holders.append(node)
    return without_surroundings(out, holders)


def without_surroundings(nodes: list[tuple[Node, int, str]], holders: list[Node], most: float = 0.8) -> list[tuple[Node, int, str]]:
    """The text nodes outside elements whose names speak against them.

    Such an element counts as layout, and stays, if it holds an article or main while none stands outside
    such elements, or if the page has neither and it holds the share ``most`` of the page's text.
    """
    layout: set[int] = set()
    if holders:
        kind = [h for h in holders if h.name == "article"] or holders
        if all(h.around for h in kind):
            layout.update(id(n) for n in kind[0].around)
    else:
        held: dict[int, int] = defaultdict(int)
        for n, _, text in nodes:
            for around in n.around:
                held[id(around)] += len(text.strip())
        total = sum(len(text.strip()) for _, _, text in nodes)
        layout.update(k for k, size in held.items() if size >= most * total)
    return [x for x in nodes if all(id(n) in layout for n in x[0].around)]


def smoothed(x: np.ndarray) -> np.ndarray:
    """Weighted mean over two neighbours on each side."""
    kernel = np.array([1, 4, 6, 4, 1], float)
    full = np.convolve(np.pad(x, 2), kernel, "valid")
    return full / np.convolve(np.pad(np.ones(len(x)), 2), kernel, "valid")


def content_root(nodes: list[tuple[Node, int, str]], threshold: float = 0.5) -> tuple[Node | None, set[str]]:
    """The deepest element that holds all text on content paths (None if there is no text), and the other paths."""
    length = np.array([len("".join(t.split())) for _, _, t in nodes], float)
    if not length.sum():
        return None, set()
    signs = np.array([len(PUNCTUATION.findall(t)) for _, _, t in nodes], float)
    paths: dict[str, list[int]] = defaultdict(list)
    for i, (n, _, _) in enumerate(nodes):
        if length[i]:
            paths[n.path].append(i)
    text_ratio, sign_ratio = np.zeros(len(nodes)), np.zeros(len(nodes))
    for where in paths.values():
        text_ratio[where] = np.sqrt(length[where].mean())
        sign_ratio[where] = signs[where].sum() / length[where].sum()
    fused = smoothed(text_ratio) * (1 + SIGN_WEIGHT * smoothed(sign_ratio))
    by_path = {p: float(np.average(fused[w], weights=length[w])) for p, w in paths.items()}
    ranked = sorted((v, length[paths[p]].sum()) for p, v in by_path.items())
    middle = np.searchsorted(np.cumsum([w for _, w in ranked]), length.sum() / 2)
    least = threshold * ranked[min(middle, len(ranked) - 1)][0]
    chosen = [i for p, w in by_path.items() if w >= least for i in paths[p]]
    total = 0.0
    touched: list[Node] = []
    for i in chosen:
        total += length[i]
        n: Node | None = nodes[i][0]
        while n:
            if not n.weight:
                touched.append(n)
            n.weight += length[i]
            n = n.parent
    best = max((n for n in touched if n.weight >= total and n.name in BLOCK | {""}), key=lambda n: n.depth)
    while best.parent and best.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "tbody", "dl", "dd", "dt", "header", "figure"):
        best = best.parent
    n = best
    while n:
        if n.name in ("article", "main"):
            return n, set()
        n = n.parent
    return best, {p for p, w in by_path.items() if w < least}


def within(node: Node | None, root: Node) -> bool:
    while node and node is not root:
        node = node.parent
    return node is root


def main_text(page: str) -> str:
    """Article text: blocks in page order, one to a line, white space within a block as one space."""
    nodes = text_nodes(page)
    root, other = content_root(nodes)
    if root is None:
        return ""
    inside = [within(node, root) for node, _, _ in nodes]
    first = inside.index(True)
    while first and (nodes[first - 1][0].head or not nodes[first - 1][2].strip()):
        first -= 1
        inside[first] = True
    #: text, and whether it is links alone on paths that are not content paths
    blocks: list[list] = []
    last = None
    for (node, mark, raw), use in zip(nodes, inside, strict=True):
        if not use:
            continue
        key = (mark, id(node.block))
        if key != last:
            blocks.append(["", True])
            last = key
        blocks[-1][0] += raw
        blocks[-1][1] &= node.link and node.path in other or not raw.strip()
    lines = (" ".join(html.unescape(b).split()) for b, links in blocks if not links)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row. ``n_chars`` counts code points.

    Null or empty html, and pages without article text: empty text. Repeated rows give equal rows. Extra
    columns are dropped. Empty table: no rows. Very long pages are read whole.
    """
    part = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h or "").encode("utf-8", "replace").decode() for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(part, run, T.StructType([part.schema["page_id"], part.schema["url"], *T.StructType.fromDDL("text string, n_chars long").fields]))
