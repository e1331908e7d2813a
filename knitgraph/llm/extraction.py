"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block elements; inline elements do not cut. A block has a word count and a
link density (share of its words inside links), those of the blocks before and after it, and flags of the
elements around it: page furniture (by element, role, class or id), header, article, heading. A tree is
grown on the blocks of a small labelled table (`labelled_pages`: pages whose main elements carry `data-keep`) by
the Gini impurity and decides block by block. Kept blocks are joined by an empty line.

Scripts, styles, templates, form controls and the head have no text. Character references are decoded and
white space, with line breaks by `br`, becomes one space.

Defined cases: null and empty html and pages without text give an empty text; unclosed elements end as in
browsers (a paragraph at the next block, an item at the next item, the rest with the page); an unclosed
comment, script or tag swallows the rest (a tag with a stray quote ends at the next `>`); a page without article elements is judged by its counts, densities and furniture;
rows that repeat a page are pages of their own. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from knitgraph.llm import text as T

#: Most labelled pages that the tree is grown on, by page_id; the table is small by definition.
LABELLED_PAGES = 2_000
DEPTH = 8
LEAF = 2

# Elements of HTML by their behaviour.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; all but textarea and xmp are never shown, and a textarea is a form's.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
UNSEEN = frozenset("audio button canvas datalist head map object option select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("aside dialog footer form menu nav search".split())
MAIN = frozenset("article main".split())
#: An element that starts ends open ones of these, up to the next other block.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()),
    "td": frozenset("td th".split()), "th": frozenset("td th".split()),
}
#: Elements open at once; deeper ones are flat, as in browsers.
NESTING = 512
# Words of class, id and role that name page furniture, and those that name the main text.
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments
    commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr legal login
    masthead menu modal nav navbar navigation newsletter notice overlay paging pagination pager popup privacy promo
    promoted promotion related reply replies respond responses search share sharing sidebar signin signup skip social sponsor sponsored
    subscribe subscription tagcloud toolbar topbar widget widgets""".split()
)
MAIN_WORDS = frozenset("article content entry main post story text".split())
HEADER_WORDS = frozenset(["header"])
#: Words after these say what an element holds beside its text, not what it is.
BESIDE = frozenset("has with without no".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?<![^\s"'/])(?:hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE
)
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_MARK = re.compile(r"(?<![^\s\"'/])data-(keep|drop)(?=[\s=/]|\Z)")

FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "header", "main",
    "heading", "page_has_main",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    header: bool
    main: bool
    heading: bool
    keep: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass(frozen=True)
class _Element:
    tag: str
    furniture: bool
    header: bool
    main: bool
    heading: bool
    keep: bool
    unseen: bool


_TOP = _Element("", False, False, False, False, False, False)


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role name furniture, a header, the main text."""
    furniture = header = main = False
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            for at, word in enumerate(words):
                if word in BESIDE:
                    del words[at:]
                    break
            furniture |= not FURNITURE_WORDS.isdisjoint(words)
            header |= not HEADER_WORDS.isdisjoint(words)
            main |= not MAIN_WORDS.isdisjoint(words)
    return furniture, header, main


def _entered(outer: _Element, tag: str, attributes: str, marked: bool) -> _Element:
    furniture = header = main = False
    unseen = tag in UNSEEN
    if attributes and tag not in ("html", "body"):
        furniture, header, main = _named(attributes)
        unseen |= "d" in attributes and _HIDDEN.search(attributes) is not None
    keep = outer.keep
    if marked and (mark := _MARK.search(attributes)):
        keep = mark[1] == "keep"
    return _Element(
        tag,
        outer.furniture or furniture or tag in FURNITURE,
        outer.header or header or tag == "header",
        outer.main or tag in MAIN or (main and not furniture),
        outer.heading or tag in HEADINGS,
        keep,
        outer.unseen or unseen,
    )


def text_blocks(page: str | None, marked: bool = False) -> list[Block]:
    """The flat text blocks of a page in order; with `marked`, `keep` follows data-keep and data-drop."""
    page = page or ""
    blocks: list[Block] = []
    stack = [_TOP]
    link = 0  # depth of the open link, 0 if none
    held: list[tuple[str, bool]] = []

    def cut() -> None:
        if not held:
            return
        words = " ".join("".join([text for text, _ in held]).split())
        if words:
            at = stack[-1]
            linked = sum(len(text.split()) for text, inside in held if inside)
            total = words.count(" ") + 1
            blocks.append(Block(words, total, min(linked, total), at.furniture, at.header, at.main, at.heading, at.keep))
        held.clear()

    def leave(depth: int) -> None:
        nonlocal link
        if any(e.tag in BLOCKS for e in stack[depth:]):
            cut()
        del stack[depth:]
        if link >= depth:
            link = 0

    def add(text: str) -> None:
        if text and not stack[-1].unseen:
            held.append((entities.unescape(text) if "&" in text else text, link > 0))

    at = 0
    while True:
        found = _TAG.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        tag, closes, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    leave(depth)
                    break
            else:
                if tag in BLOCKS:
                    cut()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            cut()
            # A block ends an open paragraph, and the inline elements in it.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    leave(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
            if tag in ENDS:
                lowest = 0
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ENDS[tag]:
                        lowest = depth
                    elif stack[depth].tag in BLOCKS:
                        break
                if lowest:
                    leave(lowest)
        if tag == "a" and link and not any(e.tag in BLOCKS for e in stack[link:]):
            leave(link)
        # An inline element matters by its attributes only, unless it is a link or hides its content.
        if tag not in VOID and len(stack) < NESTING and (attributes.strip() or tag in BLOCKS or tag in UNSEEN or tag == "a"):
            stack.append(_entered(stack[-1], tag, attributes, marked))
            if tag == "a":
                link = len(stack) - 1
    cut()
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, as FEATURES."""
    words = np.array([0, *(b.words for b in blocks), 0], dtype=np.float64)
    density = np.array([0, *(b.density for b in blocks), 0], dtype=np.float64)
    flags = np.array([[b.furniture, b.header, b.main, b.heading] for b in blocks], dtype=np.float64).reshape(len(blocks), 4)
    anywhere = np.full(len(blocks), float(any(b.main and not b.furniture for b in blocks)))
    return np.column_stack(
        [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags, anywhere]
    )


@dataclass(frozen=True)
class Tree:
    """Node i sends a row left if feature[i] of it is at most cut[i]; feature -1 marks a leaf with a share."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range(DEPTH):
            inner = self.feature[at] >= 0
            value = rows[np.arange(len(rows)), np.maximum(self.feature[at], 0)]
            to = np.where(value <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, to, at)
        return self.share[at]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
    """A tree by the Gini impurity; ties go to the first feature and the lowest cut."""
    nodes: list[list[float]] = []

    def split(which: np.ndarray, level: int) -> int:
        place = len(nodes)
        share = float(labels[which].mean()) if len(which) else 0.0
        nodes.append([-1, 0.0, 0, 0, share])
        if level == depth or share in (0.0, 1.0):
            return place
        best, chosen = 2 * share * (1 - share) * len(which) - 1e-9, None
        for f in range(rows.shape[1]):
            order = which[np.argsort(rows[which, f], kind="stable")]
            value, good = rows[order, f], np.cumsum(labels[order])
            n = np.arange(1, len(order))
            ends = np.flatnonzero((value[1:] > value[:-1]) & (n >= leaf) & (len(order) - n >= leaf))
            if not len(ends):
                continue
            below, above = n[ends], len(order) - n[ends]
            p, q = good[ends] / below, (good[-1] - good[ends]) / above
            impurity = 2 * below * p * (1 - p) + 2 * above * q * (1 - q)
            least = int(impurity.argmin())
            if impurity[least] < best:
                best, chosen = float(impurity[least]), (f, float(value[ends[least]] + value[ends[least] + 1]) / 2)
        if chosen is None:
            return place
        f, cut = chosen
        low = rows[which, f] <= cut
        nodes[place][:2] = f, cut
        nodes[place][2], nodes[place][3] = split(which[low], level + 1), split(which[~low], level + 1)
        return place

    split(np.arange(len(rows)), 0)
    feature, cut, left, right, share = zip(*nodes, strict=True)
    return Tree(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(share))


def labelled_pages(spark: SparkSession) -> DataFrame:
    """(page_id, html) of the labelled pages of this package."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled_pages")
    rows = []
    for page_id, name in enumerate(sorted(os.listdir(folder))):
        with open(os.path.join(folder, name), encoding="utf-8") as page:
            rows.append((page_id, page.read()))
    return spark.createDataFrame(rows, "page_id long, html string")


def fit(labelled: DataFrame) -> Tree:
    """The tree of a labelled table (page_id, html with data-keep and data-drop)."""
    pages = labelled.select("page_id", "html").orderBy("page_id", "html").limit(LABELLED_PAGES).collect()
    rows, labels = [np.zeros((0, len(FEATURES)))], []
    for page in pages:
        blocks = text_blocks(page["html"], marked=True)
        rows.append(features(blocks))
        labels += [b.keep for b in blocks]
    return grow(np.concatenate(rows), np.array(labels, dtype=np.float64))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    kept = tree.score(features(blocks)) > 0.5
    return "\n\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_pages(pages: DataFrame, tree: Tree) -> DataFrame:
    """page_id, url, main text and its code points of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "html"):
                texts = [main_text(page, tree) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
