"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its word count and link density, those
of the blocks before and after it, and three facts of its place: whether a boilerplate element (by tag, or
by words in its class, id or role) encloses it, whether an article or main element does, and the share of
the page's words outside boilerplate that such elements hold. ``train_tree`` fits the tree with Spark ML on
the blocks of ``LABELLED_PAGES``, small pages of which every block is labelled; the tree then runs inside the
task that parsed the page, so text is never shuffled.

Defined cases: null or empty html gives an empty text; unclosed, crossed and truncated tags are closed
with their parents; text outside any tag is a block; scripts, styles, markup comments and hidden elements
give no text; character references are decoded once; white space (also no-break) becomes one blank; a page
is read in time proportional to its length, however its tags are nested; rows keep their number, repeated
ones too, and other columns stay.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object select option canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
BOILER = set("nav header footer aside form menu dialog button fieldset".split())
MAIN = {"article", "main"}
# Words in a class, id or role that mark boilerplate.
HINTS = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert sidebar aside widget menu navbar nav navigation breadcrumb breadcrumbs footer header masthead "
    "topbar comment comments reply replies discussion disqus share sharing social related recommended newsletter "
    "subscribe signup login popup modal overlay paywall skip search toolbar pagination pager complementary contentinfo "
    "copyright disclaimer outbrain taboola".split()
)
# Hints that hold for an article element too; words that turn a hint round ("has-sidebar").
ARTICLE_HINTS = set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
TURNED = set("has with without no non".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

FEATURES = [
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_boilerplate", "in_article", "article_share",
]


def is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILER:
        return True
    if not attributes:
        return False
    hints = set() if tag in ("body", "html", "main") else ARTICLE_HINTS if tag == "article" else HINTS
    if hints and "=" in attributes:
        for groups in _MARKS.findall(attributes):
            for name in "".join(groups).split():
                words = _PART.findall(_CAMEL.sub("-", name).lower())
                if hints.intersection(words) and not TURNED.intersection(words):
                    return True
    return bool(_HIDDEN.search(attributes))


def blocks_of(page: str | None) -> list[list]:
    """Blocks in page order: [text, words, linked words, in_boilerplate, in_article]."""
    if not page:
        return []
    out: list[list] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, article
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    blocks_open: list[int] = []
    endless: set[str] = set()  # raw elements of which no further end tag follows
    parts: list[str] = []
    linked = links = 0
    boiler = article = False
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append([" ".join(words), len(words), min(linked, len(words)), boiler, article])
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal boiler, article, links
        while len(stack) > k:
            tag, boiler, article = stack.pop()
            links -= tag == "a"
            if tag:
                places[tag].pop()
            if blocks_open and blocks_open[-1] == len(stack):
                blocks_open.pop()

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        parts.append(text)
        if links:
            linked += len(text.split())

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
        if closing:
            if places.get(tag):
                k = places[tag][-1]
                if tag not in BLOCK and blocks_open and blocks_open[-1] > k:
                    # an inline end tag doesn't close blocks opened since
                    places[tag].pop()
                    links -= tag == "a"
                    stack[k] = ("", stack[k][1], stack[k][2])
                else:
                    close(k)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    at = size if tag in ("script", "style") else at
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and blocks_open:  # an open paragraph or item ends where the next begins
            alike = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, {"p"})
            last = stack[blocks_open[-1]][0]
            if last in alike or last == "p":
                close(blocks_open[-1])
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks_open.append(len(stack))
        stack.append((tag, boiler, article))
        boiler = boiler or is_boilerplate(tag, attributes)
        article = article or tag in MAIN
        links += tag == "a"
    flush()
    return out


def features_of(blocks: list[list]) -> list[tuple]:
    free = sum(b[1] for b in blocks if not b[3])
    share = sum(b[1] for b in blocks if b[4] and not b[3]) / free if free else 0.0
    shape = [(0.0, 0.0), *((float(b[1]), b[2] / b[1]) for b in blocks), (0.0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], float(b[3]), float(b[4]), share) for i, b in enumerate(blocks)]


# The labelled table, as pages. Every block begins with + if it is main text and with - if it
# isn't; {n} stands for n words. With and without article elements; menus, heads, feet, side columns, notices,
# adverts, forms, reader comments and runs of links, marked as such by tag or class and unmarked.
LABELLED_PAGES = [
    "<nav><ul><li>-<a>{1}</a><li>-<a>{2}</a><li>-<a>{1}</a><li>-<a>{1}</a></ul></nav><article><h1>+{8}</h1><p>+{60}<p>+{45}<p>+{2}<p>+{80} <a>{3}</a><ul><li>+{6}<li>+{9}</ul><p>+{30}</article><footer>-{12}</footer>",
    "<header>-{3}</header><div class=ad>-{14}</div><article><h1>+{12}</h1><p>+{1}<p>+<a>{2}</a> {3}<p>+{110}<aside>-{40}<p>-{70}</aside><p>+{3}<p>+{4}<p>+{95}<p>+{5}</article><div class=comments><p>-{25}<p>-{3}<p>-{60}</div><footer>-{20}<p>-<a>{1}</a></footer>",
    "<main><h1>+{5}</h1><p>+{200}<p>+{18}<form>-{2}<p>-{9}</form><p>+{7}<ul><li>-<a>{5}</a><li>-<a>{7}</a><li>-<a>{4}</a><li>-<a>{6}</a><li>-<a>{5}</a></ul></main><footer>-{9}<p>-{2}</footer>",
    "<article><h1>+{9}</h1><p>+{33}<p>+{71}<p>+<a>{6}</a><p>+{52}<p>+<a>{3}</a> {1}<p>+{40}<div>-<a>{2}</a></div><div>-<a>{1}</a></div><div>-<a>{2}</a></div><div>-<a>{1}</a></div></article><div class=sidebar><p>-{45}<p>-{30}</div>",
    "<div>-<a>{1}</a></div><div>-<a>{2}</a></div><div>-<a>{1}</a></div><div>-<a>{1}</a></div><div><h1>+{6}</h1><p>+{70}<p>+{40} <a>{3}</a><p>+{15}<p>+{90}<p>+{28}</div><div>-{4}</div><div>-<a>{2}</a></div>",
    "<div class=menu>-<a>{1}</a> <a>{1}</a> <a>{2}</a></div><div><h2>+{10}</h2><p>+{130}<p>+{22}<p>+{85} <a>{4}</a><p>+{3}<p>+{64}</div><div class=related><p>-{12}<p>-{40}</div><div>-<a>{3}</a> {2}</div><div>-{3} <a>{2}</a></div>",
    "<table><tr><td>-<a>{1}</a><td>-<a>{1}</a><td>-<a>{1}</a><td>-<a>{2}</a><tr><td><p>+{55}<p>+{44}<p>+{8}<p>+{77}<p>+{38} <a>{5}</a></table><p>-{5}<p>-<a>{1}</a> <a>{2}</a>",
    "<div><p>-<a>{4}</a><p>-<a>{6}</a><p>-<a>{5}</a><p>-<a>{8}</a> {1}<p>-<a>{7}</a></div><div><p>+{48}<p>+{120}<p>+{35}</div><div><p>-{6}<p>-<a>{9}</a><p>-<a>{7}</a></div><div id=footer>-{30}</div>",
    "<article><p>-{4}</article><div><h1>+{7}</h1><p>+{90}<p>+{160}<p>+{58}<p>+{12}<p>+{75}</div><div>-<a>{2}</a></div><div>-<a>{3}</a></div>",
    "<div>-<a>{2}</a> <a>{1}</a></div><article><p>-{6} <a>{2}</a></article><p>+{82}<p>+{64}<p>+{31}<p>+{140}<p>+{27}<div>-{2}</div><div>-<a>{1}</a></div>",
    "<div>-{18}</div><article><h1>+{11}</h1><p>+{240}<p>+{66}<p>+{90}<p>+{4}<p>+{150}</article><div>-{22}</div><div>-{35}</div>",
    "<div>-{60}</div><article><h1>+{6}</h1><p>+{140}<p>+{210}<p>+<a>{5}</a><p>+{3}<p>+<a>{2}</a><p>+{95}</article><div>-{55}<p>-{90}</div>",
    "<p>-{70}<p>-{4}<article><h1>+{13}</h1><p>+{180}<p>+<a>{8}</a><p>+{12}<p>+<a>{4}</a><p>+{260}</article><p>-{48}",
    "<p>-{9}<p>-{26}<main><p>+{14}<p>+{300}<p>+{2}<p>+{75}<p>+{19} <a>{2}</a><p>+{61}</main><p>-{40}<p>-<a>{6}</a>",
    "<div class=cookie-notice>-{30}<p>-<a>{1}</a></div><p>+{50}<p>+{43}<p>+{29}<p>+{100}<p>+{36}<div class=newsletter>-{16}</div>",
    "+{40}<br>+{60}<br>+{25}<hr>+{80}<p>-<a>{2}</a><p>-<a>{1}</a><p>-<a>{3}</a>",
    "+{70}",
    "<p>+{9}<p>+{40}",
    "<article><h1>+{6}</h1><p>+{30}<p>+{3}<p>+{80}</article>",
    "<article><p>+{90}<p>+<a>{4}</a><p>+{12}<p>+{2}</article>",
    "<div><p>+{25}<p>+{110}<p>+{44}<p>+{7}</div>",
    "<article><h1>+{7}</h1><p>+{20} <a>{6}</a> {15}<p>+{30} <a>{12}</a><p>+{9} <a>{5}</a> {3}<p>+{40} <a>{9}</a> {4} <a>{9}</a><p>+{12} <a>{7}</a><p>+{60}</article>",
    "<div>-<a>{1}</a> <a>{2}</a></div><div><h1>+{6}</h1><p>+{50} <a>{14}</a><p>+{30} <a>{9}</a> {20}<p>+{44} <a>{12}</a> {3} <a>{6}</a><p>+{70} <a>{18}</a><p>+{35}</div><div>-<a>{2}</a></div>",
    "<nav>-<a>{1}</a></nav><main><p>+{8}<p>+{60}<p>+{1}<p>+{4}</main>",
    "<nav>-<a>{2}</a><p>-{3}</nav><div><h1>+{6}</h1><p>+{75}<p>+{33}</div>",
    "<header>-{2}<p>-{10}</header><section><h2>+{5}</h2><p>+{88}<p>+{47} <a>{2}</a><p>+{150}</section><section><h2>+{4}</h2><p>+{66}<p>+{92}</section><footer>-{14}<p>-{3}</footer>",
]


def labelled_blocks(pages: list[str] | None = None, sizes: tuple[float, ...] = (0.4, 0.7, 1.0, 1.6, 2.5)) -> list[tuple]:
    """Features and label (1 for main text) of every block of the labelled pages, each page in several sizes,
    so that the tree learns no single page's numbers."""
    rows = []
    for page, scale in itertools.product(pages or LABELLED_PAGES, sizes):
        blocks = blocks_of(re.sub(r"\{(\d+)\}", lambda m: "w " * max(1, round(scale * int(m[1]))), page))  # noqa: B023
        marks = [b[0][0] for b in blocks]
        if set(marks) - {"+", "-"}:
            raise ValueError("every block of a labelled page must begin with + or -")
        bare = [[b[0], n := max(1, b[1] - (b[0].split()[0] in "+-")), min(b[2], n), *b[3:]] for b in blocks]
        rows += [(*x, float(mark == "+")) for x, mark in zip(features_of(bare), marks, strict=True)]
    return rows


def train_tree(spark: SparkSession, labelled: list[tuple] | None = None, depth: int = 6) -> tuple:
    """The decision tree as nested tuples: (feature, bound, left, right), or a leaf's prediction."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [tuple(float(v) for v in r) for r in labelled or labelled_blocks()]
    df = spark.createDataFrame(rows, [*FEATURES, "label"])
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=5, maxBins=256, seed=7).fit(
        VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    )

    def export(node):
        if not node.numDescendants():
            return float(node.prediction())
        split = node.split()
        return (split.featureIndex(), float(split.threshold()), export(node.leftChild()), export(node.rightChild()))

    return export(model._java_obj.rootNode())


def features_used(tree) -> set[str]:
    """The features that the tree asks for."""
    return {FEATURES[tree[0]], *features_used(tree[2]), *features_used(tree[3])} if isinstance(tree, tuple) else set()


def decide(tree, x: tuple) -> bool:
    while isinstance(tree, tuple):
        f, bound, left, right = tree
        tree = left if x[f] <= bound else right
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page)
    return " ".join(b[0] for b, x in zip(blocks, features_of(blocks), strict=True) if decide(tree, x))


def extract(tree, page: Column) -> Column:
    """The main text of each page."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return run(page.cast("string"))
