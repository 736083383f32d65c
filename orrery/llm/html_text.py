"""Main text of web pages: flat blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described by its words and link density,
those of its two neighbours, and what its elements say: whether it stands in or outside the page's article, in furniture
(menus, headers, footers, side bars, forms, dialogs, by tag or role), in an element that a class or id names so,
or in one that a class or id hints at, with that element's share of the page's words.  A CART tree, trained on the
labelled pages below when the operator is built, says which blocks are text.

An element that a class, an id or a form makes furniture is none if it holds the article itself, as wrappers of whole
pages do.  A header inside an article is the article's own.

Defined results: null and empty pages have an empty text and 0 characters; pages without a tag are one
block; unclosed tags, comments and scripts end with the page; repeated rows and null ids give their own
results; further columns are ignored.  No block is cut short and no page is skipped.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.common import arrow_map, table

SCHEMA = "page_id long, url string, text string, n_chars long"
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "named", "hinted", "share", "heading")

#: Labelled pages: {n} stands for n words, [n] for a link of n words, and a plus sign begins a block of the text.
LABELLED = (
    # an article between menu, advert and footer
    "<nav><ul><li>[1]<li>[1]<li>[1]</ul></nav><div class=ad>{9}</div><article><h1>+{8}</h1><p>+{60}<p>+{3}<p>+{35}</article><footer>{9}</footer>",
    "<header>{3}</header><nav>[1] [1] [2]</nav><article><h1>+{4}</h1><p>+{1}<p>+{1}<p>+{120}<p>+{2}</article><footer>{14}</footer>",
    "<div class=cookie>{30}</div><header><a href=x>{2}</a><p>{6}</header><article><header><h1>+{9}</h1><p>+{5}</header><p>+{80}<h2>+{3}</h2><p>+{45}</article><footer>{3} [2] [2]</footer>",
    "<nav><a href=x>{1}</a></nav><article><p>+{60}</article>",
    "<nav>{1}</nav><article><p>+{60}</article><section id=comments><p>{1}<p>{90}<p>{4}</section>",
    "<div class=advert>{5}</div><article><p>+{55}</article><div class=promo>{70}</div>",
    "<article><h1>+{6}</h1><p>+{30}<aside><p>{40}<p>[5]</aside><p>+{50}<div class=newsletter>{25}<form>{4}</form></div><p>+{20}</article>",
    "<article><h1>+{6}</h1><p>+{3}<ul><li>+{7}<li>+{4}<li>+{9}</ul><p>+{12}<ul><li>[6]<li>[8]<li>[7]</ul></article>",
    "<main><h1>+{5}</h1><p>+{40}<blockquote>+{18}</blockquote><table><tr><td>+{1}<td>+{2}<td>+{1}</table><p>+{30}</main><aside>{60}</aside>",
    "<main><p>+{25} <a href=x>{20}</a><p>+{8} [4]<p>[9]<p>[12]</main>",
    "<article><p>+{2}<div class='share-buttons'>{3} [1] [1]</div><p>+{9}</article>",
    "<article><p>+{6}</article>",
    "<article><p>+{1}</article><div class=sponsored>{40}</div>",
    "<nav>[1] [1]</nav><form><p>{20}<p>{3}</form><article><h1>+{3}</h1><p>+{9}</article>",
    "<div>{20}</div><article><h1>+{5}</h1><p>+{50}<p>+{9}</article><div>{15}</div>",
    "<main><h1>+{6}</h1><article><p>+{60}<p>+{4}</article></main><div>{9}</div>",
    "<p>{12}<article><p>+{30}<p>+{2}</article><p>{25}<p>{60}",
    "<main><p>+{12}<p>+{3}<p>+{40}</main><div>{50}</div>",
    # wrappers that a name hints at
    "<div class='post-with-sidebar'><nav>[1] [1]</nav><article><h1>+{7}</h1><p>+{70}</article><div class=sidebar><p>{30}<p>[3]</div></div>",
    "<form id=aspnetForm><div class=header>{4}</div><article><p>+{50}<p>+{12}</article><div class=footer>{12}</div></form>",
    "<div class='sidebar-layout'><p>+{60}<p>+{40}<p>+{9}<p>+{55}</div><footer>{8}</footer>",
    "<div class='banner-image-page'><h1>+{6}</h1><p>+{80}<p>+{3}<p>+{40}</div>",
    "<div class='menu-open'><p>+{45}<p>+{70}</div><div class='ad-slot'>{20}</div><div class='comment-list'><p>{30}<p>{25}</div>",
    "<article><p>+{40}<div class='ad-slot'>{12}</div><p>+{30}</article><div class='comments-area'><p>{20}<p>{60}</div><div class='related-posts'><p>{12}<p>[9]</div>",
    "<article class='comment-friendly'><h1>+{5}</h1><p>+{60}<p>+{30}</article><div class='nav-links'>[3] [3]</div>",
    # no article element
    "<div>[1] [1] [1]</div><h1>+{7}</h1><p>+{60}<p>+{4}<p>+{45}<p>+{30}<div>[2] [2]</div><div>{6}</div>",
    "<ul><li>[2]<li>[1]<li>[3]</ul><div><div>+{40}</div><div>+{9}</div><div>+{75}</div></div><ul><li>[8]<li>[9]</ul><p>{5} [2] [3]",
    "<table><tr><td>[1]<td>[1]<td>[1]</table><table><tr><td>{2}<td>[4]<tr><td>{1}<td>[3]</table><p>+{90} [2]<p>+{25}",
    "<div>{3}</div><div>[1]</div><div>[2]</div><div>{4}</div><div>[1]</div><h2>+{5}</h2><p>+{30}<h2>+{3}</h2><p>+{50}<div>[1]</div><div>{2}</div><div>[1]</div>",
    "+{9}", "+{40}", "<p>+{12}", "<p>+{30}<p>+{8}", "<h1>+{4}</h1><p>+{20}", "<div>+{5}</div>", "<p>+{50}<p>+{2}<p>+{60}", "<p>+{70}<p>+{6}<p>+{80}<p>+{35} [8]",
    "<p>[1] | [1] | [1]<p>+{35}<p>+{50}<p>[2] | {2} | [3]", "<div>[5] [4] [6] {1}</div><div>+{28}</div><div>+{3}</div><div>+{60}</div><div>{1} [9]</div><div>[7]</div>",
    # furniture alone
    "<nav><a href=x>{1}</a>", "<nav>{40}<p>{12}</nav>", "<footer>{30}</footer>", "<div class=login><p>{12}<p>{3}</div>", "<form>{6}<p>{14}</form>", "<aside><p>{60}<p>{9}</aside>", "<ul><li>[3]<li>[2]<li>[4]<li>[6]</ul>",
    "<div class='cookie-notice'>{60}</div><div class=popup><p>{20}<p>{6}</div>", "<header><h1>{5}</h1><p>{12}</header>",
)

#: Elements whose content is never text of the page.
_HIDDEN = "script|style|title|noscript|template|svg|math|iframe|object|select|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
_FURNITURE = frozenset("nav header footer aside form fieldset button dialog menu".split())
#: Roles of the accessibility standard for the same.
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
_ARTICLE = {"article": 2, "main": 1}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: p and li may stay open, so what they say holds for the block that follows only.
_LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot colgroup html body head h1 h2 h3 h4 h5 h6".split()) | _INLINE | _VOID
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Names of furniture in classes and ids.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget"
    " comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended"
    " toolbar search contentinfo complementary".split()
)
#: What a name is said of: 'post-header' is the article's own, 'with-sidebar' the layout's.
_OWN = frozenset("article entry post story content section".split())
_LAYOUT = frozenset("with has no without is not".split())


@functools.lru_cache(4096)
def _said(value: str) -> int:
    """2 if a class or id names furniture by a whole word or its last piece, 1 if a piece hints at it, else 0."""
    best = 0
    for word in value.split():
        parts = [x.lower() for x in _PIECE.findall(word)]
        if not parts or not _LAYOUT.isdisjoint(parts) or _NAMES.isdisjoint(parts):
            continue
        if parts[-1] == "header" and parts[0] in _OWN:
            continue
        best = max(best, 2 if parts[-1] in _NAMES else 1)
    return best


def _says(tag: str, attrs: str) -> tuple[int, int, int]:
    """(furniture, article, name) of an element: 1 or 0, 0 to 2, 0 to 2."""
    furniture, article, name = int(tag in _FURNITURE), _ARTICLE.get(tag, 0), 0
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), a or b or c
        if key == "role":
            furniture |= value.lower() in _ROLES
            article = max(article, _ARTICLE.get(value.lower(), 0))
        elif key in ("class", "id"):
            name = max(name, _said(value))
        elif key == "style":
            furniture |= "display:none" in value.lower().replace(" ", "")
        elif key == "hidden" or value.lower() == "true":
            furniture = 1
    return furniture, article, name


class Page:
    """The blocks of a page and the elements around them; an element's number is greater than its parent's."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.rows: list[tuple[int, float, int, int, int]] = []  # words, link density, element, name of its own, heading
        #: Of each element: parent, furniture, article, name; and whether it holds an article, or a heading of level 1.
        self.parent, self.furniture, self.article, self.name = [0], [0], [0], [0]
        self.holds, self.titled = [False], [False]
        self._read(page)

    def _read(self, page: str) -> None:
        stack, open_tags = [0], {}
        tags = [""]
        text: list[str] = []
        linked: list[str] = []
        link, own, heading = 0, 0, 0

        def flush():
            if text:
                words = "".join(text).split()
                if words:
                    n = len("".join(linked).split())
                    self.text.append(" ".join(words))
                    self.rows.append((len(words), min(1.0, n / len(words)), stack[-1], own, heading))
                text.clear()
                linked.clear()

        def add(piece: str):
            piece = html.unescape(piece)
            text.append(piece)
            if link:
                linked.append(piece)

        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                add(page[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                continue
            tag, closing = tag.lower(), bool(m[2] or m[5])
            if tag == "a":
                link = 0 if closing else 1
                linked.append(" ")
            if tag in ("br", "img"):
                text.append(" ")
            if tag in _INLINE:
                continue
            flush()
            link = own = heading = 0
            top = stack[-1]
            if tag in _LOOSE:
                if not closing:
                    furniture, _, name = _says(tag, m[4] or m[7] or "") if tag not in ("html", "body", "head") else (0, 0, 0)
                    own, heading = max(name, 2 * furniture), int(tag in _HEADING)
                    if tag == "h1" and not self.furniture[top]:
                        self.titled[top] = True
                continue
            if not closing:
                furniture, article, name = _says(tag, m[4] or m[7] or "")
                if tag == "header" and self.article[top] and not self.furniture[top]:
                    furniture = 0
                if article and not name and not furniture and not self.furniture[top]:
                    self.holds[top] = True
                soft = tag in ("form", "fieldset")  # furniture unless it holds the article
                self.parent.append(top)
                self.furniture.append(int(self.furniture[top] or (furniture and not soft)))
                self.article.append(max(self.article[top], article))
                self.name.append(3 if soft else name)
                self.holds.append(False)
                self.titled.append(False)
                tags.append(tag)
                stack.append(len(tags) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif open_tags.get(tag):
                while True:
                    t = tags[stack.pop()]
                    open_tags[t] -= 1
                    if t == tag:
                        break
        if at < len(page):
            add(page[at:])
        flush()

    def features(self) -> np.ndarray:
        n, m = len(self.rows), len(self.parent)
        x = np.zeros((n, len(FEATURES)))
        if not n:
            return x
        words, links, where, own, heading = (np.array(c) for c in zip(*self.rows))
        inside, total = np.bincount(where, words, m), words.sum()
        holds, titled = list(self.holds), list(self.titled)
        for e in range(m - 1, 0, -1):
            up = self.parent[e]
            inside[up] += inside[e]
            holds[up] |= holds[e]
            titled[up] |= titled[e] and not self.furniture[e]
        named, hinted, share = [0] * m, [0] * m, [0.0] * m
        for e in range(1, m):
            up, name = self.parent[e], self.name[e]
            named[e] = int(named[up] or (name == 2 and not holds[e]) or (name == 3 and not holds[e] and not titled[e]))
            counts = name == 1 and not holds[e] and not titled[e]
            hinted[e] = int(hinted[up] or counts)
            share[e] = share[up] if hinted[up] else inside[e] / total if counts else 0.0
        x[:, 0], x[:, 1] = words, links
        x[:, 2], x[:, 3] = np.concatenate([[-1], words[:-1]]), np.concatenate([[0], links[:-1]])
        x[:, 4], x[:, 5] = np.concatenate([words[1:], [-1]]), np.concatenate([links[1:], [0]])
        x[:, 7] = np.array(self.furniture)[where]
        inner = np.array(self.article)[where]  # 2 in an article, 1 in main alone
        x[:, 6] = np.where(inner > 0, inner / 2, -1 if (inner * (1 - x[:, 7])).any() else 0)
        x[:, 8] = np.maximum(np.array(named)[where], own == 2)
        x[:, 9] = np.maximum(np.array(hinted)[where], own == 1)
        x[:, 10] = np.where(np.array(hinted)[where] > 0, np.array(share)[where], np.where(own == 1, words / total, 0))
        x[:, 11] = heading
        return x


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """CART by Gini impurity: a leaf is its label, a node (feature, threshold, at most, above)."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() > 0.5)
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, j, float(cut), left)
    if best is None:
        return int(y.mean() > 0.5)
    _, j, cut, left = best
    return j, cut, train_tree(x[left], y[left], depth - 1), train_tree(x[~left], y[~left], depth - 1)


def predict(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node, at):
        if isinstance(node, int):
            out[at] = bool(node)
            return
        j, cut, low, high = node
        left = x[at, j] <= cut
        walk(low, at[left])
        walk(high, at[~left])

    walk(tree, np.arange(len(x)))
    return out


def labelled_blocks(pages=LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the blocks of labelled pages."""
    xs, ys = [], []
    for p in pages:
        p = re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * int(m[1])), p)
        p = re.sub(r"\[(\d+)\]", lambda m: "<a href=x>" + " ".join(["w"] * int(m[1])) + "</a>", p)
        page = Page(p)
        xs.append(page.features())
        ys += [int(t.startswith("+")) for t in page.text]
    return np.concatenate(xs), np.array(ys)


@functools.cache
def default_tree():
    return train_tree(*labelled_blocks())


def main_text(page: str, tree) -> str:
    found = Page(page)
    if not found.text:
        return ""
    return "\n".join(t for t, keep in zip(found.text, predict(tree, found.features())) if keep)


def _run(tree):
    def run(batches):
        for batch in batches:
            for part, _, _ in B.slices(batch, "html"):
                out = [main_text(h, tree) for h in B.column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([B.column(part, "page_id"), B.column(part, "url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return arrow_map(src, _run(tree or default_tree()), SCHEMA)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
