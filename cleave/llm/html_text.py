"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.llm.common import arrow_schema, pick

RESULT = "page_id bigint, url string, text string, n_chars bigint"

# HTML's element kinds, and names that mark parts of a page that are not its text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select xmp noembed object canvas audio video".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption"
    " figure figcaption header footer nav aside form fieldset address details summary hr center dialog menu hgroup legend optgroup option".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}
#: An opening tag ends the open one of its row, unless one of the stops lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
MENU_TAGS, MENU_ROLES = frozenset(("nav", "menu")), frozenset(("navigation",))
OUTSIDE_TAGS = frozenset("head footer aside form dialog button label fieldset".split())
OUTSIDE_ROLES = frozenset("banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners"
    " nav navbar navigation navi menu menus topbar bottombar toolbar breadcrumb breadcrumbs crumbs sidebar sidebars rail aside footer"
    " foot header masthead comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices"
    " notification notifications alert popup modal overlay lightbox newsletter subscribe subscription signup signin login register"
    " share sharing social related recommended recommendations trending popular teaser teasers widget widgets pagination pager paging"
    " search searchbox form forms skip copyright legal hidden response responses feedback guestbook adbox adslot adunit adblock adwrapper"
    " adcontainer topnav subnav sidenav sitenav mainnav navmenu mainmenu megamenu submenu siteheader pageheader sitefooter pagefooter colophon"
    " disclaimer".split()
)
#: Words of a name that tell nothing about what its element holds.
PLAIN_WORDS = frozenset("body box wrap wrapper container inner outer list item items block area section part row col column main content text links link bar left right top bottom title head entry post site page panel group".split())
CONTAINERS = frozenset("# html body article main section div center details".split())
ARTICLES = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|<[A-Za-z/](?:[^>\"']|\"[^\"]*\"|'[^']*')*+\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKS = re.compile(r"[.,;:!?…、。，！？；،؟।]")

#: A path's ratio without any punctuation, as a share of what one mark for each e - 1 blocks adds.
UNMARKED = 0.02
#: A path is text from this share of the page's mean ratio.
SHARE = 0.18
#: Share of linked characters from which a path is a menu, and the weight of what a page itself calls one.
LINKED, MENU_WEIGHT = 0.6, 0.3
#: Containers above a path whose ratios count; the weight falls to a quarter with each.
LEVELS = 20


class Leaf:
    __slots__ = ("block", "linked", "node", "text")

    def __init__(self, node: int, block: int, text: str, linked: bool):
        self.node, self.block, self.text, self.linked = node, block, text, linked


class Block:
    """Text between two block borders: its path, white space as single spaces, characters, marks, linked characters, weight."""

    __slots__ = ("linked", "marks", "node", "path", "size", "text", "weight")

    def __init__(self, node: int, path: int, weight: float, leaves: list[Leaf]):
        self.node, self.path, self.weight = node, path, weight
        self.text = " ".join("".join(x.text for x in leaves).split())
        self.size, self.marks = len(self.text), len(MARKS.findall(self.text))
        self.linked = max(0, self.size - sum(len(" ".join(x.text.split())) for x in leaves if not x.linked))


#: What an element's own marks say: part of the text, not part of it by a name, a menu, not part of it for sure.
INSIDE, NAMED, MENU, OUTSIDE = 0, 1, 2, 3


def _named_outside(value: str) -> bool:
    """Whether a class or id says by most of its words that its element is not part of the text."""
    for name in value.split():
        words = [w for w in (m.lower() for m in WORD.findall(name)) if w not in PLAIN_WORDS]
        if words and 2 * sum(w in OUTSIDE_WORDS for w in words) > len(words):
            return True
    return False


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return OUTSIDE
    mark = MENU if tag in MENU_TAGS else INSIDE
    if not attributes.strip():
        return mark
    if re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", attributes):
        return OUTSIDE
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "role" and value.strip().lower() in OUTSIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return OUTSIDE
        if name == "role" and value.strip().lower() in MENU_ROLES:
            mark = max(mark, MENU)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUTSIDE
        if name in ("class", "id") and tag not in ("html", "body", "main") and mark == INSIDE and _named_outside(value):
            mark = NAMED
    return mark


class Page:
    """The blocks of text of a page with their tag paths; the tree is lists of parents, so its depth costs nothing."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.node_path, self.block_node = ["#"], [0], [INSIDE], [0], [0]
        self.in_article, self.in_link = [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        #: By path: its tag, the path above, the nearest container at or above it, the nearest article or main (or -1).
        self.path_tag, self.path_parent, self.container, self.article = ["#"], [0], [0], [-1]
        self.leaves: list[Leaf] = []
        self.block = 0
        self._read(source)
        self.blocks = self._blocks()

    def _blocks(self) -> list[Block]:
        """Blocks with text, without the leaves of elements that are not part of it."""
        weight, out = self._weights(), []
        by_block: dict[int, list[Leaf]] = {}
        for x in self.leaves:
            if weight[x.node] and weight[x.node] >= weight[self.block_node[x.node]]:
                by_block.setdefault(x.block, []).append(x)
        for _, leaves in sorted(by_block.items()):
            node = self.block_node[leaves[0].node]
            block = Block(node, self.node_path[node], weight[node], leaves)
            if block.size:
                out.append(block)
        return out

    def _weights(self) -> list[float]:
        """Of each element: 0 if it is, or lies in, one that is not part of the text, less than 1 in menus. A name doesn't count on an
        element that holds half of the page's text and its main heading or article: there it tells of the layout."""
        n = len(self.tags)
        size, main = [0] * n, [t == "h1" or t in ARTICLES for t in self.tags]
        for x in self.leaves:
            size[x.node] += len(x.text)
        for k in range(n - 1, 0, -1):
            size[self.parents[k]] += size[k]
            main[self.parents[k]] |= main[k]
        out = [1.0] * n
        for k in range(1, n):
            named = self.marks[k] == NAMED and not (main[k] and 2 * size[k] >= size[0])
            own = 0.0 if named or self.marks[k] == OUTSIDE else MENU_WEIGHT if self.marks[k] == MENU else 1.0
            out[k] = min(own, out[self.parents[k]])
        return out

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.leaves.append(Leaf(node, self.block, html.unescape(raw) if "&" in raw else raw, self.in_link[node]))

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names = ".".join(sorted(w for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for w in (m[2] or m[3] or m[4] or "").split())) if attributes.strip() else ""
        key = (self.node_path[parent], f"{tag}.{names}" if names else tag)
        path = self.paths.setdefault(key, len(self.path_tag))
        if path == len(self.path_tag):
            self.path_tag.append(tag)
            self.path_parent.append(key[0])
            self.container.append(path if tag in CONTAINERS else self.container[key[0]])
            self.article.append(path if tag in ARTICLES else self.article[key[0]])
        self.tags.append(tag)
        self.parents.append(parent)
        self.node_path.append(path)
        self.block_node.append(len(self.tags) - 1 if tag in BLOCK else self.block_node[parent])
        inside = self.in_article[parent]
        self.marks.append(_mark(tag, attributes, inside))
        self.in_article.append(inside or tag in ARTICLES)
        self.in_link.append(self.in_link[parent] or tag == "a")
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, open_tags, at = [0], {}, 0

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                tag = self.tags[stack.pop()]
                open_tags[tag] -= 1
                if tag in BLOCK:
                    self.block += 1

        def close(which: set[str], stops: set[str]) -> None:
            for d in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[d]]
                if tag in which:
                    return close_to(d)
                if tag in stops:
                    return None
            return None

        while m := TOKEN.search(source, at):
            self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if open_tags.get(tag):
                    close({tag}, set())
                elif tag == "p":
                    self.block += 1
                continue
            if tag in RAW:
                if not m[3].endswith("/") and (end := re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)):
                    at = end.end()
                elif not m[3].endswith("/") and tag in ("script", "style", "title", "textarea"):
                    at = len(source)
                continue
            if tag == "br":
                self._text(stack[-1], "\n")
            if tag in CLOSES_P and open_tags.get("p"):
                close({"p"}, {"td", "th", "table", "button", "object"})
            if tag in ENDS and any(open_tags.get(x) for x in ENDS[tag][0]):
                close(*ENDS[tag])
            if tag in BLOCK:
                self.block += 1
            if tag in VOID:
                continue
            stack.append(self._open(stack[-1], tag, m[3]))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        self._text(stack[-1], source[at:])


def path_ratios(page: Page) -> dict[int, float]:
    """Of each tag path with text, its ratio, smoothed over the containers that it lies in.

    A path's own ratio fuses text and punctuation a block: characters * (UNMARKED + log(1 + marks)) * the unlinked share. A container's is the mean
    over the text of all paths below it. The smoothed ratio is half the path's own, and half of those of its containers from the
    nearest on, each with a quarter of the weight of the one before; an article or main counts like the nearest. Paths of list items, and those outside
    an article, that are mostly links, and what lies in containers of such, count by their unlinked share.
    """
    n = len(page.path_tag)
    size, marks, linked, count = [0] * n, [0] * n, [0] * n, [0] * n
    for x in page.blocks:
        size[x.path] += x.size
        marks[x.path] += x.marks
        linked[x.path] += x.linked
        count[x.path] += 1
    own = {p: size[p] / count[p] * (UNMARKED + log1p(marks[p] / count[p])) * (1 - linked[p] / size[p]) for p in range(n) if size[p]}
    mass, below, links = [0.0] * n, list(size), list(linked)
    for p in range(n - 1, -1, -1):
        mass[p] += own.get(p, 0.0) * size[p]
        if p:
            mass[page.path_parent[p]] += mass[p]
            below[page.path_parent[p]] += below[p]
            links[page.path_parent[p]] += links[p]
    region = lambda c: mass[c] / below[c]
    unlinked = lambda part, whole: 1.0 if part < LINKED * whole else 1 - part / whole
    out = {}
    for p in own:
        c, weight, around = page.container[p], 0.5, 0.0
        first = c
        for _ in range(LEVELS):
            around += weight * region(c)
            if not c:
                break
            c, weight = page.container[page.path_parent[c]], weight / 4
        article = page.article[p]
        if article >= 0:
            around = max(around, 0.5 * region(article))
        out[p] = 0.5 * own[p] + 0.5 * around
        if article < 0 or page.path_tag[p] == "li":
            out[p] *= unlinked(linked[p], size[p])
        if article < 0:
            out[p] *= unlinked(links[first], below[first])
    return out


def main_text(source: str | None) -> str:
    """The article's blocks in page order, joined by two line feeds; see `extract`."""
    if not source:
        return ""
    page = Page(source)
    ratios = path_ratios(page)
    total = sum(x.size for x in page.blocks)
    if not total:
        return ""
    least = SHARE * sum(x.weight * ratios[x.path] * x.size for x in page.blocks) / total
    return "\n\n".join(x.text for x in page.blocks if x.weight * ratios[x.path] >= least > 0)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, from its whole HTML.

    Blocks of text are gathered by tag path from the root (tags and classes). Text and punctuation a block, fused, smoothed over the
    containers around a path, make its ratio; blocks of paths from SHARE of the page's mean on are kept, wherever they lie. Headers, footers, asides,
    forms, adverts, notices and comments that a page names as such by tag, role, class or id are not text; what it names a menu weighs less.
    References are decoded, white space in a block becomes one space, blocks are joined by two line feeds.

    Null and empty HTML, and pages without text or with links only: the empty string, 0 characters. Repeated rows and null ids stay rows of their
    own. Pages of any length or depth are read whole, in time in proportion to their length. An empty table gives an empty result. Columns beyond
    id, url and html are not read.
    """
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 500
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pick(df, id_col, url_col, html_col).toDF("page_id", "url", "html")
    return rows.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
