"""Main text of web pages: flat text blocks, classified by a decision tree that labelled pages train.

A page is cut into blocks of text. A block is described by its words and link density, those of the
blocks before and after it, and what it stands in: an element for other things than the article (by
its kind or its name), an element marked as the article, and its container with the containers like
it, which stand in the same kinds of elements: an article cut into forty sections is no less one than
an article in a single section. Names alone decide nothing: an element that is named for boilerplate
but holds most of the page is a wrapper, and a mark on a small part of the text is none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import read, shielded
from loomwright.llm.html_pages import labelled_pages

#: Attributes of a tag; a quote opens a value only after an equals sign, and only if it is closed.
ATTRIBUTES = r"(?:\s++|/|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
#: Markup, in one pass: comments, declarations, elements whose content is raw text, and tags.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(script|style|iframe|noembed|noframes|noscript|textarea|title|xmp)\b{ATTRIBUTES}>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is none of the page's.
UNREAD = set("audio button canvas datalist math object select svg template video".split())
HEADS = {f"h{i}" for i in range(1, 7)}
ITEMS = set("dd dt li td th tr".split())
#: Elements that end with what they stand in; their own end tags reach no further than that.
SMALL = {"p", "span", *HEADS, *ITEMS}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements for other things than the article. What holds most of a page can be a form, but none of the others.
SIDE, SOFT = set("aside dialog footer menu nav".split()), {"fieldset", "form"}
#: Elements that contain the blocks of one part of a page.
PARTS = set("address article aside body center dialog div fieldset footer form html main menu nav section td th".split())
HELD = BLOCKS | UNREAD | {"span"}

ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = {"class", "id", "role", "aria-label", "itemprop"}
NUMBER = re.compile(r"[\d_-]+")
#: Names by which a paragraph or a headline says that it is none of the article; others on them say little.
STRICT = re.compile(r"(?:^|\s)(?:ads?|advert\w*|copyright|newsletter|promo|sponsored)(?=$|\s)", re.I)
LINES = {"p", "blockquote", "caption", "figcaption", "pre", *HEADS}
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Names for how a page is laid out: what it has besides, or where.
LAYOUT = re.compile(
    r"(?:^|(?<=\s))(?:(?:has|with|no|without)[_-]\S+|(?:left|right|both|one|two|layout|page)[_-](?:side|sidebar|nav|menu)"
    r"|(?:side|sidebar|nav|menu)[_-](?:left|right|both|layout|page|open|closed)|(?:left|right)\s+side)(?=$|\s)",
    re.I,
)
#: The head of an article, which is none of the page.
HEADLINE = re.compile(r"(?:^|(?<=\s))(?:article|entry|post|story)[_-]+header(?=$|\s)", re.I)
TALK = re.compile(r"(?:^|[\s_-])(?:comment\w*|combx|disqus\w*|discussion\w*|remark\w*|repl(?:y|ies)|respond|shoutbox)(?=$|[\s_-])", re.I)
BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adbox|banner\w*|breadcrumb\w*|byline-links|complementary|contentinfo|cookie\w*|"
    r"consent|copyright|disclaimer|dialog|footer\w*|foot|gdpr|header|login|masthead|menu\w*|meta|modal\w*|nav\w*|newsletter\w*|notice\w*|"
    r"notification\w*|outbrain|overlay|pager|pagination|popup\w*|promo\w*|popular|recommend\w*|related\w*|rss|search\w*|share\w*|"
    r"sidebar\w*|side|signup|site-header|skip\w*|skyscraper|social\w*|sponsor\w*|subscribe\w*|tags|toolbar|topbar|tracking|widget\w*)(?=$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry\w*|main|post\w*|story\w*|text)(?=$|[\s_-])", re.I)

#: How an element speaks against its text: not at all, by its name or as a form, as an element for
#: something else or the readers' comments, or as it isn't seen.
CLEAN, NAMED, OTHER, HIDDEN = range(4)
#: How it speaks for it: not at all, by its name, or as article or main element.
NONE, CALLED, MARKED = range(3)
#: The part of a page's text from which a container is a wrapper of the whole, if it has the main
#: headline or is a form, and otherwise; the part that elements marked as the article must hold, and named ones.
MOST, NEARLY_ALL, MARKED_PART, CALLED_PART = 0.5, 0.8, 0.3, 0.5

FEATURES = "side bad main outside head item paragraph home own held held_link link words before_words before_link after_words after_link".split()
#: Features that a text can only gain by: the tree splits at them only where more of them means more of the article.
RISING = {FEATURES.index(f) for f in ("main", "home", "own", "held")}
#: Depth of the tree, blocks in a leaf at least, and the levels from the top that ask for words and links alone.
DEPTH, LEAF, FLAT = 10, 3, 2
#: Words and link density of a block and of those beside it.
FLAT_FEATURES = {FEATURES.index(f) for f in ("link", "words", "before_words", "before_link", "after_words", "after_link")}


@dataclass
class Block:
    """Text between two block boundaries: where it starts in the page, and what it stands in."""

    text: str
    start: int
    words: int
    link: float
    node: int
    head: bool


@dataclass
class Page:
    """Blocks, and of each element that can hold some: the one it stands in, its name, what it speaks against and for, its kind (name and first class)."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    element: list[str] = field(default_factory=list)
    against: list[int] = field(default_factory=list)
    given: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)


@dataclass
class Tree:
    """A binary decision tree; a leaf has no column."""

    share: float
    column: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def says(self, row: list[float]) -> bool:
        node = self
        while node.column >= 0:
            node = node.low if row[node.column] <= node.at else node.high
        return node.share >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF, flat: int = FLAT) -> Tree:
    """Split by the least Gini impurity, until a node is pure, `depth` deep or too small; of equal splits the first.

    The first `flat` levels split by words and link density of a block and its neighbours; what a block
    stands in is asked for below them, of blocks that are alike in these.
    """
    node = Tree(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = None
    for j in sorted(FLAT_FEATURES) if flat > 0 else range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        value, good = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = good[:-1], good[-1] - good[:-1]
        impurity = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        impurity[(value[1:] == value[:-1]) | (n < leaf) | (len(y) - n < leaf)] = np.inf
        if j in RISING:
            impurity[left / n > right / (len(y) - n)] = np.inf
        k = int(impurity.argmin()) if len(impurity) else -1
        if k >= 0 and impurity[k] < (best[0] - 1e-9 if best else np.inf):
            best = (float(impurity[k]), j, float((value[k] + value[k + 1]) / 2))
    if best is not None:
        _, node.column, node.at = best
        low = x[:, node.column] <= node.at
        node.low, node.high = grow(x[low], y[low], depth - 1, leaf, flat - 1), grow(x[~low], y[~low], depth - 1, leaf, flat - 1)
    return node


def evidence(element: str, attributes: str) -> tuple[int, int]:
    """What an element speaks against and for its text, by itself."""
    names, hidden = [], element in UNREAD
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in NAMING:
            names.append(value)
            hidden = hidden or key == "class" and "hidden" in value.lower().split()
        elif key == "hidden":
            hidden = hidden or value.lower() != "false"
        elif key == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif key == "style":
            hidden = hidden or bool(UNSEEN.search(value))
    if hidden:
        return HIDDEN, NONE
    if element in ("html", "body"):  # these hold the whole page
        return CLEAN, NONE
    title = HEADLINE.sub("", LAYOUT.sub("", " ".join(names)))
    against = OTHER if element in SIDE or TALK.search(title) else NAMED if element in SOFT or title and (STRICT if element in LINES else BAD).search(title) else CLEAN
    if element in ("article", "main") or "articleBody" in names or "main" in names:
        return against, MARKED
    return against, CALLED if title and not against and GOOD.search(title) else NONE


def kind_of(element: str, attributes: str) -> str:
    """The name of an element with its first class, without the digits that number it."""
    if element not in PARTS or "class" not in attributes.lower():
        return element
    names = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "").split()
    return f"{element}.{NUMBER.sub('', names[0])}" if names else element


def parse(page: str) -> Page:
    """All text blocks in page order, with the elements around them. A line break is white space; two in a row end a block."""
    out = Page([], [-1], ["html"], [CLEAN], [NONE], ["html"])
    stack = [0]  # elements that are open
    places: dict[str, list[int]] = {"html": [0]}  # of each kind of element, where in the stack it is
    edges = [0]  # where in the stack the elements are whose end tags reach far
    parts: list[str] = []
    linked: list[str] = []
    links, breaks, head, start = 0, 0, 0, -1

    def flush() -> None:
        nonlocal parts, linked, start
        if parts and start >= 0:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                inside = len(html.unescape("".join(linked)).split()) if linked else 0
                out.blocks.append(Block(text, start, n, min(1.0, inside / n), stack[-1], head > 0))
        if parts:
            parts, linked = [], []
        start = -1

    def leave(to: int) -> None:
        """Close all elements from this place of the stack on."""
        for node in stack[to:]:
            places[out.element[node]].pop()
        del stack[to:]
        while edges[-1] >= to:
            edges.pop()

    last = 0
    for m in MARKUP.finditer(page):
        if m.start() > last:
            text = page[last : m.start()]
            parts.append(text)
            if links:
                linked.append(text)
            if not text.isspace():
                breaks = 0
                if start < 0:
                    start = last
        last = m.end()
        if m[3] is None:
            if m[1]:
                parts.append(" ")
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name == "a":
            links = 0 if closing else 1
            linked.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if name in BLOCKS:
            flush()
            breaks = links = 0
            if name in HEADS:
                head = 0 if closing else 1
            elif not closing:
                head = 0
            if not closing and out.element[stack[-1]] == "p":
                leave(len(stack) - 1)
        if name not in HELD or name in VOID:
            continue
        if closing:
            at = places.get(name)
            if at and at[-1] > 0 and (name not in SMALL or at[-1] > edges[-1]):
                if any(out.against[node] != CLEAN for node in stack[at[-1] :]):
                    flush()
                leave(at[-1])
            continue
        if name in ("li", "dd", "dt", "td", "th", "tr") and places.get(name) and places[name][-1] > edges[-1]:
            leave(places[name][-1])  # an item ends the one before it
        if name == "svg" and m[4].endswith("/"):
            continue
        against, given = evidence(name, m[4])
        if name == "header" and against < OTHER and not any(out.given[node] == MARKED for node in stack):
            against = OTHER
        if against and name not in BLOCKS:
            flush()
        out.parent.append(stack[-1])
        out.element.append(name)
        out.kind.append(kind_of(name, m[4]))
        out.against.append(against)
        out.given.append(given)
        if name not in SMALL:
            edges.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append(len(out.parent) - 1)
    if last < len(page):
        parts.append(page[last:])
        if start < 0 and not page[last:].isspace():
            start = last
    flush()
    return out


def described(page: Page) -> tuple[list[Block], list[list[float]]]:
    """The blocks that are seen, and of each the FEATURES."""
    n, parent, element = len(page.parent), page.parent, page.element
    text = [0.0] * n  # words outside links, of each element's own blocks
    headline = [False] * n
    for b in page.blocks:
        text[b.node] += b.words * (1 - b.link)
        i = b.node
        headline[i] = headline[i] or b.head
    hard = [False] * n  # in an element for something else
    for i in range(n):
        hard[i] = page.against[i] >= OTHER or parent[i] >= 0 and hard[parent[i]]

    def held(counts) -> list[float]:
        """Words of each element with all inside it, of those where counts."""
        total = [t if counts(i) else 0.0 for i, t in enumerate(text)]
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        return total

    free = held(lambda i: not hard[i])
    named = [False] * n
    for i in range(n):
        named[i] = page.against[i] == NAMED or parent[i] >= 0 and named[parent[i]]
    marked = any(page.given[i] == MARKED and not hard[i] and not named[i] and free[i] for i in range(n))
    titled = [element[i] == "h1" and not hard[i] and headline[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        titled[parent[i]] = titled[parent[i]] or titled[i]
    whole = max(free[0], 1.0)
    bad = [False] * n
    for i in range(n):
        against = page.against[i] == NAMED
        if against and not marked:  # a wrapper is no boilerplate
            against = free[i] <= whole * (MOST if titled[i] or element[i] in SOFT else NEARLY_ALL)
        elif against and element[i] in SOFT:
            against = free[i] <= whole * MOST
        bad[i] = against or parent[i] >= 0 and bad[parent[i]]

    good = held(lambda i: not hard[i] and not bad[i])
    whole = max(good[0], 1.0)
    inside = [NONE] * n
    for i in range(n):
        given = NONE if hard[i] or bad[i] else page.given[i]
        inside[i] = max(given, inside[parent[i]]) if parent[i] >= 0 and not hard[i] and not bad[i] else given
    own = [0.0] * 3
    for i in range(n):
        if not hard[i] and not bad[i]:
            own[inside[i]] += text[i]
    if own[MARKED] and own[MARKED] >= MARKED_PART * whole:
        level = MARKED
    elif own[CALLED] + own[MARKED] >= CALLED_PART * whole and own[CALLED]:
        level = CALLED
    else:
        level = MARKED + 1
    part = [0] * n  # the container of each element
    for i in range(n):
        part[i] = i if element[i] in PARTS else part[parent[i]] if i else 0

    direct, words, linked = [0.0] * n, [0.0] * n, [0.0] * n  # of each container's own blocks
    for i in range(n):
        if not hard[i] and not bad[i]:
            direct[part[i]] += text[i]
    for b in page.blocks:
        words[part[b.node]] += b.words
        linked[part[b.node]] += b.words * b.link
    # containers that stand in the same kinds of containers are alike, and count together
    paths: dict[tuple[int, str], int] = {}
    path = [0] * n
    for i in range(1, n):
        up = path[parent[i]]
        path[i] = paths.setdefault((up, page.kind[i]), len(paths) + 1) if part[i] == i else up
    own_words, home_words = [0.0] * (len(paths) + 1), [0.0] * (len(paths) + 1)
    for i in range(n):
        if part[i] == i:
            own_words[path[i]] += direct[i]
            home_words[path[i]] += good[i]

    hidden = [False] * n
    for i in range(n):
        hidden[i] = page.against[i] == HIDDEN or parent[i] >= 0 and hidden[parent[i]]
    seen = [b for b in page.blocks if not hidden[b.node]]
    rows = []
    for k, b in enumerate(seen):
        i = b.node
        before, after = seen[k - 1] if k else None, seen[k + 1] if k + 1 < len(seen) else None
        rows.append(
            [
                float(hard[i]), float(bad[i]), float(inside[i] >= level), float(level <= MARKED and inside[i] < level),
                float(b.head) + float(element[i] == "h1"), float(element[i] in ITEMS), float(element[i] == "p"),
                home_words[path[i]] / whole, own_words[path[i]] / whole, good[part[i]], linked[part[i]] / max(words[part[i]], 1.0), b.link, float(b.words),
                float(before.words if before else 0), before.link if before else 0.0,
                float(after.words if after else 0), after.link if after else 0.0,
            ]
        )
    return seen, rows


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The blocks of the labelled pages: features in the order of FEATURES, labels."""
    x, y = [], []
    for text, lines in labelled_pages():
        starts = np.array([a for a, _ in lines])
        for b, row in zip(*described(parse(text)), strict=True):
            label = lines[int(np.searchsorted(starts, b.start, "right")) - 1][1]
            if label < 0:
                raise ValueError(f"a line without a label has text: {b.text}")
            x.append(row)
            y.append(label)
    return np.array(x), np.array(y)


@cache
def trained() -> Tree:
    return grow(*labelled_blocks())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The article's blocks, one a line; '' for a null or empty page or one without an article."""
    tree = tree or trained()
    return "\n".join(b.text for b, row in zip(*described(parse(page or "")), strict=True) if tree.says(row))


@shielded
def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages without the source, with text and n_chars (code points).

    Each row stands for itself: repeated rows stay, and an empty table stays empty. A null or empty
    page has the text ''. Own columns text and n_chars are replaced. A page is worked on as a whole, in
    time that grows with its length, however deep its markup.
    """
    rest = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    tree = trained()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = [main_text(x, tree) for x in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*rest, "text", "n_chars"]
                )

    return pages.select(*rest, F.col(source).alias("_html")).mapInArrow(tell, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
