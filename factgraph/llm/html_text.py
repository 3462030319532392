"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A logistic classifier over a block's text (length, link share,
punctuation, kind of element) and its place (elements and names around it) gives the log-odds that it is content:
the capacity of its edge to the source where they are positive, to the sink where they are negative. Neighbours in
page order and blocks with a close common ancestor are tied by smoothness edges, the stronger the closer they stand
in the tree. The minimum cut, found by augmenting paths, labels all blocks of a page at once; the source side is the
text. Forms, scripts, styles and the like never become blocks.

The weights of the text features are fitted on a bounded sample of pages, where the elements around a block say
plainly what it is, and are held near fixed ones, which also serve alone. Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.shared import table

# Fixed values of HTML: elements whose content is no text, void elements, elements that don't break a block.
RAW = frozenset("script style noscript template iframe object svg canvas math textarea title head select datalist".split())
#: Of these, the ones that swallow the rest of a page when nothing closes them.
SWALLOW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# Elements that are closed by the start of one of these.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd figcaption caption summary legend option".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
#: Elements that hold text and no parts of a page: a name on one of them says little.
LEAVES = HEADINGS | ITEMS | PARAGRAPHS
SECTIONS = frozenset("article main nav aside footer header form section dialog menu".split())
#: Log-odds of content that an element adds to what is inside it.
TAG_ODDS = {"nav": -4.0, "footer": -4.0, "aside": -3.5, "form": -5.0, "button": -5.0, "menu": -4.0, "dialog": -4.0, "header": -2.5, "article": 3.0, "main": 2.5}
HIDDEN_ODDS, CONTENT_NAME, NAME, LAYOUT_NAME, WEAK_NAME, LEAF_SHARE = -8.0, 1.0, -4.0, -2.0, -1.5, 0.2
#: Whole words in class, id, role and label of what isn't the author's text; of where it tends to stand; of content; of layout alone.
FOREIGN_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion comment comments disqus reply replies respond response responses cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay"
        " newsletter subscribe subscription signup login social share shares sharing related recommended recommendations breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation widget widgets copyright disclaimer skip banner banners contentinfo"
        " footer sidebar toolbar search legal"
    ).split()
)
LAYOUT_WORDS = frozenset(("header", "masthead", "foot", "side", "aside", "complementary", "toc"))
CONTENT_WORDS = frozenset("article articles content contents main post posts entry story prose body text".split())
#: Words that say nothing beside a foreign word: with others, the name may be about what the text is about.
PLAIN_WORDS = frozenset(
    (
        "area bar block body box btn button buttons card cards col column container content count data div element form grid group head heading header holder icon id inner item items js label layout left line link links list main"
        " module new note outer page panel part parent post posts primary right role root row secondary section site slot small story text thread title top bottom unit user view wrap wrapper article articles entry entries"
    ).split()
)
#: Headings of what readers or the site add, in lower case without numbers; what follows up to the next heading goes with them.
FOREIGN_HEADINGS = frozenset(
    (
        "comments|comment|responses|replies|leave a comment|leave a reply|reader comments|discussion|related articles|related posts|related stories|you may also like|read more|more stories|share this|follow us|newsletter|advertisement"
        "|kommentare|leserkommentare|kommentar schreiben|mehr zum thema|anzeige|commentaires|laisser un commentaire|articles liés|à lire aussi|publicité|comentarios|deja un comentario|artículos relacionados|publicidad"
    ).split("|")
)
HEADING_ODDS = -5.0
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
# a quote counts after an equals sign only; possessive, so that a tag is read once
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: White space is what separates words in markup; a no-break space that a page asks for stays.
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_WORD_RUN = re.compile(r"[\W\d_]+")
_STOPS = re.compile(r"[.,;:!?。、，…]")
FEATURES = ("always", "length", "links", "ends", "stops", "heading", "item", "paragraph")
#: Features whose weights are learned, all of the text itself.
TAUGHT = [0, 1, 2, 3, 4]
#: Weights that the fit starts from and is held to.
WEIGHTS = np.array([-1.8, 3.0, -4.0, 0.8, 1.0, 1.3, 0.6, 0.5])
#: Bounds of the log-odds from the text alone, and strengths of the edges.
TEXT_ODDS, NEXT, SIBLING = 3.0, 1.2, 0.4
#: Pages that the fit reads (the first by a hash of their id), blocks of each, and how firmly it is held.
SAMPLE, BLOCKS, RIDGE = 2_000, 64, 0.02


class Block:
    """Text, characters inside links, element number, and the steps in the tree from the block before it."""

    __slots__ = ("text", "linked", "element", "apart", "crossed")

    def __init__(self, text: str, linked: int, element: int, apart: int, crossed: bool):
        self.text, self.linked, self.element, self.apart, self.crossed = text, linked, element, apart, crossed


class Page:
    """Blocks of a page in order, and its elements: tag, parent and odds of their own names; element 0 is the page."""

    __slots__ = ("blocks", "tags", "parents", "names", "hidden")

    def __init__(self):
        self.blocks: list[Block] = []
        self.tags, self.parents, self.names, self.hidden = [""], [0], [0.0], [False]


def name_odds(called: str) -> float:
    """Log-odds by the words of an element's names; a layout word beside a content word says nothing.

    A foreign word among plain ones speaks against the element; beside other words it is weak evidence.
    """
    words = _WORDS.findall(_CAMEL.sub(" ", called).lower())
    if any(w in FOREIGN_WORDS for w in words):
        return NAME if all(w in FOREIGN_WORDS or w in LAYOUT_WORDS or w in PLAIN_WORDS or len(w) < 3 for w in words) else WEAK_NAME
    good, layout = any(w in CONTENT_WORDS for w in words), any(w in LAYOUT_WORDS for w in words)
    return CONTENT_NAME * good + LAYOUT_NAME * layout if good != layout else 0.0


def _described(tag: str, attributes: str) -> tuple[float, bool]:
    """(odds of the names, whether hidden) of a start tag."""
    called, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role", "aria-label"):
            called.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            hidden = True
    odds = name_odds(" ".join(called)) if called and tag not in ("body", "html") else 0.0
    return odds * LEAF_SHARE if tag in LEAVES else odds, hidden


def parse(page: str | None) -> Page:
    """Blocks with references decoded and white space collapsed; time grows with the length of the page, whatever it holds."""
    page, out = page or "", Page()
    stack: list[int] = [0]  # open elements that break blocks
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link, low, crossed = 0, 0, 0, False  # link: depth at which a link is open; low: least depth since the last block
    loose, missing = False, set()

    def flush() -> None:
        nonlocal linked, low, crossed
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" \t\n\x0b\x0c\r")
            if text:
                depth = len(stack)
                last = depths[-1] if depths else depth
                out.blocks.append(Block(text, min(linked, len(text)), stack[-1], last + depth - 2 * min(low, depth), crossed))
                depths.append(depth)
                low, crossed = depth, False
            parts.clear()
            linked = 0

    def close() -> None:
        nonlocal low, link, crossed
        tag = out.tags[stack.pop()]
        opened[tag] -= 1
        low = min(low, len(stack))
        crossed |= tag in SECTIONS
        if link > len(stack):
            link = 0

    depths: list[int] = []
    at, size = 0, len(page)
    while at < size:
        found = page.find("<", at)
        if found < 0:
            found = size
        if found > at:
            parts.append(page[at:found])
            if link:
                linked += found - at
        if found == size:
            break
        after = page[found + 1 : found + 2]
        if after in ("!", "?") or after == "/" and not page[found + 2 : found + 3].isalpha():
            if page.startswith("<!--", found):
                end = page.find("-->", found + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", found) and (end := page.find("]]>", found) if "]]>" not in missing else -1) >= 0:
                parts.append(html.escape(page[found + 9 : end]))
                at = end + 3
            else:
                if page.startswith("<![CDATA[", found):
                    missing.add("]]>")
                end = page.find(">", found)
                at = end + 1 if end >= 0 else size
            continue
        if not (after == "/" or after.isascii() and after.isalpha()):  # a bare sign
            parts.append("<")
            at = found + 1
            continue
        match = None if loose else _TAG.match(page, found)
        if match is None:
            loose = True  # quotes don't pair from here on
            match = _LOOSE.match(page, found)
        if match is None:  # a tag that never ends, or a sign before letters of no alphabet of tags
            if page.find(">", found) < 0:
                break
            parts.append("<")
            at = found + 1
            continue
        at = match.end()
        closing, tag, attributes = match.group(1), match.group(2).lower(), match.group(3)
        if tag in RAW and not closing:
            if tag in missing or attributes.rstrip().endswith("/") and tag not in SWALLOW:
                continue
            if tag not in ("svg", "math"):
                flush()
            end = re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in SWALLOW:
                at = size
            else:
                missing.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else len(stack)
            continue
        flush()
        if closing:
            if opened[tag]:
                while out.tags[stack[-1]] != tag:
                    close()
                close()
            continue
        while tag in CLOSED_BY.get(out.tags[stack[-1]], ()):
            close()
        if attributes.rstrip().endswith("/"):
            continue
        odds, hidden = _described(tag, attributes) if attributes else (0.0, False)
        out.parents.append(stack[-1]), out.names.append(odds), out.hidden.append(hidden)
        stack.append(len(out.tags))
        out.tags.append(tag)
        opened[tag] += 1
        crossed |= tag in SECTIONS
    flush()
    return out


def placed(page: Page) -> list[float]:
    """Log-odds of each element by the elements and names around it.

    A part that speaks against content outweighs the article around it. Names of a wrapper say nothing: of an element
    that holds an article (or main) and most of the page's text.
    """
    n = len(page.tags)
    size, holds = [0] * n, [False] * n
    for b in page.blocks:
        size[b.element] += len(b.text)
    for e in range(n - 1, 0, -1):  # children come after their parents
        up = page.parents[e]
        size[up] += size[e]
        holds[up] |= holds[e] or page.tags[e] in ("article", "main")
    odds, inside = [0.0] * n, [False] * n
    for e in range(1, n):
        up, tag = page.parents[e], page.tags[e]
        value, inside[e] = odds[up], inside[up]
        named = 0.0 if holds[e] and 2 * size[e] > size[0] else page.names[e]
        own = 0.0 if tag == "header" and inside[up] else TAG_ODDS.get(tag, 0.0)
        if own > 0:
            value, inside[e] = (value if inside[up] or value < NAME / 2 else max(value, 0.0) + own), True
        elif own < 0:
            value = min(value, 0.0) + own
        if named <= LAYOUT_NAME:  # a part of the page, or of the article
            value = min(value, 0.0) + named
        else:
            value += named
        if page.hidden[e]:
            value = min(value, 0.0) + HIDDEN_ODDS
        odds[e] = value
    return odds


def features(page: Page) -> np.ndarray:
    """One row of FEATURES for each block."""
    x = np.zeros((len(page.blocks), len(FEATURES)))
    for row, b in zip(x, page.blocks, strict=True):
        words, tag = b.text.count(" ") + 1, page.tags[b.element]
        row[:5] = 1, min(1.5, np.log1p(words) / np.log1p(40)), b.linked / len(b.text), b.text[-1] in ".!?…。:\"”»", min(1.0, 5 * len(_STOPS.findall(b.text)) / words)
        row[5:] = tag in HEADINGS, tag in ITEMS, tag in PARAGRAPHS
    return x


def called_off(page: Page) -> list[float]:
    """Log-odds of each block by the headings before it: those of comments and the like, and what follows them in their part."""
    out, open_at, level = [0.0] * len(page.blocks), None, ""
    for i, b in enumerate(page.blocks):
        tag, up = page.tags[b.element], page.parents[b.element]
        if tag in HEADINGS:
            plain = _WORD_RUN.sub(" ", b.text.lower()).strip()
            if plain in FOREIGN_HEADINGS:
                open_at, level = up, tag
            elif open_at is not None and tag <= level:
                open_at = None
        if open_at is not None:
            while up and up != open_at:
                up = page.parents[up]
            if up == open_at:
                out[i] = HEADING_ODDS
            else:
                open_at = None
    return out


def log_odds(page: Page, weights: np.ndarray = WEIGHTS) -> list[float]:
    """Log-odds that each block is content, by itself."""
    place, off = placed(page), called_off(page)
    text = np.clip(features(page) @ weights, -TEXT_ODDS, TEXT_ODDS)
    return [place[b.element] + float(t) + o for b, t, o in zip(page.blocks, text, off, strict=True)]


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness between blocks: neighbours by their distance in the tree, and blocks of one parent with others between them."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            out.append((i - 1, i, NEXT / (1 + max(0, b.apart - 2)) * (0.25 if b.crossed else 1.0)))
        parent = page.parents[b.element]
        if last.get(parent, i) < i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source side of a minimum cut: shortest augmenting paths (Dinic's levels)."""
    n = len(source)
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to)), to.append(b), room.append(forth)
        graph[b].append(len(to)), to.append(a), room.append(back)

    for i in range(n):  # what passes straight through needs no search
        through = min(source[i], sink[i])
        if source[i] > through:
            link(n, i, source[i] - through, 0.0)
        if sink[i] > through:
            link(i, n + 1, sink[i] - through, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:
            if a == n + 1:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], n
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append(graph[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def labels(page: Page, weights: np.ndarray = WEIGHTS) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    odds = log_odds(page, weights)
    return minimum_cut([max(0.0, o) for o in odds], [max(0.0, -o) for o in odds], edges(page))


def main_text(page: str | None, weights: np.ndarray = WEIGHTS) -> str:
    """The article of a page as one line: its content blocks in page order, joined by one space."""
    found = parse(page)
    return " ".join(b.text for b, k in zip(found.blocks, labels(found, weights), strict=True) if k)


def fit(x: np.ndarray, content: np.ndarray, start: np.ndarray = WEIGHTS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of TAUGHT by logistic loss, both classes weighed alike, held to ``start`` and within half and twice of it.

    The weights of elements stay: the examples come from elements, so they would only teach themselves. One class alone
    teaches nothing.
    """
    if not len(x) or content.all() or not content.any():
        return start
    x, w, each = x[:, TAUGHT], start[TAUGHT].copy(), np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - content)) + ridge * (w - start[TAUGHT])
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-7:
            break
    out = start.copy()
    out[TAUGHT] = np.sign(start[TAUGHT]) * np.clip(np.sign(start[TAUGHT]) * w, np.abs(start[TAUGHT]) / 2, np.abs(start[TAUGHT]) * 2)
    return out


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, blocks: int = BLOCKS) -> np.ndarray:
    """Weights fitted on at most ``sample`` pages and ``blocks`` evenly spaced blocks of each.

    Blocks that elements and names place plainly (in an article and no part that speaks against it, or in such a
    part) are the examples; the weights of elements and names themselves aren't learned. Null ids, empty pages and
    pages without such blocks teach nothing. Of rows that share an id one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in batch.column(1):
                page = parse(h.as_py())
                place = placed(page)
                at = [i for i, b in enumerate(page.blocks) if not -2.5 < place[b.element] < 2.5]
                at = at[:: -(-len(at) // blocks)] if at else at
                x = features(page)[at].ravel().tolist()
                rows.append((x, [page.blocks[i].element and place[page.blocks[i].element] > 0 for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([list(map(bool, r[1])) for r in rows], pa.list_(pa.bool_()))], ["id", "x", "content"])

    ids = pages.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).where("html is not null")
    found = texts.join(F.broadcast(chosen), "id").mapInArrow(run, "id long, x array<double>, content array<boolean>")
    one = found.groupBy("id").agg(F.min(F.struct("x", "content")).alias("row")).select("id", "row.*").toArrow().sort_by("id")
    x = np.array(one.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, np.array(one.column("content").combine_chunks().flatten(), bool))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: np.ndarray = WEIGHTS) -> DataFrame:
    """(id, text) of each row: main text of the whole html. Null and empty pages, and pages without content, give an empty text.

    Every row gives one row, repeated or not, null ids too; other columns are ignored; an empty table gives no rows.
    Broken markup is read as far as it goes: unclosed elements end with the page, quotes that don't pair count as
    text of the tag. White space is space, tab and line ends; a no-break space stays what it is. Long and deep pages take time and memory in proportion to their length; one page is one task's
    work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), weights) for h in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], ["id", "text", "carried"])

    carried = F.col("url") if "url" in pages.columns else F.lit(None)
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"), carried.cast("string").alias("carried")).mapInArrow(run, "id long, text string, carried string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, weights=learn(pages))
    return found.select(F.col("id").alias("page_id"), F.col("carried").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_text": op8_html_text}
