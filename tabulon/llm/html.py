"""Main text of web pages by a tree-structured model over the page's elements.

Every block element is a node that is content or not. A node has a potential from its tag, its class names and
its text; parent and child have a joint potential. Messages go up from the leaves and down from the root, which
gives every node's marginal, and the text of nodes above one half is kept. The potentials are trained piecewise
on labelled pages: a logistic regression for the nodes, co-occurrence of labels for parents and children.

Labelled pages come from the given pages: what an article element holds is content and what navigation,
adverts, footers and the like hold isn't. The same blocks, laid out anew in layouts without such elements
(plain divisions with and without speaking class names, side columns, notices, forms, reader comments), are
labelled by construction. Where the given pages have no such elements, blocks that several pages share and
blocks of links are no content, and long blocks of one page only are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.llm.text import aliased

#: Pages that the labelled training pages are made from, the first by a hash of their id.
SAMPLE = 1000
#: Words from which a block that only one page has is taken for content, where nothing else tells.
LONG = 8

_NAME_ENDS = re.compile(r"[\s/>]")
_TURNS = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

#: HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title head".split())
UNPARSED = frozenset("script style textarea title noscript iframe".split())
#: What may stand in a head; the start of anything else ends one that isn't closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}

TAGS = (
    "p heading li article main section div nav header footer aside form table td ul blockquote pre figure body button other"
).split()
GROUPS = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs"},
    "advert": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner"},
    "foot": {"footer", "foot", "copyright", "legal", "colophon", "bottom"},
    "head": {"header", "masthead", "topbar", "top", "logo", "brand"},
    "side": {"sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "more", "trending", "complementary"},
    "comment": {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "discussion", "feedback", "reviews"},
    "notice": {"cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "overlay", "warning", "message", "toast", "dialog"},
    "form": {"share", "social", "subscribe", "newsletter", "signup", "login", "search", "form", "contact", "register"},
    "content": {"content", "article", "post", "entry", "story", "main", "body", "text", "articlebody", "prose"},
}
N_FEATURES = 1 + len(TAGS) + len(GROUPS) + 10


class Tags:
    """The tags of a page in order, each step in time linear in what it passes.

    A tag whose end isn't found is text. What was found missing once is remembered, so that no part of a broken page
    is read again for each of its tags: the last ">", where the next name ends and the next quote stands, and the
    quotes from which no end is reached.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.lost: set[int] = set()  # opening quotes behind which no tag ends
        self.name_end = self.turn = -1

    def _end(self, at: int) -> int:
        """Place of the ">" that ends a tag whose name ends at a place, -1 without one."""
        if self.turn < at:
            found = _TURNS.search(self.source, at)
            self.turn = found.start() if found else len(self.source)
        turn, passed = self.turn, []
        while turn <= self.last and self.source[turn] != ">":
            if turn in self.lost:
                break
            passed.append(turn)
            closed = self.source.find(self.source[turn], turn + 1)
            found = _TURNS.search(self.source, closed + 1) if closed >= 0 else None
            turn = found.start() if found else len(self.source)
        else:
            if turn <= self.last:
                return turn
        self.lost.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start and end of the next tag or comment, its name (empty for comments), whether it closes, its attributes."""
        source = self.source
        start = source.find("<", at)
        while start >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(source)), "", False, ""
            if start < self.last:
                if source[start + 1] in "!?":
                    return start, source.find(">", start) + 1, "", False, ""
                closing = source[start + 1] == "/"
                first = start + 1 + closing
                if source[first].isascii() and source[first].isalpha():
                    if self.name_end < first:
                        self.name_end = _NAME_ENDS.search(source, first).start()  # at most the last ">"
                    end = self._end(self.name_end)
                    if end >= 0:
                        return start, end + 1, source[first : self.name_end].lower(), closing, source[self.name_end : end]
            start = source.find("<", start + 1)
        return None


class Page:
    """Block elements in page order (parents first) and the text blocks with their element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.groups, self.label = ["root"], [-1], [frozenset()], [None]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, words inside links
        stack: list[tuple[str, int]] = [("root", 0)]  # open elements; inline ones have their block's number
        pieces: list[str] = []
        linked = links = 0
        places: defaultdict[str, list[int]] = defaultdict(list)  # where the stack has a name
        skipped: list[str] = []  # an open element whose text isn't read, and those open in it
        inside: Counter[str] = Counter()  # the names of the skipped
        tags = Tags(source)
        at = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
                pieces.clear()
            linked = 0

        def say(raw: str) -> None:
            nonlocal linked
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                if links:
                    linked += len(text.split())

        def push(name: str, node: int) -> None:
            places[name].append(len(stack))
            stack.append((name, node))

        def pop(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                if stack[-1][0] not in INLINE:
                    flush()
                elif stack[-1][0] == "a":
                    links -= 1
                places[stack.pop()[0]].pop()

        def last(names: set[str]) -> int:
            return max((places[x][-1] for x in names if places[x]), default=0)

        def skip(name: str) -> None:
            skipped.append(name)
            inside[name] += 1

        def only_head() -> bool:
            return 0 < len(skipped) == inside["head"]

        def read_on() -> None:
            skipped.clear()
            inside.clear()

        while True:
            found = tags.next(at)
            if only_head() and source[at : found[0] if found else len(source)].strip():
                read_on()  # text ends a head, too
            if found is None:
                if not skipped:
                    say(source[at:])
                break
            start, end, name, closing, attributes = found
            if not skipped:
                say(source[at:start])
            at = end
            if not name:
                continue
            if skipped:
                if only_head() and not closing and name not in IN_HEAD:
                    read_on()  # and the element is read below
                elif closing:
                    if inside[name]:
                        gone = ""
                        while gone != name:
                            gone = skipped.pop()
                            inside[gone] -= 1
                        continue
                    # the end of an element around the skipped ones ends them; the element is closed below
                    if not places[name]:
                        continue
                    read_on()
                else:
                    if name in UNPARSED:
                        at = self._behind(source, name, at)
                    elif name not in VOID and not attributes.rstrip().endswith("/"):
                        skip(name)
                    continue
            if closing:
                if places[name]:
                    pop(places[name][-1])
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr"):
                    pieces.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in UNPARSED:
                at = self._behind(source, name, at)
                continue
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    skip(name)
                continue
            if name in INLINE:
                push(name, stack[-1][1])
                links += name == "a"
                continue
            flush()
            if places["p"]:  # always the innermost block: the next one closes it
                pop(places["p"][-1])
            if name in CLOSED_BY:
                to = last(CLOSED_BY[name])
                if to > last(HOLDS.get(name, {"table"})):
                    pop(to)
            names = {w for g in _NAMES.findall(attributes) for w in _PART.findall("".join(g).lower())} if attributes else ()
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.groups.append(frozenset(g for g, words in GROUPS.items() if names and words & names))
            marked = re.search(r'data-label="([01])"', attributes) if "data-label" in attributes else None
            self.label.append(int(marked[1]) if marked else None)
            push(name, len(self.tag) - 1)
        pop(1)
        flush()

    @staticmethod
    def _behind(source: str, name: str, at: int) -> int:
        found = re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)
        return source.find(">", found.end()) + 1 or len(source) if found else len(source)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        words, linked, stops, blocks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        own = np.zeros(n)
        for node, text, in_links in self.blocks:
            size = text.count(" ") + 1
            words[node] += size
            own[node] += size
            linked[node] += in_links
            stops[node] += sum(map(text.count, ".,;!?"))
            blocks[node] += 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            words[p] += words[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            blocks[p] += blocks[i]
        out = np.zeros((n, N_FEATURES))
        out[:, 0] = 1
        for i in range(n):
            tag = _TAG_INDEX.get(self.tag[i], _OTHER)
            out[i, 1 + tag] = 1
            for g in self.groups[i]:
                out[i, _GROUP_INDEX[g]] = 1
        base = 1 + len(TAGS) + len(GROUPS)
        out[:, base] = np.log1p(words) / 4
        out[:, base + 1] = linked / np.maximum(words, 1)
        out[:, base + 2] = np.minimum(stops / np.maximum(words, 1), 1)
        out[:, base + 3] = np.log1p(words / np.maximum(blocks, 1)) / 3
        out[:, base + 4] = words / max(words[0], 1)
        out[:, base + 5] = own > 0
        out[:, base + 6] = words == 0
        out[:, base + 7] = np.log1p(blocks) / 3
        for i in range(1, n):  # below an article or main element, below something that holds no content
            bad = self.tag[i] in _NEVER or bool(self.groups[i] & _BAD) or out[self.parent[i], base + 9] > 0
            out[i, base + 9] = bad
            out[i, base + 8] = not bad and (self.tag[i] in ("article", "main") or out[self.parent[i], base + 8] > 0)
        return out


_TAG_INDEX = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 1 for i in range(1, 7)}
_TAG_INDEX |= {"ol": TAGS.index("ul"), "th": TAGS.index("td"), "tr": TAGS.index("table"), "tbody": TAGS.index("table")}
_OTHER = TAGS.index("other")
_GROUP_INDEX = {g: 1 + len(TAGS) + i for i, g in enumerate(GROUPS)}

_NEVER = {"nav", "footer", "aside", "form", "header", "button"}
_BAD = frozenset(GROUPS) - {"content"}


def labels(page: Page) -> list[int | None]:
    """Labels of a page's elements: marked ones, else inside an article or main element or not; containers by
    what most of their words are; None if there is nothing to go by."""
    n = len(page.tag)
    inherited: list[int | None] = [None] * n
    for i in range(1, n):
        up = inherited[page.parent[i]]
        if page.label[i] is not None:
            inherited[i] = page.label[i]
        elif page.tag[i] in _NEVER or page.groups[i] & _BAD:
            inherited[i] = 0
        elif page.tag[i] in ("article", "main") and up is None:
            inherited[i] = 1
        else:
            inherited[i] = up
    return _with_containers(page, inherited)


def _with_containers(page: Page, own: list[int | None]) -> list[int | None]:
    """own, and for elements without a label what most of the labelled words in them are."""
    n = len(page.tag)
    good, all_ = [0] * n, [0] * n
    for node, text, _ in page.blocks:
        size = text.count(" ") + 1
        if own[node] is not None:
            all_[node] += size
            good[node] += size * own[node]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        all_[page.parent[i]] += all_[i]
    return [x if x is not None else (None if not all_[i] else int(2 * good[i] > all_[i])) for i, x in enumerate(own)]


def labels_by_text(page: Page, pages_with: Counter) -> list[int | None]:
    """Labels from what any page has: a block that another page has, too, or that is mostly links, isn't content; one
    of LONG words or more that no other page has is; an element is what most such words of its own are."""
    good, bad = [0] * len(page.tag), [0] * len(page.tag)
    for node, text, linked in page.blocks:
        size = text.count(" ") + 1
        if pages_with[text] > 1 or 2 * linked > size:
            bad[node] += size
        elif size >= LONG:
            good[node] += size
    return _with_containers(page, [int(g > b) if g + b else None for g, b in zip(good, bad)])


def marginals(page: Page, model: dict) -> np.ndarray:
    """Chance of every element to be content, by messages up and down the tree."""
    z = np.clip(page.features() @ model["weights"], -30, 30)
    own = [(1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))) for x in z.tolist()]
    (a, b), (c, d) = model["pair"]  # parent's label, child's label
    n, parent = len(own), page.parent
    up = [[x, y] for x, y in own]  # own potential times the children's messages
    sent = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        x, y = up[i]
        m0, m1 = a * x + b * y, c * x + d * y
        s = m0 + m1
        sent[i] = (m0 / s, m1 / s)
        to = up[parent[i]]
        to[0] *= sent[i][0]
        to[1] *= sent[i][1]
        t = to[0] + to[1]
        to[0] /= t
        to[1] /= t
    out = [0.0] * n
    down = [(1.0, 1.0)] * n
    for i in range(n):
        x, y = up[i][0] * down[i][0], up[i][1] * down[i][1]
        s = x + y
        x, y = x / s, y / s
        out[i] = y
        up[i] = [x, y]
        if i + 1 < n:
            p = parent[i + 1]
            rest0, rest1 = up[p][0] / max(sent[i + 1][0], 1e-12), up[p][1] / max(sent[i + 1][1], 1e-12)
            m0, m1 = rest0 * a + rest1 * c, rest0 * b + rest1 * d
            s = m0 + m1
            down[i + 1] = (m0 / s, m1 / s)
    return np.array(out)


def main_text(source: str, model: dict) -> str:
    page = Page(source)
    if not page.blocks:
        return ""
    kept = marginals(page, model) >= 0.5
    return "\n".join(text for node, text, _ in page.blocks if kept[node])


def _layouts(page: Page, known: list[int | None], turn: int) -> Iterator[str]:
    """The page's blocks in other layouts; data-label marks what is content."""
    e = html.escape
    body = [e(t) for node, t, _ in page.blocks if known[node] == 1]
    other = [e(t) for node, t, _ in page.blocks if known[node] == 0]
    if len(body) < 2 or not other:
        return
    title, paragraphs = body[0], body[1:]
    text = f'<h1 data-label="1">{title}</h1>' + "".join(f'<p data-label="1">{p}</p>' for p in paragraphs)
    listed = "".join(f'<li data-label="1">{p}</li>' for p in paragraphs[1:4])
    if turn % 3 == 0 and listed:
        text = f'<h2 data-label="1">{title}</h2><p data-label="1">{paragraphs[0]}</p><ul data-label="1">{listed}</ul>' + "".join(
            f'<blockquote data-label="1">{p}</blockquote>' for p in paragraphs[4:]
        )
    plain = "".join(f'<div data-label="1">{p}</div>' for p in body)
    menu = "".join(f'<li><a href="/">{w}</a></li>' for w in other[:8])
    note = other[turn % len(other)]
    quote = paragraphs[turn % len(paragraphs)]
    name = ["content", "post", "entry", "story", "article-body", "", "text", "main"][turn % 8]
    said = "".join(f'<div class="comment"><b>{e(note[:12])}</b><p>{x}</p></div>' for x in (quote, title))
    yield (
        f'<body><div class="header" data-label="0"><div class="logo">{note}</div><ul class="menu">{menu}</ul></div>'
        f'<div class="{name}" data-label="1">{text}</div><div class="sidebar" data-label="0"><h3>{title}</h3><p>{quote}</p>'
        f'<ul>{menu}</ul></div><div id="comments" data-label="0">{said}</div><div class="footer" data-label="0">{note}</div></body>'
    )
    yield (
        f'<body><div data-label="0"><ul>{menu}</ul></div><div class="cookie-notice" data-label="0"><p>{quote}</p></div>'
        f'<div><div data-label="1">{plain if turn % 2 else text}</div><div class="related" data-label="0"><p>{title}</p></div>'
        f'<div data-label="0"><p><a href="/">{note}</a></p></div></div><form data-label="0"><p>{quote}</p><label>{note}</label></form></body>'
    )
    if turn % 4 == 0:
        yield (
            f'<body><table><tr><td data-label="0"><ul>{menu}</ul></td><td data-label="1">{text}</td>'
            f'<td data-label="0"><p><a href="/">{note}</a></p></td></tr></table></body>'
        )
    yield (
        f'<body><header data-label="0"><p>{note}</p></header><main data-label="1"><section>{text}</section>'
        f'<aside data-label="0"><p>{quote}</p></aside><div class="ad" data-label="0">{quote}</div>'
        f'<section class="comments" data-label="0"><article><p>{quote}</p></article><ul><li>{title}</li></ul></section>'
        f'<div class="newsletter" data-label="0"><p>{quote}</p></div></main><footer data-label="0"><p>{quote}</p></footer></body>'
    )


def fit(sources: list[str]) -> dict:
    """Potentials from labelled pages: the given ones and their blocks in other layouts.

    If their elements and class names don't show both what is content and what isn't, what the pages share does
    (labels_by_text). Without both, as for a single page of paragraphs, every block is content.
    """
    pages = [Page(source) for source in sources]
    given = [labels(page) for page in pages]
    if len({x for known in given for x in known} - {None}) < 2:
        pages_with = Counter(text for page in pages for text in {text for _, text, _ in page.blocks})
        given = [labels_by_text(page, pages_with) for page in pages]
    if len({x for known in given for x in known} - {None}) < 2:
        return {"weights": np.zeros(N_FEATURES), "pair": [[1.0, 1.0], [1.0, 1.0]]}
    rows, marks, weights, pairs = [], [], [], np.ones((2, 2))
    for turn, (page, of_page) in enumerate(zip(pages, given)):
        for one, known in ((page, of_page), *((x, labels(x)) for x in map(Page, _layouts(page, of_page, turn)))):
            at = [i for i, x in enumerate(known) if x is not None and i]
            if at:
                rows.append(one.features()[at])
                marks.append(np.array([known[i] for i in at], dtype=float))
                weights.append(np.full(len(at), (4.0 if one is page else 1.0) / len(at)))  # every page counts alike
            for i in at:
                if known[one.parent[i]] is not None:
                    pairs[known[one.parent[i]], known[i]] += 1
    x, y, much = np.concatenate(rows), np.concatenate(marks), np.concatenate(weights)
    w = np.zeros(N_FEATURES)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (much * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(N_FEATURES)
        w += np.linalg.solve(hessian, x.T @ (much * (y - p)) - 0.3 * w)
    joint = pairs / pairs.sum()
    pair = joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))
    return {"weights": w, "pair": pair.tolist()}


def train(pages: DataFrame, sample: int = SAMPLE, id_column: str = "page_id", html_column: str = "html") -> dict:
    """Model from at most `sample` pages of at most 200,000 characters; longer ones aren't trained on."""
    rows = aliased(pages, {"id": id_column, "html": html_column}).where("html is not null and length(html) <= 200000")
    # ids by hash first, so that no page goes through the sort
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    return fit([r["html"] for r in rows.join(F.broadcast(chosen), "id").orderBy("id", "html").limit(sample).collect()])


def extract(pages: DataFrame, model: dict, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """pages without the html column, with text (empty if none) and n_chars.

    A null page is empty. Rows are kept as they come; a column named text or n_chars is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    df = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_column}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__html")
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                texts = [main_text(column[start + i].as_py() or "", shared.value) for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in others], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=[*others, "text", "n_chars"],
                )

    fields = [f for f in df.schema.fields if f.name != "__html"]
    return df.mapInArrow(run, StructType([*fields, *StructType.fromDDL("text string, n_chars long").fields]))
