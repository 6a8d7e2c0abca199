"""HTML extraction by minimum-cut labelling.

A page is parsed into blocks of text. A logistic classifier gives a block's log-odds of being content, from its text (length, links, sentence end,
heading) and from what the tags, roles and names around it speak for (content, boilerplate, neither in a page that has content); bounded by `SURE`, these are its
capacity to a terminal. Smoothness edges join neighbours in page order, the stronger the nearer they are in the DOM, and
the nearest blocks under one parent, whatever their names speak for. The minimum cut (Dinic) separates content from boilerplate; content blocks in
page order are the text. So a short paragraph follows its neighbours, a list of links leaves its article, and an article whose names
are missing or sound like boilerplate is kept by its text.

The weights are fitted (`fit`) on blocks whose tags and names are known, after those of some regions are taken away or turned round: so the fit
learns how far names can be trusted, and what a text says without them. `labelled` tells how the classifier alone and the cut judge each block.

Defined results: a null or empty page has the text ""; scripts, styles, comments and the head are never text; unclosed or
stray tags are tolerated; repeated rows have equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block, that hold no text, that have no end tag, and the place they or their class or id speak for.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style head title noscript template svg iframe object textarea select button math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILER_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|footer\w*|header\w*|masthead|cookie\w*|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|comment-\w+|respond|replies|disqus\w*|widget\w*|pagination|toolbar|login|search)(?:$|[\s_-])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body-text)(?:$|[\s_-])", re.I)
#: Parts of a name that state something of a layout or of a topic ("no-sidebar", "category-social"), and names of content's own headers.
STATED = re.compile(r"(?:^|[_-])(?:no|not|non|has|have|with|without|is|hide|hidden|show|category|cat|tag|topic|layout|template)(?:[_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[_-])(?:header\w*|masthead|banner)(?:$|[_-])", re.I)
OWN_HEADER = re.compile(r"^(?:article|entry|post|story)[_-]+(?:header\w*|banner)$", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fitted by `fit` on the pages table of 2,500 rows, those with even ids: see `features`.
WEIGHTS = (-0.48, 0.76, -6.26, -1.13, 4.26, 2.02, -2.28, -0.21, -2.12)
#: Most that the classifier counts; edges between neighbours two steps apart in the DOM (siblings), and to the last block under one parent;
#: characters for which a block's capacity grows by its own size once more, and how often at most: what is long costs more to get wrong.
SURE, NEXT, SIBLING, LENGTH, LONGEST = 4.0, 1.2, 0.4, 50, 10


class Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, int, int]] = []  # tag, place (see placed), silent depth, box (nearest block element), blocks so far, region
        self.open: dict[str, list[int]] = {}  # places of a tag's open elements in the stack, so that an end tag needs no search
        self.nodes = 0
        self.boxes = {0: (0, 0)}  # parent and depth of each block element
        self.last = 0  # box of the block before
        self.texts: list[str] = []
        self.linked = self.total = 0
        self.out: list[tuple[str, int, float, int, int, int, bool]] = []  # text, place, share of linked characters, parent, steps from the block before, region, heading
        self.has_content = False

    def close_from(self, i: int) -> None:
        while len(self.stack) > i or (self.stack and not self.stack[-1][0]):
            tag = self.stack.pop()[0]
            if tag:
                self.open[tag].pop()

    def flush(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                _, place, _, box, _, region = self.stack[-1] if self.stack else ("", 0, 0, 0, 0, 0)
                heading = any(self.open.get(h) for h in HEADINGS)
                self.out.append((text, place, self.linked / max(1, self.total), self.boxes[box][0], self.steps(self.last, box), region, heading))
                self.last = box
            self.texts, self.linked, self.total = [], 0, 0

    def steps(self, a: int, b: int) -> int:
        """Edges of the DOM between two block elements. Between neighbours in page order each element is passed once up and once down."""
        n = 0
        while a != b:
            if self.boxes[a][1] >= self.boxes[b][1]:
                a = self.boxes[a][0]
            else:
                b = self.boxes[b][0]
            n += 1
        return n

    def placed(self, tag: str, above: int, names: str, role: str) -> int:
        """1 content, 0 neither, -1 boilerplate by tag or role, -2 by name only, 2 an article or main within the latter.

        2 is content if the page has no other: then the name is that of a wrapper ("page sidebar-right"), not of what is in it."""
        tokens = [] if tag in ("html", "body") else [x for x in names.split() if not STATED.search(x)]
        own = [x for x in tokens if OWN_HEADER.match(x)]
        boiler = any(BOILER_NAMES.search(x) for x in tokens if x not in own and not (above > 0 and HEADER_NAMES.search(x)))
        if role in BOILER_ROLES or (tag in BOILER and not (tag == "header" and (above > 0 or own))):
            return -1
        if boiler:
            return -1 if above == -1 else -2
        inside = tag in CONTENT or role in ("main", "article")
        if above == -2 and inside:
            return 2
        return 1 if above == 0 and (inside or any(CONTENT_NAMES.search(x) for x in tokens)) else above

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            while self.stack and self.stack[-1][0] in CLOSED_BY and tag in CLOSED_BY[self.stack[-1][0]]:
                self.close_from(len(self.stack) - 1)
        if tag in VOID:
            return
        at = self.stack[-1] if self.stack else ("", 0, 0, 0, 0, 0)
        given = dict(attrs)
        place = self.placed(tag, at[1], f"{given.get('class') or ''} {given.get('id') or ''}", (given.get("role") or "").lower())
        self.has_content |= place == 1
        self.nodes += 1
        hidden = tag in SILENT or "hidden" in given
        box = at[3]
        if tag in BLOCKS:
            box = self.nodes
            self.boxes[box] = (at[3], self.boxes[at[3]][1] + 1)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, place, at[2] + hidden, box, at[4] + (tag in BLOCKS), at[5] if place == at[1] else self.nodes))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        places = self.open.get(tag)
        if not places:
            return
        i = places[-1]
        if tag not in BLOCKS and self.stack[-1][4] > self.stack[i][4]:  # an inline tag that outlived its block
            places.pop()
            self.stack[i] = ("", *self.stack[i][1:])
        else:
            self.close_from(i)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.texts.append(data)
        n = len(data.strip())
        self.total += n
        self.linked += n * bool(self.open.get("a"))


def features(block: tuple, has_content: bool) -> tuple[float, ...]:
    """One, text's length (logarithm), share of links, sentence end, heading; names for content, for boilerplate, for neither in a page with
    content; links under names for content."""
    text, place, links, heading = block[0], block[1], block[2], block[6]
    return 1.0, math.log(len(text)), links, float(text.endswith((".", "!", "?", "…", "。"))), float(heading), float(place > 0), float(place < 0), float(place == 0 and has_content), links * (place > 0)


def score(block: tuple, has_content: bool) -> float:
    """The classifier's log-odds of content."""
    return max(-SURE, min(SURE, sum(w * x for w, x in zip(WEIGHTS, features(block, has_content)))))


def blurred(blocks: list[tuple], seed: int, taken: float = 0.1, turned: float = 0.1) -> list[tuple]:
    """blocks with the places of some regions taken away (0) or turned round (by region, repeatable)."""
    out = []
    for b in blocks:
        u = crc32(f"{seed}:{b[5]}:{b[1]}".encode()) / 2**32
        out.append((b[0], 0 if u < taken else -b[1] if u < taken + turned else b[1], *b[2:]))
    return out


def fit(pages: list[str], rounds: int = 30) -> tuple[float, ...]:
    """Weights of a logistic regression on the blocks in regions: content against boilerplate, a weak ridge."""
    x, y = [], []
    for seed, page in enumerate(pages):
        blocks, has_content = parsed(page)
        x += [features(seen, has_content) for b, seen in zip(blocks, blurred(blocks, seed)) if b[1]]
        y += [float(b[1] > 0) for b in blocks if b[1]]
    x, y = np.array(x), np.array(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return tuple(w.round(2).tolist())


def fitted(pages: DataFrame, sample: int = 1_250) -> tuple[float, ...]:
    """Weights from a bounded sample, the documented parameter: the first `sample` pages of even id."""
    return fit([r["html"] or "" for r in pages.filter("page_id % 2 = 0").orderBy("page_id").select("html").limit(sample).collect()])


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: a positive score is the cost of cutting it off, a negative one that of keeping it."""
    n = len(scores)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, s in enumerate(scores):
        add(source, i, s, 0.0) if s >= 0 else add(i, sink, -s, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level, queue = [-1] * (n + 2), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, x = [0] * (n + 2), [], source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], source
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                at[x] += 1
                continue
            path.append(e)
            x = to[e]


def parsed(page: str | None) -> tuple[list[tuple], bool]:
    """Blocks in page order (see Blocks.out; place 1 content, -1 boilerplate, 0 neither), and whether any is content."""
    parser = Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    wrapped = -1 if parser.has_content else 1
    place = {-2: -1, -1: -1, 0: 0, 1: 1, 2: wrapped}
    blocks = [(b[0], place[b[1]], *b[2:]) for b in parser.out]
    return blocks, parser.has_content or any(b[1] == 1 for b in blocks)


def labelled(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, content by the classifier alone, content by the cut) of each block."""
    return judged(*parsed(page))


def judged(blocks: list[tuple], has_content: bool) -> list[tuple[str, bool, bool]]:
    alone, edges, last = [score(b, has_content) for b in blocks], [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT / max(1, b[4] - 1)))
        if last.get(b[3], i - 1) != i - 1:
            edges.append((last[b[3]], i, SIBLING))
        last[b[3]] = i
    scores = [s * (1 + min(LONGEST, len(b[0]) / LENGTH)) for s, b in zip(alone, blocks)]
    return [(b[0], s > 0, k) for b, s, k in zip(blocks, alone, min_cut(scores, edges))]


def extract(page: str | None) -> str:
    return " ".join(text for text, _, keep in labelled(page) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
