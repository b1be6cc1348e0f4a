"""HTML extraction by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags). A fixed linear classifier gives each block the
logarithm of its odds of being content: from its words, links, punctuation and tag, and from graded evidence of the
containers around it (names and tags of different reliability add up; no class name decides alone). The two
costs are the capacities of the block's edges to the terminals, so short blocks are left uncertain.
Blocks next to each other in page order and blocks that follow each other under the same parent are joined
by smoothness edges whose capacity falls with the distance of their places in the document tree. Maximum
flow then separates content from boilerplate at the least total cost: uncertain blocks take the side
of the blocks around them.

A block whose terminal capacity is at least the sum of its smoothness edges keeps its terminal's
label in some minimum cut, so such blocks are labelled first and their edges folded into their
neighbours' terminals; the flow runs over what is left.

Scripts, styles, templates, comments of the markup, hidden elements and form controls are never text; where such an
element is not closed, it ends at the next block-level tag (a script or style at the page's end). Character
references are decoded; white space inside a block becomes one space, ends are trimmed, blocks
are joined by one space in page order.

Defined results: a null or empty page, or one without content, gives an empty text; repeated rows
each give a row; a null page_id or url stays null; an empty table gives no rows; other columns
are not read; a very long page is read whole.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"""<!--(?:.*?(?:-->|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is no text of the page; the first ones hold anything up to their own closing tag.
RAW_TAGS = frozenset("script style".split())
SKIPPED_TAGS = RAW_TAGS | frozenset("noscript template textarea title iframe noembed noframes xmp svg select button option optgroup canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEXT_BLOCK = re.compile(r"</?(?:" + "|".join(sorted(BLOCK_TAGS)) + r")(?=[\s/>])", re.I)
#: Evidence of containers, in units of cost, by tag, role, and parts of class and id names.
TAG_EVIDENCE = {"nav": -4.0, "aside": -4.0, "footer": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0, "fieldset": -4.0, "search": -4.0, "article": 1.0, "main": 1.0}
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
SURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead sidebar comment comments commentlist disqus respond replies cookie cookies consent gdpr popup modal newsletter subscribe subscription login signup pagination".split())
VAGUE_NAMES = frozenset("banner foot header topbar side aside widget related recommended recommendations discussion reply notice notices notification alert overlay search form share sharing social pager copyright legal disclaimer toolbar skip".split())
CONTENT_NAMES = frozenset("article articlebody content main post entry story body text prose page".split())
SURE, VAGUE, ROLE, NAMED_CONTENT = -4.5, -2.5, -4.0, 0.75
LEAST_EVIDENCE, MOST_EVIDENCE = -7.0, 1.75
BOILER_TEXT = re.compile(r"\b(?:cookies?|all rights reserved|subscribe|sign (?:up|in)|log ?in|privacy policy|terms of (?:use|service)|advertisement|sponsored|newsletter)\b|©", re.I)

#: Classifier weights, in units of cost.
BIAS, PER_WORD, MOST_WORDS, PUNCTUATION, PARAGRAPH, HEADING, LINKS, PHRASE = -2.0, 0.1, 3.5, 0.75, 0.5, 2.2, 4.0, 2.0
#: Smoothness between neighbours in page order and between followers under one parent, before their distance divides it.
NEXT, SIBLING = 1.5, 5.0


class Block:
    __slots__ = ("text", "link", "path", "evidence", "tag")

    def __init__(self, text: str, link: int, path: tuple[int, ...], evidence: float, tag: str):
        self.text, self.link, self.path, self.evidence, self.tag = text, link, path, evidence, tag


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Lower-case parts of class and id, role, and whether the element is hidden."""
    parts: set[str] = set()
    role, hidden = "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for word in re.split(r"[^A-Za-z0-9]+", value):
                parts.add(word.lower())
                parts.update(p.lower() for p in NAME_PART.findall(word))
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return parts, role, hidden


def container_evidence(before: float, tag: str, parts: set[str], role: str) -> float:
    """What the containers down to this one say: boilerplate inside content ends what spoke for content, content inside boilerplate speaks half as loud."""
    own = TAG_EVIDENCE.get(tag, 0.0)
    if tag == "header" and before <= 0:  # a page's header; an article's own holds its title
        own = TAG_EVIDENCE["nav"]
    if role in BOILER_ROLES:
        own += ROLE
    elif role in ("main", "article"):
        own += TAG_EVIDENCE["main"]
    good = bool(parts & CONTENT_NAMES)
    if tag not in ("html", "body"):
        if parts & SURE_NAMES:
            own += VAGUE if good else SURE
        elif parts & VAGUE_NAMES:
            own += 0.0 if good else VAGUE
        elif good:
            own += NAMED_CONTENT
    total = min(before, 0.0) + own if own < 0 else before + own if before >= 0 else before + own / 2
    return max(LEAST_EVIDENCE, min(MOST_EVIDENCE, total))


def read_blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order, with the evidence of their containers."""
    out: list[Block] = []
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]  # tag, number, evidence, hidden
    pieces: list[str] = []
    never_closed: set[str] = set()
    number = link = links_open = at = 0
    n = len(page)

    def flush() -> None:
        nonlocal link
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text and not stack[-1][3]:
            out.append(Block(text, min(link, len(text)), tuple(s[1] for s in stack), stack[-1][2], stack[-1][0]))
        pieces.clear()
        link = 0

    def say(raw: str) -> None:
        nonlocal link
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links_open:
                link += len(text)

    def past(tag: str) -> int:
        """Where the text of an element that is to be skipped ends."""
        if tag not in never_closed:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                return end.end()
            never_closed.add(tag)
        if tag in RAW_TAGS:
            return n
        end = NEXT_BLOCK.search(page, at)
        return end.start() if end else n

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links_open = max(0, links_open - 1)
            elif tag in BLOCK_TAGS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in SKIPPED_TAGS:
            if not rest.endswith("/"):
                at = past(tag)
                if tag in ("button", "select", "textarea"):
                    flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            links_open = 1  # links do not nest
            continue
        if tag not in BLOCK_TAGS:
            if rest and ("hidden" in rest.lower() or "none" in rest.lower()) and tag not in VOID_TAGS and _names(rest)[2]:
                at = past(tag)
            continue
        flush()
        links_open = 0 if tag in ("article", "section", "main", "nav", "footer", "aside", "div") and links_open else links_open
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dd", "dt", "td", "th", "tr"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag, (tag,))
            while len(stack) > 1 and stack[-1][0] in same:
                stack.pop()
        if tag in VOID_TAGS:
            continue
        parts, role, hides = _names(rest) if rest.strip(" /") else (set(), "", False)
        number += 1
        stack.append((tag, number, container_evidence(stack[-1][2], tag, parts, role), stack[-1][3] or hides))
    flush()
    return out


def leaning(b: Block) -> float:
    """How much cheaper the block is as content than as boilerplate: the logarithm of its odds."""
    words = b.text.count(" ") + 1
    s = BIAS + min(MOST_WORDS, PER_WORD * words) - LINKS * b.link / len(b.text) - PHRASE * bool(words < 40 and BOILER_TEXT.search(b.text))
    if b.tag in ("h1", "h2", "h3"):
        s += HEADING
    else:
        s += (PUNCTUATION if b.text[-1] in ".!?…:;,\"”»" else -PUNCTUATION / 2) + PARAGRAPH * (b.tag in ("p", "blockquote", "pre"))
    return s + b.evidence


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and between followers under the same parent; capacity falls with their distance in the tree."""
    edges = []
    last: dict[int, int] = {}
    for j, b in enumerate(blocks):
        parent = b.path[-2] if len(b.path) > 1 else 0
        pairs = {j - 1: NEXT} if j else {}
        if parent in last:
            pairs[last[parent]] = pairs.get(last[parent], 0.0) + SIBLING
        for i, w in pairs.items():
            a = blocks[i].path
            common = next((k for k, (x, y) in enumerate(zip(a, b.path)) if x != y), min(len(a), len(b.path)))
            edges.append((i, j, w / (1 + (len(a) + len(b.path) - 2 * common) ** 2 / 2)))
        last[parent] = j
    return edges


def min_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side, content) of a minimum cut where node i has terminal capacity |lean[i]| and edges run both ways."""
    n = len(lean)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    lean = list(lean)
    todo = deque(range(n))
    while todo:  # nodes that their terminal outweighs all neighbours
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) >= sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, w in near[i].items():
                lean[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        source, sink = len(left), len(left) + 1
        cap: list[dict[int, float]] = [{} for _ in range(len(left) + 2)]
        for i in left:
            k = place[i]
            for j, w in near[i].items():
                cap[k][place[j]] = w
            a, b = (source, k) if lean[i] > 0 else (k, sink)
            cap[a][b] = cap[a].get(b, 0.0) + abs(lean[i])
            cap[b].setdefault(a, 0.0)
        reached = max_flow(cap, source, sink)
        for i in left:
            label[i] = place[i] in reached
    return [bool(x) for x in label]


def max_flow(cap: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Push the maximum flow through residual capacities ``cap`` (changed in place) by blocking flows; the nodes then reachable from the source."""
    least = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > least and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        ways = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                keep = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= least)
                for x in path[keep + 1 :]:
                    ways[x] = iter(list(cap[x]))
                path = path[: keep + 1]
                continue
            for v in ways[u]:
                if cap[u][v] > least and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1


def labels(blocks: list[Block]) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    return min_cut([leaning(b) for b in blocks], smoothness(blocks))


def main_text(page: str) -> str:
    blocks = read_blocks(page)
    return " ".join(b.text for b, k in zip(blocks, labels(blocks)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
