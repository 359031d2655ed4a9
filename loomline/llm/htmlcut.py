"""Main-text extraction from HTML by minimum-cut labelling of text blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices

# Element names of the HTML standard.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video textarea select datalist".split())
#: What may stand in a head; any other element, or text, ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements whose text is raw up to their end tag.
RAW = frozenset("script style textarea title".split())
#: Cues of page structure: what an element or a word of its class, id or role adds to the cost of
#: what it encloses; positive speaks for content. They label blocks, if weakly, for the classifier.
TAG_COST = {"article": 4.0, "main": 3.0, "nav": -9.0, "header": -6.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "fieldset": -4.0, "address": -2.0}
WORD_COST = {w: -9.0 for w in "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus cookie cookies consent notice gdpr popup modal newsletter subscribe signup login share sharing social related recommended footer header masthead copyright pagination pager widget toolbar skip contentinfo complementary search alert".split()} | {w: 3.0 for w in "article content entry post story main body text".split()}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'){0,400}+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CELLS = frozenset(("li", "tr", "td", "th", "dt", "dd"))
_CLOSERS = _CELLS | frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
#: Capacity of the edge between a block and a container with a cue, and of one without.
CUED, PLAIN = 5.0, 0.5
#: A block's own log-odds lie within this, and an edge between neighbours is at most ADJACENT, so
#: that CUED outweighs a block's text and both its neighbours.
CLIP, ADJACENT = 2.5, 1.0
#: A block of nothing but links that ends no sentence is a menu's, whatever holds it.
MENU = 4.0
#: Blocks that all weak labels weigh together against the prior weights.
TRUST = 200.0


class Block:
    """A text block: its normalised text, share of link text, own element, and container's number."""

    __slots__ = ("text", "links", "tag", "home")

    def __init__(self, text: str, links: float, tag: str, home: int):
        self.text, self.links, self.tag, self.home = text, links, tag, home


def _element_cost(name: str, attributes: str) -> float:
    cost = TAG_COST.get(name, 0.0)
    if "=" in attributes and name not in ("html", "body"):
        words = {w for m in _ATTR.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())}
        costs = [WORD_COST[w] for w in words if w in WORD_COST]
        if costs:
            cost += min(costs) if min(costs) < 0 else max(costs)
    return cost


def _markup(html: str):
    """Pieces of a page in order: `(text, None)` or `(tag match, its end)`. Comments and declarations
    give nothing; a `<` that opens no tag is text. Linear: what is unterminated is looked for once."""
    at, n, text_from = 0, len(html), 0
    last = html.rfind(">")
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:
            break
        c = html[at + 1 : at + 2]
        m = None
        if c.isascii() and c.isalpha() or c == "/":
            m = _TAG.match(html, at) or _LOOSE.match(html, at)
            if not m:
                at += 1
                continue
            end = m.end()
        elif c and c in "!?":
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = n if end < 0 else end + 3
            else:
                end = html.find(">", at) + 1
        else:
            at += 1
            continue
        if at > text_from:
            yield html[text_from:at], None
        at = text_from = end
        if m:
            name = m[2].lower()
            if name in RAW and not m[1] and not m[3].endswith("/"):
                stop = _END[name].search(html, at)
                at = text_from = (html.find(">", stop.end()) + 1 or n) if stop else n
            else:
                yield m, name
    # A comment that is left open, or a tag without an end, takes the rest.
    rest = html[text_from:]
    k = rest.find("<!--")
    if k >= 0:
        rest = rest[:k]
    if rest:
        yield rest, None


def blocks_of(html: str) -> tuple[list[Block], list[float]]:
    """Blocks in page order, and for each container its cue: the summed cost of it and all around it.

    Comments, scripts and other hidden elements give no block; unclosed and misnested tags are tolerated: an end tag
    closes up to its nearest open element, if any; one of an inline element that is not hidden only
    if that is among the last 8. A head ends at the first element or text that cannot stand in it.
    Time is in proportion to the page's length."""
    out: list[Block] = []
    cues = [0.0]
    stack: list[tuple[str, float]] = []  # (name, cost of it and all around it)
    holders: list[tuple[str, int]] = []  # open block elements and their numbers
    open_now: Counter = Counter()
    parts: list[str] = []
    hidden, in_link, linked = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                leaf = bool(holders) and holders[-1][0] in _CLOSERS
                home = (holders[-2][1] if len(holders) > 1 else 0) if leaf and cues[holders[-1][1]] == cues[holders[-2][1] if len(holders) > 1 else 0] else holders[-1][1] if holders else 0
                out.append(Block(text, min(1.0, linked / max(len(raw.strip()), 1)), holders[-1][0] if leaf else "", home))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal hidden
        name, _ = stack.pop()
        hidden -= name in HIDDEN
        open_now[name] -= 1
        if name in BLOCK:
            holders.pop()
        return name

    for piece, name in _markup(html):
        if name is None:
            if stack and stack[-1][0] == "head" and piece.strip():
                pop()
            if not hidden:
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())
            continue
        if piece[1]:  # an end tag
            if name in BLOCK:
                flush()
            elif name == "a":
                in_link = 0
            if open_now[name] > 0 and (name in BLOCK or name in HIDDEN or any(x == name for x, _ in stack[-8:])):
                while pop() != name:
                    pass
            continue
        if name == "head" and any(x != "html" for x, _ in stack[-2:]):
            continue  # misplaced: a head stands in nothing but html
        if stack and (stack[-1][0] == "head" and name not in IN_HEAD or stack[-1][0] == "option" and name in ("option", "optgroup")):
            pop()
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            if name in _CLOSERS or stack and stack[-1][0] == "p":
                closes = ("p",) if name not in _CELLS else (("p", name, "td", "th") if name == "tr" else ("p", "dt", "dd") if name in ("dt", "dd") else ("p", "td", "th") if name in ("td", "th") else ("p", name))
                while stack and (stack[-1][0] in closes or stack[-1][0] not in BLOCK and any(x in closes for x, _ in stack[-4:])):
                    pop()
        if name == "a":
            in_link = 1
        if name not in VOID and not piece[3].endswith("/"):
            cost = _element_cost(name, piece[3])
            if name in ("header", "address") and (open_now["article"] > 0 or open_now["main"] > 0):
                cost += 5.0  # a header within the article holds its title
            cost += stack[-1][1] if stack else 0.0
            stack.append((name, cost))
            open_now[name] += 1
            hidden += name in HIDDEN
            if name in BLOCK:
                holders.append((name, len(cues)))
                cues.append(cost)
    flush()
    return out, cues


# The classifier: log-odds of a block by its own text and element, without its surroundings.

_WORD_BINS = (1, 2, 4, 8, 16, 32)
_TAG_GROUPS = ("plain", "heading", "item", "cell")
#: Prior weights: bias, seven bins of words, four of link share, sentence end, rights line, four groups of elements.
#: Whether plain text stands in a paragraph or a division is left to the cut: pages differ too much in it.
_PRIOR = np.array([-0.9, 0.05, 0.1, 0.2, 0.35, 0.65, 1.2, 2.0, 0.0, 0.0, -2.6, -4.0, 0.5, -4.0, 0.0, 0.9, 0.0, 0.0])
_SHAPE = (len(_WORD_BINS) + 1, 4, 2, 2, len(_TAG_GROUPS))


def cell_of(block: Block) -> int:
    """The cell of a block's features: words, link share, sentence end, rights line, element."""
    words = block.text.count(" ") + 1
    size = sum(words > b for b in _WORD_BINS)
    links = 0 if block.links == 0 else 1 if block.links <= 0.4 else 2 if block.links < 0.9 else 3
    ends = block.text[-1] in ".!?\"'”:;"
    rights = block.text[0] == "©" or "all rights reserved" in block.text[:200].lower() and words < 40
    group = 1 if block.tag[:1] == "h" else 2 if block.tag in ("li", "dt", "dd") else 3 if block.tag in ("td", "th") else 0
    return int(np.ravel_multi_index((size, links, int(ends), int(rights), group), _SHAPE))


def _vectors() -> np.ndarray:
    """The feature vector of every cell."""
    size, links, ends, rights, group = np.unravel_index(np.arange(math.prod(_SHAPE)), _SHAPE)
    hot = lambda x, n: np.eye(n)[x]
    return np.hstack([np.ones((len(size), 1)), hot(size, _SHAPE[0]), hot(links, 4), ends[:, None], rights[:, None], hot(group, _SHAPE[4])])


_RELATIONS = ("same container and element", "same container", "other container")


def weak_labels(blocks: list[Block], cues: list[float]) -> list[int]:
    """1 where the structure around a block says content, -1 where boilerplate, 0 where nothing."""
    return [(cues[b.home] > 0) - (cues[b.home] < 0) for b in blocks]


def relation(a: Block, b: Block) -> int:
    """Which of _RELATIONS two neighbours in page order have."""
    return 2 if a.home != b.home else int(a.tag != b.tag)


class Costs:
    """Log-odds of every cell, and the capacity of every relation of neighbours.

    A logistic regression on weakly labelled blocks, by Newton's method, with the prior weights as
    its mean: `counts` holds boilerplate and content blocks of each cell, `agree` the neighbours of each
    relation whose labels differ and agree. All labels together weigh TRUST blocks, so few or none leave the prior."""

    def __init__(self, counts: np.ndarray | None = None, agree: np.ndarray | None = None):
        x, w = _vectors(), _PRIOR.copy()
        if counts is not None and counts.sum():
            n = counts * (min(TRUST, counts.sum()) / counts.sum())
            for _ in range(20):
                p = 1 / (1 + np.exp(-(x @ w)))
                total = n.sum(1)
                slope = x.T @ (n[:, 1] - total * p) - (w - _PRIOR)
                step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
                w = w + step
                if np.abs(step).max() < 1e-9:
                    break
        self.cells = np.clip(x @ w, -CLIP, CLIP).round(9).tolist()
        half = [0.5 * math.log((same + 4) / (other + 1)) for other, same in (agree if agree is not None else np.zeros((3, 2)))]
        self.edges = [min(ADJACENT, max(0.0, h)) * share for h, share in zip(half, (1.0, 0.8, 0.3))]

    def of(self, block: Block) -> float:
        cell = cell_of(block)
        out = self.cells[cell]
        if block.links >= 0.9 and block.tag[:1] != "h" and block.text[-1] not in ".!?":
            out -= MENU
        return out


def _graph(blocks: list[Block], cues: list[float], costs: Costs) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal costs and smoothness edges. Nodes are the blocks, then the containers that hold one:
    a block is tied to its container (DOM proximity) and to its neighbours in page order (adjacency)."""
    terminal = [costs.of(b) for b in blocks]
    edges = [(i, i + 1, costs.edges[relation(a, b)]) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    nodes: dict[int, int] = {}
    for i, b in enumerate(blocks):
        at = nodes.setdefault(b.home, len(blocks) + len(nodes))
        edges.append((i, at, CUED if cues[b.home] else PLAIN))
    # A cue is taken as given: its capacity is more than all of its container's edges.
    held = Counter(b.home for b in blocks)
    terminal += [math.copysign(CUED * held[home] + 1.0, cues[home]) if cues[home] else 0.0 for home in nodes]
    return terminal, edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least energy: a block with positive cost pays it as boilerplate, one with
    negative cost pays it as content, and each edge pays its weight where labels differ.

    Terminal capacities that exceed all of a node's edges settle it at once, which folds its
    edges into its neighbours' terminals; what is left is cut by max-flow (blocking flows over
    levels). Content is what the source side of the smallest cut keeps; a zero cost is boilerplate."""
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    tied = [sum(m.values()) for m in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(costs[i]) > tied[i] + 1e-9:
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    costs[j] += w if label[i] else -w
                    tied[j] -= w
                    near[j].pop(i)
                    queue.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        kept = _source_side(free, costs, near)
        for i in free:
            label[i] = i in kept
    return [bool(x) for x in label]


def _source_side(free: list[int], costs: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that a maximal flow from source to sink leaves reachable from the source."""
    tiny = 1e-9
    at = {x: k for k, x in enumerate(free)}
    source, sink = len(free), len(free) + 1
    head: list[list[int]] = [[] for _ in range(len(free) + 2)]  # arcs by their tail; an arc's reverse is arc ^ 1
    to: list[int] = []
    room: list[float] = []

    def arc(i: int, j: int, there: float, back: float) -> None:
        head[i].append(len(to))
        head[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((there, back))

    for i in free:
        if costs[i] > 0:
            arc(source, at[i], costs[i], 0.0)
        elif costs[i] < 0:
            arc(at[i], sink, -costs[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                arc(at[i], at[j], w, w)
    while True:
        level = [-1] * len(head)
        level[source] = 0
        todo = deque([source])
        while todo:
            i = todo.popleft()
            for e in head[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return {x for x, k in at.items() if level[k] >= 0}
        turn = [0] * len(head)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[i] < len(head[i]):
                e = head[i][turn[i]]
                if room[e] > tiny and level[to[e]] == level[i] + 1:
                    break
                turn[i] += 1
            if turn[i] < len(head[i]):
                path.append(head[i][turn[i]])
                i = to[path[-1]]
            elif path:
                i = to[path.pop() ^ 1]
                turn[i] += 1
            else:
                break


def labelled(html: str | None, costs: Costs) -> list[tuple[Block, float, bool]]:
    """Every block with its own cost and whether the cut keeps it."""
    blocks, cues = blocks_of(html or "")
    terminal, edges = _graph(blocks, cues, costs)
    return list(zip(blocks, terminal, minimum_cut(terminal, edges)))


def main_text(html: str | None, costs: Costs | None = None) -> str:
    """The article's text: content blocks in page order, joined by one space; empty if none."""
    return " ".join(b.text for b, _, keep in labelled(html, costs or Costs()) if keep)


def fit(pages: DataFrame, html_col: str = "html") -> Costs:
    """Fit block costs and edge capacities to all pages, whose structure labels many blocks weakly.

    One narrow pass counts labelled blocks by cell and neighbours by relation; at most two numbers
    for each cell and relation reach the driver. Null and empty pages and pages without a cue teach nothing."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for small in slices([batch]):
                for html in small.column(0).to_pylist():
                    blocks, cues = blocks_of(html or "")
                    label = weak_labels(blocks, cues)
                    seen.update((cell_of(b), y) for b, y in zip(blocks, label) if y)
                    seen.update((-1 - relation(a, b), 1 if p == q else -1) for a, b, p, q in zip(blocks, blocks[1:], label, label[1:]) if p and q)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["cell", "y", "n"])

    counts, agree = np.zeros((math.prod(_SHAPE), 2)), np.zeros((len(_RELATIONS), 2))
    for r in pages.select(F.col(html_col)).mapInArrow(lean(run), "cell int, y int, n long").groupBy("cell", "y").agg(F.sum("n").alias("n")).collect():
        (counts[r["cell"]] if r["cell"] >= 0 else agree[-1 - r["cell"]])[int(r["y"] > 0)] = r["n"]
    return Costs(counts, agree)


def extract(pages: DataFrame, costs: Costs | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col, url_col, text, n_chars` for every whole page, with fitted `costs` or the prior ones.

    Null and empty pages give the empty text; repeated rows are extracted each; null ids and urls
    are kept; an empty table gives an empty result; other columns are ignored. Narrow: no
    shuffle, one record batch and one page's blocks in memory."""
    costs = costs or Costs()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h, costs) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(lean(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
