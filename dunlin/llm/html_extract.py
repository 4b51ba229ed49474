"""Main text of web pages by minimum-cut labelling of text blocks.

A page is read into blocks with their container paths.  A classifier's log odds
(content against boilerplate) become terminal capacities.  Adjacent blocks are tied
by smoothness edges, stronger the more containers they share, and blocks of one container
by edges to a node of that container (DOM proximity).  The minimum cut, found by maximum flow,
separates content from boilerplate.

The classifier adds a fixed weight for what a container's tag or class says to log odds of
text statistics, which are learned from all pages: blocks whose containers leave no doubt are
the examples.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import column

# a quote opens an attribute's value behind "=" only; elsewhere, as in data-x=don't, it is part of it
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|noscript|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<![^>]*>|<\?[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|[^<]+|<", re.S | re.I)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("button canvas object select svg template".split())  # their text goes
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
NO_P = BLOCK_TAGS - {"p", "li", "td", "th", "tr", "dt", "dd", "html", "body", "head"}  # a tag that ends an open paragraph
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# log odds that a container lends to what it holds
TAG_WEIGHT = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "header": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "fieldset": -6.0,
              "article": 5.0, "main": 3.0}
BAD_PART = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|newsletter|"
    r"subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|reply|disqus|respond|discussion|widget|toolbar|pagination|pager|"
    r"search|tags|legal|copyright|complementary|contentinfo|navigation|dialog)", re.I)
# what may stand beside such a word in one class: category-legal, social-history or has-sidebar say something else
PLAIN_PART = re.compile(
    r"(?:\d+|box|bar|block|body|bottom|buttons?|col|column|container|content|count|fixed|form|group|head|heading|holder|icons?|inner|inline|item|items|js|label|"
    r"left|right|top|main|site|page|links?|list|message|meta|mobile|module|outer|overlay|panel|policy|posts?|primary|secondary|row|section|area|small|sticky|text|thread|title|"
    r"unit|widgets?|wrap|wrapper|zone|global|local|user|reader|slot|gdpr|strip|center|centre|desktop|sub|e)", re.I)
BAD_CLASS, HIDDEN = -9.0, -9.0
BAD_OUTSIDE = -3.0  # what class words of the containers around an article or main lend to what is in it, at worst
# learned: words in a block, share of them inside links, sentence ends
BUCKETS = ("w0", "w1", "w2", "w3", "l0", "l1", "l2", "s0", "s1")
NEAR, SAME, CONTAINER = 0.3, 0.9, 0.6  # smoothness capacities: any neighbours, same container, container node
RUN = 2.0  # learned log odds stay within this
# log odds where no page has examples of both kinds
PRIOR = {"w0": -1.5, "w1": -0.5, "w2": 1.0, "w3": 2.0, "l0": 0.5, "l1": -1.0, "l2": -2.0, "s0": -0.7, "s1": 1.0}


class Block:
    __slots__ = ("parts", "linked", "path", "weight", "held")

    def __init__(self, path: tuple, weight: float):
        self.parts, self.linked, self.path, self.weight = [], 0, path, weight
        self.held: list[tuple[int, bool, tuple]] = []  # parts that go if a DROPPED element around them has its end tag


def says_boilerplate(value: str) -> bool:
    """Whether one of the names in a class, id or role is made of words for boilerplate, at least one, and words for any container."""
    for name in value.split():
        parts = [p for p in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if p]
        bad = [bool(BAD_PART.fullmatch(p)) for p in parts]
        if any(bad) and all(b or PLAIN_PART.fullmatch(p) for b, p in zip(bad, parts)):
            return True
    return False


def _weight(tag: str, attrs: str) -> tuple[float, float]:
    """Weight of a container, and the part of it that comes from class words."""
    w, words = TAG_WEIGHT.get(tag, 0.0), 0.0
    if attrs and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role") and says_boilerplate(value):
                w, words = min(w, 0.0) + BAD_CLASS, words + BAD_CLASS
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                w = min(w, 0.0) + HIDDEN
    return w, words


def _held_weight(stack: list[tuple[str, int, float, float]]) -> float:
    """Weight of all open containers; class words outside an article or main count BAD_OUTSIDE at worst."""
    inside = next((k for k, x in enumerate(stack) if x[0] in ("article", "main")), 0)
    outside = sum(x[3] for x in stack[:inside])
    return sum(x[2] for x in stack) - outside + max(outside, BAD_OUTSIDE)


def blocks(page: str) -> list[tuple[str, float, tuple, float]]:
    """(text, share of it in links, container path, container weight) of every block with text, in page order.

    Text of DROPPED elements goes.  One without its end tag takes what comes before the next block tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, float, float]] = []  # open elements: tag, number, weight, part of it from class words
    dropping: dict[int, bool] = {}  # open DROPPED elements: whether no block tag has come since
    ended: set[int] = set()  # DROPPED elements that had their end tag
    links, number, now = 0, 0, None

    def close(k: int):
        nonlocal links
        for tag, n, *_ in stack[k:]:
            links -= tag == "a"
            dropping.pop(n, None)
        del stack[k:]

    for m in TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            if m["raw"] is not None or m[0][:2] in ("<!", "<?"):
                continue
            if dropping and any(dropping.values()):
                continue
            if now is None:
                now = Block(tuple(n for t, n, *_ in stack if t in BLOCK_TAGS), _held_weight(stack))
                out.append(now)
            if dropping:
                now.held.append((len(now.parts), links > 0, tuple(dropping)))
            now.parts.append(m[0])
            if links:
                now.linked += len(m[0])
            continue
        tag = tag.lower()
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            now = None
            if dropping:
                dropping = dict.fromkeys(dropping, False)
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            # inline ends do not close blocks around them
            if k is not None and (tag in BLOCK_TAGS or tag in DROPPED or not any(x[0] in BLOCK_TAGS for x in stack[k:])):
                if tag in DROPPED:
                    ended.add(stack[k][1])
                close(k)
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in NO_P else ())
        while shut and (k := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK_TAGS or stack[k][0] in DROPPED), None)) is not None and stack[k][0] in shut:
            close(k)
        if tag not in VOID_TAGS and not m["attrs"].endswith("/"):
            number += 1
            stack.append((tag, number, *_weight(tag, m["attrs"])))
            links += tag == "a"
            if tag in DROPPED:
                dropping[number] = True
    done = []
    for b in out:
        for k, linked, around in b.held:
            if not ended.isdisjoint(around):
                b.linked -= len(b.parts[k]) * linked
                b.parts[k] = ""
        raw = "".join(b.parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            done.append((text, min(1.0, b.linked / max(1, len(raw))), b.path, b.weight))
    return done


def statistics(text: str, linked: float) -> tuple[str, str, str]:
    n = text.count(" ") + 1
    return ("w0" if n < 3 else "w1" if n < 8 else "w2" if n < 25 else "w3", "l0" if linked < 0.2 else "l1" if linked < 0.7 else "l2",
            "s1" if re.search(r"[.!?…。]", text) else "s0")


def _max_flow(n: int, edges: list[tuple[int, int, float, float]], s: int, t: int) -> list[bool]:
    """Nodes on the source's side of a minimum cut (Dinic). edges: (u, v, capacity, capacity back)."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for u, v, c, back in edges:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        nxt = [0] * n
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def label(found: list[tuple[str, float, tuple, float]], learned: dict[str, float]) -> list[bool]:
    """Content flags of a page's blocks.  Neighbours alike in container, weight and statistics are one node."""
    nodes: list[list] = []  # [path, odds, blocks]
    keys = []
    for text, linked, path, weight in found:
        stats = statistics(text, linked)
        odds = weight + sum(learned.get(k, 0.0) for k in stats)
        if weight == 0:
            odds -= 0.5  # nothing around it says content
        key = (path[:-1], weight, stats)
        if nodes and keys[-1] == key:
            nodes[-1][1] += odds
            nodes[-1][2] += 1
        else:
            nodes.append([path[:-1], odds, 1])
            keys.append(key)
    s, t = len(nodes), len(nodes) + 1
    holders = {p: t + 1 + k for k, p in enumerate(dict.fromkeys(x[0] for x in nodes))}
    edges = []
    for k, (path, odds, _) in enumerate(nodes):
        edges.append((s, k, odds, 0.0) if odds > 0 else (k, t, -odds, 0.0))
        edges.append((k, holders[path], CONTAINER, CONTAINER))
        if k:
            tie = SAME if nodes[k - 1][0] == path else NEAR
            edges.append((k - 1, k, tie, tie))
    side = _max_flow(t + 1 + len(holders), edges, s, t)
    return [side[k] for k, x in enumerate(nodes) for _ in range(x[2])]


def learn(pages: DataFrame) -> dict[str, float]:
    """Log odds of each text statistic, from all blocks whose containers leave no doubt."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for page in column(batch, "html").to_pylist():
                for text, linked, _, weight in blocks(page or ""):
                    if abs(weight) >= 3:
                        for k in statistics(text, linked):
                            seen[k, int(weight > 0)] += 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
                                         ["k", "y", "n"])

    rows = pages.select("html").mapInArrow(run, "k string, y int, n long").groupBy("k", "y").agg(F.sum("n").alias("n")).collect()  # at most 18 rows
    n = {(r.k, r.y): r.n for r in rows}
    total = [sum(v for (k, y), v in n.items() if y == c and k[0] == "w") for c in (0, 1)]
    if not min(total):
        return PRIOR
    import math
    odds = {k: math.log((n.get((k, 1), 0) + 1) / (total[1] + 3)) - math.log((n.get((k, 0), 0) + 1) / (total[0] + 3)) for k in BUCKETS}
    return {k: max(-RUN, min(RUN, v)) for k, v in odds.items()}


def text_of(page: str, learned: dict[str, float]) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, label(found, learned)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty page, or one without content, has an empty text.  Blocks are joined by one
    line end; nothing else is dropped or cut.  Repeated rows come out as often as they came in.
    """
    learned = learn(pages)

    def run(batches):
        for batch in batches:
            texts = [text_of(page or "", learned) for page in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
