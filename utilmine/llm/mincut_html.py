"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a list of text blocks in page order (a block is the text between two block-level
tag borders). A small classifier gives each block a cost for the label *content* and one for
*boilerplate*; these are the capacities of its edges to the two terminals. Blocks that are neighbours
on the page, and consecutive blocks below the same parent, are joined by smoothness edges whose capacity
grows with how close the blocks are in the DOM. The minimum cut is the cheapest labelling; max-flow finds it.

Before the flow runs, blocks whose terminal capacity exceeds all their smoothness edges are settled
exactly (no cut can gain by flipping them) and their edges turn into terminal capacity of their
neighbours; only what is left goes through augmenting paths.

Edge cases: null or empty html, and pages without text, give an empty text; unclosed and stray tags and
truncated pages are read as far as they go; a tag with an unclosed quote ends at its first ">"; a head left open ends where the body's elements begin;
character references are decoded once; scripts, styles, templates and comments are never text. Whole pages are read, whatever their length.
Repeated rows and ids are read row by row; a null id stays null; columns other than the three named ones are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import spread

# HTML element names by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript iframe textarea noframes xmp title".split())
HIDDEN_TAGS = frozenset("head template svg object canvas video audio datalist".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
P_CLOSERS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu select button dialog fieldset option search label".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|sidebar\w*|side|rail|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|breadcrumbs?|cookies?|consent|gdpr|notices?|notification\w*|alert|popup|pop|modal|overlay|comments?|commentlist|reply|replies|respond|disqus|discussion|related|recommend\w*|more|share\w*|sharing|social|follow|subscribe|newsletter|signup|login|search|pagination|pager|copyright|legal|disclaimer|tags|meta|skip|form)(?=$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|prose|page)(?=$|[\s_-])", re.I)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

# an attribute's value in quotes goes on to the closing quote; without one, a tag ends at its first ">" rather than with the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>)|[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW_END: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in RAW_TAGS}
_ENDS = (".", "!", "?", "…", "”", '"', "»", "。", ":")


class Block:
    __slots__ = ("text", "path", "bad", "good", "linked", "head")

    def __init__(self, text, path, bad, good, linked, head):
        self.text, self.path, self.bad, self.good, self.linked, self.head = text, path, bad, good, linked, head


class _Element:
    __slots__ = ("tag", "number", "bad", "good", "hidden")

    def __init__(self, tag, number, bad, good, hidden):
        self.tag, self.number, self.bad, self.good, self.hidden = tag, number, bad, good, hidden


def _marks(tag: str, attributes: str, above: _Element) -> tuple[int, int, bool]:
    """Depth counts of boilerplate and content marks on the way down, and whether text below is hidden."""
    bad, good, hidden = above.bad, above.good, above.hidden or tag in HIDDEN_TAGS
    if tag in BOILERPLATE_TAGS or (tag == "header" and not good):
        bad += 1
    elif tag in CONTENT_TAGS:
        good += 1
    if attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag not in ("body", "html", "article", "main") and BOILERPLATE_NAMES.search(value):
                    bad += 1
                elif CONTENT_NAMES.search(value):
                    good += 1
            elif name == "role":
                bad += value.lower() in BOILERPLATE_ROLES
                good += value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    return bad, good, hidden


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in page order."""
    root = _Element("", 0, 0, 0, False)
    stack, out, parts = [root], [], []
    state = {"link": 0, "linked": 0, "number": 0}

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            top = stack[-1]
            if text and not top.hidden:
                blocky = [e for e in stack if e.tag in BLOCK_TAGS]
                tag = blocky[-1].tag if blocky else ""
                out.append(Block(text, tuple(e.number for e in blocky), top.bad, top.good, min(1.0, state["linked"] / len(text)), len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()))
        state["linked"] = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                parts.append(token)
                if state["link"]:
                    state["linked"] += len(token)
            continue
        tag = tag.lower()
        if tag not in HEAD_TAGS and tag not in ("html", "head") and not m.group(1) and len(stack) > 1:
            # a head may be left open: whatever cannot stand in it closes it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK_TAGS or stack[i].tag in HIDDEN_TAGS:
                    break
        if m.group(1):
            if tag == "a":
                state["link"] = 0
            if tag == "br":
                parts.append(" ")
            if tag in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK_TAGS and stack[i].tag in BLOCK_TAGS:
                    break
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in P_CLOSERS or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                closes = ("p",) if tag in P_CLOSERS else ("dt", "dd", "p") if tag in ("dt", "dd") else ("td", "th", "p") if tag in ("td", "th") else (tag, "p", "td", "th") if tag == "tr" else (tag, "p")
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK_TAGS:
                        break
        if tag in RAW_TAGS:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID_TAGS or tag in ("svg", "math") and m.group(3).rstrip().endswith("/"):
            if tag in ("br", "hr", "img", "input"):
                parts.append(" ")
            continue
        if tag == "a":
            state["link"] = 1
        state["number"] += 1
        stack.append(_Element(tag, state["number"], *_marks(tag, m.group(3), stack[-1])))
    flush()
    return out


def costs(block: Block) -> tuple[float, float]:
    """(cost of the label content, cost of the label boilerplate): negative log-odds style, from structure and text.

    The weights are parameters of a logistic model. Marks of boilerplate decide by themselves; where there are no marks, a block's text is weak
    evidence (a short sentence may be a paragraph or an advert), so that what stands around it decides by the cut.
    """
    words = block.text.count(" ") + 1
    z = -0.6 + min(words, 40) / 12.0 - 4.0 * block.linked
    z += 0.3 if block.text.endswith(_ENDS) else -0.15
    z += 3.5 * min(block.good, 2) - 9.0 * min(block.bad, 2)
    if block.head:
        z += 1.0
    if "©" in block.text or "all rights reserved" in block.text.lower():
        z -= 3.0
    z = max(-20.0, min(20.0, z))
    # log(1 + e^-z) and log(1 + e^z)
    return (_softplus(-z), _softplus(z))


def _softplus(x: float) -> float:
    from math import log1p

    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def edges_of(blocks: list[Block], smooth: float = 3.0) -> list[tuple[int, int, float]]:
    """Smoothness edges: page neighbours, the weaker the more steps apart they are in the DOM, and consecutive blocks with the same parent."""
    out = []
    last: dict[tuple, int] = {}
    for i, b in enumerate(blocks):
        parent = b.path[:-1]
        if i:
            a = blocks[i - 1]
            shared = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                shared += 1
            far = len(a.path) + len(b.path) - 2 * shared
            out.append((i - 1, i, smooth * 2.0 ** (-1 if far <= 2 else 1 - min(far, 60))))
        j = last.get(parent)
        if j is not None and j < i - 1:
            out.append((j, i, smooth / 2))
        last[parent] = i
    return out


def min_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut (the smallest such side)."""
    n = len(to_source)
    gain = [s - t for s, t in zip(to_source, to_sink)]
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    weight = [0.0] * n
    for k, (a, b, w) in enumerate(edges):
        around[a].append((b, k)), around[b].append((a, k))
        weight[a] += w
        weight[b] += w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(gain[i]) > weight[i] + 1e-12:
            side[i] = gain[i] > 0
            for j, k in around[i]:
                if side[j] is None:
                    w = edges[k][2]
                    gain[j] += w if side[i] else -w
                    weight[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, s in zip(rest, _flow(rest, gain, [(a, b, w) for a, b, w in edges if side[a] is None and side[b] is None])):
            side[i] = s
    return side


def _flow(nodes: list[int], gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm on what is undecided; residual reachability from the source gives the cut."""
    at = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a, b, forth, back):
        head[a].append(len(to)), to.append(b), cap.append(forth)
        head[b].append(len(to)), to.append(a), cap.append(back)

    for v in nodes:
        if gain[v] > 0:
            add(s, at[v], gain[v], 0.0)
        elif gain[v] < 0:
            add(at[v], t, -gain[v], 0.0)
    for a, b, w in edges:
        add(at[a], at[b], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, v = [], s
                continue
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if cap[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(head[v]):
                path.append(head[v][turn[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                turn[v] += 1
            else:
                break


def extract_text(html: str | None, smooth: float = 3.0) -> str:
    """The main text of a page: content blocks in page order, one per line."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    both = [costs(b) for b in blocks]
    # on the source side a block is content: cutting its source edge costs what the label boilerplate costs
    kept = min_cut([boiler for _, boiler in both], [content for content, _ in both], edges_of(blocks, smooth))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smooth: float = 3.0) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(h.as_py(), smooth) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return spread(chosen).mapInArrow(run, "page_id long, url string, text string, n_chars long")
