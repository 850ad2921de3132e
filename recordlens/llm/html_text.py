"""Main text of HTML pages by minimum-cut labelling (operator 6).

A page becomes a row of text blocks with their place in the DOM. A linear classifier gives each block
the cost of calling it content and of calling it boilerplate; these are the capacities of its edges to
the two terminals. Neighbouring blocks, and blocks of one parent, are joined by smoothness edges that
grow with their DOM proximity: they halve with each step of the way between them, and are weak across the
border of an element that is marked as boilerplate. A minimum cut (maximum flow) parts content from
boilerplate: a short line among paragraphs stays with them, one among menu lines goes with those.

Null html is empty. A page without content has the text ''. Unclosed and truncated markup ends where
its parent ends. Repeated rows are extracted alike. Extra columns are ignored. An empty table gives an empty result. A very long page is worked
on whole by one task, in time that grows with its blocks; its elements may be nested as deeply as they are.
"""

import math
import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements whose content is no page text, and elements that end a block of text.
RAW = "script|style|textarea|title|noscript|iframe|template|svg|math|xmp|noembed|noframes|object|canvas|audio|video"
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

# Fixed values of the classifier: log-odds for content.
BASE, PER_LOG_CHAR, LINKED, HEADING, PARAGRAPH = -2.2, 0.55, -4.0, 0.8, 0.8
INSIDE = {"article": 4.0, "main": 2.5, "nav": -7.0, "aside": -7.0, "footer": -7.0, "form": -5.0, "button": -7.0, "select": -7.0, "option": -7.0, "dialog": -6.0, "menu": -6.0, "head": -9.0, "label": -4.0, "fieldset": -4.0}
HEADER = -5.0
GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article|content|entry|post|main|story|body|text|prose)(?:$|[-_\s])", re.I)
BAD_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|sidebar|side|menu\w*|nav\w*|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommend\w*|widget\w*|login|signup|search|copyright|legal|disclaimer|skip|hidden)(?:$|[-_\s])",
    re.I,
)
GOOD, BAD = 1.5, -7.0
ROLES = {"navigation": -7.0, "banner": -5.0, "contentinfo": -7.0, "complementary": -7.0, "search": -6.0, "alert": -6.0, "dialog": -6.0, "alertdialog": -6.0, "menu": -6.0, "menubar": -6.0, "form": -5.0, "main": 2.5, "article": 4.0}
SMOOTH_NEXT, SMOOTH_SIBLING = 3.0, 1.5
#: An element whose own odds are at most this is marked as boilerplate; an edge across its border keeps this share.
MARKED, ACROSS = -4.0, 0.05

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class _Element:
    __slots__ = ("name", "odds", "parent", "depth", "inside_article", "number", "marked")

    def __init__(self, name: str, odds: float, parent: "_Element | None", inside_article: bool, number: int):
        self.name, self.odds, self.parent, self.inside_article, self.number = name, odds, parent, inside_article, number
        self.depth = parent.depth + 1 if parent else 0
        self.marked = parent is not None and odds - parent.odds <= MARKED


def _odds(name: str, attrs: str, inside_article: bool) -> float:
    """Log-odds that an element adds to all blocks in it."""
    out = INSIDE.get(name, HEADER if name == "header" and not inside_article else 0.0)
    if not attrs or name in ("html", "body"):
        return out
    names = []
    for key, *value in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(value)
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            out += ROLES.get(value.lower(), 0.0)
    label = " ".join(names)
    if label:
        out += BAD if BAD_NAME.search(label) and name not in ("article", "main") else GOOD if GOOD_NAME.search(label) else 0.0
    return out - 9.0 if _HIDDEN.search(attrs) else out


def blocks(html: str) -> list[tuple[str, float, _Element, int]]:
    """(text, log-odds for content, element, linked characters) of each block in page order."""
    root = _Element("", 0.0, None, False, 0)
    at, stack, number = root, [root], 0
    out: list[tuple[str, float, _Element, int]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                n = len(text)
                odds = BASE + PER_LOG_CHAR * math.log(1 + n) + LINKED * min(1.0, linked / n)
                odds += HEADING if re.fullmatch("h[1-6]", at.name) else PARAGRAPH if at.name in ("p", "blockquote", "pre") else 0.0
                out.append((text, odds + max(-12.0, min(6.0, at.odds)), at, min(linked, n)))
        linked = 0

    def leave(count: int) -> None:
        nonlocal at
        del stack[len(stack) - count :]
        at = stack[-1]

    last = 0
    for m in _TOKEN.finditer(html):
        if m.start() > last:
            parts.append(html[last : m.start()])
            if in_link:
                linked += m.start() - last
        last = m.end()
        name = m["tag"]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        elif name in ("br", "td", "th", "img", "wbr"):
            parts.append(" ")
        if name not in BLOCK and name not in ("button", "label"):
            continue
        close_block()
        if m["end"]:
            for k, e in enumerate(reversed(stack[1:]), 1):
                if e.name == name:
                    leave(k)
                    in_link = False
                    break
            continue
        if name in VOID:
            continue
        if at.name == "p" and name in BLOCK:
            leave(1)
        if name in CLOSES:
            for k, e in enumerate(reversed(stack[1:]), 1):
                if e.name in CLOSES[name]:
                    leave(k)
                    break
                if e.name in ("ul", "ol", "dl", "table", "select", "menu", "dir"):
                    break
        number += 1
        odds = _odds(name, m["attrs"] or "", at.inside_article)
        at = _Element(name, at.odds + odds, at, at.inside_article or name in ("article", "main"), number)
        stack.append(at)
    tail = html[last:]
    if tail:
        parts.append(tail)
    close_block()
    return out


def _proximity(a: _Element, b: _Element) -> float:
    """1 for blocks of one parent, half for each further step of the way between them, less across a marked border."""
    steps, out = 0, 1.0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        out *= ACROSS if a.marked else 1.0
        a, steps = a.parent, steps + 1
    return out * 0.5 ** max(0, steps - 2)


def label(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: content (True) costs softplus(-odds), boilerplate softplus(odds), a parted edge its weight."""
    around: list[dict[int, float]] = [{} for _ in odds]
    for i, j, w in edges:
        if i != j and w > 0:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    pull = list(odds)  # boilerplate's cost minus content's: softplus(x) - softplus(-x) = x
    fixed: list[bool | None] = [None] * len(odds)
    # Blocks whose own pull outweighs all their edges keep their side in every minimum cut.
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if fixed[i] is None and abs(pull[i]) >= sum(around[i].values()):
            fixed[i] = pull[i] > 0
            for j, w in around[i].items():
                pull[j] += w if fixed[i] else -w
                del around[j][i]
                queue.append(j)
            around[i] = {}
    rest = [i for i, f in enumerate(fixed) if f is None]
    if rest:
        content = _min_cut(rest, pull, around)
        for i in rest:
            fixed[i] = i in content
    return [bool(f) for f in fixed]


def _min_cut(nodes: list[int], pull: list[float], around: list[dict[int, float]]) -> set[int]:
    """The source side of a minimum cut: maximum flow by blocking flows in level graphs, source -2, sink -1."""
    source, sink = -2, -1
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if pull[i] > 0:
            room[source][i], room[i][source] = pull[i], 0.0
        else:
            room[i][sink], room[sink][i] = -pull[i], 0.0
    ways = {i: list(r) for i, r in room.items()}
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j in ways[i]:
                if room[i][j] > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        tried, path = dict.fromkeys(ways, 0), [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[x][y] for x, y in steps)
                for x, y in steps:
                    room[x][y] -= flow
                    room[y][x] += flow
                del path[next(k for k, (x, y) in enumerate(steps) if room[x][y] <= 1e-9) + 1 :]
                continue
            while tried[i] < len(ways[i]):
                j = ways[i][tried[i]]
                if room[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                tried[i] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(html: str) -> str:
    found = blocks(html)
    edges, last_of = [], {}
    for k, (_, _, element, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, SMOOTH_NEXT * _proximity(found[k - 1][2], element)))
        parent = element.parent.number if element.parent else 0
        if parent in last_of and last_of[parent] < k - 1:
            edges.append((last_of[parent], k, SMOOTH_SIBLING * _proximity(found[last_of[parent]][2], element)))
        last_of[parent] = k
    keep = label([o for _, o, _, _ in found], edges)
    return "\n".join(text for (text, _, _, _), yes in zip(found, keep, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for b in batches:
            html = b.column("html")
            for at in range(0, b.num_rows, 256):
                text = [main_text(h.as_py() or "") for h in html.slice(at, 256)]
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
