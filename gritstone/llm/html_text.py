"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "select", "canvas", "audio", "video", "head"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "figure"}
#: Words of classes, ids and roles. Those of the first list mark what is never the article's; those of the second what often is not.
AWAY_ALWAYS = re.compile(
    r"(?:^|[_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|foot|header|masthead|menu|modal|nav\w*|"
    r"newsletter|notices?|alert|pagination|pager|popup|promo\w*|replies|reply|respond|sidebar|side|signup|sponsor\w*|"
    r"subscribe|topbar|contentinfo|complementary|navigation|login|copyright)(?=$|[_-])",
    re.I,
)
AWAY_OFTEN = re.compile(r"(?:^|[_-])(related|share|sharing|social|tags?|toolbar|widget|search|discussion|feedback|legal|recommended)(?=$|[_-])", re.I)
TOWARDS = re.compile(r"(?:^|[_-])(article|content|entry|main|post|story|body|text)(?=$|[_-])", re.I)
OWN_HEAD = re.compile(r"(?:article|content|entry|post|story)[_-]+header", re.I)
#: Names that tell a state of an element or what else the page has, not what the element is: all of the name, or the rest of it.
STATE = re.compile(r"(?:^|[_-])(?:has|no|not|with|without|hide|show)[_-].*|.*[_-](?:open|opened|closed|free|enabled|disabled|visible|collapsed|expanded)$|side[_-]by[_-]side", re.I)
TEXT_TAGS = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(4096)
def named_lean(words: str, tag: str, inside: bool) -> tuple[float, bool]:
    """What names say of an element's blocks (above zero: content), and whether they set it apart from its neighbours.

    A name that ends in a word for content after one that often marks none says little; an article's
    own header is part of it; a paragraph that a doubtful word names can stand by its form. What a
    name says of a state (``has-sidebar``, ``comments-open``, ``story-with-banner``) is no name of a
    container; of a paragraph or heading it is (``no-comments``).
    """
    low, high = 0.0, 0.0
    for name in words.split():
        name = name if tag in TEXT_TAGS else STATE.sub("", name)
        if AWAY_ALWAYS.search(name):
            if not (inside and OWN_HEAD.fullmatch(name)):
                return -9.0, True
            continue
        towards = list(TOWARDS.finditer(name))
        if AWAY_OFTEN.search(name):
            low = min(low, -1.0 if towards and towards[-1].end() == len(name) else -7.0 if tag in TEXT_TAGS else -9.0)
        elif towards and tag not in INLINE:
            high = 2.0
    return low or high, False


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""
    parent: int = 0
    section: int = 0
    lean: float = 0.0  # what ancestors say: above zero for content
    text: str = ""


def blocks(html: str) -> list[Block]:
    """The page's non-empty text blocks, in page order, with what their ancestors say."""
    out: list[Block] = []
    # element: (tag, number, what it says of its blocks, its section's number, place of the nearest one that is not inline)
    stack: list[tuple[str, int, float, int, int]] = [("", 0, 0.0, 0, 0)]
    opened: Counter = Counter()  # open elements by tag, so that no tag looks through all of them
    cur: Block | None = None
    at, n, low = 0, 0, None

    def end() -> None:
        nonlocal cur
        if cur is not None:
            cur.text = " ".join(unescape("".join(cur.parts)).split())
            if cur.text:
                out.append(cur)
            cur = None

    def say(piece: str) -> None:
        nonlocal cur
        if cur is None:
            if piece.isspace():
                return
            holder = stack[stack[-1][4]]
            cur = Block(tag=holder[0], parent=stack[-2][1] if len(stack) > 1 and holder is stack[-1] else holder[1], section=holder[3], lean=holder[2])
        cur.parts.append(piece)
        if opened["a"]:
            cur.linked += len(piece)

    while True:
        m = MARKUP.search(html, at)
        if m is None:
            if at < len(html):
                say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                say(" ")
                continue
            if name not in INLINE:
                end()
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in RAW and not m[3].endswith("/"):
            if low is None:
                low = html.lower() if len(html.lower()) == len(html) else html
            if name == "head":  # only its raw children hold text
                continue
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*+(?:>|\\Z)").search(low, at)
            if name not in ("svg", "math", "iframe"):
                end()
            at = close.end() if close else len(html)
            continue
        if name == "br":
            if cur is not None:
                cur.parts.append(" ")
            continue
        if name not in INLINE:
            end()
            if name in ("p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "header", "nav", "aside", "form", "blockquote", "pre", "main", "hr"):
                close_tag("p", stack, opened)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close_tag(name, stack, opened, stop=("ul", "ol", "dl", "table"))
        if name in VOID or m[3].endswith("/"):
            continue
        n += 1
        _, _, lean, section, holder = stack[-1]
        inside = opened["article"] or opened["main"]
        if name in ("article", "main"):  # a page's one main element counts whatever a wrapper is called
            lean, section = max(lean, -4.0) + 5.0 if lean > -8 or name == "main" else lean, n
        elif name in AWAY:
            lean, section = lean - 2.0 if name == "figure" else min(lean - 9.0, -6.0) if name in ("nav", "aside", "footer", "menu") else lean - 9.0, n
        elif name == "header":
            lean, section = lean - (2.0 if inside else 9.0), n
        elif name in ("section", "div", "body"):
            section = n
        if m[3] and name != "body":
            named = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])}
            words = " ".join(named.get(k, "") for k in ("class", "id", "role"))
            if words.strip():
                said, apart = named_lean(words, name, bool(inside))
                lean += said
                if apart:  # however much the article around it is one
                    lean, section = min(lean, -8.0), n
            if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
                lean -= 9.0
        stack.append((name, n, lean, section, holder if name in INLINE else len(stack)))
        opened[name] += 1
    end()
    return out


def close_tag(name: str, stack: list, opened: Counter, stop: tuple = ("article", "section", "div", "body", "td", "li", "blockquote", "main")) -> None:
    """Ends an open ``name`` whose end tag the page leaves out."""
    if not opened[name]:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] == name:
            opened.subtract(e[0] for e in stack[i:])
            del stack[i:]
            return
        if stack[i][0] in stop:
            return


def reserved(b: Block) -> bool:
    """Whether a block is a note of rights."""
    return "©" in b.text[:3] or "all rights reserved" in b.text.lower()


def content_odds(b: Block) -> float:
    """Log-odds that a block is main text: a linear classifier over its form and its ancestors."""
    words = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, len(b.text)))
    odds = -1.2 + b.lean + 0.9 * math.log1p(words) - 4.0 * density
    if b.tag in ("p", "blockquote", "pre"):
        odds += 0.8
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += 0.5
    elif b.tag in ("li", "td", "th", "dt", "dd"):
        odds -= 0.5
    if reserved(b):
        odds -= 4.0
    return max(-12.0, min(12.0, odds))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source when the least capacity is cut.

    A node's odds are its terminal capacity (to the source above zero, to the sink below); edges
    hold in both ways. Dinic's max-flow, then what the residual graph still reaches.
    """
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, c: float, back: float) -> None:
        adj[u].append(len(to))
        adj[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((c, back))

    for i, o in enumerate(odds):
        if o > 0:
            link(s, i, o, 0.0)
        elif o < 0:
            link(i, t, -o, 0.0)
    for u, v, c in edges:
        link(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:  # blocking flow, without recursion
            if u == t:
                low = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= low
                    cap[e ^ 1] += low
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(adj[u]):
                e = adj[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def main_text(html: str | None, near: float = 0.6, kin: float = 1.2) -> str:
    """The page's main text; empty if it has none or the page is null.

    Where the cut leaves no block, those that nothing marks as boilerplate and that are not mostly
    links are the text.
    """
    found = blocks(html or "")
    odds = [content_odds(b) for b in found]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            same = found[i - 1].section == b.section
            edges.append((i - 1, i, near + kin if same else near / 2))
        j = last.get(b.section)
        if j is not None and j < i - 1:
            edges.append((j, i, kin))
        last[b.section] = i
    keep = min_cut(odds, edges) if any(o < 0 for o in odds) else [True] * len(odds)
    if not any(keep):  # a page of few words: what nothing marks as boilerplate
        keep = [b.lean >= 0 and 2 * b.linked < len(b.text) and not reserved(b) for b in found]
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null and empty pages, and pages without main text, have an empty text; repeated rows, null ids
    and null urls are returned as they come; an empty table gives no rows. Broken markup is read as browsers would: an
    unended element ends with its parent, an unended comment or script with the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
SQL: dict[str, str] = {}
