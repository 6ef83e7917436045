"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks.  A small fixed classifier gives each block
a cost for either label; the costs are its terminal capacities.  The role of an
element (nav, aside, footer, hidden) is nearly sure; whole names in class and id
attributes are evidence that fades outwards and that text and neighbours can
overrule.  Neighbouring blocks, and blocks near to each other in the DOM, are
tied by smoothness edges.  The minimum cut, found by max-flow, separates content
from boilerplate.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their role, and words of class and id attributes.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "object", "canvas", "audio", "video", "textarea", "select", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
FRAME_TAGS = {"nav", "aside", "footer", "menu", "search", "button", "option"}  # outside the article wherever they stand
FORM_TAGS = {"form", "fieldset", "dialog", "label", "legend"}
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "notices", "notification", "alert", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "footer", "foot", "pagination", "pager", "toolbar", "widget", "masthead", "topbar", "skip", "copyright", "legal", "disclaimer"}
ALONE_WORDS = {"widget", "side", "alert", "skip", "foot", "legal"}  # say little at the end of a longer name
OUTER_WORDS = {"header", "head", "top"}  # boilerplate unless inside an article
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "body", "main", "text"}
HOLDER_WORDS = {"list", "container", "wrapper", "wrap", "box", "area", "section", "bar", "block", "slot", "inner", "outer", "links", "thread"}  # the word before says what is held
SWITCH_WORDS = {"has", "no", "with", "without", "is", "not", "hide", "show"}  # a name that begins so describes a layout
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
COMMENT_HEADINGS = r"(?:\d+\s+)?(?:reader |user )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\W{0,3}(?:\(?\d+\)?)?:?|leave a (?:reply|comment)|join the (?:discussion|conversation)"
REPLY_LABELS = {"reply", "antworten", "répondre", "responder"}

# Log-odds of a hint.
FRAME, FORM, NAME, PART, CONTENT = -8.0, -4.0, -5.0, -2.5, 3.0
#: What a hint still weighs one container further out, and behind a content or form element.
FADE, BEHIND = 0.85, 0.15

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z][^<>]*\Z", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMENTS = re.compile(COMMENT_HEADINGS, re.I)


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]  # ids of the open containers
    link: int  # characters inside links
    hint: float  # log-odds of the open containers
    content: bool  # a container says that it holds content


@dataclass
class _Open:
    tag: str
    key: int
    frame: float  # holds for all inside, whatever is between
    hint: float  # fades outwards
    shade: float  # what hints further out keep
    content: bool
    article: bool


def _name_hint(value: str, inside_article: bool) -> tuple[float, float]:
    """(boilerplate, content) log-odds of a class or id attribute, by its whole names."""
    boiler = content = 0.0
    for token in value.split():
        parts = [p.lower() for p in _NAME.findall(token)]
        if not parts or parts[0] in SWITCH_WORDS and len(parts) > 1:
            continue
        if len(parts) > 2 and parts[-1] in HOLDER_WORDS or len(parts) == 2 and parts[-1] in HOLDER_WORDS and parts[0] not in ALONE_WORDS:
            parts.pop()
        known = lambda w: w in BOILER_WORDS or not inside_article and w in OUTER_WORDS
        if len(parts) == 1:
            boiler = min(boiler, NAME if known(parts[0]) else 0.0)
        elif known(parts[-1]) and parts[-1] not in ALONE_WORDS:
            boiler = min(boiler, NAME)
        elif known(parts[0]):
            boiler = min(boiler, PART)
        if parts[-1] in CONTENT_WORDS and not known(parts[0]):
            content = CONTENT
    return boiler, content


def _opened(tag: str, key: int, attrs: str, article: bool) -> _Open:
    """The hints of an element: its role is sure, its names are evidence."""
    frame = FRAME if tag in FRAME_TAGS or tag == "header" and not article else 0.0
    boiler, content = FORM if tag in FORM_TAGS else 0.0, CONTENT if tag in CONTENT_TAGS else 0.0
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), _html.unescape(value.strip("\"'"))
        if tag in ("html", "body"):
            continue  # their names describe the site
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            frame = FRAME
        elif name == "role":
            frame = FRAME if value.lower() in BOILER_ROLES else frame
            content = CONTENT if value.lower() in ("main", "article") else content
        elif name in ("class", "id"):
            b, c = _name_hint(value, article)
            boiler, content = min(boiler, b / 2 if tag in CONTENT_TAGS else b), max(content, c)
    shade = BEHIND if tag in CONTENT_TAGS or tag in FORM_TAGS or boiler <= NAME else FADE
    return _Open(tag, key, frame, boiler + content, shade, content > 0, article or tag in CONTENT_TAGS)


def _hint(stack: list[_Open]) -> float:
    total, left = min((o.frame for o in stack), default=0.0), 1.0
    for o in reversed(stack):
        total += left * o.hint
        left *= o.shade
    return total


def blocks(page: str) -> list[Block]:
    """Non-empty text blocks in page order; comments, scripts, styles and head left out."""
    found: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked, in_link, tag, at, keys = 0, 0, "", 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, tag, tuple(o.key for o in stack), min(linked, len(text)), _hint(stack), any(o.content for o in stack)))
            parts.clear()
        linked = 0

    search = _TOKEN.search
    while True:
        m = search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name, closing, attrs = (m[2], m[1], m[3]) if m[2] is not None else (m[5], m[4], m[6])
        if name is None:
            continue
        name, closing = name.lower(), bool(closing)
        if name in RAW and not closing and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCK:
            continue
        flush()
        in_link = 0 if name in ("div", "section", "article", "p", "body") else in_link
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            tag = stack[-1].tag if stack else ""
        else:
            if name in ("p", *HEADING):  # these end an open paragraph or heading
                while stack and (stack[-1].tag == "p" or stack[-1].tag in HEADING):
                    stack.pop()
            elif stack and stack[-1].tag == "p":
                stack.pop()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                peers = {"td", "th"} if name in ("td", "th") else {"dt", "dd"} if name in ("dt", "dd") else {name, "td", "th"} if name == "tr" else {name}
                while stack and stack[-1].tag in peers:
                    stack.pop()
            tag = name
            if name not in VOID:
                article = bool(stack) and stack[-1].article
                keys += 1
                stack.append(_opened(name, keys, attrs, article))
    flush()
    return _with_comments(found)


def _with_comments(found: list[Block]) -> list[Block]:
    """Lowers the hints of unlabelled reader comments.

    They follow a short heading that names them, in its container, or stand in
    sibling containers of which two or more hold a reply button.
    """
    under: tuple[int, ...] | None = None
    replies = Counter(b.path[:-1][:-1] for b in found if b.text.lower() in REPLY_LABELS)
    for b in found:
        if _COMMENTS.fullmatch(b.text):
            under = b.path[:-1] if b.path else ()
            b.hint += NAME
        elif under is not None:
            if b.path[: len(under)] == under and under:
                b.hint += NAME
            else:
                under = None
    for parent, n in replies.items():
        if n > 1 and parent:
            who = {b.path[len(parent)] for b in found if b.text.lower() in REPLY_LABELS and b.path[: len(parent)] == parent and len(b.path) > len(parent)}
            for b in found:
                if len(b.path) > len(parent) and b.path[: len(parent)] == parent and b.path[len(parent)] in who:
                    b.hint += NAME
    return found


def evidence(b: Block) -> float:
    """Log-odds that a block is content: the fixed classifier."""
    words = b.text.count(" ") + 1
    links = b.link / len(b.text)
    z = -0.4 + min(2.0, words / 10) * (1 - links) - 3 * links
    z += 0.8 if b.text[-1] in ".!?…\"'»”" else 0.0
    z += 0.7 if b.tag in HEADING and b.content else 0.0
    z += 0.6 if b.tag in ("p", "pre", "blockquote") else 0.0
    return z + b.hint


def _ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: page neighbours by DOM distance, and the next block of the same parent."""
    ties, last = [], {}
    for i, b in enumerate(found):
        if i:
            p, q = found[i - 1].path, b.path
            same = 0
            for x, y in zip(p, q):
                if x != y:
                    break
                same += 1
            ties.append((i - 1, i, 1.2 * math.exp(-(len(p) + len(q) - 2 * same) / 4)))
        parent = b.path[:-1]
        if parent in last and last[parent] != i - 1:
            ties.append((last[parent], i, 0.4))
        last[parent] = i
    return ties


def min_cut(unary: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source (content) side of the least cut.

    Node i is tied to the source with max(unary, 0) and to the sink with
    max(-unary, 0); a tie's weight is its capacity both ways.  Blocking flows
    in level graphs; a node that could go either way is boilerplate.
    """
    n = len(unary)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(c)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, z in enumerate(unary):
        edge(s, i, z, 0.0) if z > 0 else edge(i, t, -z, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in at[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= eps)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(at[a]):
                e = at[a][nxt[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(at[a]):
                path.append(at[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of a page; ("", 0, 0) for a null or blank one."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    keep = min_cut([evidence(b) for b in found], _ties(found))
    text = [b.text for b, k in zip(found, keep) if k]
    return "\n".join(text), len(found), len(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content: one row per row of pages.

    The whole html is read, whatever its length.  A null or empty html, and a
    page of boilerplate only, give an empty text with n_chars 0.  page_id and
    url pass through, null or repeated; other columns are not returned, whatever
    their names.  Repeated rows are extracted each, and alike; of cuts that tie
    the one with the least content counts.  An empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            got = [main_text(h) for h in b.column(2).to_pylist()]
            cols = [[g[0] for g in got], [len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_content long")
