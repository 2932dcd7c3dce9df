"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block. A sliding window sums the text lengths of the lines; a
run of lines ends where the sums dive to nothing and is text if they surge inside it. Containers that
are boilerplate by their tag, role or class leave empty lines, so the sums dive there; inside one
container they leave nothing, as they only part its text. Where a page
names its article (`article` or `main`), its lines weigh as much as a surge more and all other lines
a part of their length, so text beside the article has to surge by much more. Where it names none,
paragraphs and headings weigh a surge more. A class, an id or a form
makes a container boilerplate only where it doesn't wrap the page's text, and a page is named only if
its articles hold most of its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import query, table

WINDOW = 3
# Window sum, in characters, from which a run of lines is text; on a page that reaches less than twice
# as much anywhere, half of its largest sum.
SURGE = 80
# Weight of a character beside the named article.
BESIDE = 0.25
# Share of a line's characters inside links from which the line is a menu.
LINK_SHARE = 0.5

# A tag with its attributes; quoted values may hold >. Comments, declarations and processing
# instructions go whole. A tag that never ends is tried once to the end of the page; from there on
# quotes don't count, so that a page of open quotes takes linear time.
_MARKUP = r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
_PLAIN_TAG = r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|\Z)"
_TOKEN = re.compile(
    _MARKUP
    + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|(\Z)))",
    re.S,
)
_SIMPLE = re.compile(_MARKUP + _PLAIN_TAG, re.S)
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math",
        "title", "textarea", "xmp", "noembed", "noframes")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>|\Z", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp "
    "rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_JUNK_TAGS = frozenset("nav header footer aside menu button select dialog head".split())
_FORMS = frozenset("form fieldset".split())
_JUNK_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar".split()
)
# Words of a class or id: of parts that may also wrap a page, of parts that repeat beside the text,
# and of what readers wrote.
_JUNK_WORDS = {
    **dict.fromkeys(
        "banner nav navbar navigation navi menu header masthead footer foot sidebar aside rail popup "
        "modal overlay signup login toolbar skip paywall form search".split(), "layout"
    ),
    **dict.fromkeys(
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb "
        "breadcrumbs widget cookie cookies consent gdpr notice notices notification alert newsletter "
        "subscribe subscription share sharing social related recommended pagination pager copyright "
        "legal disclaimer".split(), "list"
    ),
    **dict.fromkeys(
        "comment comments commentlist disqus respond reply replies discussion".split(), "reply"
    ),
}
# A name that begins or ends so says what its element has or lacks, not what it is.
_MODIFIED_BY = frozenset("has no with without not".split())
_MODIFIER_ENDS = frozenset("open opened closed enabled disabled".split())
# Part of a page's text from which a form beside a named article is the text itself.
FORM_SHARE = 0.8
# class names inside which these words name a part of the article itself
_PART = re.compile(r"(article|entry|post|story|content)[-_]?(header|title|body|text|content)", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
_ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
              "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table article main section div body".split())
_HOLDS = frozenset("article main section div body form".split())
# Blocks of one piece of text: a class or an id doesn't make them boilerplate.
_LEAVES = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6 figure figcaption blockquote pre".split())
# Blocks that authors write text in, also where it is short.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def _junk_kind(tag: str, attrs: str, in_article: bool) -> str:
    """`sure` if tag, role or style say boilerplate; else the kind of the first junk word, or none."""
    # the head of an article holds its title
    if tag in _JUNK_TAGS and not (tag == "header" and in_article):
        return "sure"
    kind = "form" if tag in _FORMS else ""
    if tag in _JUNK_TAGS or not attrs or "=" not in attrs and "hidden" not in attrs:
        return kind
    if _HIDDEN.search(_ATTR.sub("", attrs)):
        return "sure"
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in _JUNK_ROLES:
            return "sure"
        if name == "role" and value.lower() == "form":
            kind = kind or "form"
        if name == "style" and _HIDDEN.search(value):
            return "sure"
        if name == "aria-hidden" and value.lower() == "true":
            return "sure"
        if not kind and name in ("class", "id") and tag not in ("html", "body", "main") and tag not in _LEAVES:
            for part in value.split():
                if _PART.search(part):
                    continue
                words = [w.lower() for w in _SPLIT.split(part) if w]
                if len(words) > 1 and (words[0] in _MODIFIED_BY or words[-1] in _MODIFIER_ENDS):
                    continue
                kind = kind or next((_JUNK_WORDS[w] for w in words if w in _JUNK_WORDS), "")
    return kind


@dataclass
class Line:
    """A block's text and where it stands."""

    text: str
    linked: int  # characters inside links
    article: bool
    junk: bool  # inside sure boilerplate
    held: int  # the outermost article or main, or else the nearest part of a page
    box: int  # the innermost container that may be boilerplate, or -1
    prose: bool  # a paragraph or heading


@dataclass
class Box:
    """A container whose class, id or tag says boilerplate, which its text may disprove."""

    kind: str
    article: bool = False  # is or holds an article
    main: bool = False  # holds a main
    inside: bool = False  # stands in an article
    parent: int = -1  # the next container around it that may be boilerplate


def page_lines(page: str) -> tuple[list[Line], list[Box]]:
    """The blocks of text in order, and the containers that may be boilerplate."""
    lines, buffer = [], []
    linked = 0
    found: list[Box] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, sure, article, container, box or -1
    boxes: list[int] = []
    opened: Counter[str] = Counter()  # tags on the stack
    junk = article = links = made = prose = 0
    at, token = 0, _TOKEN

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                held = stack[-1][3] if stack else 0
                lines.append(Line(text, linked, article > 0, junk > 0, held, boxes[-1] if boxes else -1, prose > 0))
            buffer.clear()
        linked = 0

    def drop(k):
        nonlocal junk, article, links, prose
        flush()
        while len(stack) > k:
            tag, bad, main, _, box = stack.pop()
            if box >= 0:
                boxes.pop()
            opened[tag] -= 1
            junk -= bad
            article -= main
            links -= tag == "a"
            prose -= tag in _PROSE

    while True:
        m = token.search(page, at)
        if m is not None and token is _TOKEN and m[4] is not None:
            token = _SIMPLE
            m = token.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            buffer.append(piece)
            if links:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] == "/", m[3] or ""
        if closing:
            if not opened[tag]:
                if tag not in _INLINE:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _INLINE and not any(s[1] or s[2] or s[4] >= 0 for s in stack[k:]):
                        links -= sum(s[0] == "a" for s in stack[k:])
                        # an inline end closes only inline parts; blocks inside it stay open
                        opened.subtract(s[0] for s in stack[k:] if s[0] in _INLINE)
                        stack[k:] = [s for s in stack[k + 1 :] if s[0] not in _INLINE]
                    else:
                        drop(k)
                    break
                if tag in _INLINE and stack[k][0] in _FENCE:
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        if tag in _RAW:
            at = _RAW_END[tag].search(page, at).end()
            if tag not in ("svg", "math", "canvas", "object"):
                buffer.append(" ")
            continue
        if tag in _VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            ends = ("p",) if tag in _CLOSES_P else _ENDS_SELF.get(tag, ())
            for k in range(len(stack) - 1, -1, -1) if any(opened[e] for e in ends) else ():
                if stack[k][0] in ends:
                    drop(k)
                    break
                if stack[k][0] in _FENCE or stack[k][1] or stack[k][2] or stack[k][4] >= 0:
                    break
        if attrs.endswith("/") and tag not in _INLINE and tag not in _CLOSES_P:
            continue
        kind = _junk_kind(tag, attrs, article > 0)
        bad = kind == "sure"
        main = tag in ("article", "main") and not bad
        if kind:
            flush()
        box = -1
        if kind and not bad:
            box = len(found)
            found.append(Box(kind, inside=article > 0, parent=boxes[-1] if boxes else -1))
            boxes.append(box)
        if main and not junk and boxes:
            found[boxes[-1]].article = True
            found[boxes[-1]].main |= tag == "main"
        held = stack[-1][3] if stack else 0
        if tag in _HOLDS and not article:
            made += 1
            held = made
        stack.append((tag, bad, main, held, box))
        opened[tag] += 1
        prose += tag in _PROSE
        junk += bad
        article += main
        links += tag == "a"
    flush()
    for box in reversed(found):  # parents stand before their children
        if box.parent >= 0:
            found[box.parent].article |= box.article
            found[box.parent].main |= box.main
    return lines, found


def junk_boxes(lines: list[Line], boxes: list[Box]) -> list[bool]:
    """Which boxes are boilerplate, or stand in one that is; the others wrap the page's text.

    What readers wrote is boilerplate however much of it there is.
    """
    size = [0 if line.junk or _is_menu(line, line.article) else len(line.text) for line in lines]
    total = sum(size)
    own, own_named = [0] * (len(boxes) + 1), [0] * (len(boxes) + 1)  # the last is outside all boxes
    for line, n in zip(lines, size, strict=True):
        own[line.box] += n
        own_named[line.box] += n * line.article
    holds, articles = own[:-1], own_named[:-1]
    for k in range(len(boxes) - 1, -1, -1):
        if boxes[k].parent >= 0:
            holds[boxes[k].parent] += holds[k]
            articles[boxes[k].parent] += articles[k]
    # text that stands in no boilerplate so far, and how much of it is named
    out, named = own[-1], own_named[-1]
    bad = [True] * len(boxes)
    for k, box in enumerate(boxes):
        most = 2 * holds[k] > total
        if box.parent >= 0 and bad[box.parent] or not (most or box.article) or box.kind == "reply" and not box.main:
            continue
        layout = box.kind in ("layout", "form")
        if (
            box.main
            or (layout and box.article and not named)
            or (most and not named and (out < SURGE or layout or (box.kind == "list" and box.article)))
            or (most and layout and holds[k] >= SURGE and not box.inside and articles[k] > named)
            or (box.kind == "form" and holds[k] >= max(SURGE, FORM_SHARE * total))
        ):
            bad[k] = False
            out, named = out + own[k], named + own_named[k]
    return bad


def _is_menu(line: Line, named: bool) -> bool:
    return not named and line.linked >= LINK_SHARE * len(line.text)


def text_regions(lengths: np.ndarray, window: int = WINDOW, surge: float = 0) -> list[tuple[int, int]]:
    """[from, to) of the line runs between dives of the windowed sums whose sums reach `surge`.

    A window reaches `window` lines forward; a dive is the first window that holds nothing. `surge`
    is lowered to half of the largest sum.
    """
    if not len(lengths):
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.minimum(np.arange(len(lengths)) + window, len(lengths))
    sums = total[ends] - total[:-1]
    surge = min(surge, sums.max() / 2)
    regions, start = [], None
    for i, size in enumerate(lengths):
        if start is None and size > 0:
            start = i
        elif start is not None and sums[i] == 0:
            regions.append((start, i))
            start = None
    if start is not None:
        regions.append((start, len(lengths)))
    return [(a, b) for a, b in regions if sums[a:b].max() >= surge]


def main_text(page: str | None) -> str:
    """Text of the article, its blocks joined by one newline; empty if the page has none."""
    if not page:
        return ""
    lines, boxes = page_lines(page)
    bad = junk_boxes(lines, boxes)
    junk = [line.junk or line.box >= 0 and bad[line.box] for line in lines]
    size = [0 if bad or _is_menu(line, line.article) else len(line.text) for line, bad in zip(lines, junk, strict=True)]
    named = 2 * sum(n for line, n in zip(lines, size, strict=True) if line.article) > sum(size)
    texts, lengths = [], []
    before, gap = None, False
    for line, bad in zip(lines, junk, strict=True):
        main = named and line.article
        if bad or _is_menu(line, main):
            gap = True
        else:
            # stripped blocks between two containers and the edge of the article leave as many
            # empty lines as a window has, so the sums dive
            if before and ((gap and line.held != before[1]) or main != before[0]):
                texts += [""] * WINDOW
                lengths += [0] * WINDOW
            before, gap = (main, line.held), False
            texts.append(line.text)
            # on pages that name no article, paragraphs and headings are text however short; those of a
            # lesser `article` are teasers
            surges = main or not named and line.prose and not line.article
            lengths.append(len(line.text) + SURGE if surges else len(line.text) * (BESIDE if named else 1))
    regions = text_regions(np.array(lengths, dtype=float), surge=SURGE)
    return "\n".join(t for a, b in regions for t in texts[a:b] if t)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with the columns `text` and `n_chars` (code points), replacing any of that name.

    Null or empty html, and pages without a text block, give empty text. Each page is read whole by
    one task; nothing is shuffled.
    """

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    read = pages.withColumn("text", extract(F.col(html_col).cast("string")))
    return read.withColumn("n_chars", F.length("text").cast("bigint"))


@query()
def op1_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
