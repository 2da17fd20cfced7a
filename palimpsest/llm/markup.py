"""Cuts one HTML page into text lines, told apart by what they stand in.

A small tag scanner for pages as found: unclosed and stray tags, raw script
text, comments, character references. It yields one line per text block.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noembed xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset(
    "nav footer aside form button select option datalist fieldset dialog menu svg math object "
    "canvas audio video label optgroup".split()
)
_CLOSED_BY_NEXT = frozenset("p li dt dd td th tr option".split())
_PROSE = frozenset(
    "p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption article main section".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset("html body main article".split())
# Words in a class, id or role that mark what is not the article.
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment "
    "comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer "
    "discussion disqus footer form gdpr masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices pager pagination popup privacy promo promoted promotion recommended related "
    "replies reply respond responses search share sharing sidebar signup skip social sponsor "
    "sponsored sponsors subscribe subscription toolbar widget widgets alert alerts header topbar".split()
)
_MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:(?:article|post|entry|story)[_-]?(?:body|content|text)|main[_-]?content)(?:$|\s)", re.I
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    text: str
    prose: bool  # in a paragraph-like block of the page's article
    weak: bool  # mostly link text, or under five words


class _Open(NamedTuple):
    tag: str
    aside: bool
    article: int  # 0 outside, 1 in a content-named block, 2 in main, 3 in article
    header: bool


def _looks_aside(words: str) -> bool:
    for name in words.split():
        parts = [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))]
        if parts and parts[0] not in ("has", "no", "with", "is") and not _ASIDE_WORDS.isdisjoint(parts):
            return True
    return False


def _opened(tag: str, attributes: str, outer: _Open, by_name: bool) -> _Open:
    aside, article, header = outer.aside, outer.article, outer.header
    if tag in _NEVER:
        aside = True
    elif tag == "header":
        aside, header = aside or article == 0, True
    if tag == "article":
        article = 3
    elif tag == "main":
        article = max(article, 2)
    if attributes and tag not in ("html", "body"):
        for name, value in _MARKS.findall(attributes):
            name, value = name.lower(), unescape(value.strip("\"'"))
            if name in ("class", "id", "role"):
                if name == "role" and value.lower() == "main":
                    article = max(article, 2)
                elif tag not in ("main",) and by_name and _looks_aside(value):
                    aside = True
                elif _MAIN_WORDS.search(value):
                    article = max(article, 1)
            elif name == "style":
                aside = aside or bool(_HIDDEN.search(value))
            elif name == "hidden" or value.lower() == "true":
                aside = True
    return _Open(tag, aside, article, header)


def _scan(html: str, by_name: bool) -> list[tuple[str, str, int, bool]]:
    """Lines outside of asides: text, block tag, article rank, weak."""
    out: list[tuple[str, str, int, bool]] = []
    stack = [_Open("", False, 0, False)]
    text: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        line = " ".join("".join(text).split())
        if line:
            top = stack[-1]
            block = next((o.tag for o in reversed(stack) if o.tag not in _INLINE), "")
            if not top.aside and (not top.header or block in _HEADINGS):
                links = len(" ".join("".join(linked).split()))
                out.append((line, block, top.article, 2 * links > len(line) or line.count(" ") < 4))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        piece = unescape(piece)
        text.append(piece)
        if in_link:
            linked.append(piece)

    at = 0
    while found := _TAG.search(html, at):
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag == "br":
            text.append(" ")
        elif closing:
            if tag == "a":
                in_link = False
            if tag not in _INLINE:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _CLOSED_BY_NEXT and stack[i].tag not in _INLINE | _CLOSED_BY_NEXT:
                    break
        elif tag in _RAW:
            if tag not in _INLINE:
                flush()
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            if tag not in _INLINE:
                flush()
                in_link = False
                if tag in _CLOSED_BY_NEXT or tag in _HEADINGS or (tag not in _VOID):
                    # A new block ends an open paragraph, and a new item its like.
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p" or (tag in _CLOSED_BY_NEXT and stack[i].tag == tag):
                            del stack[i:]
                            break
                        if stack[i].tag not in _INLINE:
                            break
            if tag == "a":
                in_link = True
            if tag not in _VOID and not attributes.endswith("/"):
                stack.append(_opened(tag, attributes, stack[-1], by_name))
    if at < len(html):
        add(html[at:])
    flush()
    return out


def lines(html: str | None) -> list[Line]:
    """The page's lines that may be main text, in page order.

    Blocks that are marked as something else (navigation, header, footer,
    sidebar, form, advert, notice, comments, hidden) are left out. If the page
    marks containers of its text (article, main, named block), the lines of all
    of them are given, and those in paragraph-like blocks of the containers of
    the highest rank are ``prose``. If the class names leave nothing of a page,
    they are not believed.
    """
    if not html:
        return []
    found = _scan(html, True) or _scan(html, False)
    best = max((rank for _, _, rank, _ in found), default=0)
    return [
        Line(text, rank == best > 0 and block in _PROSE, weak)
        for text, block, rank, weak in found
        if rank > 0 or best == 0
    ]
