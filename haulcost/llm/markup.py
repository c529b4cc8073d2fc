"""Reading one web page: its tags, and its blocks of text; runs inside tasks.

Every step moves forward in the page, whatever it holds, so that a page takes time in
proportion to its length: unclosed quotes, comments and elements, stray ends and deep
nesting included.
"""

from __future__ import annotations

import html as references
import re
from hashlib import blake2b
from typing import NamedTuple

# Elements of HTML by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu"
    " nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that end before a start of one of the named others.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}

# Elements and names of classes that are not the article.
APART = frozenset(
    "aside button dialog fieldset footer form head menu nav noscript object search select svg template".split()
)
APART_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal"
    " nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo"
    " promotion recommended related replies respond search share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription toolbar widget".split()
)
REMARKS = frozenset("comment comments disqus replies respond".split())
#: Names of classes that hold the article where no element marks it.
CONTENT_NAMES = frozenset(
    "article article-body article-content content entry entry-content main main-content page-content post"
    " post-body post-content story story-body".split()
)

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_START = re.compile(r"[a-zA-Z][^\s/>]*")
_NOTED = re.compile(
    r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]|$))""",
    re.IGNORECASE,
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def key(*parts: object) -> int:
    """A 64-bit number for what identifies a token."""
    whole = "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(whole, digest_size=8).digest(), "big", signed=True)


class Block(NamedTuple):
    """Text without a block boundary: where it lies, whether marked as article, and how much is links."""

    text: str
    place: int
    level: int
    linked: int

    @property
    def token(self) -> int:
        return key(self.place, "text", self.text)


class Tag:
    """A tag of the page, told apart by the elements around it."""

    __slots__ = ("chars", "first", "label", "linked", "n", "parent")

    def __init__(self, label: str, parent: int, first: int):
        self.label, self.parent, self.first = label, parent, first
        self.n = self.chars = self.linked = 0


class _Open(NamedTuple):
    name: str
    place: int
    level: int
    apart: bool


def _is_apart(names: list[str], inside_article: bool) -> bool:
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in ("has", "with", "no", "without"):
            continue
        hits = APART_NAMES.intersection((words[0], words[-1]))
        if inside_article:
            hits -= {"header"}
        if hits:
            return True
    return False


class Page:
    """The tags of a page by their token, and its blocks outside of what is set apart."""

    def __init__(self, html: str):
        self.tags: dict[int, Tag] = {}
        self.blocks: list[Block] = []
        self._open = [_Open("", 0, 0, False)]
        self._names: dict[str, int] = {}
        self._pieces: list[str] = []
        self._linked = 0
        self._link = 0
        self._position = 0
        self._read(html)
        self._end_block()

    def _tag(self, token: int, label: str, parent: int) -> None:
        tag = self.tags.get(token)
        if tag is None:
            tag = self.tags[token] = Tag(label, parent, self._position)
        tag.n += 1
        self._position += 1

    def _text(self, text: str) -> None:
        if text and not self._open[-1].apart:
            text = references.unescape(text)
            self._pieces.append(text)
            if self._link:
                self._linked += len("".join(text.split()))

    def _end_block(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                last = self._open[-1]
                self.blocks.append(Block(text, last.place, last.level, self._linked))
                tag = self.tags.get(last.place)
                if tag is not None:
                    tag.chars += len(text) - text.count(" ")
                    tag.linked += self._linked
        self._pieces, self._linked = [], 0

    def _close(self, name: str) -> None:
        """Close elements up to the last open one of the name."""
        while len(self._open) > 1:
            gone = self._open.pop()
            self._names[gone.name] -= 1
            if gone.name == name:
                return

    def _implied_ends(self, name: str) -> None:
        """Close what a start of the name ends without an end of its own."""
        if name == "body":
            while len(self._open) > 1 and self._open[-1].name != "html":
                self._close(self._open[-1].name)
        elif self._open[-1].name == "head" and name not in IN_HEAD:
            self._close("head")
        elif self._open[-1].name == "p" and name != "button":
            self._close("p")
        while name in ENDED_BY.get(self._open[-1].name, ()):
            self._close(self._open[-1].name)

    def _element(self, name: str, attributes: str) -> None:
        is_block = name in BLOCK
        if is_block:
            self._end_block()
            self._implied_ends(name)
        elif name == "a":
            self._link += 1
        last = self._open[-1]
        noted: dict[str, str] = {}
        for which, *values in _NOTED.findall(attributes) if attributes else ():
            noted.setdefault(which.lower(), next(filter(None, values), ""))
        names = f"{noted.get('class', '')} {noted.get('id', '')}".split()
        apart = last.apart or name in APART or "hidden" in noted or (name == "header" and not last.level)
        if not apart and names and name not in ("html", "body", "main"):
            if name == "article":
                names = [x for x in names if REMARKS.intersection(_WORDS.findall(x.lower()))]
            apart = _is_apart(names, last.level > 0)
        if not is_block and not apart:
            return  # within a line
        level = last.level
        if not apart:
            role, item = noted.get("role", "").lower(), noted.get("itemprop", "").lower()
            if name == "article" or role == "article" or item == "articlebody":
                level = 2
            elif name == "main" or role == "main" or CONTENT_NAMES.intersection(x.lower() for x in names):
                level = max(level, 1)
        label = name + "".join(f".{_DIGITS.sub('#', x)}" for x in sorted(set(names)))
        place = key(last.place, label)
        self._tag(place, f"<{label}>", last.place)
        self._open.append(_Open(name, place, level, apart))
        self._names[name] = self._names.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = max(0, self._link - 1)
        if name in BLOCK:
            self._end_block()
        if self._names.get(name):
            place = next(x.place for x in reversed(self._open) if x.name == name)
            self._close(name)
            self._tag(key(place, "/"), f"</{name}>", place)

    def _read(self, html: str) -> None:
        at, loose = 0, False
        while True:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            following = html[start + 1 : start + 2]
            if not (following in ("!", "/", "?") or (following.isascii() and following.isalpha())):
                self._text(html[at : start + 1])
                at = start + 1
                continue
            self._text(html[at:start])
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4 - 2 * html.startswith("<!-->", start))
                if end < 0:
                    return
                at = end + 3
                continue
            found = None if loose or following in "!/?" else _TAG.match(html, start)
            if found is not None:
                name, attributes, at = found[1].lower(), found[2], found.end()
            else:
                end = html.find(">", start)
                if end < 0:
                    return
                at = end + 1
                if following in "!?":
                    continue
                begin = start + 1 + (following == "/")
                found = _START.match(html, begin, end)
                if found is None:
                    continue
                name, attributes = found[0].lower(), html[found.end() : end]
                if following == "/":
                    self._end(name)
                    continue
                loose = True  # a quote that is never closed is looked for once
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                if end is None:
                    return
                at = html.find(">", end.start()) + 1
                if at == 0:
                    return
                self._tag(key(self._open[-1].place, name), f"<{name}>", self._open[-1].place)
            elif name in VOID:
                if name == "hr":
                    self._end_block()
                elif name == "br":
                    self._text("\n")
                if name != "br":
                    self._tag(key(self._open[-1].place, name), f"<{name}>", self._open[-1].place)
            elif attributes.endswith("/") and name in ("svg", "path", "use"):
                continue
            else:
                self._element(name, attributes)


def article(page: Page, fixed: frozenset[int] = frozenset(), menus: frozenset[int] = frozenset()) -> str:
    """The page's main text, given the template text and the link lists of its host.

    Where elements mark an article, its blocks are the text, and otherwise all blocks
    but lists of links. Template text goes, unless most of the page's text would:
    then the pages are copies of one article.
    """
    level = max((b.level for b in page.blocks), default=0)
    blocks = [b for b in page.blocks if b.level == level]
    if level == 0:
        tags = page.tags
        own = {p for p, t in tags.items() if 2 * t.linked > t.chars}
        blocks = [b for b in blocks if b.place not in own and b.place not in menus]
    if fixed:
        varying = [b for b in blocks if b.token not in fixed]
        if 2 * sum(len(b.text) for b in varying) >= sum(len(b.text) for b in blocks):
            blocks = varying
    return "\n\n".join(b.text for b in blocks)
