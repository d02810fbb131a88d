"""From html to the sequence of its text blocks, each with the tags it stands in."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements by what HTML makes of them.
SILENT = frozenset(("script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "select", "option", "textarea", "button"))
CLOSED = frozenset(("button", "canvas", "iframe", "math", "noscript", "object", "option", "select", "svg", "template", "textarea"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
     "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "br")
)
CLOSES_P = frozenset(
    ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
     "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
)
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
IN_HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title"))
NAME = re.compile(r"[A-Za-z]+|[0-9]+")
END = re.compile(r"</(button|canvas|iframe|math|noscript|object|option|select|svg|template|textarea)\b", re.IGNORECASE)


@dataclass
class Block:
    path: tuple[str, ...]  # tags and the words of their classes and ids, outermost first
    text: str
    linked: int = 0  # characters within links


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]


@dataclass
class _State:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


class _Reader(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.ends = Counter(m[1].lower() for m in END.finditer(html))  # end tags still to come
        self.stack: list[_Open] = []
        self.blocks: list[Block] = []
        self.now = _State()
        self.silent = self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.now.parts).split())
        if text:
            self.blocks.append(Block(tuple(n for o in self.stack if o.tag not in INLINE for n in o.names), text, self.now.linked))
        self.now = _State()

    def _pop(self, at: int) -> None:
        if any(o.tag not in INLINE for o in self.stack[at:]):
            self._flush()
        for o in self.stack[at:]:
            self.silent -= o.tag in SILENT
            self.links -= o.tag == "a"
        del self.stack[at:]

    def _find(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stop:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.now.parts.append(" ")
            return
        if tag in CLOSES_P and (at := self._find(("p",), ("article", "section", "div", "td", "li", "body", "blockquote"))) >= 0:
            self._pop(at)
        if tag in SAME_CLOSES and (at := self._find((tag,), SAME_CLOSES[tag])) >= 0:
            self._pop(at)
        if self.stack and self.stack[-1].tag == "head" and tag not in IN_HEAD or tag == "body":
            self._leave_head()
        if tag == "button" and (at := self._find(("button",))) >= 0:
            self._pop(at)
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        own = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                own += [f".{w.lower()}" for w in NAME.findall(value)]
        if tag in SILENT and tag in CLOSED and not self.ends[tag]:
            return  # it is never closed, so what follows isn't in it
        self.stack.append(_Open(tag, tuple(own)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSED:  # nothing is in it, and no end tag of another is its own
            self._flush()
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _leave_head(self) -> None:
        if (at := self._find(("head",))) >= 0:
            self._pop(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self.ends[tag] -= 1
        if (at := self._find((tag,))) >= 0:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and data.strip():
            self._leave_head()
        if not self.silent:
            self.now.parts.append(data)
            self.now.linked += len(data) * (self.links > 0)


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in page order.  Inline elements don't end a block, ``br`` counts as white space, and
    scripts, styles, comments, form fields and what is in ``head`` have no text.  Tags that HTML lets out are put in: a head ends where
    something begins that can't be in it, and a button, object and the like that nothing closes holds nothing.  Null or empty html
    has no blocks."""
    if not html:
        return []
    reader = _Reader(html)
    reader.feed(html)
    reader.close()
    reader._flush()
    return reader.blocks
