"""Leaf text blocks of an HTML page, with their ancestors.  Tolerates broken markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: A comment, something else that is no element, or a tag.  A quote opens a string right after ``=`` only.
_MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>",
    re.S,
)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)

RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "canvas"}
#: Of these, the ones whose content is markup: without an end tag they are empty.
MARKUP = {"noscript", "template", "svg", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "math", "maction", "menclose", "mfrac", "mi", "mn", "mo", "mover", "mrow", "ms", "msqrt", "mstyle", "msub", "msup", "mtext", "munder", "object", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag closes open elements of these names, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Block:
    """Text of one leaf block."""

    tags: tuple[str, ...]  # from the root
    names: str  # classes, ids and roles of the ancestors
    text: str = ""
    linked: int = 0  # characters inside links
    marks: dict = field(default_factory=dict)


def hidden(attributes: str) -> bool:
    """Whether a start tag hides its element: ``hidden``, ``aria-hidden=true`` or ``style="display: none"``."""
    if not _MAY_HIDE.search(attributes):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NOT_DISPLAYED.search(value)):
            return True
    return False


def self_closed(attributes: str) -> bool:
    """Whether a start tag ends with a slash that isn't part of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attributes):
        pass
    return last is None or last.end() < len(attributes)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, white space made one blank, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, names, hidden
    held: list[str] = []
    links = [0, 0]  # open links, characters in them
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    page = page or ""

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                tags = tuple(x for x, _, _ in stack)
                out.append(Block(tags, " ".join(n for _, n, _ in stack if n), text, links[1]))
            held.clear()
        links[1] = 0

    def close(names: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    end = len(page)
    last = page.rfind(">")  # behind it no tag ends, so none is looked for
    while at < end:
        m, begin = None, page.find("<", at)
        while 0 <= begin <= last and not (m := _MARK.match(page, begin)):
            begin = page.find("<", begin + 1)
        if m is None and begin >= 0:
            end = end if (comment := page.find("<!--", begin)) < 0 else comment
        piece = page[at : m.start() if m else end]
        if piece and not any(h for _, _, h in stack):
            held.append(piece)
            if links[0]:
                links[1] += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            links[0] = 0 if closing else 1
            if not held:
                links[1] = 0
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        rest = m[3] or ""
        if tag in RAW:
            if tag in unclosed or (tag == "svg" and self_closed(rest)):
                continue
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif tag in MARKUP:
                unclosed.add(tag)
            else:
                at = end
            continue
        if tag in VOID or (tag == "math" and self_closed(rest)):
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag not in INLINE:
            # a paragraph and the inline elements left open in it end where a block starts
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        names = " ".join(a or b or c for a, b, c in _NAME.findall(rest)).lower() if "=" in rest else ""
        stack.append((tag, names, bool(rest) and hidden(rest)))
    flush()
    return out
