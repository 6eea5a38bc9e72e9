"""The blocks of an HTML page: leaf sequences of text, each with its tag path."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements that never interrupt a line of text, that have no content, whose
#: content is not text, and that a new one of their kind ends.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "button iframe math meter noscript object output progress select svg textarea "
    "annotation menclose mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder "
    "munderover semantics circle defs ellipse g line path polygon polyline rect text tspan use".split()
)
#: Elements to act on rather than to read: a block that lies in them alone names them in its path.
CONTROLS = frozenset("button select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template")
ENDED_BY_ITSELF = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: A new one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: A slash that closes a tag; after an unquoted value it belongs to the value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")


@dataclass
class Block:
    """A run of text, its path (tags and words of class, id and role), and its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(attrs: str) -> list[str]:
    if "=" not in attrs:
        return []
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
    return [f".{w}" for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())]


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; broken markup is read as far as it goes."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    pieces: list[str] = []
    linked, anchors, at, free = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, free
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                path = tuple(x for tag, names in stack if tag not in INLINE for x in (tag, *names))
                path += () if free else ("button",)
                found.append(Block(text, path, min(linked, len(text))))
            pieces.clear()
        linked, free = 0, False

    def add(raw: str) -> None:
        nonlocal linked, free
        if raw:
            pieces.append(raw)
            if not free and not raw.isspace():
                free = not any(tag in CONTROLS for tag, _ in stack)
            if anchors:
                linked += len(raw)

    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in INLINE:
                add(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
        elif m["close"] or m["close2"]:
            if tag not in INLINE:
                flush()
            if any(tag == t for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    anchors -= t == "a"
                    if t == tag:
                        break
        else:
            if tag not in INLINE:
                flush()
            ended = ENDED_BY_ITSELF.get(tag, {"p"} if tag in ENDS_PARAGRAPH else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    anchors -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag not in VOID and not _CLOSED.search(attrs):
                stack.append((tag, _names(attrs)))
                anchors += tag == "a"
    add(page[at:])
    flush()
    return found
