"""A small page reader for what regular expressions cannot decide.

Element nesting follows the lenient rules of the standard tokenizer: nothing
closes by itself, an end tag closes up to the nearest open element of its name,
an end tag without one is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ---- fixed values ----
DROPPED_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
BODY_NAME = re.compile("article|content|post|entry", re.I)
DATE_METAS = [("property", "article:published_time"), ("name", "pubdate"), ("itemprop", "datePublished")]
JSONLD_TYPE = "application/ld+json"
LISTING_CLASSES = ["news", "press", "story", "post", "card", "listing", "resource", "results"]
MIN_BODY_CHARS = 100
# ---- end of fixed values ----

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template", "rt", "rp"}


REFERENCE = re.compile(r"&([a-zA-Z][-.a-zA-Z0-9]*);?|(&#(?:[0-9]+|[xX][0-9a-fA-F]+);?)")


def entity(name: str) -> str:
    """The character of an entity in text; an unknown one stays, without a semicolon."""
    return html5.get(f"{name};", f"&{name}")


def decode(text: str) -> str:
    """Text with its entities as characters, by the rules for text between tags."""
    return REFERENCE.sub(lambda m: entity(m[1]) if m[1] else unescape(m[2]), text)


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def strings(self, drop=frozenset()):
        """Stripped non-empty texts below this element, hidden and dropped elements left out."""
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Node):
                    if part.tag not in HIDDEN and part.tag not in drop:
                        stack.append(iter(part.parts))
                        break
                elif part is not None and (text := part.strip()):
                    yield text
            else:
                stack.pop()

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Page(HTMLParser):
    """The element tree of one page; ``elements`` lists it in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.root = self.here = Node("", {}, None)
        self.elements: list[Node] = []
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first[name] = value or ""
        node = Node(tag, first, self.here)
        self.here.parts.append(node)
        self.elements.append(node)
        if tag not in VOID:
            self.here = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            node, self.here = self.here, self.here.parent
            self.open[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_data(self, data):
        parts = self.here.parts
        if parts and isinstance(parts[-1], str):
            parts[-1] += data
        else:
            parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(entity(name))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.here.parts.append(None)  # ends the text before it


def article_text(html: str) -> str | None:
    """The main text of a page, else all paragraphs; white space as found (H1)."""
    page = Page(html)
    dropped = set(DROPPED_TAGS)
    kept = [n for n in page.elements if n.tag not in dropped and not any(a.tag in dropped for a in n.ancestors())]
    tests = [
        lambda n: n.tag == "article",
        lambda n: n.tag == "div" and BODY_NAME.search(n.attrs.get("class", "")),
        lambda n: n.tag == "div" and BODY_NAME.search(n.attrs.get("id", "")),
        lambda n: n.tag == "main",
    ]
    body = next((n for test in tests for n in kept if test(n)), None)
    text = " ".join(body.strings(dropped)) if body else ""
    if len(text) < MIN_BODY_CHARS:
        paragraphs = ("".join(n.strings(dropped)) for n in kept if n.tag == "p")
        text = " ".join(p for p in paragraphs if p)
    return text or None


# What the one-pass reader takes for granted; any other page goes through the tree.
_ODD = re.compile(r"<!\[|<\?|<!(?!--|doctype)|<title[^>]*>[^<]*<(?!/title)|</?(?:textarea|plaintext|xmp|iframe|noembed|noframes|noscript)|\x00", re.I)
_ATTRIBUTES = r"""(?:\s+[a-zA-Z_:@][^\s=<>"'/]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`/]+))?)*+"""
_PIECE = re.compile(
    rf"""<!--(?P<note>.*?)-->|<!doctype[^>]*>|<(?P<code>script|style)(?P<codeattr>{_ATTRIBUTES})\s*>(?P<inner>.*?)</(?P=code)\s*>"""
    rf"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attr>{_ATTRIBUTES})\s*(?P<self>/?)>""",
    re.I | re.S,
)
_ONE = re.compile(r"""([a-zA-Z_:@][^\s=<>"'/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`/]+)))?""")


def _attributes(source: str) -> dict[str, str]:
    """The first value of each attribute, as written; names in lower case."""
    found: dict[str, str] = {}
    for m in _ONE.finditer(source):
        found.setdefault(m[1].lower(), m[m.lastindex] if m.lastindex > 1 else "")
    return found


def _value(attributes: str, wanted: str) -> str:
    """The first attribute of a name, decoded, '' when missing."""
    value = _attributes(attributes).get(wanted, "")
    return unescape(value) if "&" in value else value


def pieces(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Stretches (start, stop) of rows of about so many bytes of text, one row at least: what is made of a page is let go with its stretch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most_bytes, prepend=-1))
    if len(cuts):
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(texts)], strict=True)


@dataclass
class Reading:
    """What one pass over a page's source finds."""

    title: str | None = None  # decoded text of the first title element
    shared_title: str | None = None  # decoded content of the first og:title meta
    dates: list[str] = field(default_factory=list)  # texts that may hold the date, in order
    text: str | None = None  # main text, white space as found
    items: list[str] = field(default_factory=list)  # JSON-LD texts
    anchors: list[tuple[int, str, str, int | None]] = field(default_factory=list)


def _text_of(bodies: list[list[str] | None], paragraphs: list[list[str]]) -> str | None:
    body = next((b for b in bodies if b is not None), None)
    text = " ".join(body) if body else ""
    if len(text) < MIN_BODY_CHARS:
        text = " ".join(p for own in paragraphs if (p := "".join(own)))
    return text or None


def one_pass(html: str, fields: bool = True) -> Reading | None:
    """Title, dates, main text, embedded items and links of a page of ordinary tags; None for any other.

    The tags are met once, in order and in time linear in the source; no tree is built. An open text
    is told to everything that is open around it and not hidden from it. Without ``fields`` only links and items are
    read; main text and metas stay empty.
    """
    lowered = html.lower()
    open_ends = [(lowered.rfind(a), lowered.rfind(b)) for a, b in (("<!--", "-->"), ("<script", "</script"), ("<style", "</style"))]
    if any(a > b for a, b in open_ends) or _ODD.search(html):
        return None
    out = Reading()
    stack: list[tuple[str, int | None]] = []  # tag, best rank of a listing container down to it
    open_tags: dict[str, int] = {}
    hidden: list[int] = []  # places in the stack of elements whose text does not count for a link
    dropped: list[int] = []  # and for the main text
    links: list[list] = []  # position, href, texts, rank, place in the stack
    live: list[list] = []
    bodies: list[list[str] | None] = [None] * 4  # texts of the first article, div by class, div by id, main
    paragraphs: list[list[str]] = []
    reading: list[tuple[int, list[str]]] = []  # places and texts of the open ones of both
    metas: dict[tuple[str, str], str] = {}
    time_texts: list[str] | None = None  # data of the first time element, None while there was none
    date_shown, time_content, in_time, in_title = "", "", False, False
    title: list[str] | None = None
    at, data = 0, ""

    def flush() -> None:
        nonlocal data
        if data:
            if in_time:
                time_texts.append(data)
            if in_title:
                title.append(data)
            if (live or reading) and (text := decode(data).strip()):
                last = hidden[-1] if hidden else -1
                for link in live:
                    if link[4] >= last:
                        link[2].append(text)
                last = max(last, dropped[-1] if dropped else -1)
                for place, texts in reading:
                    if place >= last:
                        texts.append(text)
            data = ""

    for m in _PIECE.finditer(html):
        between = html[at : m.start()]
        if "<" in between:
            return None  # something that looks like a tag but is not one of these
        data += between
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["code"]:
                flush()
                if m["code"].lower() == "script" and m["inner"] and _attributes(m["codeattr"]).get("type") == JSONLD_TYPE:
                    out.items.append(m["inner"])
            elif m["note"] is not None:  # a declaration does not part a text
                flush()
            continue
        tag = tag.lower()
        if m["end"]:
            if m["attr"] or m["self"]:
                return None
            if tag == "time" and in_time:
                flush()
                in_time, date_shown = False, time_content or "".join(time_texts)  # one that never ends has no date
            elif tag == "title" and in_title:
                flush()
                in_title, out.title = False, "".join(title)
            if open_tags.get(tag):
                flush()
                while True:
                    name = stack.pop()[0]
                    open_tags[name] -= 1
                    if name == tag:
                        break
                depth = len(stack)
                live = [x for x in live if x[4] < depth]
                reading = [x for x in reading if x[0] < depth]
                while hidden and hidden[-1] >= depth:
                    hidden.pop()
                while dropped and dropped[-1] >= depth:
                    dropped.pop()
            continue
        flush()
        rank = stack[-1][1] if stack else None
        attr = m["attr"]
        place = len(stack)
        if tag == "a":
            href = _value(attr, "href") if attr else ""
            if href:
                links.append([len(links), href, [], rank, place])
                live.append(links[-1])
        elif tag == "meta" and attr and fields:
            values = _attributes(attr)
            for key in ("property", "name", "itemprop"):
                if key in values:
                    metas.setdefault((key, values[key]), values.get("content", ""))
        elif tag == "time" and time_texts is None and not m["self"]:
            time_texts, in_time = [], True
            time_content = _attributes(attr).get("content", "") if attr else ""
        elif tag == "title" and title is None and not m["self"]:
            title, in_title = [], True
        if tag in VOID:
            continue
        own = [] if rank is None else [rank]
        if tag == "article":
            own.append(0)
        lowered = attr.lower() if attr else ""
        if "class" in lowered:
            names = _value(attr, "class").split()
            own += [i for i, name in enumerate(LISTING_CLASSES, 1) if name in names]
        if fields and not dropped and tag in ("article", "div", "main", "p"):
            kinds = []
            if tag == "article":
                kinds = [0]
            elif tag == "main":
                kinds = [3]
            elif tag == "div":
                kinds = [k for k, name in ((1, "class"), (2, "id")) if name in lowered and BODY_NAME.search(_value(attr, name))]
            for k in kinds:
                if bodies[k] is None:
                    bodies[k] = []
                    if not m["self"]:
                        reading.append((place, bodies[k]))
            if tag == "p":
                paragraphs.append([])
                if not m["self"]:
                    reading.append((place, paragraphs[-1]))
        if m["self"]:
            live = [x for x in live if x[4] < len(stack)] if tag == "a" else live
            continue
        stack.append((tag, min(own, default=None)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in HIDDEN:
            hidden.append(place)
        if tag in DROPPED_TAGS:
            dropped.append(place)
    if "<" in html[at:]:
        return None
    data += html[at:]
    flush()
    out.title = None if out.title is None else decode(out.title)
    shared = metas.get(("property", "og:title"), "")
    out.shared_title = unescape(shared) if "&" in shared else shared
    out.dates = [metas.get(key, "") for key in DATE_METAS] + [date_shown]
    out.text = _text_of(bodies, paragraphs)
    out.anchors = [(n, href, " ".join(texts), rank) for n, href, texts, rank, _ in links]
    return out


def anchors(html: str) -> list[tuple[int, str, str, int | None]]:
    """(position, href, text, rank of the best enclosing listing container) of all links (H4).

    Rank 0 is an article element, 1 to 8 a listing class, None no container.
    """
    found = one_pass(html)
    return tree_anchors(html) if found is None else found.anchors


def tree_anchors(html: str) -> list[tuple[int, str, str, int | None]]:
    """``anchors`` by the element tree."""
    found = []
    for position, node in enumerate(n for n in Page(html).elements if n.tag == "a" and n.attrs.get("href")):
        rank = None
        for above in node.ancestors():
            names = above.attrs.get("class", "").split()
            hits = [0] if above.tag == "article" else []
            hits += [i for i, name in enumerate(LISTING_CLASSES, 1) if name in names]
            rank = min([*hits, *([] if rank is None else [rank])], default=None)
        found.append((position, node.attrs["href"], " ".join(node.strings()), rank))
    return found
