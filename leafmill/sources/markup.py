"""Documents of EPUB packages as sections of content items: a small tree of tags, and the rules over it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

from leafmill.operators.layout import FOOTNOTE_MARK

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HEADINGS = {f"h{i}" for i in range(1, 7)}
CLOSES |= {x: {"p"} for x in (*HEADINGS, "address", "article", "aside", "blockquote", "dl", "div", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")}
BLOCKS = {"p", "blockquote", "ul", "ol", "table", "pre", "img", "figure", "aside", "math"}
FLOWING = BLOCKS | HEADINGS | {"hgroup"}
#: Classes of boxes, and their labels in the order in which they are looked for.
BOXES, BOX_LABELS = ("callout", "note", "warning", "tip", "important", "caution"), ("warning", "tip", "caution", "important", "info", "note")
#: Arrows that lead back from a note.
ARROWS = {"↩", "↩︎", "^"}
#: Labels of divisions, in file names, titles and types.
FRONT = ["cover", "titlepage", "title page", "title-page", "imprint", "halftitle", "halftitlepage", "half-title", "copyright", "dedication", "preface", "foreword", "prologue", "frontmatter", "prelims", "contents", "table of contents", "toc"]
BODY = ["part", "chapter", "bodymatter", "subchapter"]
BACK = ["epilogue", "afterword", "appendix", "appendices", "bibliography", "references", "glossary", "index", "colophon", "uncopyright", "copyright-page", "endnotes", "endnote", "notes", "acknowledgments", "acknowledgements", "about the author", "backmatter", "endmatter"]
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "strike": "~~", "del": "~~", "sup": "^", "sub": "~"}
NUMBERED = re.compile(r"\s*\d+(?:\.\d+)+\.?\s+\S")
#: What may stand before and behind the text of a note.
NOTE_MARK, NOTE_TAIL = re.compile(r"^(?:\[\d+\]|\d+[.:\s]+|\^|\*)\s*"), re.compile(r"[\s↩︎^]+$")
#: Fixed value: what may call a note.
_NOTE_MARKER = re.compile(r"\[?\d+\]?|[a-zA-Z]{1,3}|\*+|†|‡|§|#")


class Tag:
    """A place in a Page: `at` is its own number in the page's nodes, `end` that of the first node after it."""

    __slots__ = ("page", "name", "attrs", "at", "end", "said", "told", "dense", "inner")

    def __init__(self, page: Page, name: str, attrs: dict[str, str | None]) -> None:
        self.page, self.name, self.attrs = page, name, attrs
        self.at = self.end = len(page.nodes)
        #: Where its text begins and ends in the page's, its characters without white space, and the blocks and headings in it.
        self.said = self.told = page.length
        self.dense, self.inner = page.dense, page.flowing

    def get(self, key: str, default: str = "") -> str:
        return self.attrs.get(key) or default

    @property
    def classes(self) -> str:
        return " ".join(self.get("class").split()).lower()

    @property
    def children(self) -> Iterator[Tag | str]:
        i = self.at + 1
        while i < self.end:
            node = self.page.nodes[i]
            yield node
            i = i + 1 if isinstance(node, str) else node.end

    def text(self) -> str:
        return self.page.text[self.said : self.told]

    def all(self, *names: str) -> Iterator[Tag]:
        nodes = self.page.nodes
        self.page.look(self.end - self.at)
        for i in range(self.at + 1, self.end):
            if not isinstance(nodes[i], str) and (not names or nodes[i].name in names):
                yield nodes[i]

    def first(self, *names: str) -> Tag | None:
        return next(self.all(*names), None)

    def without(self, gone: Callable[[Tag], bool]) -> Tag:
        """A copy, of a page of its own, without the tags of which gone is true."""
        page = Page()
        open_: list[int] = []
        page.start(self.name, self.attrs)
        i = self.at + 1
        while True:
            while open_ and i >= open_[-1]:
                open_.pop()
                page.stop()
            if i >= self.end:
                return page.done()
            node = self.page.nodes[i]
            i += 1
            if isinstance(node, str):
                page.say(node)
            elif gone(node):
                i = node.end
            else:
                page.start(node.name, node.attrs)
                open_.append(node.end)


class Page:
    """A document as the row of its tags and texts in the order in which they begin, however deep they lie in each other.

    Rules over it go along the row, with a stack of their own where they need one, so depth costs no more than length.
    """

    def __init__(self) -> None:
        self.nodes: list[Tag | str] = []
        self.open: list[Tag] = []
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.length = self.dense = self.flowing = self.steps = 0

    def start(self, name: str, attrs: dict[str, str | None]) -> None:
        if name in FLOWING:
            self.flowing += 1
        tag = Tag(self, name, attrs)
        self.nodes.append(tag)
        self.open.append(tag)
        self.names[name] += 1

    def stop(self) -> str:
        tag = self.open.pop()
        self.names[tag.name] -= 1
        tag.end, tag.told, tag.dense, tag.inner = len(self.nodes), self.length, self.dense - tag.dense, self.flowing - tag.inner
        return tag.name

    def say(self, text: str) -> None:
        self.nodes.append(text)
        self.parts.append(text)
        self.length += len(text)
        self.dense += sum(map(len, text.split()))

    def done(self) -> Tag:
        while self.open:
            self.stop()
        self.text = "".join(self.parts)
        return self.nodes[0]

    def look(self, n: int) -> None:
        """Rules may look at each node so many times on average; those that tell what lies in each other could go on."""
        self.steps += n
        if self.steps > 1_000_000 + 50 * len(self.nodes):
            raise ValueError("quotations or tables lie too deep in each other")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.page.start("root", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.page.open[-1].name in CLOSES.get(tag, ()):
            self.page.stop()
        self.page.start(tag, dict(attrs))
        if tag in VOID:
            self.page.stop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.page.start(tag, dict(attrs))
        self.page.stop()

    def handle_endtag(self, tag: str) -> None:
        if self.page.names[tag] and tag != "root":
            while self.page.stop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.page.say(data)


def tree(html: str) -> Tag:
    """The root of a page. A comment that isn't closed goes on to the end."""
    builder = _Builder()
    builder.feed(html)
    if not builder.rawdata.startswith("<!--"):
        builder.close()
    return builder.page.done()


def squeezed(text: str) -> str:
    return " ".join(text.split())


def _is_arrow(tag: Tag) -> bool:
    return tag.dense <= 2 and tag.text().strip() in ARROWS


def _leads_back(tag: Tag) -> bool:
    return "backlink" in tag.get("epub:type") or tag.get("role") == "doc-backlink" or _is_arrow(tag)


def inline(element: Tag) -> tuple[str, list[tuple[str, str]]]:
    """Markdown of what is in an element, and the (marker, id) of the footnotes that it refers to."""
    parts: list[str] = []
    notes: list[tuple[str, str]] = []
    closing: list[tuple[int, str]] = []  # where open tags end, and what is put there
    i = element.at + 1
    while i < element.end or closing:
        if closing and i >= closing[-1][0]:
            parts.append(closing.pop()[1])
            continue
        element.page.look(1)
        child = element.page.nodes[i]
        if isinstance(child, str):
            parts.append(child)
            i += 1
            continue
        i = child.end
        if _leads_back(child):
            continue
        href, kind = child.get("href"), child.get("epub:type")
        refers = "noteref" in kind or "footnote" in kind or any(x in href for x in ("#fn", "#footnote", "#note"))
        marker = child.text().strip("[]^ ") if refers else ""
        if refers and _NOTE_MARKER.fullmatch(marker):
            notes.append((marker, href.rsplit("#", 1)[-1] if "#" in href else marker))
            parts.append(f"{FOOTNOTE_MARK}{marker}{FOOTNOTE_MARK}")
        elif child.name == "code":
            parts.append(f"`{child.text()}`")
        elif child.name == "br":
            parts.append("\n")
        else:
            mark = INLINE.get(child.name, "")
            link = child.name == "a" and href and not href.startswith("#")
            parts.append("[" if link else mark)
            closing.append((child.end, f"]({href})" if link else mark))
            i = child.at + 1
    return re.sub(r"[ \t]+", " ", "".join(parts)), notes


def flow(container: Tag) -> Iterator[tuple[str, Tag | str]]:
    """text, heading, hgroup and block elements in order; what only holds such ones is looked into."""
    i = container.at + 1
    while i < container.end:
        child = container.page.nodes[i]
        if isinstance(child, str):
            i += 1
            if child.strip():
                yield "text", child.strip()
            continue
        i = child.end
        if child.name in HEADINGS:
            yield "heading", child
        elif child.name == "hgroup":
            yield "hgroup", child
        elif child.name in BLOCKS or any(x in child.classes for x in (*BOXES, "highlight")):
            yield "block", child
        elif child.inner:
            i = child.at + 1
        else:
            yield "block", child


def _image(tag: Tag, images: dict[str, str]) -> dict | None:
    """images: names of files by path, by name, and by both without percent signs."""
    src = tag.get("src")
    clean = unquote(src).split("#")[0].split("?")[0]
    name = images.get(clean) or images.get(clean.rsplit("/", 1)[-1]) or images.get(src)
    if not src or not name:
        return None
    base = clean.rsplit("/", 1)[-1]
    return {"kind": "image", "image": name, "caption": tag.get("alt").strip() or None, "label": base.rsplit(".", 1)[0] if "." in base else base}


def block(tag: Tag, images: dict[str, str]) -> tuple[dict | None, list[tuple[str, str]]]:
    """The item that a block is, and the footnotes that it refers to."""
    notes: list[tuple[str, str]] = []

    def told(element: Tag) -> str:
        text, more = inline(element)
        notes.extend(more)
        return text.strip()

    if tag.name == "p":
        text = told(tag)
        return ({"kind": "paragraph", "text": text} if text else None), notes
    if tag.name == "blockquote":
        lines, by = [], None
        for child in tag.all("p", "div"):
            if "attribution" in child.classes or "author" in child.classes:
                by = child.text().strip()
            elif text := told(child):
                lines.append(text)
        cite = tag.first("cite")
        by = by or (cite.text().strip() if cite else None)
        lines = lines or [x.strip() for x in told(tag).splitlines() if x.strip()]
        return ({"kind": "quote", "lines": lines, "attribution": by, "italic": True} if lines else None), notes
    if tag.name in ("ul", "ol"):
        ordered = tag.name == "ol"
        rows = [c for c in tag.children if isinstance(c, Tag) and c.name == "li"]
        points = [{"text": told(li), "level": 0, "ordered": ordered, "marker": str(i) if ordered else None} for i, li in enumerate(rows, 1)]
        return ({"kind": "list", "points": points} if points else None), notes
    if tag.name == "table":
        cells = [[told(c).replace("\n", " ") for c in tr.all("th", "td")] for tr in tag.all("tr")]
        spans = any(c.get(x, "1").strip() not in ("", "0", "1") for c in tag.all("th", "td") for x in ("colspan", "rowspan"))
        cells = [r for r in cells if r]
        return ({"kind": "table", "cells": cells, "complex": spans} if cells else None), notes
    if tag.name == "pre" or (tag.name == "div" and "highlight" in tag.classes.split()):
        return {"kind": "code", "lines": (tag.first("code") or tag).text().splitlines()}, notes
    if tag.name == "img":
        return _image(tag, images), notes
    if tag.name == "figure" and (img := tag.first("img")):
        made, caption = _image(img, images), tag.first("figcaption")
        if made and caption:
            made["caption"] = caption.text().strip()
        return made, notes
    if tag.name == "aside" or any(x in tag.classes for x in BOXES):
        label = next((x for x in BOX_LABELS if x in tag.classes), "note").capitalize()
        lines = [x for x in map(told, tag.all("p")) if x] or [x for x in [told(tag)] if x]
        if lines:
            return {"kind": "callout", "label": label, "lines": lines}, notes
    if tag.name == "math" or "math" in tag.classes:
        return {"kind": "math", "text": tag.text().strip(), "display": tag.get("display") == "block" or "display" in tag.classes}, notes
    if not any(isinstance(c, Tag) for c in tag.children) and (text := told(tag)):
        return {"kind": "paragraph", "text": text}, notes
    return None, notes


def note_definitions(root: Tag) -> tuple[Tag, dict[str, str]]:
    """The tree without the definitions of notes, and their texts by id."""

    def defines(tag: Tag) -> bool:
        if tag.name not in ("aside", "div", "li", "p") or not tag.get("id"):
            return False
        named = any(x in y for x in ("footnote", "endnote") for y in (tag.get("epub:type"), tag.classes))
        return named or (tag.name in ("aside", "li") and tag.get("id").startswith(("fn", "note-", "footnote-")))

    texts = {}
    for tag in root.all():
        if defines(tag) and tag.get("id") not in texts:
            whole = tag.without(lambda t: (t.name in ("a", "span") and "backlink" == t.get("epub:type")) or (t.name == "a" and (t.get("role") == "doc-backlink" or _is_arrow(t)))).text().strip()
            texts[tag.get("id")] = NOTE_TAIL.sub("", NOTE_MARK.sub("", whole).strip()).strip() or whole
    return root.without(defines), texts


def document_title(root: Tag, name: str, item_title: str | None) -> str:
    """From a group of headings, the first of them, the file's being a cover, its title in the package, or its name."""

    def clean(tag: Tag) -> str:
        refers = lambda t: (t.name in ("a", "sup", "span") and any(x in t.get("epub:type") for x in ("noteref", "footnote"))) or (t.name == "a" and t.get("role") == "doc-noteref")
        return squeezed(tag.without(refers).text())

    group = root.first("hgroup")
    parts = list(dict.fromkeys(x for x in map(clean, group.all(*HEADINGS, "p", "span")) if x)) if group else []
    if parts:
        return ": ".join(parts)
    head = root.first("h1", "h2", "h3")
    if head and clean(head):
        return clean(head)
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if is_cover(root, stem):
        return "Cover"
    return squeezed(item_title or "") or squeezed(re.sub(r"[-_]", " ", stem).strip().title())


def is_cover(root: Tag, stem: str) -> bool:
    return stem.lower() in ("wrap0000", "cover") or any("x-ebookmaker-cover" in t.classes.split() for t in root.all())


def division(root: Tag, name: str, title: str) -> str:
    """front, body or back: by the types of the body and its first container, else by title and file name."""
    stem, title = name.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower(), title.lower().strip()
    if is_cover(root, stem):
        return "front"
    body = root.first("body")
    inner = body.first("section", "div") if body else None
    types = {x for t in (body, inner) if t for x in t.get("epub:type").lower().split()}
    for label, names in (("body", BODY), ("front", FRONT), ("back", BACK)):
        if types & set(names):
            return label
    for label, names in (("front", FRONT), ("back", BACK)):
        if any(title == x or title.startswith(x + " ") or stem == x or stem.startswith((x + "-", x + "_")) for x in names):
            return label
    return "body"


def sections(root: Tag, title: str, images: dict[str, str], texts: dict[str, str]) -> tuple[list[dict], list[tuple[str, str]], int]:
    """title, level and items of each section; marker and text of the footnotes, once each; how many headings have dotted numbers."""
    out, notes, numbered = [], {}, 0
    now = {"title": None, "level": 2, "items": []}

    def begin(heading: str, level: int) -> None:
        nonlocal now
        if now["items"] or now["title"]:
            out.append(now)
        now = {"title": heading, "level": level, "items": []}

    for kind, element in flow(root.first("body") or root):
        if kind == "text":
            now["items"].append({"kind": "paragraph", "text": element})
        elif kind == "hgroup":
            heading = ": ".join(x for x in (t.text().strip() for t in element.all(*HEADINGS, "p", "span")) if x) or element.text().strip()
            if heading and heading.lower() != title.lower():
                begin(heading, 2)
        elif kind == "heading":
            heading, level = element.text().strip(), int(element.name[1])
            numbered += bool(heading and NUMBERED.match(heading))
            if heading and not (level == 1 and title and heading.lower() == title.lower()):
                begin(heading, level)
        else:
            made, refs = block(element, images)
            if made:
                now["items"].append(made)
            for marker, at in refs:
                notes.setdefault(marker, texts.get(at) or texts.get(marker) or f"Footnote {marker}")
    if now["items"] or now["title"]:
        out.append(now)
    return out, list(notes.items()), numbered
