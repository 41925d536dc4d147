"""Books from files: the catalog of a folder, and EPUB and DOCX packages as content items.

Files are read by Spark, so any store that it opens will do; a package is unzipped in memory, one book at a time. A
book that can't be read is a row with an error. PDF pages come from a decoder that the caller gives (none is bundled).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.layout import FOOTNOTE_MARK
from leafmill.sources import markup

FORMATS = ("pdf", "epub", "docx")
#: Folders of tools, whose files are nobody's books.
TOOL_FOLDERS = [".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".obsidian"]
#: Labels of the divisions of manuscripts.
DOCX_FRONT = ["cover", "title", "titlepage", "title page", "copyright", "dedication", "preface", "foreword", "prologue", "halftitle", "frontmatter", "contents", "table of contents", "toc"]
DOCX_BACK = ["epilogue", "afterword", "appendix", "appendices", "bibliography", "references", "glossary", "index", "colophon", "acknowledgments", "acknowledgements", "about the author", "backmatter"]


class EncryptedError(ValueError):
    """A reader's: the file can't be opened without a password."""


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """Files of books: none that is hidden or temporary, or in a folder that is hidden or a tool's, below `folder`."""
    return of_books(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder), folder, recursive)


def of_books(files: DataFrame, folder: str, recursive: bool) -> DataFrame:
    """files (path and more) that are books, with filename and format."""
    name, depth = _name(F.col("path")), len([x for x in re.sub(r"^[a-z0-9]+:/+", "", folder).split("/") if x])
    parts = F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", ""), "/"), lambda x: x != "")
    inner = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth - 1, F.lit(0)))
    hidden = F.exists(inner, lambda x: x.startswith(".") | x.isin(TOOL_FOLDERS)) if recursive else F.lit(False)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.withColumn("filename", name).withColumn("format", kind).filter(kind.isin(*FORMATS) & ~name.rlike(r"^(\.|~\$)") & ~hidden)


def catalog(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, filename, stem, format, size_bytes, size: books of a folder by name. Contents are not read."""
    shown = _files(spark, folder, recursive).select("path", "filename", F.regexp_replace("filename", r"\.[^.]+$", "").alias("stem"), "format", F.col("length").alias("size_bytes"))
    return shown.withColumn("size", T.file_size(F.col("size_bytes"))).orderBy(F.lower("filename"), "path")


def total_size(found: DataFrame) -> DataFrame:
    """n_books, total_bytes, total of a catalog."""
    sums = found.agg(F.count("*").alias("n_books"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    return sums.withColumn("total", T.file_size(F.col("total_bytes")))


def as_json(found: DataFrame) -> DataFrame:
    """json: each row of a catalog as one object."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("json"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if _local(e.tag) == name)


def _texts(root: ET.Element, name: str) -> list[str]:
    return ["".join(e.itertext()).strip() for e in _all(root, name)]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if _local(k) == name), "")


def _package(z: zipfile.ZipFile) -> tuple[ET.Element, str]:
    container = ET.fromstring(z.read("META-INF/container.xml"))
    path = next(e.attrib["full-path"] for e in _all(container, "rootfile"))
    return ET.fromstring(z.read(path)), path.rpartition("/")[0]


def epub_sniff(data: bytes) -> tuple[str, str]:
    """Title and author of the package alone."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf, _ = _package(z)
        return (_texts(opf, "title") or [""])[0], (_texts(opf, "creator") or [""])[0]


def docx_sniff(data: bytes) -> tuple[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ET.Element("none")
        return (_texts(core, "title") or [""])[0], (_texts(core, "creator") or [""])[0]


SNIFFERS: dict[str, Callable[[bytes], tuple[str, str]]] = {"epub": epub_sniff, "docx": docx_sniff}


def sniffed(spark: SparkSession, folder: str, recursive: bool = False, sniffers: dict[str, Callable] | None = None) -> DataFrame:
    """path, format, title, author of each book without reading more than its package's data; other formats, and books
    that can't be read, have the file's name and Unknown. sniffers adds formats, such as PDF with a decoder."""
    known = SNIFFERS | (sniffers or {})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kind, data in zip(batch["format"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    found.append(known[kind](data))
                except Exception:  # the name does
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["format"], pa.array([t for t, _ in found], pa.string()), pa.array([a for _, a in found], pa.string())], names=["path", "format", "raw", "by"])

    rows = _files(spark, folder, recursive).select("path", "format", "content").mapInArrow(task, "path string, format string, raw string, by string")
    stem = F.regexp_replace(_name(F.col("path")), r"\.[^.]+$", "")
    return rows.select("path", "format", T.clean_title(F.col("raw"), stem).alias("title"), F.coalesce(F.nullif(T.stripped(F.col("by")), F.lit("")), F.lit("Unknown")).alias("author"))


def _bookmark(level: int, title: str, at: int) -> dict:
    return {"row": "bookmark", "section_level": level, "section_title": title, "page": at}


def _epub_bookmarks(z: zipfile.ZipFile, opf: ET.Element, base: str) -> list[dict]:
    """Entries of the table of contents, nested ones one level down, counted through."""
    join = lambda href: f"{base}/{href}" if base else href
    out: list[dict] = []
    ncx = next((e for e in _all(opf, "item") if _attr(e, "media-type") == "application/x-dtbncx+xml"), None)
    nav = next((e for e in _all(opf, "item") if "nav" in _attr(e, "properties").split()), None)

    def entries(top: list, label: Callable, below: Callable) -> None:
        """What label says of each entry, with those below it next, one level down."""
        waiting = [(e, 1) for e in reversed(top)]
        while waiting:
            e, level = waiting.pop()
            if (told := label(e)) is not None:
                out.append(_bookmark(level, told, len(out) + 1))
            waiting += [(x, level + 1) for x in reversed(below(e))]

    def point_label(p: ET.Element) -> str:
        return "".join(next((c for c in p if _local(c.tag) == "navLabel"), ET.Element("none")).itertext()).strip()

    def tags(node: markup.Tag, *names: str) -> list[markup.Tag]:
        return [c for c in node.children if isinstance(c, markup.Tag) and c.name in names]

    def link_label(li: markup.Tag) -> str | None:
        return next((markup.squeezed(c.text()) for c in tags(li, "a", "span")), None)

    points = lambda parent: [c for c in parent if _local(c.tag) == "navPoint"]
    links = lambda node: [x for inner in tags(node, "ol") for x in tags(inner, "li")]
    if ncx is not None and join(_attr(ncx, "href")) in z.namelist():
        for m in _all(ET.fromstring(z.read(join(_attr(ncx, "href")))), "navMap"):
            entries(points(m), point_label, points)
    elif nav is not None and join(_attr(nav, "href")) in z.namelist():
        root = markup.tree(z.read(join(_attr(nav, "href"))).decode("utf-8", "replace"))
        toc = next((t for t in root.all("nav") if "toc" in t.get("epub:type").split()), root.first("nav"))
        if toc and toc.first("ol"):
            entries(tags(toc.first("ol"), "li"), link_label, links)
    return out


def _is_isbn(x: str) -> bool:
    """Ten places of digits, the last of which may be X, or thirteen that begin with 978 or 979."""
    return (len(x) == 10 or (len(x) == 13 and x[:3] in ("978", "979"))) and x[:-1].isdigit() and (x[-1].isdigit() or x[-1] == "X")


def _epub_meta(opf: ET.Element) -> dict[str, str]:
    """Names of Dublin Core; the year of the date, the number of the book, and what else is said."""
    first = lambda name: next((x for x in _texts(opf, name) if x), None)
    ids = _texts(opf, "identifier")
    isbn = next((x for x in ids if "isbn" in x.lower() or _is_isbn(x)), ids[0] if ids else None)
    year = re.search(r"\b(\d{4})\b", first("date") or "")
    out = {"isbn": isbn, "publisher": first("publisher"), "year": year[1] if year else None, "language": first("language"), "description": first("description")}
    return {k: v for k, v in out.items() if v}


def _score(numbered: int, bookmarks: list[dict], code: int, many_code: int, tables: int, maths: int | None) -> str:
    """technical with three points or more, else literature."""
    step = lambda n, many, high: high if n >= many else int(n > 0)
    points = step(numbered, 2, 3) + 3 * any(markup.NUMBERED.match(b["section_title"]) for b in bookmarks) + step(code, many_code, 3) + step(tables, 2, 2) + (step(maths, 2, 3) if maths is not None else 0)
    return "technical" if points >= 3 else "literature"


class _Book:
    """Rows of a book: items of front matter, chapters and back matter, and their notes."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.front: list[dict] = []
        self.back: list[dict] = []
        self.chapters: list[dict] = []
        self.kinds: list[str] = []

    def chapter(self, title: str, sections: list[dict], notes: list[tuple[str, str]]) -> None:
        self.chapters.append({"title": title, "sections": sections, "notes": notes})

    def all_rows(self) -> list[dict]:
        out = []
        for division, parts in (("front", [(0, self.front)]), ("body", [(i, c["sections"]) for i, c in enumerate(self.chapters, 1)]), ("back", [(0, self.back)])):
            for part, sections in parts:
                for s, section in enumerate(sections):
                    base = {"row": "item", "division": division, "part": part, "section": s, "section_title": section["title"], "section_level": section["level"]}
                    pages = {} if division != "body" else {"page": part}
                    out += [{**base, "item": i, **({} if x["kind"] == "image" else pages or {"page": section.get("page", 1)}), **x} for i, x in enumerate(section["items"])] or [{**base, "item": 0}]
        for number, c in enumerate(self.chapters, 1):
            out.append({"row": "chapter", "part": number, "section_title": c["title"]})
            out += [{"row": "note", "part": number, "page": number, "item": i, "label": m, "text": t} for i, (m, t) in enumerate(c["notes"])]
        return out


def epub_book(data: bytes, stem: str, profile: str = "auto", pictures: bool = True) -> list[dict]:
    """Rows (book, chapter, item, note, bookmark, image) of an EPUB package; without pictures, no images are unpacked."""
    book = _Book()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf, base = _package(z)
        join = lambda href: f"{base}/{href}" if base else href
        items = {e.attrib["id"]: e for e in _all(opf, "item")}
        shown = [_attr(e, "href") for e in items.values() if _attr(e, "media-type").startswith("image/") and join(unquote(_attr(e, "href"))) in z.namelist()]
        names: dict[str, str] = {}
        for href in shown:
            for alias in (href, href.rsplit("/", 1)[-1], unquote(href), unquote(href.rsplit("/", 1)[-1])):
                names[alias] = unquote(href).rsplit("/", 1)[-1]
        bookmarks = _epub_bookmarks(z, opf, base)
        is_text = lambda e: "html" in _attr(e, "media-type") or _attr(e, "href").rsplit(".", 1)[-1].lower() in ("html", "xhtml", "htm")
        texts = [e for e in items.values() if is_text(e)]

        def is_nav(e: ET.Element) -> bool:
            name = _attr(e, "href").lower()
            return "nav" in _attr(e, "properties").split() or ("nav" in name and ("toc" in name or name.endswith("nav.xhtml")))

        spine = [items[i] for i in (_attr(e, "idref") for e in _all(opf, "itemref")) if i in items and is_text(items[i]) and not is_nav(items[i])] or texts
        docs = [(_attr(e, "href"), markup.tree(z.read(join(unquote(_attr(e, "href")))).decode("utf-8", "replace"))) for e in spine]
        definitions: dict[str, str] = {}
        clean = []
        for name, root in docs:
            root, told = markup.note_definitions(root)
            definitions |= told
            clean.append((name, root))
        waiting: list[tuple[str, str]] = []
        seen_body, numbered, page = False, 0, 1
        for name, root in clean:
            if any("x-ebookmaker-wrapper" in t.classes.split() for t in root.all()):
                continue
            head = root.first("title")
            title = markup.document_title(root, name, head.text() if head else None)
            division = markup.division(root, name, title)
            division = "body" if seen_body and division == "front" else division  # front matter can't follow the body
            seen_body |= division == "body"
            sections, notes, n = markup.sections(root, title, names, definitions)
            numbered += n
            if not sections and not notes:
                continue
            if division == "body":
                book.chapter(title or f"Chapter {len(book.chapters) + 1}", sections, waiting + notes)
                waiting, page = [], page + 1
                continue
            for s in sections:
                s["title"], s["page"] = s["title"] or title, page
            (book.front if division == "front" else book.back).extend(sections)
            if division == "front":
                waiting += notes
            elif book.chapters:
                book.chapters[-1]["notes"] += notes
        if not book.chapters and book.front:
            for i, s in enumerate(book.front, 1):
                book.chapter(s["title"] or f"Section {i}", [s], [])
            book.front = []
        every = [x["kind"] for c in [book.front, book.back, *(c["sections"] for c in book.chapters)] for s in c for x in s["items"]]
        found = _score(numbered, bookmarks, every.count("code"), 3, every.count("table"), every.count("math"))
        title, author = (_texts(opf, "title") or [""])[0] or stem, (_texts(opf, "creator") or [""])[0] or "Unknown"
        meta = {"title": title, "author": author, "profile": found if profile == "auto" else profile} | _epub_meta(opf)
        images = [{"row": "image", "image": unquote(h).rsplit("/", 1)[-1], "content": z.read(join(unquote(h)))} for h in shown if pictures]
    return [{"row": "book", "meta": list(meta.items())}, *book.all_rows(), *bookmarks, *images]


def docx_division(title: str) -> str:
    title = title.lower().strip()
    is_one = lambda names: any(title == x or title.startswith(x + " ") for x in names)
    return "front" if is_one(DOCX_FRONT) else "back" if is_one(DOCX_BACK) else "body"


def _run(run: ET.Element) -> tuple[str, bool]:
    """Markdown of a run, and whether its font has one width."""
    props = next((c for c in run if _local(c.tag) == "rPr"), ET.Element("none"))
    on = {_local(c.tag): _attr(c, "val") for c in props}
    active = lambda name: name in on and on[name] not in ("0", "false", "none")
    text = "".join({"t": c.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(c.tag), "") for c in run)
    font = next((_attr(c, "ascii") for c in props if _local(c.tag) == "rFonts"), "")
    mono = bool(font) and any(x in re.sub("[^a-z]", "", font.lower()) for x in T.MONOSPACE)
    marks = (("`", mono), ("**", active("b")), ("*", active("i")), ("~~", active("strike")), ("^", on.get("vertAlign") == "superscript"), ("~", on.get("vertAlign") == "subscript"))
    for mark, use in marks:
        text = f"{mark}{text}{mark}" if use and text else text
    return text, mono


def _plain(e: ET.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(x.tag), "") for x in e.iter())


def docx_book(data: bytes, stem: str, profile: str = "auto", pictures: bool = True) -> list[dict]:
    """Rows (book, chapter, item, note, bookmark, image) of a DOCX package: first-level headings begin chapters; without
    pictures, no images are unpacked."""
    book, bookmarks = _Book(), []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        read = lambda name: ET.fromstring(z.read(name)) if name in there else ET.Element("none")
        targets = {_attr(r, "Id"): _attr(r, "Target") for r in _all(read("word/_rels/document.xml.rels"), "Relationship")}
        media = {x.rsplit("/", 1)[-1] for x in there if x.startswith("word/media/")}
        styles = {_attr(s, "styleId"): next((_attr(c, "val") for c in s if _local(c.tag) == "name"), "") for s in _all(read("word/styles.xml"), "style")}
        notes = {}
        for f in _all(read("word/footnotes.xml"), "footnote"):
            if _attr(f, "id") and _attr(f, "type") not in ("separator", "continuationSeparator"):
                whole = "".join(f.itertext()).strip()
                notes[_attr(f, "id")] = markup.NOTE_MARK.sub("", whole).strip() or whole
        core = read("docProps/core.xml")
        title, sections, now = None, [], {"title": None, "level": 2, "items": []}
        division, told, numbered, code, tables, page = "body", {}, 0, 0, 0, 1

        def section_done() -> None:
            nonlocal now
            if now["items"] or now["title"]:
                sections.append(now)

        def chapter_done() -> None:
            nonlocal title, sections, now, told, page
            section_done()
            if sections or title or told:
                if division == "body":
                    book.chapter(title or f"Chapter {len(book.chapters) + 1}", sections, list(told.items()))
                    page += 1
                else:
                    for s in sections:
                        s["title"], s["page"] = s["title"] or title or f"{division.capitalize()} Matter", page
                    (book.front if division == "front" else book.back).extend(sections)
                title, sections, told = None, [], {}
            now = {"title": None, "level": 2, "items": []}

        def paragraph(p: ET.Element, style: str) -> None:
            nonlocal code
            for blip in _all(p, "blip"):
                target = targets.get(_attr(blip, "embed"), "")
                if target.rsplit("/", 1)[-1] in media and target:
                    name = target.rsplit("/", 1)[-1]
                    now["items"].append({"kind": "image", "image": name, "label": name.rsplit(".", 1)[0]})
            parts, all_mono, runs = [], True, 0
            for c in p:
                if _local(c.tag) == "hyperlink":
                    inner, url = "".join(_run(r)[0] for r in _all(c, "r")), targets.get(_attr(c, "id"))
                    parts.append(f"[{inner}]({url})" if url else inner)
                    runs, all_mono = runs + 1, False
                elif _local(c.tag) == "r":
                    text, mono = _run(c)
                    parts.append(text)
                    runs, all_mono = runs + 1, all_mono and mono
            refs = [_attr(x, "id") for x in _all(p, "footnoteReference") if _attr(x, "id") in notes]
            parts += [f"{FOOTNOTE_MARK}{x}{FOOTNOTE_MARK}" for x in refs]
            told.update({x: notes[x] for x in refs if x not in told})
            text = "".join(parts).strip()
            if not text:
                return
            if "quote" in style:
                item = {"kind": "quote", "lines": [text], "italic": True}
            elif "list" in style or style.startswith("bullet"):
                ordered = "number" in style
                item = {"kind": "list", "points": [{"text": text, "level": 0, "ordered": ordered, "marker": "1" if ordered else None}]}
            elif "code" in style or "preformatted" in style or (runs and all_mono):
                code += 1
                item = {"kind": "code", "lines": _plain(p).splitlines() or [_plain(p)]}
            else:
                item = {"kind": "paragraph", "text": text}
            now["items"].append(item)

        body = next(_all(read("word/document.xml"), "body"), ET.Element("none"))
        for e in body:
            if _local(e.tag) == "tbl":
                tables += 1
                rows = [[_cell(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
                merged = any(True for name in ("gridSpan", "vMerge") for _ in _all(e, name))
                if any(rows):
                    now["items"].append({"kind": "table", "cells": [r for r in rows if r], "complex": merged})
            elif _local(e.tag) == "p":
                key = next((_attr(s, "val") for s in _all(e, "pStyle")), "")
                style = (styles.get(key) or re.sub(r"(?<=[a-z])(?=[0-9])", " ", key)).lower().strip()
                level, text = re.fullmatch(r"heading (\d+)", style), _plain(e).strip()
                if level:
                    numbered += bool(markup.NUMBERED.match(text))
                    if level[1] == "1":
                        chapter_done()
                        title, division = text, docx_division(text)
                    else:
                        section_done()
                        now = {"title": text, "level": int(level[1]), "items": []}
                    bookmarks.append(_bookmark(int(level[1]), text, page))
                else:
                    paragraph(e, style)
        chapter_done()
        for name in ("front", "back"):  # a manuscript without chapters
            if not book.chapters and getattr(book, name):
                for i, s in enumerate(getattr(book, name), 1):
                    book.chapter(s["title"] or f"Chapter {i}", [s], [])
                setattr(book, name, [])
        found = _score(numbered, bookmarks, code, 2, tables, None)
        created = re.match(r"\d{4}", (_texts(core, "created") or [""])[0])
        meta = {"title": (_texts(core, "title") or [""])[0] or stem, "author": (_texts(core, "creator") or [""])[0] or "Unknown", "profile": found if profile == "auto" else profile}
        meta |= {k: v for k, v in {"comments": (_texts(core, "description") or [""])[0], "year": created[0] if created else ""}.items() if v}
        images = [{"row": "image", "image": x.rsplit("/", 1)[-1], "content": z.read(x)} for x in sorted(there) if pictures and x.startswith("word/media/")]
    return [{"row": "book", "meta": list(meta.items())}, *book.all_rows(), *bookmarks, *images]


def _cell(cell: ET.Element) -> str:
    return "\n".join(_plain(p) for p in cell if _local(p.tag) == "p").strip().replace("\n", " ")


READERS: dict[str, Callable[[bytes, str, str], list[dict]]] = {"epub": epub_book, "docx": docx_book}
_POINT = pa.struct([("text", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("marker", pa.string())])
_ENTRY = pa.struct([("term", pa.string()), ("definition", pa.string())])
ROWS = pa.schema(
    [("path", pa.string()), ("format", pa.string()), ("row", pa.string()), ("error", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("division", pa.string()), *((x, pa.int32()) for x in ("part", "section", "item")), ("section_title", pa.string()), ("section_level", pa.int32()), ("page", pa.int32()), ("kind", pa.string()), ("text", pa.string())]
    + [("lines", pa.list_(pa.string())), *((x, pa.string()) for x in ("label", "attribution", "numbering")), *((x, pa.bool_()) for x in ("italic", "display", "quoted")), ("entries", pa.list_(_ENTRY)), ("points", pa.list_(_POINT)), ("cells", pa.list_(pa.list_(pa.string()))), ("complex", pa.bool_()), ("image", pa.string()), ("caption", pa.string()), ("content", pa.binary())]
)
ROWS_DDL = "path string, format string, row string, error string, meta map<string, string>, division string, part int, section int, item int, section_title string, section_level int, page int, kind string, text string, lines array<string>, label string, attribution string, numbering string, italic boolean, display boolean, quoted boolean, entries array<struct<term: string, definition: string>>, points array<struct<text: string, level: int, ordered: boolean, marker: string>>, cells array<array<string>>, complex boolean, image string, caption string, content binary"


def file_rows(path: str, kind: str, data: bytes, known: dict[str, Callable], profile: str = "auto", pictures: bool = True) -> list[dict]:
    """Rows of one file, or one row with an error."""
    stem = re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])
    try:
        if kind not in known:
            return [{"row": "error", "error": f"unsupported: {kind}"}]
        more = {} if pictures or READERS.get(kind) is not known[kind] else {"pictures": False}
        return known[kind](data, stem, profile, **more)
    except Exception as e:  # one bad file doesn't fail the others
        return [{"row": "error", "error": f"{'encrypted' if isinstance(e, EncryptedError) else 'corrupt'}: {type(e).__name__}: {e}"}]


def book_rows(files: DataFrame, readers: dict[str, Callable[[bytes, str, str], list[dict]]] | None = None, profile: str = "auto") -> DataFrame:
    """Rows of files (path, format, content), each of which is parsed once a run of the plan; see read_books."""
    known = READERS | (readers or {})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time is a Python object
                path, kind, data = (batch[c][i].as_py() for c in ("path", "format", "content"))
                yield pa.RecordBatch.from_pylist([{"path": path, "format": kind, **r} for r in file_rows(path, kind, data, known, profile)], schema=ROWS)

    return files.select("path", "format", "content").mapInArrow(task, ROWS_DDL)


def read_books(spark: SparkSession, folder: str, readers: dict[str, Callable[[bytes, str, str], list[dict]]] | None = None, recursive: bool = False, profile: str = "auto") -> DataFrame:
    """Rows of the books of a folder: book, chapter, item, note, bookmark and image rows, or one row with an error.

    error is encrypted, corrupt or unsupported, and what was said; the other books are read all the same. readers adds
    formats: a function of the file's bytes, its stem and the profile (auto, literature or technical) that returns rows.
    A task holds the files of its partition, which the scan packs up to spark.sql.files.maxPartitionBytes. Who reads the
    rows several times saves them first (see convert.staged), or the files are parsed as often.
    """
    return book_rows(_files(spark, folder, recursive), readers, profile)
