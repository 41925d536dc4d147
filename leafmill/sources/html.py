"""Web pages as rows of content items.

A page is one text of bounded size, so it is parsed whole, by the standard library's tokenizer; pages are dealt to
tasks by the scan. Comments, scripts, styles and templates don't count as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources import markup
from leafmill.sources.books import ROWS

SKIPPED = {"script", "style", "head", "template", "noscript"}
_NAMES = ["section", "item", "section_title", "section_level", "kind", "text", "lines", "label", "attribution", "italic", "display", "points", "cells", "complex", "image", "caption", "error"]
_DDL = "section int, item int, section_title string, section_level int, kind string, text string, lines array<string>, label string, attribution string, italic boolean, display boolean, points array<struct<text: string, level: int, ordered: boolean, marker: string>>, cells array<array<string>>, complex boolean, image string, caption string, error string"


_REFERENCE = re.compile(r"&(#?[0-9A-Za-z]+)(;?)")


def closed_references(html: str) -> str:
    """The page with references that no semicolon closes written so that they are read as text, where HTML knows some of them (&amp)."""
    return _REFERENCE.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)


def page_items(html: str) -> list[dict]:
    """Rows of the items of a page, by the sections that its headings begin; a section without items is a row of no kind.

    Images are those of the page itself, by their addresses.
    """
    root = markup.tree(html).without(lambda t: t.name in SKIPPED)
    root, texts = markup.note_definitions(root)
    images = {t.get("src"): t.get("src") for t in root.all("img")}
    images |= {x.split("#")[0].split("?")[0]: x for x in images}
    sections, _, _ = markup.sections(root, "", images, texts)
    out = []
    for n, s in enumerate(sections):
        base = {"section": n, "section_title": s["title"], "section_level": s["level"]}
        out += [{**base, "item": i, **x} for i, x in enumerate(s["items"])] or [{**base, "item": 0}]
    return out


def _rows(html: str) -> list[dict]:
    try:
        return page_items(html)
    except Exception as e:  # one bad page doesn't fail the others
        return [{"error": f"corrupt: {type(e).__name__}: {e}"}]


def items(pages: DataFrame, key: str, html: str, unclosed: bool = True) -> DataFrame:
    """key and the items of each row, as rendering takes them; null and empty pages have none.

    References to characters are decoded as HTML does; those that no semicolon closes stay text if unclosed is false.

    A page that can't be read, or whose quotations and tables lie so deep in each other that telling them would not end,
    is one row with an error. Rows are read alone, so repeated ones have their items as often as they come.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x or "" if unclosed else closed_references(x or "") for x in batch["html"].to_pylist())
            rows = [{"key": k, **x} for k, text in zip(batch["key"].to_pylist(), texts, strict=True) for x in _rows(text)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field("key", batch.schema.field("key").type), *(ROWS.field(x) for x in _NAMES)]))

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(task, f"key {rows.schema['key'].dataType.simpleString()}, {_DDL}").withColumnRenamed("key", key)
