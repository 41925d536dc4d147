"""What a decoder tells of a file of pages, in one pass, as rows of one shape that are split into tables once.

A decoder is a function of a file's bytes that yields rows, as dicts with `row` and what that kind has:

    book      title, author
    page      page, width, height (points)
    line      page, line, vertical
    span      page, line, seq, text, font, size, flags, x0, y0, x1, y1
    grid      page, cells, x0, y0, x1, y1
    image     page, image (a name), x0, y0, x1, y1, w, h (pixels), content
    word      page, seq, text, conf, block, par, line, left, top, width, height (pixels; recognised by the decoder itself)
    raster    page, content (a picture of the page, for a recogniser)
    bookmark  seq, level, title, page
    label     page, title (the number printed on it)

It may raise books.EncryptedError, or anything else for a file that it can't read. No decoder comes with this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.books import EncryptedError

Decoder = Callable[[bytes], Iterable[dict]]
#: Rows and bytes of one batch that a task passes on.
MOST_ROWS, MOST_BYTES = 4_096, 8 << 20
_FIELDS = {
    "path": "string", "row": "string", "error": "string", "page": "bigint", "line": "int", "seq": "int", "text": "string", "font": "string", "size": "double", "flags": "int", "vertical": "boolean",
    **dict.fromkeys(("x0", "y0", "x1", "y1"), "double"), "cells": "array<array<string>>", "image": "string", **dict.fromkeys(("w", "h", "conf", "block", "par"), "int"), **dict.fromkeys(("left", "top", "width", "height"), "double"),
    "level": "int", "title": "string", "author": "string", "content": "binary",
}
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
SCHEMA = pa.schema([(k, _KINDS[v]) for k, v in _FIELDS.items()])
DDL = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())


def _told(path: str, kind: str, data: bytes, decoders: dict[str, Decoder]) -> Iterator[dict]:
    if kind not in decoders:
        yield {"row": "error", "error": f"unsupported: {kind}"}
        return
    try:
        yield from decoders[kind](data)
    except Exception as e:  # one bad file doesn't fail the others
        yield {"row": "error", "error": f"{'encrypted' if isinstance(e, EncryptedError) else 'corrupt'}: {type(e).__name__}: {e}"}


def decoded(files: DataFrame, decoders: dict[str, Decoder]) -> DataFrame:
    """path, row and the rest, of files (path, format, content). decoders: by format. A file that fails on the way has an
    error row besides those of the pages before; see split."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                path, kind, data = (batch[c][i].as_py() for c in ("path", "format", "content"))
                have: list[dict] = []
                size = 0
                for row in _told(path, kind, data, decoders):
                    have.append({"path": path, **row})
                    size += len(row.get("content") or b"") + len(row.get("text") or "")
                    if len(have) >= MOST_ROWS or size >= MOST_BYTES:
                        yield pa.RecordBatch.from_pylist(have, schema=SCHEMA)
                        have, size = [], 0
                if have:
                    yield pa.RecordBatch.from_pylist(have, schema=SCHEMA)

    return files.select("path", "format", "content").mapInArrow(task, DDL)


_COLUMNS = {
    "book": ("title", "author"), "page": ("page", "width", "height"), "line": ("page", "line", "vertical"), "span": ("page", "line", "seq", "text", "font", "size", "flags", "x0", "y0", "x1", "y1"),
    "grid": ("page", "cells", "x0", "y0", "x1", "y1"), "image": ("page", "image", "x0", "y0", "x1", "y1", "w", "h", "content"), "word": ("page", "seq", "text", "conf", "block", "par", "line", "left", "top", "width", "height"),
    "raster": ("page", "content"), "bookmark": ("seq", "level", "title", "page"), "label": ("page", "title"),
}


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """A table for each kind of rows, which should have been staged by kind; book is the path. errors: path and error of
    the files that failed, of which no other table has rows."""
    errors = rows.filter("row = 'error'").groupBy("path").agg(F.min("error").alias("error"))
    failed = errors.select(F.col("path").alias("book"))
    of = lambda kind: rows.filter(F.col("row") == kind).select(F.col("path").alias("book"), *_COLUMNS[kind]).join(failed, "book", "left_anti")
    return {kind: of(kind) for kind in _COLUMNS} | {"errors": errors}


def recognised(rasters: DataFrame, states: DataFrame, recogniser: Callable[[bytes], Iterable[dict]], resources: ResourceProfile | None = None) -> DataFrame:
    """Words (see decoded) of the pages that are to be recognised, by a function of a page's picture.

    Only those pages' pictures reach it, each once a run of the plan. resources: what its tasks need, such as a GPU.
    """
    wanted = states.filter("needs_ocr").select("book", "page")
    columns = ("book", *_COLUMNS["word"])
    kinds = {"book": pa.string()} | {c: SCHEMA.field(c).type for c in _COLUMNS["word"]}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                book, page, content = (batch[c][i].as_py() for c in ("book", "page", "content"))
                words = [{"seq": n, "block": 0, "par": 0, "line": 0} | w | {"book": book, "page": page} for n, w in enumerate(recogniser(content))]
                if words:
                    yield pa.RecordBatch.from_pylist([{c: w.get(c) for c in columns} for w in words], schema=pa.schema(list(kinds.items())))

    pages = rasters.join(wanted, ["book", "page"], "left_semi").repartition("book", "page")
    return pages.mapInArrow(task, ", ".join(f"{c} {'string' if c == 'book' else _FIELDS[c]}" for c in columns), profile=resources)
