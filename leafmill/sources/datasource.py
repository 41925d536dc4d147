"""spark.read.format("books") and spark.readStream.format("books"): rows of books as a source of its own.

    register(spark)
    spark.read.format("books").option("recursive", "true").load("file:///shelf").filter("format = 'epub'")

Filters on format, path and row are pushed down: files of other formats and paths aren't opened, other rows aren't made.
Columns are chosen by the schema that the reader is given, a part of ROWS_DDL: without `content` no image is unpacked.
Files are opened one at a time by tasks of up to `bytes` (64 MB) of them each. Stores are those that pyarrow opens (file,
hdfs, s3, gs); for others there is read_books, whose files Spark reads.
"""

from __future__ import annotations

import importlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from leafmill.sources import books

#: Whether Python sources get filters is a setting that is off by default.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Files(InputPartition):
    """path and format of the files of one task."""

    files: list[tuple[str, str]]

    def __init__(self, files: list[tuple[str, str]]) -> None:
        super().__init__(None)
        self.files = files


@dataclass(frozen=True)
class Found:
    path: str
    format: str
    size: int
    changed: int  # nanoseconds


def opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before paths of it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri, "file://"
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file://"
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path, uri[: uri.index(path)] if path in uri else ""


class _Books:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("books: load() needs a folder")
        self.names = schema.fieldNames()
        self.folder, self.profile = options["path"], options.get("profile", "auto")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.bytes = int(options.get("bytes", 64 << 20))
        self.settle = float(options.get("settle", 1.0))
        #: reader.<format> = module:function adds a format.
        self.more = {k.removeprefix("reader."): v for k, v in options.items() if k.startswith("reader.")}
        self.filters: list[Filter] = []

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps those that can be told of a file or a row by itself; the others are Spark's."""
        for f in filters:
            one = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and one in (("format",), ("path",), ("row",)):
                self.filters.append(f)
            else:
                yield f

    def passes(self, **values: str) -> bool:
        """False if a filter on one of values says no."""
        for f in self.filters:
            x = values.get(f.attribute[0])
            if x is None:
                continue
            good = x == f.value if isinstance(f, EqualTo) else x in f.value if isinstance(f, In) else x.startswith(f.value) if isinstance(f, StringStartsWith) else x.endswith(f.value)
            if not good:
                return False
        return True

    def listed(self) -> list[Found]:
        """Books of the folder, by path: none that is hidden, temporary or a tool's, nor what filters rule out."""
        fs, root, before = opened(self.folder)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=self.recursive)):
            inner = [x for x in info.path[len(root) :].split("/") if x]
            name = inner[-1] if inner else ""
            kind = name.rpartition(".")[2].lower() if "." in name else ""
            hidden = any(x.startswith(".") or x in books.TOOL_FOLDERS for x in inner[:-1]) or re.match(r"\.|~\$", name)
            path = f"{before}{info.path}"
            if info.type == pafs.FileType.File and kind in (*books.FORMATS, *self.more) and not hidden and self.passes(format=kind, path=path):
                out.append(Found(path, kind, info.size or 0, info.mtime_ns or 0))
        return sorted(out, key=lambda f: f.path)

    def dealt(self, files: list[Found]) -> list[Files]:
        """Files by tasks, each of which gets up to `bytes`, or one larger file."""
        out: list[list[tuple[str, str]]] = []
        size = 0
        for f in files:
            if not out or size + f.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append((f.path, f.format))
            size += f.size
        return [Files(x) for x in out] or [Files([])]

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        known: dict[str, Callable] = dict(books.READERS)
        for kind, name in self.more.items():
            module, _, function = name.partition(":")
            known[kind] = getattr(importlib.import_module(module), function)
        schema = pa.schema([books.ROWS.field(x) for x in self.names])
        pictures = "content" in self.names and self.passes(row="image")
        for path, kind in part.files:
            fs, place, _ = opened(path)
            with fs.open_input_stream(place) as src:
                data = src.read()
            made = [{"path": path, "format": kind, **r} for r in books.file_rows(path, kind, data, known, self.profile, pictures)]
            made = [{k: r.get(k) for k in self.names} for r in made if self.passes(row=r["row"])]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)


class BooksReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.books = _Books(schema, options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.books.push(filters)

    def partitions(self) -> list[Files]:
        return self.books.dealt(self.books.listed())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.books.rows(partition)


class BooksStream(DataSourceStreamReader):
    """Files by the time of their last change, once that lies `settle` seconds (1) back. What is moved in with an older
    time is not seen; streaming.intake.watch keeps a list of files instead."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.books = _Books(schema, options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.books.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.books.dealt([f for f in self.books.listed() if start["until"] <= f.changed < end["until"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.books.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept of files that have been read."""


class BooksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return books.ROWS_DDL

    def reader(self, schema: StructType) -> BooksReader:
        return BooksReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> BooksStream:
        return BooksStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it get filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BooksSource)
