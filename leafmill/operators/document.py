"""Rules over parts of documents: tables, zones, rendering, validation, review."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.functions import text as T
from leafmill.sources.shared import opened, put, shared_folder

#: Titles of one automaton, automata that a task keeps between its batches, and rests by which characters are counted.
MOST_TITLES, HELD_FILES, BINS = 100_000, 4, 64
#: Rests by which three characters in a row are counted, lines that are counted at once, and from which length on
#: SequenceMatcher leaves frequent characters out.
TRIPLE_BITS = 11
TRIPLES, SOME_LINES, JUNK_FROM = 1 << TRIPLE_BITS, 1024, 200
#: From how many first lines on common subsequences are found for all at once.
MANY_NEAR = 200
#: Titles of a book in one automaton, shares that a book's pages are dealt in, and pairs of pages and titles sent on at once.
OF_BOOK, SHARES, SOME_PAIRS = 20_000, 16, 50_000

#: Labels of front and back matter, as alternatives of a pattern.
FRONT = "table of contents|contents|preface|foreword|dedication|acknowledgments|acknowledgements"
FRONT_DATA = "copyright|published by|isbn|all rights reserved"
BACK = "bibliography|references|works cited|glossary|index|notes|endnotes|appendix|about the author"
FRONT_LABELS = ["preface", "foreword", "dedication", "acknowledgments", "acknowledgements", "introduction", "prologue", "note to the reader"]
BACK_LABELS = ["glossary", "bibliography", "references", "works cited", "index", "appendix", "notes", "endnotes", "about the author", "afterword", "epilogue"]


def tables(rows: DataFrame) -> DataFrame:
    """book, page, cells: the rows (book, page, seq, cells) of each page that has two or more, in order."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("seq", "cells"))), lambda x: x["cells"])
    return rows.groupBy("book", "page").agg(cells.alias("cells")).filter("size(cells) >= 2")


def is_complex(cells: Column) -> Column:
    return F.exists(cells, lambda r: (F.size(r) > 8) | F.exists(r, lambda c: F.length(c) > 80))


def filled(found: DataFrame) -> DataFrame:
    """book, page, r, col, cell, merged: cells with one space between words; empty ones take the last one above that isn't."""
    flat = found.select("book", "page", F.posexplode("cells").alias("r", "row")).select("book", "page", "r", F.posexplode("row").alias("col", "raw"))
    flat = flat.withColumn("raw", T.stripped(F.regexp_replace("raw", f"{T.SPACES}+", " ")))
    above = Window.partitionBy("book", "page", "col").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return flat.select("book", "page", "r", "col", F.coalesce(F.last(F.nullif("raw", F.lit("")), True).over(above), F.lit("")).alias("cell"), (F.col("raw") == "").alias("merged"))


def tables_found(grids: DataFrame) -> DataFrame:
    """Grids (cells, an array of rows) that are tables: two rows or more, each of two cells or more."""
    return grids.filter((F.size("cells") >= 2) & F.forall("cells", lambda r: F.size(r) >= 2))


def monotone(rows: DataFrame, book: str, at: str) -> DataFrame:
    """Front matter after the body counts to the body."""
    before = Window.partitionBy(book).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("division") == "body").over(before), F.lit(False))
    return rows.withColumn("seen", seen).withColumn("division", F.when(F.col("seen") & (F.col("division") == "front"), "body").otherwise(F.col("division"))).drop("seen")


def _automaton(titles: dict) -> bytes:
    search = ahocorasick.Automaton()
    for title, told in titles.items():
        search.add_word(title, told)
    search.make_automaton()
    return pickle.dumps(search)


def title_files(titles: DataFrame, folder: str, most: int = MOST_TITLES) -> None:
    """Writes automata of `most` titles each to a folder that all machines share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        part, n, have = TaskContext.get().partitionId(), 0, {}

        def flush() -> pa.RecordBatch:
            nonlocal n, have
            put(fs, f"{root}/{part:05d}-{n:05d}.titles", _automaton(have))
            told = pa.RecordBatch.from_pydict({"n": [len(have)]})
            n, have = n + 1, {}
            return told

        for batch in batches:
            for title in batch["title"].to_pylist():
                have[title] = title
                if len(have) == most:
                    yield flush()
        if have:
            yield flush()

    titles.select("title").mapInArrow(task, "n long").write.format("noop").mode("overwrite").save()


class _Held:
    """Automata of a folder; the first HELD_FILES are kept, the others are read again whenever they are asked for."""

    def __init__(self, fs, names: list[str]):
        self.fs, self.names, self.kept = fs, names, {}

    def __iter__(self) -> Iterator[ahocorasick.Automaton]:
        for name in self.names:
            made = self.kept.get(name)
            if made is None:
                with self.fs.open_input_stream(name) as src:
                    made = pickle.loads(src.read())
                if len(self.kept) < HELD_FILES:
                    self.kept[name] = made
            yield made


def _title_names(fs, root: str) -> list[str]:
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".titles"))


def contained(pages: DataFrame, titles: DataFrame, longest: int, most: int = MOST_TITLES) -> DataFrame:
    """page, title of the titles (4 to `longest` characters) in each page's text t, once each.

    Titles are looked for all at once, by automata of `most` titles each that are kept in the shared folder; a text is
    read once for each of those, however many titles it could hold. Pairs leave a task SOME_PAIRS or a page's at a time.
    Null texts hold none.
    """
    folder = shared_folder(pages.sparkSession, "titles")
    title_files(titles.filter(F.length("title").between(4, longest)).distinct(), folder, most)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        held = _Held(fs, _title_names(fs, root))
        for batch in batches:
            for search in held:
                at, said = [], []

                def told(at: list, said: list, pages: pa.Array = batch["page"]) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pages.take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=["page", "title"])

                for i, t in enumerate(batch["t"]):
                    found = {x for _, x in search.iter(t.as_py())} if t.is_valid else ()
                    at += [i] * len(found)
                    said += found
                    if len(said) >= SOME_PAIRS:
                        yield told(at, said)
                        at, said = [], []
                yield told(at, said)

    return pages.select("page", "t").mapInArrow(task, f"page {pages.schema['page'].dataType.simpleString()}, title string").distinct()


def titles_held(pages: DataFrame, titles: DataFrame, most: int = OF_BOOK) -> DataFrame:
    """pages (book, page, t and others) with held instead of t: how many titles (book, title) of their book, 4 characters
    or longer, the text has; titles that repeat count as often.

    Each book has automata of its own, of `most` titles each. Pages are dealt to tasks by book and SHARES shares of a
    book, and sorted by book, so that a task holds those of one book at a time and reads a text once for each of them.
    """
    folder = shared_folder(pages.sparkSession, "titles-of-books")
    of_book = titles.filter(F.length("title") >= 4).filter("book IS NOT NULL").groupBy("book", "title").agg(F.count("*").alias("n"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        now, n, have = None, 0, {}

        def flush() -> pa.RecordBatch:
            nonlocal n, have
            path = f"{root}/{_book_folder(now)}"
            fs.create_dir(path, recursive=True)
            put(fs, f"{path}/{n:05d}.titles", _automaton(have))
            told = pa.RecordBatch.from_pydict({"n": [len(have)]})
            n, have = n + 1, {}
            return told

        for batch in batches:
            for book, title, often in zip(*(batch[c].to_pylist() for c in ("book", "title", "n")), strict=True):
                if have and (book != now or len(have) == most):
                    yield flush()
                if book != now:
                    now, n = book, 0
                have[title] = (title, often)
        if have:
            yield flush()

    of_book.repartition("book").sortWithinPartitions("book", "title").mapInArrow(build, "n long").write.format("noop").mode("overwrite").save()
    others = [f for f in pages.schema if f.name != "t"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        now, held = None, _Held(fs, [])
        for batch in batches:
            books, counts = batch["book"].to_pylist(), [0] * batch.num_rows
            for book, rows in groupby(range(batch.num_rows), books.__getitem__):
                if book != now:
                    now, held = book, _Held(fs, _title_names(fs, f"{root}/{_book_folder(book)}") if book is not None else [])
                rows = list(rows)
                for search in held:
                    for i in rows:
                        t = batch["t"][i]
                        if t.is_valid:
                            counts[i] += sum(n for _, n in {x for _, x in search.iter(t.as_py())})
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), pa.array(counts, pa.int64())], names=[*(f.name for f in others), "held"])

    share = F.pmod(F.hash("page"), F.lit(SHARES))
    dealt = pages.repartition(F.col("book"), share).sortWithinPartitions("book").select(*(f.name for f in others), "t")
    return dealt.mapInArrow(task, StructType([*others, StructField("held", LongType())]))


def _book_folder(book) -> str:
    return hashlib.sha256(str(book).encode()).hexdigest()


def is_decorative(c: Column) -> Column:
    return c.rlike(r"^[\s§*❧◆•~×\-—–]{1,5}$")


def matter_label(c: Column, labels: list[str]) -> Column:
    """The label that a line of four words or fewer is; null if none."""
    name = F.regexp_replace(T.collapsed(c), "[.:]+$", "")
    return F.when((T.n_words(c) <= 4) & name.isin(labels), name)


def page_ranges(pages: DataFrame) -> DataFrame:
    """book, ranges of distinct (book, page)."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("book").orderBy("page"))
    spans = pages.withColumn("island", island).groupBy("book", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"])
    return spans.groupBy("book").agg(F.array_join(parts, ", ").alias("ranges"))


def _of(files: DataFrame, pattern: str, name: str) -> DataFrame:
    return files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), 1))).alias(name))


def footnote_faults(files: DataFrame) -> DataFrame:
    """Markers of a file used without a definition, and defined without a use."""
    defs, uses = _of(files, r"(?m)^\[\^([^\]]+)\]:", "marker"), _of(files, r"\[\^([^\]]+)\](?!:)", "marker")
    on = ["file", "marker"]
    return uses.join(defs, on, "left_anti").withColumn("fault", F.lit("undefined")).unionByName(defs.join(uses, on, "left_anti").withColumn("fault", F.lit("unused")))


def image_faults(files: DataFrame, disk: DataFrame) -> DataFrame:
    """book, image, fault: images that a book's files (book, file, body) show but it hasn't, and the other way."""
    refs = files.select("book", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"!\[\[([^\]]+)\]\]"), 1))).alias("image")).distinct()
    on = ["book", "image"]
    return refs.join(disk, on, "left_anti").withColumn("fault", F.lit("missing")).unionByName(disk.join(refs, on, "left_anti").withColumn("fault", F.lit("unused")))


def heading_jumps(files: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    levels = F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^(#{1,6})\s+\S"), 1), F.length)
    pairs = F.arrays_zip(F.slice("levels", 1, F.greatest(F.size("levels") - 1, F.lit(0))).alias("a"), F.slice("levels", 2, F.greatest(F.size("levels") - 1, F.lit(0))).alias("b"))
    rows = files.select("file", levels.alias("levels")).filter("size(levels) > 1").select("file", F.explode(pairs).alias("p"))
    return rows.select("file", F.col("p.a").alias("level"), F.col("p.b").alias("next_level")).filter("next_level > level + 1")


def size_faults(files: DataFrame, least: int = 500, most: int = 200_000) -> DataFrame:
    size = F.octet_length("body")
    return files.select("file", size.alias("size"), F.when(size < least, "small").when(size > most, "large").alias("fault")).filter("fault IS NOT NULL")


def unclaimed(books: DataFrame, spans: DataFrame, zones: DataFrame) -> DataFrame:
    """book, page of the pages of each book (book, total) that neither a chapter's span nor a zone of front or back claims.

    spans: book, start_page, end_page; zones: the same with zone. page_ranges puts the pages into words.
    """
    matter = zones.filter(F.col("zone").isin("front", "back")).select("book", "start_page", "end_page")
    claimed = spans.select("book", "start_page", "end_page").unionByName(matter).filter("end_page >= start_page")
    claimed = claimed.select("book", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    every = books.filter("total > 0").select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).alias("page"))
    return every.join(claimed, ["book", "page"], "left_anti")


def report(chapters: DataFrame, footnotes: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """book, total_chapters, total_footnotes, total_images, ocr_pages: counts of the rows of each, which have a book; pages a true `ocrd`."""
    counts = [rows.groupBy("book").agg(n.alias(name)) for rows, n, name in ((chapters, F.count("*"), "total_chapters"), (footnotes, F.count("*"), "total_footnotes"), (images, F.count("*"), "total_images"))]
    out = pages.groupBy("book").agg(F.count_if("ocrd").alias("ocr_pages"))
    for c in counts:
        out = out.join(c, "book", "left")
    return out.select("book", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("total_chapters", "total_footnotes", "total_images", "ocr_pages")))


def corrections(answers: DataFrame, key: str) -> DataFrame:
    """key, id, action, new_level of the corrections in answers (key, answer, n_headings) that can be followed.

    Of several of one heading the first in the answer counts, if it can be followed. Demotions of all headings count as none.
    """
    fenced = F.regexp_extract("answer", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(fenced != "", fenced).otherwise(bare), "corrections array<struct<id: int, action: string, new_level: int>>")
    rows = answers.select(key, "n_headings", F.posexplode(parsed["corrections"]).alias("at", "x")).select(key, "n_headings", "at", "x.*")
    allowed = F.col("id").between(1, F.col("n_headings")) & (F.col("action").isin("keep", "demote", "set_part") | ((F.col("action") == "set_level") & (F.col("new_level") >= 1)))
    first = rows.filter(allowed).withColumn("n", F.row_number().over(Window.partitionBy(key, "id").orderBy("at"))).filter("n = 1")
    gone = F.count_if(F.col("action") == "demote").over(Window.partitionBy(key))
    return first.withColumn("gone", gone).filter("NOT (action = 'demote' AND gone >= n_headings)").select(key, "id", "action", "new_level")


def _numbers(at: np.ndarray, bins: int) -> tuple[np.ndarray, int]:
    """How often each number comes, 255 at most, and what is over that in all."""
    n = np.bincount(at, minlength=bins)
    return np.minimum(n, 255).astype(np.uint8), int(np.maximum(n - 255, 0).sum())


def _shared(rows: np.ndarray, near: np.ndarray, own: np.ndarray, over: int) -> np.ndarray:
    """The sums of the lesser numbers of own and of each of the near rows, at least, by parts so that no copy is large."""
    parts = [np.minimum(rows[near[i : i + SOME_LINES]], own).sum(axis=1, dtype=np.uint32) for i in range(0, len(near), SOME_LINES)]
    return np.concatenate(parts).astype(np.int64) + over if parts else np.zeros(0, np.int64)


def _triples(line: np.ndarray) -> np.ndarray:
    wide = line.astype(np.uint64)
    return wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:]


def common_lengths(line: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The longest common subsequence of line with each stretch of text: of bits by words of 64, for all stretches at once."""
    words = -(-len(line) // 64)
    known, where = np.unique(line, return_inverse=True)
    masks = np.zeros((words, len(known) + 1), np.uint64)  # the last of characters that line has not
    at = np.arange(len(line))
    np.bitwise_or.at(masks, (at // 64, where), np.uint64(1) << (at % 64).astype(np.uint64))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    left = np.full((words, len(size)), ~np.uint64(0))
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, "left"))  # stretches longer than i
        c = text.take(start[:live] + i)
        found = np.searchsorted(known, c)
        found[known.take(found, mode="clip") != c] = len(known)
        carry = np.zeros(live, np.uint64)
        for w in range(words):
            v = left[w, :live]
            u = v & masks[w].take(found)
            total = v + u
            more = total < u
            total += carry
            more |= total < carry
            left[w, :live] = total | (v - u)
            carry = more.astype(np.uint64)
    if len(line) % 64:
        left[-1] |= ~np.uint64(0) << np.uint64(len(line) % 64)
    out = np.empty(len(size), np.int64)
    out[order] = np.bitwise_count(~left).sum(axis=0, dtype=np.int64)
    return out


def common_length(places: dict[str, int], whole: int, other: str) -> int:
    """The same for one pair, by numbers of as many bits as a line has characters: places has those of each, whole is all ones."""
    left = whole
    for c in other:
        if c in places:
            u = left & places[c]
            left = (left + u | left - u) & whole
    return (whole ^ left).bit_count()


class _Firsts:
    """First lines of clusters, by what bounds how much of another line can match them."""

    def __init__(self) -> None:
        self.n, self.size, self.rare, self.start = 0, np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.letters, self.triples, self.triple_of = np.zeros((64, BINS), np.uint8), np.zeros((64, TRIPLES), np.uint8), np.zeros(64, np.int64)
        self.long, self.text, self.used = 0, np.zeros(4096, np.uint32), 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        while n > len(x):
            x = np.concatenate([x, np.zeros_like(x)])
        return x

    def add(self, line: np.ndarray, letters: np.ndarray, triples: np.ndarray) -> None:
        k = self.n
        self.n += 1
        for name in ("size", "rare", "start", "letters", "triple_of"):
            setattr(self, name, self._room(getattr(self, name), self.n))
        self.text = self._room(self.text, self.used + len(line))
        self.text[self.used : self.used + len(line)] = line
        self.size[k], self.start[k], self.letters[k] = len(line), self.used, letters
        self.used += len(line)
        if len(line) >= JUNK_FROM:
            seen = np.unique(line, return_counts=True)[1]
            self.rare[k], self.triple_of[k] = int(seen[seen <= len(line) // 100 + 1].sum()), self.long
            self.long += 1
            self.triples = self._room(self.triples, self.long)
            self.triples[self.triple_of[k]] = triples

    def near(self, line: np.ndarray, letters: tuple, triples: tuple, ratio: float) -> np.ndarray:
        """Those that line may be as alike as ratio, at least."""
        need = ratio * (self.size[: self.n] + len(line)) / 2 - 1e-9
        near = np.flatnonzero(np.minimum(self.size[: self.n], len(line)) >= need)
        near = near[_shared(self.letters, near, *letters) >= need[near]]
        is_long = self.size[near] >= JUNK_FROM
        some = near[is_long]
        some = some[_shared(self.triples, self.triple_of[some], *triples) + 2 * self.rare[some] >= need[some]]
        near = np.sort(np.concatenate([near[~is_long], some]))
        if len(near) > MANY_NEAR:
            near = near[common_lengths(line, self.text, self.start[near], self.size[near]) >= need[near]]
        return near


def clusters(lines: list[tuple[str, int]], ratio: float) -> tuple[list[tuple[str, int, list[str]]], int]:
    """(first line, number, lines) of the clusters of distinct lines (and how often each comes), in order, and how many pairs
    were compared.

    Two lines can't be more alike than the characters that they share: twice the sum of the lesser numbers of each, over
    both lengths. That is asked of all first lines at once, of the numbers of characters by the rest of their code modulo
    BINS (which can only be more). In a first line of JUNK_FROM characters or more SequenceMatcher begins no match at
    a frequent character, so there are at most as many matches as rare characters, and of each all but two characters
    begin three that both lines have. What matches is a common subsequence too, which is found where many are left.
    Only where all of these reach the ratio are the lines themselves compared.
    """
    found: list[list] = []
    firsts, compared = _Firsts(), 0
    for norm, n in lines:
        line = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = _numbers((line % BINS).astype(np.int64), BINS)
        triples = _numbers((_triples(line) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TRIPLE_BITS)).astype(np.int64), TRIPLES)
        best, most = None, 0.0
        near, places = firsts.near(line, letters, triples, ratio).tolist(), {}
        for i, c in enumerate(norm if near else ""):
            places[c] = places.get(c, 0) | 1 << i
        for k in near:  # of those that are alike the most, the first of equal ones
            if 2 * common_length(places, (1 << len(norm)) - 1, found[k][0]) < max(ratio, most) * (len(norm) + len(found[k][0])) - 1e-9:
                continue
            compared += 1
            m = SequenceMatcher(None, norm, found[k][0])
            if m.quick_ratio() >= max(ratio, most) and (now := m.ratio()) > most:
                best, most = found[k], now
        if best is not None and most >= ratio:
            best[1] += n
            best[2].append(norm)
            continue
        firsts.add(line, letters[0], triples[0])
        found.append([norm, n, [norm]])
    return [tuple(c) for c in found], compared


def alike(edges: DataFrame, least: int = 5, ratio: float = 0.82) -> DataFrame:
    """book, band, first, n_lines, members: clusters of `least` lines or more that are like their first one.

    Each line goes to the cluster whose first line it is like the most. Equal lines are grouped before, with the place
    of the first and their number, so a task gets the distinct lines of a book's band, not its pages.
    """
    distinct = edges.groupBy("book", "band", "norm").agg(F.min(F.struct("page", "seq")).alias("at"), F.count("*").alias("n")).select("book", "band", "norm", "at.page", "at.seq", "n")

    def cluster(key: tuple, rows: pa.Table) -> pa.Table:
        lines = [(norm, n) for _, _, norm, n in sorted(zip(*(rows[c].to_pylist() for c in ("page", "seq", "norm", "n")), strict=True))]
        kept = [c for c in clusters(lines, ratio)[0] if c[1] >= least]
        return pa.table({"book": [key[0].as_py()] * len(kept), "band": [key[1].as_py()] * len(kept), "first": [c[0] for c in kept], "n_lines": [c[1] for c in kept], "members": [c[2] for c in kept]}, schema=pa.schema([("book", pa.string()), ("band", pa.string()), ("first", pa.string()), ("n_lines", pa.int64()), ("members", pa.list_(pa.string()))]))

    return distinct.groupBy("book", "band").applyInArrow(cluster, "book string, band string, first string, n_lines long, members array<string>")


def edge_bands(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """book, page, seq, band, norm of the blocks that are in the top or bottom 15 hundredths of their page, or else
    in its outer 12; digits are masked in norm."""
    band = F.when(F.col("y1") <= 0.15 * page_height, "header").when(F.col("y0") >= page_height * (1 - 0.15), "footer")
    band = band.when((F.col("x1") <= 0.12 * page_width) | (F.col("x0") >= page_width * (1 - 0.12)), "margin")
    near = blocks.withColumn("band", band).filter("band IS NOT NULL")
    return near.select("book", "page", "seq", "band", T.masked(F.col("text")).alias("norm")).filter("norm <> ''")


def without_repeats(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """The blocks that aren't running headers, footers or margins, which five blocks of a book's band or more are like."""
    edges = edge_bands(blocks, page_width, page_height)
    running = alike(edges).select("book", "band", F.explode("members").alias("norm"))
    return blocks.join(edges.join(running, ["book", "band", "norm"], "left_semi").select("book", "page", "seq"), ["book", "page", "seq"], "left_anti")


def regions(boxes: DataFrame, exclude: DataFrame | None = None, gap: float = 10.0, least: float = 50.0) -> DataFrame:
    """book, page, n, x0, y0, x1, y1: boxes of a page linked by gaps of `gap` or less on both axes, as one region each.

    Regions of less than `least` on either side go, as do those that overlap a box of `exclude` (book, page and box).
    """

    def merge(b: list[tuple]) -> list[list]:
        root = list(range(len(b)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        open_: list[int] = []  # boxes that reach far enough to the right to be near the next ones
        for i, p in enumerate(b):
            open_ = [j for j in open_ if p[0] - b[j][2] <= gap]
            for j in open_:
                q = b[j]
                if q[1] - p[3] <= gap and p[1] - q[3] <= gap:
                    root[find(i)] = find(j)
            open_.append(i)
        out: dict[int, list] = {}
        for i, p in enumerate(b):
            at = find(i)
            r = out.get(at)
            out[at] = [1, *p] if r is None else [r[0] + 1, min(r[1], p[0]), min(r[2], p[1]), max(r[3], p[2]), max(r[4], p[3])]
        return list(out.values())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages one after another, as they are sorted; one call to Python for a batch of them, not for each."""
        now, page = None, []

        def told(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 2, *[pa.float64()] * 4), strict=True)], names=["book", "page", "n", "x0", "y0", "x1", "y1"])

        for batch in batches:
            done = []
            for *key, x0, y0, x1, y1 in zip(*(batch[c].to_pylist() for c in ("book", "page", "x0", "y0", "x1", "y1")), strict=True):
                if key != now:
                    done += [(*now, *r) for r in merge(page)] if page else []
                    now, page = key, []
                page.append((x0, y0, x1, y1))
            yield told(done)
        if page:
            yield told([(*now, *r) for r in merge(page)])

    rows = boxes.select(F.col("book").cast("string").alias("book"), F.col("page").cast("long").alias("page"), "x0", "y0", "x1", "y1")
    dealt = rows.repartition("book", "page").sortWithinPartitions("book", "page", "x0", "y0", "x1", "y1")
    found = dealt.mapInArrow(task, "book string, page long, n long, x0 double, y0 double, x1 double, y1 double")
    found = found.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    if exclude is None:
        return found
    on = "a.book = b.book AND a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
    return found.alias("a").join(exclude.select(F.col("book").cast("string").alias("book"), F.col("page").cast("long").alias("page"), "x0", "y0", "x1", "y1").alias("b"), F.expr(on), "left_anti")
