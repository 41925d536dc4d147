"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows of 13 words (or whole items of fewer) are the test strings, by length. For each length a shift
table has, by the hash of a block of words, how far the search may jump: the least distance of that block from the end
of any test string, or past the block if no test string has it. Where the shift is zero, the bucket of the block's
hash selects test strings, by the hash of the whole window, and the bytes are compared. The texts of a batch are
searched side by side, in stretches, a jump of each at a time.

The test strings are kept as files of a bounded number of words in the shared folder, and each task searches its
documents for one file after another, so neither their number nor the documents must fit anywhere.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Flat, SpanHash, byte_texts, map_rows, open_folder, put_file, shared_folder, slices
from leafmill.llm.tables import saved

WINDOW = 13
FILE_WORDS = 1_000_000
STRETCH = 1024
TABLE_BITS = 18
HASH_SEED = 7
#: Files of search strings that a task keeps between its batches.
HELD_FILES = 4
#: Words are runs of digits, letters a to z (A-Z lower-cased) and characters from U+0080 on.
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


class ShiftTable:
    """Test strings of `length` words: bytes with words joined by one space, each with the numbers of its items."""

    def __init__(self, length: int, tests: dict[bytes, list[int]], hasher: SpanHash):
        self.length, self.block = length, min(3, length)
        flat = Flat(list(tests))
        prefix = hasher.prefix(flat.data)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int16)
        first = flat.first[:-1]
        for end in range(self.block, length + 1):
            slot = self._slot(hasher.spans(prefix, flat.start[first + end - self.block], flat.end[first + end - 1]))
            np.minimum.at(self.shift, slot, length - end)
        key = hasher.spans(prefix, flat.start[first], flat.end[first + length - 1])
        order = np.argsort(key)
        listed = list(tests.items())
        self.keys, self.tests = key[order], [listed[i] for i in order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, flat: Flat, prefix: np.ndarray, hasher: SpanHash) -> Iterator[tuple[int, list[int]]]:
        """(word at which a test string starts, its items), for each occurrence."""
        counts = flat.counts - self.length + 1  # starts of each text
        texts = np.flatnonzero(counts > 0)
        per = -(-counts[texts] // STRETCH)
        owner = np.repeat(texts, per)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = flat.first[owner] + step * STRETCH + self.length - 1  # the last word of the window looked at
        stop = np.minimum(at + STRETCH, flat.first[owner + 1])
        found = []
        while len(at):
            jump = self.shift[self._slot(hasher.spans(prefix, flat.start[at - self.block + 1], flat.end[at]))]
            zero = jump == 0
            found.append(at[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(ends):
            return
        starts = ends - self.length + 1
        key = hasher.spans(prefix, flat.start[starts], flat.end[ends])
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        for i in np.flatnonzero(high > low):
            text = flat.raw[flat.start[starts[i]] : flat.end[ends[i]]]
            for test, items in self.tests[low[i] : high[i]]:
                if test == text:
                    yield int(starts[i]), items


class SearchStrings:
    """The windows of some items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], hasher: SpanHash, window: int = WINDOW):
        self.ids = [i for i, _ in items]
        by_length: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for number, (_, text) in enumerate(items):
            words = text.split()
            n = min(window, len(words))
            for at in range(len(words) - n + 1 if n else 0):
                owners = by_length[n].setdefault(b" ".join(words[at : at + n]), [])
                if not owners or owners[-1] != number:
                    owners.append(number)
        self.tables = [ShiftTable(n, tests, hasher) for n, tests in sorted(by_length.items())]

    def search(self, flat: Flat, prefix: np.ndarray, hasher: SpanHash, edge: np.ndarray, items: dict[int, set[str]]) -> None:
        """Adds occurrences to edge (+1 at the first word, -1 after the last) and the items to those of each text."""
        for table in self.tables:
            for start, numbers in table.search(flat, prefix, hasher):
                edge[start] += 1
                edge[start + table.length] -= 1
                items[int(flat.owner[start])].update(self.ids[i] for i in numbers)


def string_files(benchmark: DataFrame, spark: SparkSession, folder: str, window: int = WINDOW, file_words: int = FILE_WORDS) -> list[str]:
    """Writes the items' search strings, with their tables, to files and returns their names; a file holds one item at
    least. So a table is built once, by the task that writes it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        part, names, have, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            nonlocal have, size
            names.append(f"tests-{part:05d}-{len(names):05d}.pickle")
            put_file(fs, f"{root}/{names[-1]}", pickle.dumps(SearchStrings(have, SpanHash.of(HASH_SEED), window), pickle.HIGHEST_PROTOCOL))
            have, size = [], 0

        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), byte_texts(batch["text"]), strict=True):
                words = text.translate(WORD_BYTES)
                have.append((item or "", words))
                size += len(words.split())
                if size >= file_words:
                    flush()
        if have:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return sorted(r["name"] for r in saved(items.mapInArrow(task, "name string"), spark, f"{folder}/names").collect())


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontamination(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, window: int = WINDOW, hit_share: int = 20, file_words: int = FILE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs.

    A document is contaminated if it has a hit word and at least one in hit_share of its words is hit. Null texts, on
    either side, have no words; an item without words has no window; an item_id that is null counts as the empty
    string, and rows that repeat an item_id are one item. Rows of docs are judged alone, so repeated ones are returned
    as often as they come. Empty tables give no rows, an empty benchmark no hits. Other columns are not read.
    """

    def answer(part: pa.RecordBatch, flat: Flat, n_hit: np.ndarray, dirty: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
        found = [sorted(items.get(i, ())) for i in range(part.num_rows)]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
        columns = [part["doc_id"], pa.array(flat.counts), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(dirty)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_search(benchmark, spark, window, hit_share, file_words, answer), OUT)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, window: int = WINDOW, hit_share: int = 20, file_words: int = FILE_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, as they are.

    Null, empty and blank texts have no words and stay; each row is judged alone, so repeated rows share one fate and a
    null doc_id stays. Other columns may have any type and name; empty tables give no rows, an empty benchmark all.
    """
    return map_rows(docs, _search(benchmark, spark, window, hit_share, file_words, lambda part, flat, n_hit, dirty, items: part.filter(pa.array(~dirty))))


def _search(benchmark: DataFrame, spark: SparkSession, window: int, hit_share: int, file_words: int, answer: Callable) -> Callable:
    """A task that gives answer(rows, words, hit words, contaminated, items) of the rows of its batches, a piece at a time."""
    folder = shared_folder(spark, "tests")
    names = string_files(benchmark, spark, folder, window, file_words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        hasher = SpanHash.of(HASH_SEED)
        held: dict[str, SearchStrings] = {}

        def tests(name: str) -> SearchStrings:
            if name in held:
                return held[name]
            with fs.open_input_stream(f"{root}/{name}") as src:
                made = pickle.loads(src.read())
            if len(held) < HELD_FILES:  # the others are read again for each batch
                held[name] = made
            return made

        for batch in batches:
            parts = list(slices([batch]))
            edges: list[np.ndarray] = []
            items: list[dict[int, set[str]]] = []
            for turn, name in enumerate(names or [""]):
                for i, part in enumerate(parts):
                    flat = Flat([x.translate(WORD_BYTES) for x in byte_texts(part["text"])])
                    if not turn:
                        edges.append(np.zeros(len(flat.start) + 1, np.int64))
                        items.append(defaultdict(set))
                    if name and len(flat.start):
                        tests(name).search(flat, hasher.prefix(flat.data), hasher, edges[i], items[i])
                    if turn == max(len(names), 1) - 1:
                        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[i][:-1]) > 0)])
                        n_hit = hit[flat.first[1:]] - hit[flat.first[:-1]]
                        yield answer(part, flat, n_hit, (n_hit > 0) & (hit_share * n_hit >= flat.counts), items[i])

    return task


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)
