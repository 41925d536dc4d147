"""Periodic runs of words, found by matching blocks of a text in the text itself.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least `least` words and
`times` periods long, that no neighbouring word extends. The words are cut into aligned blocks of B words, for each
power of two B. A run of period q, B <= q < 2 B, holds at least one aligned block together with its copy q words on. So
the blocks of a scale are the keys of an automaton (pyahocorasick, keys are sequences of word numbers) that searches the
text; an occurrence at a distance of B to 2 B - 1 from an aligned block that is the same is a seed; and the seed is
extended both ways, word by word, as far as words at that distance agree. Periods below the smallest block are found
as multiples of theirs, and each stretch is brought down to its smallest period.

Which blocks can have such a copy at all is asked first of the places of their first four words, so a text without
repeats builds no automaton. Blocks whose copies lie in a run already found, of a period up to B, can lead to nothing
else (two periods of a stretch that is as long as their sum have a common divisor that is one), so a text that is one
long run has few blocks at each scale.

Each row is judged alone, in the task that reads it, so there is no shuffle, and what is held grows with one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import U64, Flat, byte_texts, map_rows, slices, table

LEAST, TIMES = 24, 3
Run = tuple[int, int, int]


def smallest_block(least: int) -> int:
    """The largest power of two whose blocks find every period below it in runs of `least` words (by way of multiples)."""
    if least < 6:
        raise ValueError("runs must have 6 words or more")
    return 1 << ((least + 2) // 4).bit_length() - 1


class _Places:
    """Where each sequence of four words is, to ask for the next one in a range."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        with np.errstate(over="ignore"):
            w = words.astype(U64)
            gram = ((w[:-3] * U64(0x9E3779B97F4A7C15) + w[1:-2]) * U64(0xC2B2AE3D27D4EB4F) + w[2:-1]) * U64(0x165667B19E3779F9) + w[3:]
        order = np.argsort(gram, kind="stable")
        new = np.concatenate([[False], gram[order[1:]] != gram[order[:-1]]])
        group = np.cumsum(new)
        self.repeats = int(group[-1]) + 1 < len(gram)
        self.sorted = group * self.n + order
        self.group = np.empty(len(gram), np.int64)
        self.group[order] = group

    def again(self, at: np.ndarray, nearest: int, farthest: int) -> np.ndarray:
        """Whether the four words at each place come again at a distance from nearest to farthest."""
        base = self.group[at] * self.n
        k = np.searchsorted(self.sorted, base + at + nearest)
        found = self.sorted[np.minimum(k, len(self.sorted) - 1)]
        return (k < len(self.sorted)) & (found <= base + np.minimum(at + farthest, self.n - 1))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start are equal; looks no further than twice that."""
    n, size = 0, 32
    while n < len(a):
        different = np.flatnonzero(a[n : n + size] != b[n : n + size])
        if len(different):
            return n + int(different[0])
        n, size = min(n + size, len(a)), 2 * size
    return n


def _extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and end of the longest stretch with this period that holds the words at `at` and `at + period`."""
    right = _agree(words[at:-period], words[at + period :])
    left = _agree(words[:at][::-1], words[period : at + period][::-1])
    return at - left, at + period + right


def _least_period(words: np.ndarray, start: int, period: int) -> int:
    """Of a stretch that is at least two of its periods long: the smallest divisor that is a period too."""
    one = words[start : start + period]
    for q in range(1, period // 2 + 1):
        if period % q == 0 and np.array_equal(one[q:], one[:-q]):
            return q
    return period


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of all runs of a text whose words are given by number, by start, then period."""
    if times < 3:
        raise ValueError("runs must have three periods or more")
    n, size = len(words), smallest_block(least)
    if n < max(least, 4):
        return []
    places = _Places(words)
    if not places.repeats:
        return []
    found: set[Run] = set()
    told = words.tolist()
    while times * size <= max(n, times * smallest_block(least)) and 2 * size <= n:
        at = np.arange(0, n - 2 * size + 1, size)
        probe = np.minimum(at, n - 4)
        at = at[places.again(probe, size, 2 * size - 1)] if size >= 4 else at
        reach = np.zeros(n, np.int64)  # how far the runs that have begun go, of periods up to size
        for start, length, period in found:
            if period <= size:
                reach[start] = max(reach[start], start + length)
        np.maximum.accumulate(reach, out=reach)
        at = at[reach[at] < np.minimum(at + 3 * size - 1, n)]
        if len(at):
            found |= _at_scale(words, told, at.tolist(), size, reach, least, times)
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _at_scale(words: np.ndarray, told: list[int], blocks: list[int], size: int, reach: np.ndarray, least: int, times: int) -> set[Run]:
    """Runs that the blocks of one size lead to."""
    keys: dict[tuple[int, ...], int] = {}
    key_at = {s: keys.setdefault(tuple(told[s : s + size]), len(keys)) for s in blocks}
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, number in keys.items():
        search.add_word(key, number)
    search.make_automaton()
    found: set[Run] = set()
    ends: dict[int, int] = {}  # of each distance, how far the last stretch went
    first = blocks[0] + size
    for end, number in search.iter(tuple(told[first : blocks[-1] + 3 * size])):
        p = first + end - size + 1
        s = (p // size - 1) * size  # the one aligned place at a distance of size to 2 size - 1
        d = p - s
        if key_at.get(s) != number or reach[s] >= p + size or ends.get(d, 0) >= p + size:
            continue
        start, stop = _extended(words, s, d)
        ends[d] = stop
        if stop - start >= max(least, 2 * d):
            q = _least_period(words, start, d)
            if stop - start >= times * q:
                found.add((start, stop - start, q))
    return found


def _texts(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[tuple[pa.RecordBatch, Flat, list[list[Run]]]]:
    """Each piece of the batches with its words and the runs of each text."""
    for batch in slices(batches):
        flat = Flat(byte_texts(batch["text"]))
        numbers = pa.array(flat.words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        yield batch, flat, [runs_of(numbers[a:b], least, times) for a, b in zip(flat.first[:-1].tolist(), flat.first[1:].tolist(), strict=True)]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if of each run one period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _rest(flat: Flat, i: int, runs: list[Run]) -> bytes:
    a, b = int(flat.first[i]), int(flat.first[i + 1])
    if not runs:
        return flat.raw[flat.start[a] : flat.end[b - 1]] if b > a else b""
    return b" ".join([flat.words[a + k] for k in np.flatnonzero(kept_words(b - a, runs)).tolist()])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start (number of the first word), length, period of each run of each text.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage return. Null, empty, blank and
    short texts have no runs. Rows are judged alone, so repeated rows have their runs as often as they come, and a null
    doc_id stays null. A text, however long, is one task's, which holds some 100 bytes a word. Other columns are not
    read; empty tables give no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _texts(batches, least, times):
            rows = [(i, *r) for i, runs in zip(batch["doc_id"].to_pylist(), found, strict=True) for r in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "period"])

    return _plain(docs).mapInArrow(task, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs, where texts with runs keep one period of each, their words joined by one space; see periodic_runs.

    Texts without runs, null ones too, and all other columns, of any type and name, are as they were.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, found in _texts(batches, least, times):
            old = batch["text"].cast(pa.binary()).to_pylist()
            new = pa.array([_rest(flat, i, runs) if runs else old[i] for i, runs in enumerate(found)], pa.binary()).cast(batch["text"].type)
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), new)

    return map_rows(docs, task)


def summaries(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """A row for each row of docs: how many runs, the one that repeats most often, digests of the runs and of what stays.

    The run with the greatest length / period, then the smallest start, then period; null without runs.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, found in _texts(batches, least, times):
            rows = []
            for i, (doc_id, runs) in enumerate(zip(batch["doc_id"].to_pylist(), found, strict=True)):
                most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
                rows.append((doc_id, len(runs), *((*most, 1000 * most[1] // most[2]) if most else (None,) * 4), hashlib.sha256(listed).hexdigest(), hashlib.sha256(_rest(flat, i, runs)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _plain(docs).mapInArrow(task, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The words that the contract of the query puts in a document's place, None where it leaves them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def with_planted(docs: DataFrame) -> DataFrame:
    """docs with the repeats of the contract in every tenth of them, about."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = byte_texts(batch["text"])
            made = [planted(i, x.split()) if zlib.crc32(str(i).encode()) % 10 == 0 else None for i, x in zip(batch["doc_id"].to_pylist(), texts, strict=True)]
            new = pa.array([x if m is None else b" ".join(m) for x, m in zip(texts, made, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], new], names=["doc_id", "text"])

    return _plain(docs).mapInArrow(task, "doc_id long, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(with_planted(table(spark, sf_dir, "documents")))
