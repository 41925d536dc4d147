"""Which tokens of two vocabularies stand for the same bytes of a text, and how often over the corpus.

The bytes of a text are cut at the ends of both vocabularies' tokens (their union, sorted) into elementary intervals. A
search in both arrays of ends gives each interval's two owners, so an interval is one overlap; an interval whose end is
an end in both closes a group; and the links of a group are the product of its tokens on either side.

Both vocabularies cut a text at a single space, and at a line feed, between characters that are no white space: of A by
its pattern, of B because no piece has a space after another character, and line feeds are bytes of their own. What
stands between such places is a unit; groups never go over one. So the distinct units of a batch are encoded and
aligned once, frequent ones once in a worker, and a text is its units in a row.

Counts go by documents: a chunk of documents (a home, some MB of text) sums its pairs first, so that a pair, however
common, is one row a home. The sums go back to the homes, which have kept the pairs of each document by their places in
the home's own list.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import byte_texts, give_back, runs, shared_folder, slices, table
from leafmill.llm.tables import saved
from leafmill.llm.tokens import SHOWN, WordTokenizer

HOME_BYTES = 12 << 20
#: Links of one expansion, so that a long group is expanded in parts.
PART = 1 << 21
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_FEED = re.compile(r"(?<=\S)\n(?=\S)")
_PLAIN_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r")
_SUMS = ("n_a", "n_b", "n_groups", "n_links")
_here: dict[tuple, Units] = {}


def cut(text: str) -> list[str]:
    """The units of a text that has a space before it. One that doesn't follow a space has a line feed before it; a line
    feed between two units is a unit, of two. A text that begins with a line feed has the space before it told."""
    if text[:1] == "\n":
        first, *rest = cut_at_places(text)
        return [f"\n {first}", *rest]
    return cut_at_places(text)


def cut_at_places(text: str) -> list[str]:
    if "\0" in text:
        return [text]
    if not text.isascii() or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(x in text for x in _PLAIN_ODD):
        return _FEED.sub("\0\n\n\0\n", _SPACE.sub("\0", text)).split("\0")
    return text.replace(" ", "\0").replace("\n", "\0\n\n\0\n").split("\0")


class Units:
    """The ids of units in both vocabularies; empty where what they stand for isn't the unit."""

    def __init__(self, a_path: str, b_path: str, units: int = 100_000):
        self.a = WordTokenizer(a_path, drops_space=False, units=units, special_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.units = units
        self.known: dict[str, tuple[bytes, bytes]] = {}
        back = {c: b for b, c in SHOWN.items()}
        vocab = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back.get(c, ord(c) & 255) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece has a space after another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        #: Each id as text, followed by what may stand after it: A's by a comma or a bar, B's by a comma or a semicolon.
        self.said = pa.array([f"{i}{c}" for n, cs in ((len(self.a_bytes), ",|"), (len(pieces), ",;")) for c in cs for i in range(n)])
        self.said_at = np.cumsum([0, len(self.a_bytes), len(self.a_bytes), len(pieces)])

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Units:
        """One for each worker process."""
        if (a_path, b_path) not in _here:
            _here[a_path, b_path] = cls(a_path, b_path)
        return _here[a_path, b_path]

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """B puts a space before a text; a unit that follows none is given with a line feed, and both are taken off."""
        return [ids[2:] if u[:1] == "\n" and u != "\n\n" else ids for u, ids in zip(units, self.b.encode(units, num_threads=1), strict=True)]

    def _feed(self) -> tuple[bytes, bytes]:
        return np.array(self.a.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes(), np.array(self.b.encode("\n")[1:], "<u4").tobytes()

    def ids(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Little-endian unsigned 32-bit ids of each unit in A and B."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > 2 * self.units:
            self.known.clear()
            new = units
        for u, a, b in zip(new, self.a.learn(new), self._b_ids(new), strict=True):
            if u == "\n\n":
                self.known[u] = self._feed()
                continue
            told = (u[1:] if u[:1] == "\n" else f" {u}").encode()
            same = b"".join([self.a_bytes[i] for i in np.frombuffer(a, "<u4").tolist()]) == told == b"".join([self.b_bytes[i] for i in b])
            self.known[u] = (a, np.array(b, "<u4").tobytes()) if same else (b"", b"")
        return [self.known[u] for u in units]


def aligned(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from the bytes of each; both stand for the same bytes in a row."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    ends = np.union1d(a_end, b_end)
    a_owner, b_owner = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)  # of each interval
    closes = (a_end[a_owner] == ends) & (b_end[b_owner] == ends)
    group = np.cumsum(closes) - closes
    return group[np.searchsorted(ends, a_end)], group[np.searchsorted(ends, b_end)]


def _product(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, a, b, how often) of the links of all groups, in parts: distinct ids of a group on either side, multiplied."""

    def distinct(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n = np.unique(group << 32 | ids, return_counts=True)
        return keys >> 32, keys & 0xFFFFFFFF, n

    ag, a, an = distinct(a_ids, a_group)
    bg, b, bn = distinct(b_ids, b_group)
    first = np.searchsorted(bg, ag)
    each = np.searchsorted(bg, ag, "right") - first
    upto = np.cumsum(each)
    at = 0
    while at < len(ag):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
        n = each[at:stop]
        k = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]
        yield ag[k], a[k], b[j], an[k] * bn[j]
        at = stop


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of n of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = runs(keys)[:-1]
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


class _Texts:
    """What a batch of texts gives: a row of sums and the digest for each, and its distinct pairs, sorted by text."""

    def __init__(self, texts: list[str], units: Units):
        cuts = [cut(x) if x else [] for x in texts]
        counts = np.array([len(x) for x in cuts], np.int64)
        numbered = pa.array([u for x in cuts for u in x], pa.string()).dictionary_encode()
        codes = numbered.indices.to_numpy().astype(np.int64)
        ids = units.ids(numbered.dictionary.to_pylist())
        known = np.array([len(a) > 0 for a, _ in ids], bool)
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.zeros(len(texts), bool)
        bad[owner[~known[codes]]] = True  # a unit is not what its tokens stand for: the text has none
        codes, owner = codes[~bad[owner]], owner[~bad[owner]]
        a, b = (np.frombuffer(b"".join([x[side] for x in ids]), "<u4").astype(np.int64) for side in (0, 1))
        a_n, b_n = (np.array([len(x[side]) >> 2 for x in ids], np.int64) for side in (0, 1))
        a_group, b_group = aligned(units.a_size[a], units.b_size[b])
        a_unit, b_unit = (np.repeat(np.arange(len(ids)), n) for n in (a_n, b_n))
        group_unit = np.zeros(int(a_group[-1]) + 1 if len(a) else 0, np.int64)
        group_unit[a_group] = a_unit
        in_a, in_b = np.bincount(a_group, minlength=len(group_unit)), np.bincount(b_group, minlength=len(group_unit))
        each = np.stack([a_n, b_n, np.bincount(group_unit, minlength=len(ids)), np.bincount(group_unit, in_a * in_b, len(ids)).astype(np.int64)])
        self.sums = np.stack([np.bincount(owner, x[codes], len(texts)).astype(np.int64) for x in each])
        self.digests = self._digests(units, len(texts), codes, owner, len(ids), (a, a_group, a_unit, in_a), (b, b_group, b_unit, in_b))
        self._pairs(a, a_group, b, b_group, group_unit, len(ids), codes, owner)

    def _digests(self, units: Units, n_texts: int, codes: np.ndarray, owner: np.ndarray, n_units: int, a: tuple, b: tuple) -> list[str]:
        """sha256 of the groups as text: of each group the tokens of A, then those of B."""
        (a_ids, a_group, a_unit, in_a), (b_ids, b_group, b_unit, in_b) = a, b
        ends_a, ends_b = np.append(a_group[1:] != a_group[:-1], True)[: len(a_ids)], np.append(b_group[1:] != b_group[:-1], True)[: len(b_ids)]
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        unit = np.empty_like(order)
        place_a = np.arange(len(a_ids)) + (np.cumsum(in_b) - in_b)[a_group]
        place_b = np.arange(len(b_ids)) + np.cumsum(in_a)[b_group]
        at = units.said_at
        order[place_a], order[place_b] = a_ids + at[ends_a.astype(int)], b_ids + at[2 + ends_b.astype(int)]
        unit[place_a], unit[place_b] = a_unit, b_unit
        told = units.said.take(pa.array(order))
        byte_at = np.frombuffer(told.buffers()[1], np.int32, len(told) + 1)[np.searchsorted(unit, np.arange(n_units + 1))] if len(told) else np.zeros(n_units + 1, np.int32)
        pieces = pa.LargeStringArray.from_buffers(n_units, pa.py_buffer(byte_at.astype(np.int64).tobytes()), told.buffers()[2]) if len(told) else pa.array([""] * n_units, pa.large_string())
        whole = pieces.take(pa.array(codes))
        ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1) if len(whole) else np.zeros(1, np.int64)
        raw = memoryview(whole.buffers()[2]) if len(whole) else b""
        first = np.searchsorted(owner, np.arange(n_texts + 1))
        return [hashlib.sha256(raw[ends[i] : ends[j] - 1]).hexdigest() if j > i else "" for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def _pairs(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, group_unit: np.ndarray, n_units: int, codes: np.ndarray, owner: np.ndarray) -> None:
        """text, pair (both ids in one number) and n of the distinct pairs of each text."""
        unit, pair, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group, x, y, n in _product(a, a_group, b, b_group):
            unit.append(group_unit[group])
            pair.append(x << 32 | y)
            times.append(n)
        unit, pair, times = (np.concatenate(x) for x in (unit, pair, times))  # by unit, as groups are
        first = np.searchsorted(unit, np.arange(n_units + 1))
        used, often = np.unique(owner * max(n_units, 1) + codes, return_counts=True)  # distinct units of each text
        text, code = used // max(n_units, 1), used % max(n_units, 1)
        names, number = np.unique(pair, return_inverse=True)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = first[code + 1] - first[code]
        upto = np.cumsum(size)
        at = 0
        while at < len(code):  # some whole texts at a time
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
            n = size[at:stop]
            k = np.repeat(np.arange(at, stop), n)
            j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[code[k]]
            found.append(_sums(text[k] * len(names) + number[j], often[k] * times[j]))
            at = stop
        keys, self.n = _sums(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2
        self.text, self.pair, self.n = (keys // max(len(names), 1)).astype(np.int32), names[keys % max(len(names), 1)] if len(names) else keys, self.n.astype(np.int32)


_TOLD = f"home long, doc_id long, {', '.join(f'{x} long' for x in _SUMS)}, groups_sha256 string, places array<int>, times array<int>, place int, a int, b int, n long"


def _told(docs: DataFrame, a_path: str, b_path: str, most: int) -> DataFrame:
    """Two kinds of rows: of each document its sums and pairs, as places in the home's list; and the home's list of
    pairs (place, a, b), with how many of its documents have each (n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        units = Units.of(a_path, b_path)
        part, count, size = TaskContext.get().partitionId(), 0, 0
        have: list[tuple[list[int | None], _Texts]] = []
        ints = lambda xs, t: pa.array(xs, t)

        def home() -> Iterator[pa.RecordBatch]:
            nonlocal have, size, count
            number = (part << 24) + count
            names = np.unique(np.concatenate([t.pair for _, t in have]))
            docs_with = np.zeros(len(names), np.int64)
            for ids, t in have:
                place = np.searchsorted(names, t.pair)
                docs_with += np.bincount(place, minlength=len(names))
                ends = np.searchsorted(t.text, np.arange(len(ids) + 1)).astype(np.int32)
                n = len(ids)
                yield _rows([pa.array([number] * n), ints(ids, pa.int64()), *map(pa.array, t.sums), pa.array(t.digests, pa.string()), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(t.n.astype(np.int32)))], n)
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield _rows([pa.array([number] * len(some)), *[None] * 8, pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array((some >> 32).astype(np.int32)), pa.array((some & 0xFFFFFFFF).astype(np.int32)), pa.array(docs_with[i : i + len(some)])], len(some))
            have, size, count = [], 0, count + 1

        for batch in slices(batches, most=min(most, 2 << 20)):
            texts = byte_texts(batch["text"])
            have.append((batch["doc_id"].to_pylist(), _Texts([x.decode() for x in texts], units)))
            size += sum(map(len, texts))
            if size >= most:
                yield from home()
        if have:
            yield from home()
        _here.clear()
        give_back()

    return docs.mapInArrow(task, _TOLD)


_KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
_NAMES = ["home", "doc_id", *_SUMS, "groups_sha256", "places", "times", "place", "a", "b", "n"]


def _rows(columns: list[pa.Array | None], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c.cast(t) for c, t in zip([*columns, *[None] * (len(_KINDS) - len(columns))], _KINDS, strict=True)], names=_NAMES)


def _scored(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """A home's documents with count_sum and n_best: replies has place, count and best of each pair of its list."""
    place = replies["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = replies["count"].to_numpy(), replies["best"].to_numpy()
    at, times = pc.list_flatten(rows["places"]).to_numpy(), pc.list_flatten(rows["times"]).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["places"]).to_numpy())
    sums = [np.zeros(rows.num_rows, np.int64) for _ in range(2)]
    np.add.at(sums[0], owner, np.where(best[at], times, 0))
    np.add.at(sums[1], owner, times * count[at])
    names = ["doc_id", *_SUMS, "groups_sha256"]
    return pa.table([*(rows[x] for x in names), *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])


def align(docs: DataFrame, spark: SparkSession, a_path: str, b_path: str, most: int = HOME_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of docs.

    Documents: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is in most documents of all pairs of
    its A id, ties too), count_sum (over links: documents that have the pair), groups_sha256 (of the groups as
    "a1,a2|b1;a3|b2,b3"). Pairs: a, b, count (documents that have them linked).

    A byte-level vocabulary (A) reads a space and the text, a sentencepiece model (B) the text, before which it puts a
    space itself; strings of special tokens are text. Null and empty texts, and those that the tokens of either don't
    stand for byte by byte, have no tokens: zeros and ''. Repeated rows are documents of their own; a null doc_id stays
    null. A text is one task's, which holds its tokens and distinct pairs. Other columns are not read; empty tables give
    no rows. A row's chunk and place are written in one pass, so nothing depends on the input's order.
    """
    folder = shared_folder(spark, "alignment")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = saved(_told(plain, a_path, b_path, most), spark, f"{folder}/told")
    listed = told.filter("place IS NOT NULL").select("home", "place", "a", "b", "n")
    counts = saved(listed.groupBy("a", "b").agg(F.sum("n").alias("count")), spark, f"{folder}/counts")
    most_of = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row an id of A: bounded by its vocabulary
    judged = counts.join(F.broadcast(most_of), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    replies = listed.join(judged, ["a", "b"]).select(F.col("home").alias("to"), "place", "count", "best")
    rows = told.filter("place IS NULL").drop("place", "a", "b", "n")
    out = rows.groupBy("home").cogroup(replies.groupBy("to")).applyInArrow(_scored, f"doc_id long, {', '.join(f'{x} long' for x in _SUMS)}, groups_sha256 string, n_best long, count_sum long")
    return out, counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
