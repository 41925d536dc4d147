"""Substring deduplication by seed and extend on winnowed anchors.

Anchors are K-word grams chosen by winnowing: of every N - K + 1 grams in a row the smallest hash, the last on ties.
Equal passages of N words choose equal anchors, so a passage of N words or more that two documents share has an anchor
that both send. The seeds are the anchors found in two documents or more. Each seed is extended both ways, a word at a
time: a step is a window of N words whose anchor is the seed, and it holds if the window starts in a document with a
smaller id too (128 bits of hashes of its words decide). Steps that hold in a row are a maximal repeat, and
its words are removed from every document but the one with the smallest id.

Anchors and windows are exchanged between homes (see homes.py): a home sends a key once, however many of its documents
hold it, so copies by the thousand and passages in a third of all documents cost a row a home, and no pairs of
documents are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.common import U64, Flat, byte_texts, give_back, runs, shared_folder, window_hashes, word_hashes
from leafmill.llm.homes import key_runs, read_home, settle, text_slices

MIN_WORDS = 13
GRAM_WORDS = 5
KEYS = "home long, key long, key2 long, doc long, kind int"
_KEYS = pa.schema([("home", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("kind", pa.int32())])
#: kind of a row: a home that must answer, a key found in one document of the home, a key found in several.
HOME, ONE, MANY = 0, 1, 2
#: What a null id counts as.
NO_ID = -(1 << 63)


class _Windows:
    """Windows of n words in a piece of a home: the word each starts at, and their anchors."""

    def __init__(self, rows: pa.Table, n: int, gram: int):
        self.flat = flat = Flat(byte_texts(rows["text"]))
        self.ids = np.array([NO_ID if x is None else x for x in rows["doc_id"].to_pylist()], np.int64)
        self.n, self.gram = n, gram
        self.at = np.flatnonzero(np.arange(len(flat.start)) + n <= flat.stop)
        self.one, self.two = word_hashes(flat.words)

    def grams(self) -> np.ndarray:
        """Hash of the gram at each word; past a text's last gram it isn't used."""
        n = len(self.flat.start)
        full = max(n - self.gram + 1, 0)
        return np.concatenate([window_hashes(self.one, np.arange(full), self.gram, 11), np.zeros(n - full, U64)])

    def chosen(self, grams: np.ndarray) -> np.ndarray:
        """For each window the word at which its anchor starts."""
        best, least = self.at.copy(), grams[self.at]
        for j in range(1, self.n - self.gram + 1):
            h = grams[self.at + j]
            less = h <= least
            best[less], least[less] = self.at[less] + j, h[less]
        return best

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, of other halves of its words' 128 bits."""
        return window_hashes(self.one, at, self.n, 11).view(np.int64), window_hashes(self.two, at, self.n, 23).view(np.int64)


def _batch(home: int, key: np.ndarray, key2: np.ndarray | None = None, doc: np.ndarray | None = None, kind: np.ndarray | int = ONE) -> pa.RecordBatch:
    n = len(key)
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, home, np.int64)), pa.array(key), pa.array(zero if key2 is None else key2), pa.array(zero if doc is None else doc), pa.array(np.full(n, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32))], schema=_KEYS)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def removed_words(docs: DataFrame, spark: SparkSession, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start and end word of each maximal repeat that goes), text (what is left).

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage return, taken as they are.
    Where nothing is removed, `text` is the text as it was; else removed words go with the white space before them.
    Null texts have no words; texts shorter than min_words keep all. Rows that repeat a doc_id count as one document:
    a repeat within it doesn't remove. A null doc_id counts as -2^63, so it is below all others, and stays null. Empty tables give no rows. Columns of docs
    named in carry are returned in the struct `rest`, whatever their names; others are not read. docs must have the same
    partitions when it is computed again, as a scan of files has; save what has not.
    """
    if not 0 < gram_words <= min_words:
        raise ValueError("gram_words must be between 1 and min_words")
    folder = shared_folder(spark, "substring")
    rest = F.struct(*(F.col("`" + x.replace("`", "``") + "`").alias(x) for x in carry)) if carry else F.lit(None).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    fields = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>, text string"), texts.schema["rest"]])

    def seeds(home: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield _batch(home, np.array([home], np.int64), kind=HOME)
        parts = []
        for piece in text_slices(rows):
            w = _Windows(piece, min_words, gram_words)
            if len(w.at):
                grams = w.grams()
                at = np.unique(w.chosen(grams))
                parts.append((grams[at].view(np.int64), w.ids[w.flat.owner[at]]))
        if parts:
            key, doc = _merged(parts)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            cut = runs(key)[:-1]
            new = np.ones(len(key), np.int32)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            docs_of = np.add.reduceat(new, cut)
            yield _batch(home, key[cut], kind=np.where(docs_of > 1, MANY, ONE))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of two documents or more, to each home that has them."""

        def reply(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            kind = rows["kind"].to_numpy()
            home = rows["home"].to_numpy()
            word = (kind != HOME).astype(np.int64)
            total = np.add.reduceat(kind * word, starts[:-1])
            keep = np.repeat(total > 1, np.diff(starts)) | (kind == HOME)
            return pa.RecordBatch.from_arrays([pa.array(home[keep]), pa.array(rows["key"].to_numpy()[keep]), pa.array(rows["key2"].to_numpy()[keep]), pa.array(rows["doc"].to_numpy()[keep]), pa.array(kind[keep])], schema=_KEYS)

        return key_runs(batches, reply, ("key",))

    def extend(group: pa.Table) -> pa.Table:
        """The windows around the seeds, each with its smallest document in this home."""
        home, kind = group["home"][0].as_py(), group["kind"].to_numpy()
        seeds_here = np.unique(group["key"].to_numpy()[kind != HOME])
        out = [_batch(home, np.array([home], np.int64), kind=HOME)]
        parts = []
        if len(seeds_here):
            for piece in text_slices(read_home(folder, home)):
                w = _Windows(piece, min_words, gram_words)
                if not len(w.at):
                    continue
                grams = w.grams()
                key = grams[w.chosen(grams)].view(np.int64)
                at = w.at[seeds_here[np.minimum(np.searchsorted(seeds_here, key), len(seeds_here) - 1)] == key]
                if len(at):
                    parts.append((*w.keys(at), w.ids[w.flat.owner[at]]))
        if parts:
            key, key2, doc = _merged(parts)
            order = np.lexsort((doc, key2, key))
            key, key2, doc = key[order], key2[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
            cut = np.flatnonzero(new)
            last = np.concatenate([cut[1:], [len(key)]]) - 1
            out.append(_batch(home, key[cut], key2[cut], doc[cut], np.where(doc[last] > doc[cut], MANY, ONE)))
            del parts, key, key2, doc, order, new
        give_back()
        return pa.Table.from_batches(out)

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For windows of two documents or more the smallest one, to each home that has a larger one."""

        def reply(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            kind, doc = rows["kind"].to_numpy(), rows["doc"].to_numpy()
            least = np.repeat(np.minimum.reduceat(doc, starts[:-1]), np.diff(starts))
            keep = (kind == HOME) | (kind == MANY) | (doc > least)
            return pa.RecordBatch.from_arrays([pa.array(rows["home"].to_numpy()[keep]), pa.array(rows["key"].to_numpy()[keep]), pa.array(rows["key2"].to_numpy()[keep]), pa.array(least[keep]), pa.array(kind[keep])], schema=_KEYS)

        return key_runs(batches, reply, ("key", "key2"))

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])

    def cut(group: pa.Table) -> pa.Table:
        home, found = group["home"][0].as_py(), group["kind"].to_numpy() != HOME
        key, key2, least = (group[x].to_numpy()[found] for x in ("key", "key2", "doc"))
        order = np.lexsort((key2, key))
        key, key2, least = key[order], key2[order], least[order]
        out, rests = [], []
        for piece in text_slices(read_home(folder, home)):
            w = _Windows(piece, min_words, gram_words)
            flat, n = w.flat, len(w.flat.start)
            edge = np.zeros(n + 1, np.int64)
            if len(w.at) and len(key):
                k1, k2 = w.keys(w.at)
                lo = np.searchsorted(key, k1)
                near = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == k1)
                at, lo, k1, k2 = w.at[near], lo[near], k1[near], k2[near]
                hit = np.zeros(len(at), bool)
                doc = w.ids[flat.owner[at]]
                while len(lo):  # past windows that share the first hash only
                    same = (lo < len(key)) & (key[np.minimum(lo, len(key) - 1)] == k1)
                    match = same & (key2[np.minimum(lo, len(key) - 1)] == k2)
                    hit |= match & (doc > least[np.minimum(lo, len(key) - 1)])
                    if not (same & ~match).any():
                        break
                    lo = lo + (same & ~match)
                np.add.at(edge, at[hit], 1)
                np.add.at(edge, at[hit] + min_words, -1)
            gone = np.cumsum(edge[:n]) > 0
            texts = byte_texts(piece["text"])
            for i, doc_id in enumerate(piece["doc_id"].to_pylist()):
                a, b = int(flat.first[i]), int(flat.first[i + 1])
                mask = gone[a:b]
                removed = int(mask.sum())
                words = flat.raw[flat.start[a] : flat.end[b - 1]] if b > a else b""
                spans, text = [], texts[i]
                if removed:
                    bounds = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans = [{"start": int(x), "end": int(y)} for x, y in bounds.reshape(-1, 2)]
                    kept = words.split()
                    words = b" ".join([x for x, g in zip(kept, mask, strict=True) if not g])
                    text = _without(texts[i], kept, mask)
                out.append((doc_id, b - a, removed, hashlib.sha256(words).hexdigest(), spans, text.decode()))
            rests.append(piece["rest"])
        del key, key2, least, order
        give_back()
        made = pa.Table.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*out, strict=True), result, strict=True)], schema=result)
        return made.append_column("rest", pa.chunked_array([c for r in rests for c in r.chunks], rests[0].type))

    sent = settle(texts, folder, seeds, KEYS)
    asked = sent.repartition("key").sortWithinPartitions("key").mapInArrow(shared, KEYS)
    steps = asked.groupBy("home").applyInArrow(extend, KEYS)
    found = steps.repartition("key").sortWithinPartitions("key", "key2").mapInArrow(earliest, KEYS)
    return found.groupBy("home").applyInArrow(cut, fields)


def _without(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space before them; what is left keeps its own."""
    out, at = [], 0
    for word, g in zip(words, gone, strict=True):
        start = text.index(word, at)
        if not g:
            out.append(text[at:start] if out else b"")
            out.append(word)
        at = start + len(word)
    return b"".join(out)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return removed_words(docs, spark).select("doc_id", "n_words", "n_removed", "kept_sha256")
