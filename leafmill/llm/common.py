"""What the training-data operators share: text batches, word spans, span hashes and the shared folder."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests), one is chosen below /tmp, which is right on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/leafmill-shared"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not urlsplit(base).scheme:  # a path of the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/leafmill-{label}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """Works for file, hdfs, s3 and gs URIs, as pyarrow does."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(fs: pafs.FileSystem, path: str, data: bytes | pa.Buffer) -> None:
    """Whole or not at all: a second attempt of a task replaces what the first has left."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def map_rows(docs: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs.mapInArrow(task) with the schema of docs, whose columns besides doc_id and text may have any name."""
    plain = docs.toDF(*(x if x in ("doc_id", "text") else f"_{i}" for i, x in enumerate(docs.columns)))
    return plain.mapInArrow(task, plain.schema).toDF(*docs.columns)


def fold(doc_id: object, n: int) -> int:
    """crc32 of the id as text, mod n; a null id falls in fold 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def fold_column(doc_id: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows into pieces of about `most` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch[text].cast(pa.binary())).to_pylist()], np.int64)
        start = 0
        total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Lets the system have the memory that a task no longer uses, as the worker may live on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


class Flat:
    """The words of many texts in one byte array.

    Words are what bytes.split() gives: runs without space, tab, line feed, vertical tab, form feed and carriage return.
    start, end: the byte span of each word in `data`, where words are joined by one space.
    first: for each text, the number of its first word; one more at the end.
    """

    def __init__(self, texts: list[bytes]):
        words = [x.split() for x in texts]
        #: The words of all texts in a row.
        self.words = [w for x in words for w in x]
        counts = np.array([len(x) for x in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.raw = b" ".join(self.words)
        self.data = np.frombuffer(self.raw, np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        n = int(self.first[-1])
        self.start = np.concatenate([[0], gaps + 1])[:n].astype(np.int64)
        self.end = np.concatenate([gaps, [len(self.data)]])[:n].astype(np.int64)
        #: The text of each word, and the end (as a word number) of that text.
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
        self.stop = self.first[1:][self.owner] if n else np.zeros(0, np.int64)
        self.counts = counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of MurmurHash3, so that all bits of a sum count in all bits of the key."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit XXH3 of each word's bytes."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return halves[:, 0].astype(U64), halves[:, 1].astype(U64)


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hashes of the windows of `width` words that start at `at`: the words' hashes, each times a number drawn for its place.

    Windows of other words collide by chance only, whatever pattern the words follow; that of several hashes (two
    halves, two seeds) is the product of their chances.
    """
    factors = np.random.default_rng([seed, width]).integers(0, MASK64, width, dtype=U64, endpoint=True) | U64(1)
    out = np.full(len(at), width * 0x9E3779B97F4A7C15 & MASK64, U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += hashes[at + j] * factors[j]
    return mix(out)


_hashers: dict[int, SpanHash] = {}


class SpanHash:
    """64-bit hashes of byte spans from prefix sums of table[byte] * base^i, modulo 2^64, whatever the span's place.

    Spans that follow certain patterns collide under every seed, so these only select what is then compared byte by byte.
    The table is drawn by the seed; the base and its powers are the same for all, and kept once in a process.
    """

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up = down = np.ones(1, U64)

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, MASK64, 256, dtype=U64, endpoint=True)

    @classmethod
    def of(cls, seed: int) -> SpanHash:
        """One for each worker process."""
        if seed not in _hashers:
            _hashers[seed] = cls(seed)
        return _hashers[seed]

    @classmethod
    def _grow(cls, n: int) -> None:
        with np.errstate(over="ignore"):
            while len(cls.up) <= n:
                m = len(cls.up)
                cls.up = np.concatenate([cls.up, cls.up * U64(pow(cls.base, m, 1 << 64))])
                cls.down = np.concatenate([cls.down, cls.down * U64(pow(cls.inverse, m, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.down[start] + U64(0x9E3779B97F4A7C15) * (end - start).astype(U64))


def runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).astype(np.int64)
