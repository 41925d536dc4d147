"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of some documents in a row, in blocks of BLOCK ids (the last may be shorter). Of each block the
minimum is subtracted; the width in bits is that which a share of PERCENT of the differences fit, rounded up to half
bytes; the low bits of all
are packed at this width, least significant bit first, and the differences that need more are kept whole in a list of
exceptions. The index has where each block starts, so that any range of ids is read without the blocks before it.

    magic "LMFR", version 2, blocks ..., documents, index, footer
    block: minimum u32, width u8, exceptions u16, packed bits, places of exceptions u8 each, their differences u32 each
    documents: doc_id i64 each, number of ids u64 each, 1 for a doc_id and 0 for a null one u8 each
    index: start of each block in the file u64 each, and the end of the last
    footer: documents' place u64, index's place u64, number of documents u64, of blocks u64, of ids u64, crc32 of
    documents and index u32, magic "LMFR"; integers are little-endian
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import byte_texts, give_back, open_folder, put_file, shared_folder, slices
from leafmill.llm.tables import saved
from leafmill.llm.tokens import WordTokenizer

MAGIC, VERSION = b"LMFR", b"\2"
BLOCK = 256
PERCENT = 90
SHARD_IDS = 3 << 20
END_ID = 2
_HEAD = struct.Struct("<IBH")
_FOOT = struct.Struct("<QQQQQI4s")


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each row's values, (rows, BLOCK * width / 8) bytes."""
    raw = rows.astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)
    if width % 8 == 0:
        return np.ascontiguousarray(raw[:, :, : width // 8]).reshape(len(rows), -1)
    bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    raw = np.zeros((len(packed), BLOCK, 4), np.uint8)
    if width % 8 == 0:
        raw[:, :, : width // 8] = packed.reshape(len(packed), BLOCK, width // 8)
    else:
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
        raw[:, :, : (width + 7) // 8] = np.packbits(bits, axis=2, bitorder="little")
    return raw.view("<u4")[:, :, 0]


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, percent: float = PERCENT) -> bytes:
    """One file of the ids of documents with these ids and numbers of token ids."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks: list[bytes] = []
    for at in range(0, n_blocks, 1024):
        part = ids[at * BLOCK : (at + 1024) * BLOCK]
        n = -(-len(part) // BLOCK)
        full = np.concatenate([part, np.full(n * BLOCK - len(part), part[-1], np.uint32)]).reshape(n, BLOCK)
        low = full.min(axis=1)
        diff = full - low[:, None]
        fits = int(np.ceil(BLOCK * percent / 100))
        widths = np.full(n, 32)
        for width in range(28, -1, -4):  # the least that enough differences fit
            enough = (diff < np.uint32(1 << width)).sum(axis=1) >= fits
            if not enough.any():
                break
            widths[enough] = width
        body: list[bytes] = [b""] * n
        for width in np.unique(widths[widths > 0]):
            here = np.flatnonzero(widths == width)
            size, data = BLOCK * int(width) // 8, _packed(diff[here], int(width)).tobytes()
            for k, i in enumerate(here.tolist()):
                body[i] = data[k * size : (k + 1) * size]
        row, place = np.nonzero(diff > np.array((1 << widths) - 1, np.uint32)[:, None])
        edge = np.searchsorted(row, np.arange(n + 1)).tolist()
        places, values = place.astype(np.uint8).tobytes(), diff[row, place].astype("<u4").tobytes()
        for i, (least, width) in enumerate(zip(low.tolist(), widths.tolist(), strict=True)):
            a, b = edge[i], edge[i + 1]
            blocks.append(_HEAD.pack(least, width, b - a) + body[i] + places[a:b] + values[4 * a : 4 * b])
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8") + 5
    data = b"".join(blocks)
    documents = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + counts.astype("<u8").tobytes() + bytes([x is not None for x in doc_ids])
    index = starts.tobytes()
    place = 5 + len(data)
    return b"".join([MAGIC, VERSION, data, documents, index, _FOOT.pack(place, place + len(documents), len(doc_ids), n_blocks, len(ids), zlib.crc32(documents + index), MAGIC)])


class IdFile:
    """Reads what encode_file has written."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if len(data) < 5 + _FOOT.size or data[:5] != MAGIC + VERSION:
            raise ValueError("not a file of token ids")
        place, index, n_docs, n_blocks, self.n_ids, crc, magic = _FOOT.unpack(self.data[-_FOOT.size :])
        if magic != MAGIC or crc != zlib.crc32(self.data[place : -_FOOT.size]):
            raise ValueError("the file of token ids is damaged")
        self.doc_ids = np.frombuffer(self.data, "<i8", n_docs, place)
        self.counts = np.frombuffer(self.data, "<u8", n_docs, place + 8 * n_docs).astype(np.int64)
        self.nulls = np.frombuffer(self.data, np.uint8, n_docs, place + 16 * n_docs) == 0
        self.starts = np.frombuffer(self.data, "<u8", n_blocks + 1, index).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Those from start to end, from their blocks alone."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        heads = [_HEAD.unpack_from(self.data, self.starts[i]) for i in range(a, b)]
        widths = np.array([h[1] for h in heads])
        out = np.zeros((b - a, BLOCK), np.uint32)
        for width in np.unique(widths):
            here = np.flatnonzero(widths == width)
            if width:
                size = BLOCK * int(width) // 8
                body = b"".join(self.data[p : p + size] for p in self.starts[a + here] + _HEAD.size)
                out[here] = _unpacked(np.frombuffer(body, np.uint8).reshape(len(here), size), int(width))
        for i, (_, width, n) in enumerate(heads):
            if n:
                at = int(self.starts[a + i]) + _HEAD.size + BLOCK * width // 8
                out[i, np.frombuffer(self.data, np.uint8, n, at)] = np.frombuffer(self.data, "<u4", n, at + n)
        out += np.array([h[0] for h in heads], np.uint32)[:, None]
        return out.reshape(-1)[start - a * BLOCK : end - a * BLOCK]


def write_id_files(docs: DataFrame, spark: SparkSession, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order to files in `folder`; returns a row for each file.

    file, part and seq (their order is that of the files), n_docs, n_tokens, start (ids in all files before). A file
    ends with the document that reaches shard_ids, so a document is in one file, however long. The rows are in the
    table `folder`/manifest; a task that runs again writes its files anew, whole or not at all.
    Null texts are empty and have the end id alone; a null doc_id comes first. Rows with one doc_id are ordered by
    their texts' hashes, so a doc_id with very many rows is dealt to several tasks too.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        words, end = WordTokenizer.of(tokenizer, drops_space=False), np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        have: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, have, size, seq
            file = f"ids-{part:06d}-{seq:05d}.lmfr"
            put_file(fs, f"{root}/{file}", encode_file(names, np.array([len(x) // 4 for x in have], np.int64), np.frombuffer(b"".join(have), "<u4")))
            row = pa.RecordBatch.from_pylist([{"file": file, "part": part, "seq": seq, "n_docs": len(names), "n_tokens": size}])
            names, have, size, seq = [], [], 0, seq + 1
            return row

        for batch in slices(batches, most=4 << 20):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(byte_texts(batch["text"])), strict=True):
                names.append(doc_id)
                have.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield flush()
        if names:
            yield flush()
        give_back()  # the tokenizer, and the units that it has met, stay for the worker's next task

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    files = texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, "file string, part long, seq long, n_docs long, n_tokens long")
    manifest = saved(files, spark, f"{folder}/manifest")
    upto = (Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a task
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*upto)), F.lit(0))
    return manifest.withColumn("within", within).join(earlier, "part").withColumn("start", F.col("earlier") + F.col("within")).drop("earlier", "within")


def read_id_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; one file a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordTokenizer.drop()
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{row['file']}") as src:
                    file = IdFile(src.read())
                ends = np.cumsum(file.counts)
                crcs, at = np.zeros(len(ends), np.int64), 0
                while at < len(ends):  # a stretch of documents at a time
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] - file.counts[at] + (1 << 18), "right")))
                    base = int(ends[at] - file.counts[at])
                    raw = memoryview(file.ids(base, int(ends[upto - 1])).astype("<u4").tobytes())
                    for i in range(at, upto):
                        crcs[i] = zlib.crc32(raw[4 * int(ends[i] - file.counts[i] - base) : 4 * int(ends[i] - base)])
                    at = upto
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, mask=file.nulls), pa.array(row["start"] + ends - file.counts), pa.array(file.counts), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return manifest.select("file", "start").repartition(max(1, min(n, 100_000))).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_id_files(write_id_files(docs, spark, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
