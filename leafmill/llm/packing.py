"""Best-fit packing of documents into sequences by patterns and non-negative least squares.

A pattern is a few lengths that together fill a sequence. Only the histogram of lengths (as many numbers as a sequence
has tokens, whatever the corpus) comes to the driver. There patterns of two and three lengths, and of one length
several times with what is left, are enumerated, how often each is used is fitted to the histogram by non-negative
least squares, rounded down, and the residual lengths are packed best-fit decreasing, in classes of bins alike. The result is a list of slots: of length L the pieces of rank
a to b go to these sequences at these offsets. Ranks are dealt in chunks of each length, so a length that a third of
all pieces have is no task's alone.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import byte_texts, give_back, shared_folder, slices
from leafmill.llm.tables import saved
from leafmill.llm.tokens import WordTokenizer

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of the documents, cut if longer than capacity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = WordTokenizer.of(tokenizer, drops_space=True), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, most=1 << 20 if with_ids else 4 << 20):  # rows with ids are larger
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(byte_texts(batch["text"])), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        words.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, PIECES + (", ids array<int>" if with_ids else ""))


def patterns_of(counts: dict[int, int], capacity: int, partners: int = 6, most: int = 9) -> list[tuple[int, ...]]:
    """Patterns of present lengths that fill a sequence exactly, of `most` documents at most.

    Pairs, triples (for each first length with the most frequent second ones), and a length as often as it fits with
    one that fills the rest. What no pattern takes is packed best-fit, so partners bounds the work, not what is packed.
    """
    present = sorted(counts, reverse=True)
    common = sorted(counts, key=lambda x: (-counts[x], -x))
    found = {(a, capacity - a) for a in present if 2 * a >= capacity and capacity - a in counts}
    for a in present:
        times, rest = divmod(capacity, a)
        if 2 < times + (rest > 0) <= most and (not rest or rest in counts):
            found.add((a,) * times + ((rest,) if rest else ()))
        left, got = capacity - a, 0
        for b in common:
            c = left - b
            if 0 < c <= b <= a and c in counts:
                found.add((a, b, c))
                got += 1
                if got == partners:
                    break
    return sorted(found, reverse=True)


def fitted(counts: dict[int, int], patterns: list[tuple[int, ...]], sweeps: int = 40) -> list[float]:
    """x >= 0 that makes the sum of the squares of (counts - what x patterns use) small, by coordinate descent."""
    left = {k: float(v) for k, v in counts.items()}
    uses = []
    for p in patterns:
        rows: dict[int, int] = defaultdict(int)
        for k in p:
            rows[k] += 1
        uses.append((list(rows.items()), float(sum(m * m for m in rows.values()))))
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, (rows, norm) in enumerate(uses):
            step = max(-x[i], sum(m * left[k] for k, m in rows) / norm)
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for k, m in rows:
                    left[k] -= m * step
        if moved < 0.01:
            break
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many in a sequence)]) of all sequences that hold the lengths counted."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is over the capacity")
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if capacity in left:
        out.append((left.pop(capacity), [(capacity, 1)]))
    patterns = patterns_of(left, capacity)
    for p, x in sorted(zip(patterns, fitted(left, patterns), strict=True), key=lambda t: -t[1]):
        rows = [(k, p.count(k)) for k in dict.fromkeys(p)]
        n = min([int(x), *(left[k] // m for k, m in rows)])
        if n > 0:
            out.append((n, rows))
            for k, m in rows:
                left[k] -= m * n
    room: list[list[tuple[int, tuple[tuple[int, int], ...]]]] = [[] for _ in range(capacity + 1)]
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            r = next((r for r in range(k, capacity) if room[r]), None)  # the fullest bins that still have room
            if r is None:
                each = capacity // k
                whole, rest = divmod(n, each)
                if whole:
                    room[capacity - each * k].append((whole, ((k, each),)))
                if rest:
                    room[capacity - rest * k].append((1, ((k, rest),)))
                n = 0
                continue
            bins, rows = room[r].pop()
            took = min(bins, n)
            if took < bins:
                room[r].append((bins - took, rows))
            last = (k, rows[-1][1] + 1) if rows[-1][0] == k else None
            room[r - k].append((took, (*rows[:-1], last) if last else (*rows, (k, 1))))
            n -= took
    out += [(bins, list(rows)) for group in room for bins, rows in group]
    return out


def slots(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, how many in a sequence, first sequence, first offset), sorted."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for repeats, rows in made:
        offset = 0
        for k, m in rows:
            out.append((k, used[k], m, sequence, offset))
            used[k] += repeats * m
            offset += k * m
        sequence += repeats
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def placed(cut: DataFrame, spark: SparkSession, capacity: int = CAPACITY) -> DataFrame:
    """cut (see pieces; read twice) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slot = slots(plan(counts, capacity))
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("local", local).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "chunk")

    names = cut.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slot[:, 0] << 44) + slot[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            within = rank - slot[k, 1]
            sequence, offset = slot[k, 3] + within // slot[k, 2], slot[k, 4] + within % slot[k, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(task, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with the sequence that each is in and its offset there.

    Null texts are empty and have the end id alone. Repeated rows are packed as often as they come; a null doc_id stays
    null. Empty tables give no rows; columns besides doc_id and text are not read.
    """
    cut = saved(pieces(docs, tokenizer, capacity, end_id, with_ids), spark, shared_folder(spark, "pieces"))
    return placed(cut, spark, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of the sequences of pack(..., with_ids=True); a group holds one sequence."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).alias("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark, public_tokenizers.path("word_bpe_49k.json"))
