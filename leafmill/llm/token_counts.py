"""Numbers of tokens of whole texts, huge ones by overlapping chunks that are spliced where both encodings agree.

A text of up to CHUNK characters is encoded whole. A longer one is dealt to many tasks as chunks; each is encoded, with
offsets, together with `width` characters of the chunks beside it. Two neighbours thus have encoded the same characters
around the seam between them, and are spliced at a place there that is

* proven: a single space or line feed between two other characters that are no white space. The vocabularies' own
  patterns never join what stands before such a place with what follows, nor do their normalizers and special tokens, so
  a text is encoded there as its two parts are;
* common: in both encodings no token goes over the place, and the tokens beside it, with their offsets, are the same.

What the left chunk has before that place and the right chunk from there on are then the whole text's tokens. Where a
seam has no such place (a long passage without white space), the text's chunks are joined by twos and the overlaps
made twice as wide, until all seams are spliced or the text is one chunk.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm.common import byte_texts, give_back, shared_folder, slices, table
from leafmill.llm.tables import saved
from leafmill.llm.tokens import WordTokenizer

CHUNK, WIDTH, LIMIT = 1 << 15, 256, 2048
_PLACE = re.compile(r"(?<=\S)[ \n](?=\S)")
_PART = "key long, doc_id long, n_bytes long, n_tokens long, no long, of long, core string"
_SIDE = "array<struct<place: long, near: long, before: long>>"


def places(text: str, start: int, stop: int) -> list[int]:
    """Proven places from start to stop: no token goes over one, whatever stands around."""
    return [m.start() for m in _PLACE.finditer(text, max(start, 1), stop) if m.start() + 1 < len(text)]


def _sides(text: str, ids: list[int], offsets: list[tuple[int, int]], start: int, stop: int, seam: int) -> list[tuple[int, int, int]]:
    """(place from the seam, digest of the tokens beside it, tokens before it) where no token goes over the place."""
    starts = np.array([a for a, _ in offsets], np.int64)
    out = []
    for p in places(text, start, stop):
        k = int(np.searchsorted(starts, p))
        if 0 < k < len(ids) and offsets[k - 1][1] <= p:
            near = [(ids[i], offsets[i][0] - p, offsets[i][1] - p) for i in (k - 1, k)]
            out.append((p - seam, zlib.crc32(repr(near).encode()), k))
    return out


def _encoded(around: DataFrame, tokenizer: str) -> DataFrame:
    """key, no, n (tokens of a chunk with what is around it), left and right: where its seams may be."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(tokenizer)
        for batch in slices(batches, "core"):
            rows = []
            for key, no, before, core, after in zip(*(batch[c].to_pylist() for c in ("key", "no", "before", "core", "after")), strict=True):
                text, a = (before or "") + core + (after or ""), len(before or "")
                b = a + len(core)
                told = library.encode(text, add_special_tokens=False)
                ids, offsets = told.ids, told.offsets
                left = [] if before is None else _sides(text, ids, offsets, 0, 2 * a, a)
                right = [] if after is None else _sides(text, ids, offsets, 2 * b - len(text), len(text), b)
                rows.append({"key": key, "no": no, "n": len(ids), **{side: [dict(zip(("place", "near", "before"), x, strict=True)) for x in found] for side, found in (("left", left), ("right", right))}})
            side = pa.list_(pa.struct([("place", pa.int64()), ("near", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("left", side), ("right", side)]))

    return around.mapInArrow(task, f"key long, no long, n long, left {_SIDE}, right {_SIDE}")


def _joined(chunks: DataFrame, tokenizer: str, width: int, spark: SparkSession, folder: str) -> DataFrame:
    """key, n_tokens of each text of chunks (key, no, of, core); n_tokens is null where a seam has no common place."""
    head, tail = F.substring("core", 1, width), F.expr(f"right(core, {width})")
    before = chunks.select("key", (F.col("no") + 1).alias("no"), tail.alias("before"))
    after = chunks.select("key", (F.col("no") - 1).alias("no"), head.alias("after"))
    dealt = chunks.select("key", "no", "core").join(before, ["key", "no"], "left").join(after, ["key", "no"], "left")
    coded = saved(_encoded(dealt, tokenizer), spark, f"{folder}/coded-{width}")
    side = lambda name, seam, as_: coded.select("key", (F.col("no") + seam).alias("seam"), F.inline(name)).withColumnRenamed("before", as_)
    common = side("right", 0, "till").join(side("left", -1, "since"), ["key", "seam", "place", "near"])
    seams = common.groupBy("key", "seam").agg(F.min_by(F.col("till") - F.col("since"), F.struct(F.abs("place"), "place")).alias("more"))
    told = seams.groupBy("key").agg(F.count("*").alias("n_seams"), F.sum("more").alias("more"))
    last = chunks.filter("no = of - 1").select("key", "no", "of").join(coded.select("key", "no", "n"), ["key", "no"])
    whole = F.coalesce("n_seams", F.lit(0)) == F.col("of") - 1
    return last.join(told, "key", "left").select("key", F.when(whole, F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, spark: SparkSession, tokenizer: str, drops_space: bool, limit: int = LIMIT, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each row of docs.

    As the library counts them, without added tokens; strings of special tokens in a text become such tokens, as is its
    default. tokenizer: one of the vocabularies that WordTokenizer takes, which say whether they ignore white space.
    Null and empty texts have no tokens. Repeated rows are counted as often as they come; a null doc_id stays null.
    Of a text longer than `chunk` characters no task but the one that reads it holds more than a chunk, unless it has no
    white space. Other columns are not read; empty tables give no rows.
    """
    folder = shared_folder(spark, "counts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = WordTokenizer.of(tokenizer, drops_space)
        first, n = TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([*((x, pa.int64()) for x in ("key", "doc_id", "n_bytes", "n_tokens", "no", "of")), ("core", pa.string())])
        for batch in slices(batches, most=4 << 20):
            texts, doc_ids = byte_texts(batch["text"]), batch["doc_id"].to_pylist()
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            ids = words.encode([texts[i] for i in short])
            rest = [None] * len(short)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((rest, [doc_ids[i] for i in short], [len(texts[i]) for i in short], [len(x) // 4 for x in ids], rest, rest, rest), schema.types, strict=True)], schema=schema)
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    text = x.decode()
                    of = -(-len(text) // chunk)
                    for no in range(of):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((first + n, doc_ids[i], len(x), None, no, of, text[no * chunk : (no + 1) * chunk]), schema.types, strict=True)], schema=schema)
                    n += 1
        words.forget()
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = saved(plain.mapInArrow(task, _PART), spark, f"{folder}/parts")
    chunks, done = parts.filter("key IS NOT NULL").select("key", "no", "of", "core"), []
    while True:
        joined = saved(_joined(chunks, tokenizer, width, spark, folder), spark, f"{folder}/joined-{width}")
        done.append(joined.filter("n_tokens IS NOT NULL"))
        again = joined.filter("n_tokens IS NULL").select("key")
        if again.isEmpty():
            break
        twos = chunks.join(again, "key", "left_semi").groupBy("key", F.floor(F.col("no") / 2).alias("no"), F.ceil(F.col("of") / 2).alias("of"))
        chunks, width = saved(twos.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("no").alias("at"), "core"))), lambda x: x["core"]), "").alias("core")), spark, f"{folder}/chunks-{2 * width}"), 2 * width
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    long = parts.filter("no = 0").select("key", "doc_id", "n_bytes").join(counts, "key").drop("key")
    told = parts.filter("key IS NULL").select("doc_id", "n_bytes", "n_tokens").unionByName(long)
    return told.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
