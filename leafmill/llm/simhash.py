"""Near duplicates by SimHash: pigeonhole blocks, a join on them, then the Hamming distance.

A fingerprint of 64 bits is split into four blocks of 16. Two that differ in at most two bits agree on two blocks at
least, so each is keyed by its six pairs of blocks, pairs of fingerprints meet where a key is equal, and their distance
is verified in the join. Documents with one fingerprint are one class throughout: links are looked for between
distinct fingerprints only, and copies never become pairs.

A key that more than LARGE distinct fingerprints share (many near copies of one text) isn't joined with itself. Its
fingerprints are linked exactly by way of their neighbours: each sends itself and its 64 neighbours at one bit; two
that send the same value differ in two bits or fewer, and two that differ in two bits or fewer send the same value.
A value is sent by 65 fingerprints at most, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import byte_texts, shared_folder, slices
from leafmill.llm.tables import components, kept_rows, saved, text_key

SEED = 42
SHINGLE = 3
LARGE = 64
#: The bits of each pair of blocks.
MASKS = [sum(0xFFFF << (16 * b) for b in pair) for pair in combinations(range(4), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the words of one text, A-Z lower-cased; 0 without words. Over half of the shingles must have a bit."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in map(b" ".join, grams)]), np.uint8).reshape(-1, 8))


def majority(digests: np.ndarray) -> int:
    """The fingerprint of shingles' hashes, rows of eight bytes: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(digests), 1 << 14):
        ones += np.unpackbits(digests[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row; null texts have no words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_signed(fingerprint(x, shingle)) for x in byte_texts(batch["text"])], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, fp long")


def _keys() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(MASKS))))


def links(classes: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Edges (a, b) that connect all fingerprints `fp` of classes, distinct ones, within a distance of two."""
    keys = saved(classes.select("fp", _keys().alias("key")).select("key.*", "fp"), spark, f"{folder}/keys")
    sizes = keys.groupBy("pair", "block").agg(F.count("*").alias("n")).filter("n > 1")
    shared = saved(keys.join(sizes, ["pair", "block"]), spark, f"{folder}/shared")
    few = shared.filter(F.col("n") <= LARGE).drop("n")
    other = few.select("pair", "block", F.col("fp").alias("b"))
    near = few.withColumnRenamed("fp", "a").join(other, ["pair", "block"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    many = shared.filter(F.col("n") > LARGE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(64)))
    sent = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    met = sent.groupBy("value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return near.unionByName(met.select(F.explode("all").alias("a"), "b").filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, spark: SparkSession, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links lead to) of each row of docs.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage return; A-Z are lower-cased.
    Texts with fewer words than a shingle have one shingle; null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows are returned as often as they come. A null doc_id gets its component's
    smallest id, null if all of them are. Other columns of docs are not read; empty tables give no rows.
    """
    folder = shared_folder(spark, "simhash")
    docs = saved(fingerprints(docs, shingle), spark, f"{folder}/fingerprints")
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes, spark, folder), spark, folder)
    rooted = saved(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), spark, f"{folder}/rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, spark: SparkSession, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component of near duplicates, all columns as they are: see kept_rows."""
    folder = shared_folder(spark, "simhash-rows")
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", text_key().alias("text_key"))
    prints = saved(named.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "text_key").mapInArrow(_keyed(shingle), "doc_id long, text_key long, fp long"), spark, f"{folder}/fingerprints")
    classes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    roots = components(links(classes, spark, folder), spark, folder)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "least")
    return kept_rows(docs, rooted.groupBy("root").agg(F.min("least").alias("x")).select("x.*"))


def _keyed(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array([_signed(fingerprint(x, shingle)) for x in byte_texts(batch["text"])], pa.int64())], names=["doc_id", "text_key", "fp"])

    return task


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
