"""Bounded samples of labelled documents, and the optimizer that the classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import fold_column


#: Longer texts are learned from in stretches of so many characters, each of which counts as a row.
STRETCH_CHARS = 1 << 17


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, stretch: int = STRETCH_CHARS) -> DataFrame:
    """doc_id, text, label (0 or 1), part (0 to 99, from the id's hash), key and place of at most `most` rows: labelled
    documents whole, or stretches of them if they are longer than `stretch` characters.

    Rows whose crc32(doc_id as text) mod folds is held_out are never among them; the others are taken in the order of a
    hash of their id (and place, and text), whatever the partitions, so two runs have the same rows. Repeated labels of
    a document count as the largest; null labels and ids don't count. A doc_id with several texts gives rows of each;
    equal rows count once. What is broadcast has `most` rows at most. Sorted by doc_id, key and place the rows have one
    order; key is a hash of the text, place the number of the stretch.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_column("doc_id", folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / stretch).cast("int"))
    dealt = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "key", "label", F.explode(places).alias("place")).distinct()
    rows = dealt.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "key").limit(most)
    cut = texts.join(F.broadcast(rows), ["doc_id", "key"]).select("doc_id", "key", "place", "label", F.substring("text", F.col("place") * stretch + 1, F.lit(stretch)).alias("text"))
    return cut.groupBy("doc_id", "key", "place").agg(F.first("label").alias("label"), F.first("text").alias("text")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)))


def batches_of(n: int, size: int, steps: int, seed: int) -> Iterator[tuple[float, np.ndarray]]:
    """For each of so many steps its share of all, and row numbers: all rows in a new order each time they are through."""
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for step in range(steps):
        while len(order) < min(size, n):
            order = np.concatenate([order, rng.permutation(n)])
        yield step / steps, order[:size]
        order = order[size:]


class Adam:
    """Steps for some arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float, decay: float = 0.0):
        self.arrays, self.rate, self.decay, self.t = arrays, rate, decay, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * m / (np.sqrt(v) + 1e-7) + self.rate * self.decay * a


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
