"""Intermediate tables in the shared folder, and connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def saved(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Written as Parquet and read again, so that nothing before it is computed twice or lost with an executor."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key() -> Column:
    """Tells rows with one doc_id and other texts apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def kept_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, text_key) of chosen, which are distinct, and all rows without a doc_id.

    Rows of docs that agree in both are repeats; of those one stays, whichever, with all its columns. A row whose
    doc_id another row has too, with another text, is judged by its own text. Columns may have any type and name.
    """
    key, of = "_kept_text_key", "_kept_doc_id"
    chosen = chosen.select(F.col("doc_id").alias(of), F.col("text_key").alias(key))
    rows = docs.withColumn(key, text_key()).withColumn(of, F.col("doc_id").cast("long")).join(chosen, [of, key], "left_semi")
    place = F.row_number().over(Window.partitionBy(of, key).orderBy(F.lit(0)))
    names = [F.col(f"`{x.replace('`', '``')}`") for x in docs.columns]
    return rows.withColumn("_kept_place", place).filter("_kept_place = 1").select(*names).unionByName(docs.filter(F.col("doc_id").isNull()))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task, as an edge from each node to the smallest one it is linked with there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in root]
    pairs = [(x, y) for x, y in pairs if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component, which is the root.

    Each task first reduces its own edges to a forest; then large-star and small-star steps alternate until the edges
    are stars. Every step is a minimum by node and a join, so a node with many neighbours is combined before the
    shuffle and split by the adaptive join after it.
    """

    def star(both: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both, least

    e = edges.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct()
    e, seen, turn = saved(e, spark, f"{folder}/edges-0"), None, 0
    while True:
        both, least = star(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        turn += 1
        e = saved(small, spark, f"{folder}/edges-{turn}")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
