"""The driver's tables as books, pages and blocks, for Spark and as DuckDB SQL.

A book is a source, a page a document, a block a line of it. Positions and styles, which plain text lacks, are derived
from numbers of the row by GEOMETRY, the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 500.0, 600.0

#: SQL that both engines read, over book, page, seq and text.
GEOMETRY = {
    "font": "CASE WHEN (page + seq) % 7 = 0 THEN 'Courier New' ELSE 'Times-Roman' END",
    "size": "CAST(CASE WHEN (page * 3 + seq) % 13 = 0 THEN 18 WHEN (page + seq * 5) % 17 = 0 THEN 14 WHEN (page + seq) % 19 = 0 THEN 8 ELSE 10 END AS DOUBLE)",
    "bold": "(page + seq * 2) % 5 = 0",
    "italic": "(page + seq) % 6 < 2 AND seq < 2",
    "x0": "CAST(50 + 30 * ((page + seq) % 3) AS DOUBLE)",
    "x1": "CAST(50 + 30 * ((page + seq) % 3) + 4 * (length(text) % 90) + 10 AS DOUBLE)",
    "y0": "CAST(40 + 16 * seq + 20 * (seq // 5) AS DOUBLE)",
    "y1": "CAST(52 + 16 * seq + 20 * (seq // 5) AS DOUBLE)",
}

LINES_SQL = """lines AS (SELECT source AS book, doc_id AS page, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq,
    unnest(string_split(text, chr(10))) AS text FROM documents)"""
BLOCKS_SQL = f"{LINES_SQL}, blocks AS (SELECT book, page, seq, text, {', '.join(f'{v} AS {k}' for k, v in GEOMETRY.items())} FROM lines)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = {k: v.replace("seq // 5", "seq div 5") for k, v in GEOMETRY.items()}
    return lines(spark, sf_dir).select("book", "page", "seq", "text", *(F.expr(v).alias(k) for k, v in spelled.items()))
