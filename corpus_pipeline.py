"""From documents to packed sequences: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import shared_folder, table
from leafmill.llm.decontamination import uncontaminated
from leafmill.llm.packing import pack
from leafmill.llm.quality_rules import keep_clean
from leafmill.llm.shingle_dedup import keep_first_similar
from leafmill.llm.substring_dedup import removed_words
from leafmill.llm.tables import saved


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, follows a text that has changed; a null text has null."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail.

    Null, empty and blank texts are rejected. Each row is judged alone and whole, so repeated rows share one fate and a
    null doc_id stays. Other columns, of any type and name, are as they were; empty tables give no rows.
    """
    return _counted(keep_clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, and of repeated rows, the one with the smallest doc_id stays.

    Null, empty and blank texts are near duplicates of each other. Rows with one doc_id and other texts are judged by
    their texts; of a tie between them the one with the smaller hash of the text stays. Rows without a doc_id stay.
    Other columns, of any type and name, are as they were; empty tables give no rows.
    """
    return keep_first_similar(docs, spark)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start in a document with a smaller id go, and documents of which nothing is left.

    Null, empty and blank texts, and those shorter than a passage, stay as they are. Rows that repeat a doc_id are one
    document, so they keep what they share. A null doc_id counts as the smallest. Other columns, of any type and name,
    are as they were; empty tables give no rows.
    """
    others = tuple(x for x in docs.columns if x not in ("doc_id", "text"))
    out = removed_words(docs, spark, carry=others).filter("n_removed = 0 or n_removed < n_words")
    kept = {x: F.col("rest").getField(x) for x in others}
    return _counted(out.select(*((kept[x] if x in kept else F.col(x)).alias(x) for x in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null, empty and blank texts have no words and stay, as does everything if the benchmark is empty. Each row is
    judged alone, so repeated rows share one fate and a null doc_id stays. Other columns, of any type and name, are as
    they were; empty tables give no rows.
    """
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"), spark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids and their places in sequences of 2048 tokens.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed as often as they come; a null doc_id
    stays null. Columns besides doc_id and text are not returned; empty tables give no rows.
    """
    return pack(docs, spark, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, tokenizers and the packing plan are beyond SQL; tests/llm holds run() against plain versions.
ORACLE_SQL = None


#: Rows that go to a Python worker at once: texts and their ids are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting of BATCH_ROWS holds for the stages, all of which are written here, and is then as it was."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = saved(stage(spark, docs, sf_dir), spark, f"{folder}/{i}-{name}")
    finally:
        spark.conf.set(setting, before)
    return docs
