"""From books in a folder to Markdown files: one plan for the whole collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import rendering
from leafmill.sources import books
from leafmill.sources.shared import Told, opened, put, shared_folder, written


def staged(rows: DataFrame, spark: SparkSession, label: str = "books", told: Told | None = None) -> DataFrame:
    """rows of books, written once to the shared folder by their kind: who asks for one kind reads that alone, and
    nothing but the pictures' reader touches pictures. told gets the numbers of rows, books, pages and errors."""
    folder = f"{shared_folder(spark, label)}/rows"
    kinds = {f"{kind}s": F.col("row") == kind for kind in ("book", "page", "error")}
    written(rows, spark, label, "rows", lambda x: x.write.partitionBy("row").parquet(folder), told, **kinds)
    return spark.read.schema(rows.schema).parquet(folder)


def tables(rows: DataFrame, converted: str) -> dict[str, DataFrame]:
    """books, chapters, items and footnotes of rows of read_books, as rendering takes them; book is the path."""
    of = lambda kind: rows.filter(F.col("row") == kind).withColumnRenamed("path", "book")
    meta = lambda key: F.try_element_at("meta", F.lit(key)).alias(key)
    found = of("book").select("book", meta("title"), meta("author"), meta("profile"), F.lit(converted).alias("converted"))
    drop = ("format", "row", "error", "meta", "content")
    return {
        "books": found,
        "chapters": of("chapter").select("book", F.col("part").alias("number"), F.col("section_title").alias("title"), F.lit(None).cast("string").alias("part_title")),
        "items": of("item").drop(*drop),
        "footnotes": of("note").select("book", "part", "page", F.col("item").alias("seq"), F.col("label").alias("marker"), "text"),
        "images": of("image").select("book", "image", "content"),
    }


def folders(found: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """book, name, folder: a folder for each book, called after its title; books of one title differ by a number.

    taken: book, name, folder of earlier runs. A book that has a folder keeps it; numbers go on where those ended.
    """
    rows = found.select("book", T.file_name(F.col("title")).alias("name"))
    before = F.lit(0)
    if taken is not None:
        kept = taken.select("book", "folder", F.lower("name").alias("_key"))
        rows = rows.join(kept.select("book", F.col("folder").alias("_had")).dropDuplicates(["book"]), "book", "left").withColumn("_key", F.lower("name"))
        rows = rows.join(kept.groupBy("_key").agg(F.count_distinct("folder").alias("_n")), "_key", "left").drop("_key")
        before = F.coalesce("_n", F.lit(0))
    else:
        rows = rows.withColumn("_had", F.lit(None).cast("string"))
    fresh = F.col("_had").isNull()
    nth = before + F.row_number().over(Window.partitionBy(F.lower("name"), fresh).orderBy("book"))
    new = F.when(nth == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), nth.cast("string"), F.lit(")")))
    return rows.select("book", "name", F.coalesce("_had", new).alias("folder"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (folder, file, content) to folder/its folder/its file, whole or not at all; returns
    path, folder, file and size. The folder is a URI that all machines share. To write the same again changes nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            sizes = []
            for own, file, content in zip(*(batch[c].to_pylist() for c in ("folder", "file", "content")), strict=True):
                path = f"{root}/{own}/{file}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                put(fs, path, content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch["book"], batch["folder"], batch["file"], pa.array(sizes, pa.int64())], names=["path", "folder", "file", "size"])

    return files.select("book", "folder", "file", "content").mapInArrow(task, "path string, folder string, file string, size long")


def write_books(rows: DataFrame, out: str, day: str, places: DataFrame, single_file: bool = False, core_only: bool = False) -> DataFrame:
    """Writes the files of staged rows; path, folder, file, size of each, and path and error of each book that can't be
    read. places: book and folder. The rows are computed once, when what is returned is."""
    t = tables(rows, day)
    if single_file:
        files = rendering.single_documents(t["books"], t["chapters"], t["items"], t["footnotes"], core_only)
    else:
        files = rendering.library(t["books"], t["chapters"], t["items"], t["footnotes"])
    texts = files.select("book", "file", F.encode("body", "utf-8").alias("content"))
    shown = t["items"].filter("kind = 'image'").select("book", "image", rendering.attachment_name(F.col("label"), F.col("image")).alias("name"))
    one = shown.groupBy("book", "name").agg(F.min("image").alias("image"))  # of equal names one is kept
    pictures = one.join(t["images"].dropDuplicates(["book", "image"]), ["book", "image"]).select("book", F.concat(F.lit("attachments/"), "name").alias("file"), "content")
    done = write_files(texts.unionByName(pictures).join(places.select("book", "folder"), "book"), out)
    failed = rows.filter("row = 'error'").select("path", F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("size"), "error")
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def today(spark: SparkSession) -> str:
    return spark.sql("SELECT CAST(current_date() AS STRING)").first()[0]


def convert_books(spark: SparkSession, folder: str, out: str, recursive: bool = False, single_file: bool = False, core_only: bool = False, profile: str = "auto", converted: str | None = None, readers: dict[str, Callable] | None = None, told: Told | None = None) -> DataFrame:
    """Converts the books of a folder; path, folder, file, size of each file written, and path and error of each book
    that can't be read. Images that the text shows go to attachments. converted: the date in the files; today without.
    Each file is parsed once: its rows are staged by kind in the shared folder. told: see staged."""
    rows = staged(books.read_books(spark, folder, readers, recursive, profile), spark, told=told)
    day = converted or today(spark)
    return write_books(rows, out, day, folders(tables(rows, day)["books"]), single_file, core_only)
