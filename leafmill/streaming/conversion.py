"""A watched folder's books through to Markdown files, each once.

A batch of new files is parsed, rendered and written in one handler. Which books it had and where they went is written
last, as the batch's part of a manifest; a batch is done when its part is there. Should the job end before that, the
stream gives the same files with the same number again: the handler then sees the manifest of earlier batches only,
gives the same names, writes the same files over those that are there, and the part once more. So a batch may run as
often as it likes, and a book is in the manifest, and in the folder, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.plans import convert
from leafmill.sources import books
from leafmill.streaming.intake import watch

MANIFEST = "batch long, book string, name string, folder string, files long, bytes long, error string"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """batch, book, name, folder, files, bytes, error of all books that batches have dealt with."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_books")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{out}/_books")


def convert_batch(files: DataFrame, batch: int, folder: str, out: str, recursive: bool = True, profile: str = "auto", converted: str | None = None, readers: dict[str, Callable] | None = None, before_commit: Callable[[int], None] | None = None) -> None:
    """Converts the files (path, content) of one batch and commits it; before_commit(batch) is called in between."""
    spark = files.sparkSession
    found = books.of_books(files, folder, recursive)
    rows = convert.staged(books.book_rows(found, readers, profile), spark, "batch")
    day = converted or convert.today(spark)
    earlier = manifest(spark, out).filter(F.col("batch") < batch)
    places = convert.folders(convert.tables(rows, day)["books"], earlier.filter("folder IS NOT NULL").select("book", "name", "folder"))
    done = convert.write_books(rows, out, day, places)
    sums = done.groupBy(F.col("path").alias("book"), "folder", "error").agg(F.count("file").alias("files"), F.sum("size").alias("bytes"))
    told = sums.join(places.select("book", "name"), "book", "left").select("book", "name", "folder", "files", "bytes", "error")
    kept = convert.shared_folder(spark, "manifest")
    told.write.parquet(kept)  # all files are written here
    if before_commit is not None:
        before_commit(batch)
    spark.read.schema(told.schema).parquet(kept).coalesce(1).write.mode("overwrite").parquet(f"{out}/_books/batch={batch}")


def convert_new_books(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False, most_files: int = 1_000, **options) -> StreamingQuery:
    """Converts books as they come to a folder; options as convert_batch. With once, what is there now, then it ends."""
    return watch(spark, folder, lambda files, batch: convert_batch(files, batch, folder, out, **options), checkpoint, once=once, most_files=most_files)
