"""New books of a folder, as they come, through the same rules as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*", once: bool = False, most_files: int = 1_000) -> StreamingQuery:
    """Calls handle(files, batch) for each batch of new files; the checkpoint keeps which have been handled."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(folder)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
