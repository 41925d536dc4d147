"""Rules over what comes to a table's folder, into a table that has each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def into_table(rows: DataFrame, rule: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes rule(batch) of each batch of a stream to out/batch=N, which a batch that runs again replaces.

    rule is a batch plan: windows, joins and Python all work; it sees the batch's rows only. With once, what is there now,
    then it ends.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rule(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
