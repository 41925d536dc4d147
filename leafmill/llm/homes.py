"""Homes: chunks of documents kept in the shared folder, and messages that are exchanged by key between them.

Some operators ask of each word, window or anchor in how many documents it is. Sending every occurrence through a
shuffle costs several times the text, and a common key would gather a third of all rows in one task. Here a chunk of
documents (a home, some MB of text) sends each distinct key once, so a key has at most one row a home; the answer
goes back to the home, which reads its texts again from its file in the folder that all machines share.

A home's number comes from the task's partition and the chunk's place in it, so a task that runs again after a lost
executor writes the same files, whole or not at all. That holds where the partitions of the input are the same when
they are computed again, as those of a file scan are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafmill.llm.common import give_back, open_folder, put_file

HOME_BYTES = 6 << 20


def _put_home(fs, root: str, number: int, rows: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    put_file(fs, f"{root}/{number}.arrow", sink.getvalue())


def read_home(folder: str, number: int) -> pa.Table:
    fs, root = open_folder(folder)
    with fs.open_input_stream(f"{root}/{number}.arrow") as src, pa.ipc.open_stream(src) as stream:
        return stream.read_all()


def settle(docs: DataFrame, folder: str, send: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = HOME_BYTES) -> DataFrame:
    """Writes docs as homes of about `most` bytes of text and returns what send(home, rows) yields for each.

    The text column is `text`; a home holds one document at least, however long.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        part, count = TaskContext.get().partitionId(), 0
        have: list[pa.RecordBatch] = []
        size = 0

        def home() -> Iterator[pa.RecordBatch]:
            nonlocal have, size, count
            rows, number = pa.Table.from_batches(have), (part << 24) + count
            have, size, count = [], 0, count + 1
            _put_home(fs, root, number, rows)
            yield from send(number, rows)

        for batch in batches:
            lengths = np.array(pc.fill_null(pc.binary_length(batch["text"].cast(pa.binary())), 0), np.int64)
            start = 0
            for i, n in enumerate(lengths):
                if size and size + n > most:
                    have += [batch.slice(start, i - start)] if i > start else []
                    start = i
                    yield from home()
                size += int(n)
            if batch.num_rows > start:
                have.append(batch.slice(start))
        if have:
            yield from home()
        give_back()

    return docs.mapInArrow(task, schema)


def text_slices(rows: pa.Table, most: int = 1 << 20) -> Iterator[pa.Table]:
    """Pieces of a home, cut between documents."""
    lengths = np.array(pc.fill_null(pc.binary_length(rows["text"].cast(pa.binary())), 0), np.int64)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield rows.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield rows.slice(start)


def key_runs(batches: Iterator[pa.RecordBatch], reply: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], keys: tuple[str, ...], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Calls reply(rows, starts) on rows sorted by keys, cut so that no run of equal keys is split.

    A run has a row for each home at most, so what is held stays small.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def sorted_runs(rows: pa.Table) -> np.ndarray:
        cut = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in keys:
            v = rows[k].to_numpy()
            cut |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [rows.num_rows]]).astype(np.int64)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        rows = pa.Table.from_batches(held)
        starts = sorted_runs(rows)
        last = int(starts[-2])
        if last:
            out = reply(rows.slice(0, last), starts[:-1])
            if out is not None and out.num_rows:
                yield out
        held, size = rows.slice(last).to_batches(), rows.num_rows - last
        if not last:
            most *= 2
    if size:
        rows = pa.Table.from_batches(held)
        out = reply(rows, sorted_runs(rows))
        if out is not None and out.num_rows:
            yield out
    give_back()
