"""What Python workers keep from task to task."""

import public_tokenizers
import pyarrow as pa
from conftest import prose

from leafmill.llm import id_files


def test_tokenizers_stay_while_ids_are_written_only(spark, tmp_path):
    """A worker's next task that writes ids begins with the units it has met; those that read the files have none."""
    def _kept(batches):
        from leafmill.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._here)], pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(40)], "doc_id long, text string")
    kept = lambda: [r.n for r in spark.range(0, 16, 1, 4).mapInArrow(_kept, "n long").collect()]
    folder = f"file://{tmp_path}/ids"
    files = id_files.write_id_files(docs, spark, folder, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=100)
    assert max(kept()) == 1
    assert id_files.read_id_files(files, folder).count() == 40
    held = [r.n for r in id_files.read_id_files(files, folder).select("doc_id").mapInArrow(_kept, "n long").collect()]
    assert held and max(held) == 0
