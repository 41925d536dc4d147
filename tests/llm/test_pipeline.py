"""The pipeline's stages, one after the other, against plain versions of their rules."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from test_shingle_dedup import brute as first_similar
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm.quality_rules import judge

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = sorted(docs)
    found = judge([docs[i].text.encode() for i in ids], 50, 50, 40)
    texts = {i: t for i, t, k in zip(ids, found["clean_text"].to_pylist(), found["kept"], strict=True) if k}
    assert {i for i in texts} <= {i for i, v in brute.rules({i: docs[i].text for i in ids}).items() if not v[5]}
    texts = {i: texts[i] for i in first_similar(texts)}
    removed = brute.removed(texts)
    texts = {i: t for i, t in texts.items() if removed[i][1] < removed[i][0]}
    stage = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = {r.doc_id: r.text for r in corpus_pipeline.removed_words(stage, spark).collect()}
    for i, text in cut.items():
        assert brute.removed({i: text})[i][2] == removed[i][2]
    clean = {i: t for i, t in cut.items() if not brute.hits({i: t}, bench)[i][4]}
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, text in clean.items():
        tokens = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, a, len(tokens[a : a + 2048]), zlib.crc32(tokens[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(tokens), 2048))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_ids_are_in_the_table(spark):
    rows = corpus_pipeline.packing(spark, spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), SF).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert {r.doc_id: r.ids for r in rows}[2] == [0]


def test_odd_rows_and_columns(spark):
    """Null, empty, repeated and tied rows, and columns of odd names and types, through each stage."""
    from conftest import prose

    text = "\n".join(prose(i, 40) for i in range(3))
    rows = [(1, text, {"a": 1}, [1], "x"), (1, text, {"a": 1}, [1], "x"), (2, None, None, None, None), (3, "", {}, [], ""), (None, text, None, None, "y"), (None, None, None, None, None), (4, text + " tail.", {"b": 2}, [2], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` map<string, int>, `a.b` array<int>, `n_words` string")
    stages = dict(corpus_pipeline.STAGES)
    made = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    for name, df in list(made.items())[:-1]:
        assert df.schema == docs.schema or df.columns == docs.columns, name
    ids = {name: sorted((r.doc_id or 0) for r in df.collect()) for name, df in made.items()}
    assert ids["quality_rules"] == [0, 1, 1, 4]
    assert ids["near_dedup"] == [0, 0, 1, 2]
    assert ids["substring_dedup"] == [0, 0, 2, 3, 4]
    assert ids["decontamination"] == [0, 0, 1, 1, 2, 3, 4]
    assert ids["packing"] == [0, 0, 1, 1, 2, 3, 4]
    tail = {r.doc_id: r for r in made["substring_dedup"].collect()}[4]
    assert tail.text == "tail." and tail["my col"] == {"b": 2} and tail["a.b"] == [2]


@pytest.mark.parametrize("fails", [False, True])
def test_batches_are_small_in_the_stages_only(spark, tmp_path, monkeypatch, fails):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(setting)))
        if fails:
            raise KeyError("no stage")
        return docs

    spark.range(3).selectExpr("id AS doc_id", "'a b' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage)])
    if fails:
        with pytest.raises(KeyError):
            corpus_pipeline.run(spark, str(tmp_path))
    else:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert seen == [corpus_pipeline.BATCH_ROWS] and spark.conf.get(setting) == before
