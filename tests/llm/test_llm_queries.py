"""The registered queries: against their SQL where there is some, else against plain versions, on the smallest tables."""

import math
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, found = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def encoded(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in sorted(texts.items())}


def test_op2(spark, tables):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()} == brute.simhash(tables)


def test_op3(spark, tables):
    want, start = set(), 0
    for i, ids in encoded("byte_bpe_50k.json", tables, 2).items():
        want.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op3_token_ids"](spark, SF).collect()} == want


def test_op5(spark, tables):
    rows = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == brute.rules(tables)
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)


def test_op8(spark, tables):
    want = brute.base_scores(tables)
    rows = QUERIES["op8_lm_scores"](spark, SF).collect()
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {i: v[:4] for i, v in want.items()}
    assert all(math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) for r in rows)


def test_op10(spark, tables):
    rows = QUERIES["op10_packing"](spark, SF).collect()
    want = {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, ids in encoded("word_bpe_49k.json", tables, 0).items() for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(r.length for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.03 * -(-total // 2048)


@pytest.mark.parametrize(("name", "label", "folds", "held_out"), [("op1_toxicity", "toxic", 5, 0), ("op6_quality_classifier", "quality", 3, 1)])
def test_classifiers(spark, tables, name, label, folds, held_out):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] is not None}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == held_out) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    apart = [rows[i].predicted == y for i, y in labels.items() if i in rows and rows[i].held_out]
    assert np.mean(apart) > 0.93
