"""The pipeline's near-dedup stage against all pairs: five-word shingles, similarity of 0.8 or more."""

import random

from conftest import prose

import corpus_pipeline


def brute(docs):
    """Ids that stay: the least of each component."""
    sets = {}
    for d, t in docs.items():
        ws = (t or "").encode().lower().split()
        sets[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                a0, b0 = sorted((find(a), find(b)))
                root[b0] = a0
    return {d for d in docs if find(d) == d}


def changed(text, n, seed):
    ws, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"new{rng.randint(0, 1 << 30)}"
    return " ".join(ws)


def test_stage(spark, texts):
    docs = dict(texts)
    for i in range(40):
        docs[100 + 2 * i] = prose(500 + i, 200)
        docs[101 + 2 * i] = changed(docs[100 + 2 * i], i % 8, i)
    want = brute(docs)
    assert sum(101 + 2 * i not in want for i in range(40)) > 15
    stage = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, stage, "").collect()} == want


def test_odd(spark, odd):
    rows = corpus_pipeline.near_dedup(spark, odd, "").collect()
    assert sorted(r.doc_id is None for r in rows) == [False, False, True, True]
