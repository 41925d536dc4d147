"""Operators 11 to 13 against plain versions, and their odd rows."""

import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leafmill.llm import alignment, periodic_runs, token_counts
from leafmill.llm.queries import QUERIES

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
PARTS = ["a", "Bc", "'s", "é", "É", "12", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "\r\n", "Σ", "é", "<|endoftext|>", "<s>", "<0x41>", "!?", "\U0001f600", "don't", ".", " Hello", "$$$", "\n\n", "\x00", "world\n", "▁"]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    out = {i: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for i in range(400)}
    out |= {i: x for i, x in enumerate(["", None, "\n", "\n\n", " ", " a", "a ", "\na\nb", "a\n\nb", "a  b", "=" * 3000, "日本語のテキスト。" * 200, "x" * 700, " " * 300, "ab▁c d"], 1000)}
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def linked(texts):
    """{doc_id: row} by the contract, a text at a time."""
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    told = {}
    for d, t in texts.items():
        t = t or ""
        a, b = a_of.encode(f" {t}", add_special_tokens=False), b_of.encode(t)
        a_raw = [bytes(byte[c] for c in x) for x in a.tokens]
        b_raw = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_of.id_to_piece, b), strict=True)]
        if not t or b"".join(a_raw) != f" {t}".encode() or b"".join(b_raw) != f" {t}".encode():
            told[d] = None
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for side, (ids, stops) in enumerate(((a.ids, ends[0]), (b, ends[1]))):
            for i, e in zip(ids, stops, strict=True):
                groups[bisect_left(both, e)][side].append(i)
        told[d] = (len(a.ids), len(b), groups)
    links = {d: Counter((x, y) for ga, gb in r[2] for x in ga for y in gb) if r else Counter() for d, r in told.items()}
    counts = Counter(p for c in links.values() for p in c)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = {}
    for d, r in told.items():
        c = links[d]
        best = sum(n for p, n in c.items() if counts[p] == most[p[0]])
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in r[2]) if r else None
        out[d] = (*((r[0], r[1], len(r[2])) if r else (0, 0, 0)), sum(c.values()), best, sum(n * counts[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if r else "")
    return out, counts


def row11(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("most", [300, 12 << 20])
def test_alignment(spark, made, most):
    rows, counts = alignment.align(frame(spark, made), spark, BYTES, PIECES, most=most)
    want, told = linked(made)
    got = {r.doc_id: row11(r) for r in rows.collect()}
    assert {d: ascii(made[d]) for d in got if got[d] != want[d]} == {} and got.keys() == want.keys()
    assert sum(v == (0, 0, 0, 0, 0, 0, "") for v in got.values()) > 3
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == told


def test_expansion_in_parts(spark, made, monkeypatch):
    units = alignment.Units(BYTES, PIECES)
    texts = [x or "" for x in made.values()]
    whole = alignment._Texts(texts, units)
    monkeypatch.setattr(alignment, "PART", 7)
    parts = alignment._Texts(texts, units)
    assert all(np.array_equal(getattr(whole, x), getattr(parts, x)) for x in ("text", "pair", "n", "sums"))


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_alignment"](spark, SF).collect()
    assert {r.doc_id: row11(r) for r in rows} == linked(texts)[0] and len(rows) == len(texts)


def test_alignment_odd(spark, odd, none, docs, texts):
    rows, counts = alignment.align(odd, spark, BYTES, PIECES)
    assert sorted((r.doc_id is None, r.n_a > 0) for r in rows.collect()) == [(False, False), (False, True), (False, True), (True, False), (True, True)]
    assert counts.agg({"count": "max"}).first()[0] == 3
    assert [x.count() for x in alignment.align(none, spark, BYTES, PIECES)] == [0, 0]
    assert alignment.align(docs, spark, BYTES, PIECES)[0].count() == len(texts)


library = cache(Tokenizer.from_file)


def counted(path, text):
    return len(library(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("path", "drops"), [(BYTES, False), (WORDS, True)])
@pytest.mark.parametrize(("chunk", "width"), [(40, 8), (100, 4), (1 << 15, 256)])
def test_counts(spark, made, path, drops, chunk, width):
    rng = random.Random(8)
    texts = made | {2000 + i: "".join(rng.choice(PARTS) + rng.choice(["", " ", "word "]) for _ in range(300)) for i in range(10)} | {3000: "y" * 500 + " z" * 100}
    rows = token_counts.count_tokens(frame(spark, texts), spark, path, drops, limit=100, chunk=chunk, width=width).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: counted(path, t) for d, t in texts.items()} and len(rows) == len(texts)
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 100) for r in rows)


def test_counts_odd(spark, odd, none, docs, texts):
    rows = token_counts.count_tokens(odd, spark, WORDS, True, chunk=50).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in rows) == [(0, False), (0, True), (1, True), (1, True), (2, False)]
    assert token_counts.count_tokens(none, spark, WORDS, True).count() == 0
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, spark, WORDS, True).collect()}
    assert got == {d: counted(WORDS, t) for d, t in texts.items()} and len(texts[5]) > token_counts.CHUNK


def test_op12(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len((t or "").encode()), n := counted(WORDS, t), n > 2048) for d, t in texts.items()}


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 3), (6, 4), (50, 3)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(250):
        kinds = rng.choice([1, 2, 3, 50])
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))] * rng.randint(2, 6)
            at = rng.randint(0, len(words))
            words[at:at] = unit[: rng.randint(1, len(unit))]
        assert periodic_runs.runs_of(np.array(words, np.int64), least, times) == brute.periodic(words, least, times)


def test_runs_of_patterns():
    fibonacci, b = [0], [0, 1]
    while len(b) < 900:
        fibonacci, b = b, b + fibonacci
    for words in (b, [1] * 500, [1, 2] * 300 + [3], ([1] * 30 + [2]) * 12, [1] * 40 + [2] + [1] * 40):
        assert periodic_runs.runs_of(np.array(words, np.int64)) == brute.periodic(words)
    words = np.array([1, 2, 3] * 200_000, np.int64)  # one long run needs few blocks
    assert periodic_runs.runs_of(words) == [(0, 600_000, 3)]
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.runs_of(words, times=2)


def test_op13(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, SF).collect()
    want = {d: brute.run_summary(d, t) for d, t in texts.items()}
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(texts)
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_runs_odd(spark, odd, none, docs, texts):
    assert sorted((r.doc_id or 0, r.n_runs) for r in periodic_runs.summaries(odd).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0)]
    assert [f(none).count() for f in (periodic_runs.summaries, periodic_runs.periodic_runs, periodic_runs.collapsed, periodic_runs.with_planted)] == [0] * 4
    assert {r.doc_id: r.text for r in periodic_runs.with_planted(odd).collect()}[2] == ""
    again = frame(spark, {1: "go on " * 30 + "end", 2: None, 3: "x"})
    assert {r.doc_id: r.text for r in periodic_runs.collapsed(again).collect()} == {1: "go on end", 2: None, 3: "x"}
    assert [tuple(r) for r in periodic_runs.periodic_runs(again).collect()] == [(1, 0, 60, 2)]
    kept = periodic_runs.collapsed(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert zlib.crc32(b"2") % 10 != 0 or periodic_runs.planted(2, []) is None
