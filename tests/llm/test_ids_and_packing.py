"""Operators 3 and 10: exact ids, round trips, and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import id_files, packing
from leafmill.llm.common import shared_folder
from leafmill.llm.tokens import WordTokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, text):
    t = Tokenizer.from_file(path)
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("path", "drops"), [(BYTES, False), (WORDS, True)])
def test_ids_are_the_tokenizers(path, drops, texts):
    words, t = WordTokenizer(path, drops), Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", "Bc", "'s", "é", "É", "12", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "\r\n", "Σ", "ς", "é", "<|endoftext|>", "!?", "İ", "\U0001f600", "don't", ".", " Hello", "$$$", "_b", "№", "ß", "ŉ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [x or "" for x in texts.values()]
    got = [x for i in range(0, len(made), 100) for x in words.encode([m.encode() for m in made[i : i + 100]])]
    for m, g in zip(made, got, strict=True):
        assert g == np.array(t.encode(m, add_special_tokens=False).ids, "<u4").tobytes(), ascii(m)


@pytest.mark.parametrize("most", [1, 2, 300, 1 << 12, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_round_trip(most, n):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32)
    ids[:: max(1, n // 7)] = 0xFFFFFFFF if most == 1 << 32 else most - 1
    file = id_files.IdFile(id_files.encode_file([7], np.array([n]), ids))
    assert (file.ids(0, n) == ids).all() and file.doc_ids.tolist() == [7]
    for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n)):
        assert (file.ids(a, b) == ids[a:b]).all()


def test_damage_is_seen():
    data = bytearray(id_files.encode_file([1], np.array([3]), np.array([1, 2, 3], np.uint32)))
    data[-60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        id_files.IdFile(bytes(data))


def test_files(spark, docs, texts):
    folder = shared_folder(spark, "test-ids")
    manifest = id_files.write_id_files(docs, spark, folder, BYTES, shard_ids=3000)
    assert manifest.count() > 3
    got = sorted(tuple(r) for r in id_files.read_id_files(manifest, folder).collect())
    want, start = [], 0
    for i, t in sorted(texts.items()):
        ids = plain(BYTES, t) + np.array([2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want


def test_files_odd(spark, odd, none):
    folder = shared_folder(spark, "test-ids")
    rows = id_files.read_id_files(id_files.write_id_files(odd, spark, folder, BYTES), folder).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, 1, 1, 2]
    folder = shared_folder(spark, "test-ids")
    assert id_files.read_id_files(id_files.write_id_files(none, spark, folder, BYTES), folder).count() == 0


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, docs, texts):
    packed = packing.pack(docs, spark, WORDS, capacity=256, with_ids=True)
    rows = packed.collect()
    bins = check(rows, 256)
    got = {(r.doc_id, r.piece): np.array(r.ids, "<u4").tobytes() for r in rows}
    want = {}
    for i, t in texts.items():
        ids = plain(WORDS, t) + bytes(4)
        want |= {(i, k): ids[a : a + 1024] for k, a in enumerate(range(0, len(ids), 1024))}
    assert got == want and all(zlib.crc32(got[r.doc_id, r.piece]) == r.ids_crc32 and r.start == 256 * r.piece for r in rows)
    least = -(-sum(len(x) // 4 for x in want.values()) // 256)
    bfd = []  # room left in the bins of a plain best-fit decreasing
    for n in sorted((len(x) // 4 for x in want.values()), reverse=True):
        fit = min((r for r in bfd if r >= n), default=None)
        if fit is not None:
            bfd.remove(fit)
        bfd.append((256 if fit is None else fit) - n)
    assert least <= len(bins) <= len(bfd)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(len(x) // 4 for x in want.values())


def test_packing_odd(spark, odd, none):
    rows = packing.pack(odd, spark, WORDS).collect()
    check(rows, 2048)
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2]
    assert packing.pack(none, spark, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_length(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(rng.choice([1, 5, 400]))}
    made = packing.plan(counts)
    used = {}
    for repeats, rows in made:
        assert sum(k * m for k, m in rows) <= 2048
        for k, m in rows:
            used[k] = used.get(k, 0) + repeats * m
    assert used == counts
