"""Operator 8's contexts: counted apart however large the corpus is."""

import math
import random

import brute
import numpy as np

from leafmill.llm import lm_scoring


def known(tree, corpus, texts):
    every = [*corpus, *texts]
    keys, n = lm_scoring.symbol_counts(tree, every, np.arange(len(every)) < len(corpus))
    return lm_scoring.Known(tree, keys, lm_scoring.node_logits(tree, keys, n))


def tree_of(texts):
    return lm_scoring.Tree(lm_scoring.cell_counts(texts))


def test_contexts_are_counted_exactly():
    texts = [b"the cat sat on the mat", b"", b"the cap", b"a dog sat"]
    learn, tree = np.array([True, True, True, False]), tree_of(texts)
    keys, n = lm_scoring.symbol_counts(tree, texts, learn)
    flat, s = lm_scoring.node_logits(tree, keys, n), lm_scoring.Symbols(texts)
    told = brute.contexts([x for x, t in zip(texts, learn, strict=True) if t], tree, lm_scoring.ORDERS)
    places = lm_scoring.Known(tree, keys, flat).places(s)
    at = [(t, i) for t, x in enumerate(texts) for i in range(len(x) + 1)]
    for k, order in enumerate(lm_scoring.ORDERS):
        for place, (t, i) in zip(places[k], at, strict=True):
            cell = brute.cell(texts[t], i)
            for j in range(tree.lens[cell]):
                zero, one = (told[k, brute.context(texts[t], i, order), tree.inner[j, cell], bit] for bit in (0, 1))
                assert flat[place + j] == np.rint(math.log((one + 0.4) / (zero + 0.4)) * lm_scoring.STEP)


def test_mixing_against_a_plain_version():
    """A bit at a time, each document alone."""
    rng = random.Random(3)
    corpus = [(" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "and"], k=n))).encode() for n in (0, 1, 9, 40, 200, 700)]
    texts = [*corpus[2:], b"", b"quite another text", bytes(range(256))]
    tree = tree_of(corpus)
    start = np.linspace(0.2, 0.6, lm_scoring.GATES * lm_scoring.PREDICTORS).reshape(lm_scoring.GATES, -1).astype(np.float32)
    got = lm_scoring.Mixer(tree, known(tree, corpus, texts), start).scores(texts)
    told = brute.contexts(corpus, tree, lm_scoring.ORDERS)
    assert np.allclose(got, [brute.mixed(x, tree, told, start, lm_scoring) for x in texts], rtol=1e-4)


def test_a_large_corpus_is_not_averaged(spark):
    """More contexts than a fixed table of 2^20 holds: a text that was learned stays cheaper than one that was not."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4000))) for i in range(700)]
    out = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark).collect()
    seen = np.mean([r.bits_per_byte for r in out if not r.held_out])
    apart = np.mean([r.bits_per_byte for r in out if r.held_out])
    assert seen < 0.6 * apart


def flat_score(tree, text):
    """Bits of a text where all logits of the corpus are zero, so that what is left is what the text itself teaches."""
    return -lm_scoring.Mixer(tree, known(tree, [], [text])).scores([text])[0]


def test_every_bit_is_refined():
    """Symbols whose deep bits are all ones: without refinement each of their bits costs one."""
    corpus = [bytes(range(256))]
    tree = tree_of(corpus)
    text, path, top = [], 0, 0
    for i in range(3200):  # the first four bits take turns
        before = text[-1] if text else 256
        for s in range(256):
            bits = tree.bits[: tree.lens[before * 257 + s], before * 257 + s]
            if len(bits) > 6 and bits[4:].all() and int("".join(map(str, bits[:4])), 2) == i % 16:
                text.append(s)
                path, top = path + len(bits), top + 4
                break
    assert len(text) > 2000
    assert flat_score(tree, bytes(text)) < path - 0.05 * (path - top)


def test_long_texts_keep_learning():
    """A text that turns from one kind of bits to another at its middle pays for the turn by stretch, not by half."""
    corpus = [bytes(range(256))]
    tree = tree_of(corpus)
    a, b = (max(range(256), key=lambda s: sum(pick == x for x in tree.bits[: tree.lens[s * 258], s * 258])) for pick in (0, 1))
    n = 1 << 15
    alone = [flat_score(tree, bytes([x]) * n) for x in (a, b)]
    turned = flat_score(tree, bytes([a]) * n + bytes([b]) * n)
    assert turned < 1.02 * sum(alone)


def test_weights_start_from_training_documents(spark, monkeypatch):
    starts, real = [], lm_scoring._start
    monkeypatch.setattr(lm_scoring, "_start", lambda *x: starts.append(real(*x)) or starts[-1])
    rows = [(i, f"the cat number {i % 7} sat on the mat and looked at the dog " * 40) for i in range(40)]
    assert lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark).count() == 40
    assert starts[0].shape == (lm_scoring.GATES, lm_scoring.PREDICTORS) and starts[0][0, -1] > lm_scoring.START


def test_first_weights_come_from_all_training_documents(spark, monkeypatch):
    """Every document is a home: all of them, copies too, have a part in the weights, bit by bit."""
    starts, real = [], lm_scoring._start
    monkeypatch.setattr(lm_scoring, "_start", lambda *x: starts.append(real(*x)) or starts[-1])
    monkeypatch.setattr(lm_scoring, "HOME_BYTES", 1)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", f"w{i % 9}"], k=30))) for i in range(24)]
    rows.append((24, rows[23][1]))
    assert lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark).count() == 25
    texts = [t.encode() for i, t in rows if lm_scoring.fold(i, lm_scoring.FOLDS) != lm_scoring.HELD_OUT]
    tree = tree_of(texts)
    keys, n = lm_scoring.symbol_counts(tree, texts, np.ones(len(texts), bool))
    flat, s = lm_scoring.node_logits(tree, keys, n), lm_scoring.Symbols(texts)
    places = lm_scoring.Known(tree, keys, flat).places(s)
    told = np.zeros((lm_scoring.GATES, lm_scoring.PREDICTORS, 1 + lm_scoring.PREDICTORS))
    for i, cell in enumerate(s.cell):
        for j in range(tree.lens[cell]):
            x = np.array([flat[at[i] + j] for at in places]) / lm_scoring.STEP
            p = 1 / (1 + math.exp(-lm_scoring.START * x.sum()))
            told[min(j, lm_scoring.GATES - 1), :, 0] += x * (int(tree.bits[j, cell]) - p)
            told[min(j, lm_scoring.GATES - 1), :, 1:] += np.outer(x, x) * p * (1 - p)
    assert np.allclose(starts[0], lm_scoring.first_weights(told), atol=1e-4)
