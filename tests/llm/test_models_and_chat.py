"""Operators 1, 6, 8 and 9: held-out accuracy, plain versions, round trips, and edge cases."""

import hashlib
import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, lm_scoring, quality_classifier, toxicity
from leafmill.llm.common import fold
from leafmill.llm.labelled import training_sample

SF = "/root/testdata/sf0.01"


def accuracy(rows, labels):
    apart = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in apart) / len(apart)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(tables, docs, odd, none):
    model = toxicity.train(*tables)
    rows = toxicity.toxicity(tables[0], model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert accuracy(rows, {r.doc_id: r.toxic for r in tables[1].collect()}) > 0.9
    few = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert few[2] == few[3] == few[4] and len(few) == 46
    assert toxicity.toxicity(odd, model).count() == 5 and toxicity.toxicity(none, model).count() == 0


def test_toxicity_guesses_languages():
    words = toxicity.Words([b"the cat and the dog of it", "der Hund und die Katze ist".encode(), b"zzz", b""])
    model = toxicity.Toxicity(np.zeros(0, np.int64), np.zeros(0, np.float32))
    assert model.language(words.hashed, words.counts) == ["en", "de", "", ""]
    assert model.logits(words.hashed, words.counts).shape == (4,)


def test_quality(tables, docs, odd, none):
    net = quality_classifier.train(*tables)
    rows = quality_classifier.quality(tables[0], net).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in tables[1].collect()}) > 0.93
    assert quality_classifier.quality(docs, net).count() == 46
    assert quality_classifier.quality(odd, net).count() == 5 and quality_classifier.quality(none, net).count() == 0


def test_every_position_is_in_one_chunk():
    for n in (0, 1, 15, 16, 17, 511, 512, 513, 5000):
        data, spans, owner = quality_classifier.chunked([b"x" * n, b"y" * 40])
        first = [s for s, o in zip(spans.tolist(), owner.tolist(), strict=True) if o == 0]
        assert [i for a, b in first for i in range(a, b)] == list(range(max(-(-n // 4), 4) - 3))


def test_samples_leave_out_the_fold(spark, tables):
    rows = training_sample(*tables, "toxic", 5, 0, 50).collect()
    assert len(rows) == 50 and all(fold(r.doc_id, 5) for r in rows)
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(tables[0], toxicity.train(tables[0], empty)).count() == 1000
    assert quality_classifier.quality(tables[0], quality_classifier.train(tables[0], empty)).count() == 1000


def test_samples_of_long_and_repeated_texts(spark):
    """Long texts come in stretches, whole; rows of one id are each taken, in one order whatever the partitions."""
    long = "".join(f"word{i} " for i in range(2_000))
    docs = spark.createDataFrame([(1, long), (2, "b"), (2, "a"), (2, "a"), (3, None), (4, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 5)], "doc_id long, toxic int, quality int")
    rows = training_sample(docs, known, "quality", 5, 4, 1_000, stretch=1_000).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.key, r.place)):
        found.setdefault((r.doc_id, r.key), []).append(r.text)
    assert sorted("".join(x) for x in found.values()) == sorted([long, "a", "b", "", ""]) and max(len(r.text) for r in rows) == 1_000
    few = [sorted((r.doc_id, r.place, r.text) for r in training_sample(docs.repartition(n), known, "quality", 5, 4, 4, stretch=1_000).collect()) for n in (1, 3, 7)]
    assert few[0] == few[1] == few[2] and len(few[0]) == 4


def test_long_texts_are_learned_from(spark, tables):
    few = [(r.doc_id, r.text) for r in tables[0].orderBy("doc_id").limit(150).collect()]
    known = spark.createDataFrame([(i, int(i % 2)) for i, _ in few] + [(10_005, 1)], "doc_id long, quality int")
    with_long = spark.createDataFrame([*few, (10_005, "zq " * 350_000)], "doc_id long, text string")
    nets = [quality_classifier.train(d, known) for d in (spark.createDataFrame(few, "doc_id long, text string"), with_long, with_long.repartition(5))]
    one, two, three = (float(n.scores([b"zq " * 200])[0]) for n in nets)
    assert two == three and two != one


def test_lm_base(spark, docs, texts):
    rows = lm_scoring.lm_scores(docs, spark).collect()
    want = brute.base_scores(texts)
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == {i: v[:4] for i, v in want.items()}
    assert all(math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9, abs_tol=1e-9) for r in rows)
    assert all(r.score <= 0 for r in rows) and {r.doc_id for r in rows if r.bits_per_byte is None} == {2, 3}


def slopes(loss, arrays, grads, picks=12):
    """Gradients against differences, at some places of each array (of 64-bit floats)."""
    rng = np.random.default_rng(0)
    for array, grad in zip(arrays, grads, strict=True):
        flat, given = array.reshape(-1), np.asarray(grad, np.float64).reshape(-1)
        for i in {int(np.abs(given).argmax()), *rng.integers(0, len(flat), picks).tolist()}:
            old, ends = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                ends.append(loss())
            flat[i] = old
            assert math.isclose((ends[0] - ends[1]) / 2e-5, given[i], rel_tol=1e-3, abs_tol=1e-6)


def test_toxicity_against_loops():
    texts = [b"a b c a d", b"", b"b", b"zzz a zzz b c c"]
    words = toxicity.Words(texts)
    model = toxicity.Toxicity(np.unique(toxicity.Words([b"a b c d"]).hashed), np.array([0.5, -1.0, 2.0, 0.1], np.float32))
    for name in ("emb", "bias", "dense", "offset"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.filters, y = [f.astype(np.float64) for f in model.filters], np.array([1.0, 0.0, 0.0, 1.0])
    model.emb[0] = 0
    model.bias += np.linspace(0.01, 0.2, model.bias.size).reshape(model.bias.shape)  # off the kink at zero
    want = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        rows = [*model.rows(words.hashed[a:b]), *([0] * (2 if b > a else 3))]
        tops = []
        for k, f in enumerate(model.filters):
            each = [[sum(model.emb[rows[i + j]] @ f[j][:, x] for j in range(len(f))) for i in range(max(b - a, 1))] for x in range(toxicity.FILTERS)]
            tops += [max(0, max(e) + model.bias[k, x]) for x, e in enumerate(each)]
        want.append(np.array(tops) @ model.dense + model.offset[0])
    assert np.allclose(model.logits(words.hashed, words.counts), want)

    def loss():
        p = toxicity.sigmoid(model.logits(words.hashed, words.counts))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rows, starts = model.padded(model.rows(words.hashed), words.counts)
    top, responses = model.pooled(rows, starts)
    hidden = np.maximum(top + model.bias.reshape(-1), 0)
    slope = (toxicity.sigmoid(hidden @ model.dense + model.offset[0]) - y) / len(y)
    grads = model.gradients(rows, starts, np.maximum(words.counts, 1), responses, hidden, slope)
    slopes(loss, [model.emb[1:], *model.filters, model.bias, model.dense, model.offset], [grads[0][1:], *grads[1:]])


def test_quality_against_loops(monkeypatch):
    rng, q = random.Random(5), quality_classifier
    texts = [b"", b"short", bytes(rng.randrange(256) for _ in range(1900)), b"The quick brown fox. " * 60]
    net, y = q.ByteNet(), np.array([0.0, 1.0, 1.0, 0.0])
    for name in ("emb", "filters", "bias", "dense", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += np.linspace(0.01, 0.2, q.FILTERS)  # off the kink at zero
    want = []
    for text in texts:
        n = max(-(-len(text) // q.STEP), q.STEPS)
        data = [*text, *([q.PAD] * (n * q.STEP - len(text)))]
        steps = [net.emb[data[i * q.STEP : (i + 1) * q.STEP]].reshape(-1) for i in range(n)]
        response = np.array([sum(steps[i + j] @ net.filters[j] for j in range(q.STEPS)) for i in range(n - q.STEPS + 1)])
        chunks = np.array([np.maximum(response[i : i + q.POSITIONS].max(0) + net.bias, 0) for i in range(0, len(response), q.POSITIONS)])
        want.append(q.sigmoid(np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.dense + net.offset[0]))
    assert np.allclose(net.scores(texts), want)
    monkeypatch.setattr(q, "STRETCH", 7)
    assert np.allclose(net.scores(texts), want)
    loss = lambda: -np.mean(y * np.log(net.scores(texts)) + (1 - y) * np.log(1 - net.scores(texts)))
    grads = net.gradients(texts, y)
    slopes(loss, [net.emb[:256], net.filters, net.bias, net.dense, net.offset], [grads[0][:256], *grads[1:]])


def test_lm_learns_and_is_a_code():
    """Seen text is cheaper, and the chances of all one-byte texts sum to one at most."""
    corpus = [("the cat sat on the mat and " * 30).encode()] * 5
    tree = lm_scoring.Tree(lm_scoring.cell_counts(corpus))
    texts = [b"the cat sat on the mat", b"qzx kvj wwy pfh ggt uuo", *(bytes([b]) for b in range(256)), b"", b"the cat", b"a longer text than the others by far " * 20]
    every = corpus + texts
    keys, n = lm_scoring.symbol_counts(tree, every, np.arange(len(every)) < len(corpus))
    mixer = lm_scoring.Mixer(tree, lm_scoring.Known(tree, keys, lm_scoring.node_logits(tree, keys, n)))
    scores = mixer.scores(texts)
    assert scores[0] > scores[1]
    assert np.exp2(scores[2:259]).sum() <= 1.001
    assert np.allclose(scores, [mixer.scores([x])[0] for x in texts])


def test_lm_odd(spark, odd, none):
    assert lm_scoring.lm_scores(odd, spark).count() == 5
    assert lm_scoring.lm_scores(none, spark).count() == 0


EVENTS = "conv_id long, seq long, kind string, message string, role string, text string"


def formatted(spark, rows, **more):
    df = spark.createDataFrame(rows, EVENTS).withColumn("formatted", F.lit(1)).withColumn("part", F.lit(1))
    return chat.format_chats(df, **more)


def messages(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.part)):
        out.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
    return out


def test_fold(spark):
    rows = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "delta", "b", "assistant", "hel"), (1, 2, "delta", "b", "assistant", "lo"),
        (1, 3, "message", "c", "user", "more"), (1, 4, "regenerate", "b", None, None), (1, 5, "delta", "b", "assistant", "bye"),
        (2, 0, "message", "a", "user", "x"), (2, 1, "message", "b", "assistant", "y"), (2, 2, "edit", "a", "user", "z"),
        (3, 0, "message", None, "user", None), (3, 0, "message", None, "user", None), (None, 0, "message", None, None, "n"),
    ]
    assert messages(formatted(spark, rows)) == {1: [("user", "hi"), ("assistant", "bye")], 2: [("user", "z")], 3: [("user", "")] * 2, None: [("", "n")]}


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "a<", "<", "|>", "<|<|", "\n\n", "", "<|im_end|>\n<|im_start|>assistant\nok"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    (made, loss), = chat.render(iter([("user", text), ("assistant", text), (text, "x")]))
    assert list(chat.parse(made)) == [("user", text), ("assistant", text), (text, "x")]
    spans = [chat.unescape(made[s["start"] : s["end"]]) for s in loss]
    assert spans == [text] + (["x"] if text == "assistant" else [])


def test_parts_and_spool(spark, monkeypatch):
    rows = [(1, i, "message", None, "assistant" if i % 2 else "user", f"text {i} " * 50) for i in range(200)]
    df = formatted(spark, rows, part_chars=2000)
    assert df.count() > 10
    got = chat.read_back(df).first()
    whole = "".join(f"{r[4]}\n{r[5]}\n" for r in rows)
    assert got.n_turns == 200 and got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(r[5] for r in rows if r[4] == "assistant").encode()).hexdigest()
    monkeypatch.setattr(chat, "SPOOL", 10)
    talk = chat.Conversation("file:///tmp/leafmill-shared/test-chat")
    for _, _, kind, message, role, text in rows[:5]:
        talk.apply(kind, message, role, text)
    assert list(talk) == [(r[4], r[5]) for r in rows[:5]]


def test_chat_odd(spark):
    assert chat.read_back(formatted(spark, [])).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        formatted(spark, [(1, 0, "shout", None, "user", "x")]).count()
