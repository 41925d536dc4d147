"""Quality: a byte-level convolutional network, trained in numpy.

Bytes are embedded; filters of WIDTH bytes run over the whole text every STEP bytes. Responses are max-pooled in chunks
of CHUNK bytes that overlap by WIDTH - STEP, so no filter position is lost between them, and the chunks' features are
combined into the text's by their mean and their maximum, from which a dense layer gives one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import byte_texts, fold, slices
from leafmill.llm.labelled import Adam, batches_of, sigmoid, training_sample

FOLDS, HELD_OUT = 3, 1
#: At most so many labelled documents are learned from.
MAX_LABELLED = 4_000
#: Optimizer steps and documents a step, whatever the number of documents.
TRAINING_STEPS, BATCH = 750, 32
DIM, FILTERS, STEP, STEPS = 6, 24, 4, 4
WIDTH = STEP * STEPS
#: Filter positions in a chunk: CHUNK bytes with the overlap.
CHUNK = 512
POSITIONS = (CHUNK - WIDTH) // STEP + 1
PAD = 256
#: Filters run over so many steps at a time, so that a very long text needs no more memory.
STRETCH = 1 << 16


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (padded so that each text is whole steps and has WIDTH bytes at least), and for each chunk its first
    position and its text. Positions are numbered through all texts; those that reach into the next are not in a chunk."""
    steps = np.array([max(-(-len(x) // STEP), STEPS) for x in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(steps)])
    data = np.full(int(first[-1]) * STEP, PAD, np.int16)
    for x, at in zip(texts, first[:-1] * STEP, strict=True):
        data[at : at + len(x)] = np.frombuffer(x, np.uint8)
    positions = steps - STEPS + 1
    per = -(-positions // POSITIONS)
    owner = np.repeat(np.arange(len(texts)), per)
    start = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * POSITIONS
    stop = np.minimum(start + POSITIONS, (first[:-1] + positions)[owner])
    return data, np.stack([start, stop], 1), owner


class ByteNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.emb[PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (STEPS, STEP * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """(positions, FILTERS); the last positions, which reach past the data, are of what there is."""
        n = len(data) // STEP
        out = np.empty((n, FILTERS), self.filters.dtype)
        joined = np.ascontiguousarray(self.filters.transpose(1, 0, 2).reshape(STEP * DIM, STEPS * FILTERS))
        for a in range(0, n, STRETCH):
            b, end = min(a + STRETCH, n), min(a + STRETCH + STEPS - 1, n)
            each = self.emb.take(data[a * STEP : end * STEP], axis=0).reshape(end - a, STEP * DIM) @ joined
            out[a:b] = each[: b - a, :FILTERS]
            for j in range(1, STEPS):
                more = each[j : b - a + j, j * FILTERS : (j + 1) * FILTERS]
                out[a : a + len(more)] += more
        return out

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        data, spans, owner = chunked(texts)
        response = self.responses(data)
        cuts = spans.reshape(-1)
        cuts = cuts[:-1] if cuts[-1] >= len(response) else cuts
        top = np.maximum.reduceat(response, cuts, axis=0)[::2]
        hidden = np.maximum(top + self.bias, 0)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        per = np.diff(np.concatenate([start, [len(owner)]]))
        mean = np.add.reduceat(hidden, start, axis=0) / per[:, None]
        most = np.maximum.reduceat(hidden, start, axis=0)
        return np.concatenate([mean, most], 1), data, spans, owner, response, hidden, start, per

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid((self.features(texts)[0] @ self.dense + self.offset[0]).astype(np.float64))

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = TRAINING_STEPS, batch: int = BATCH, rate: float = 0.003, seed: int = 4) -> None:
        adam = Adam([self.emb, self.filters, self.bias, self.dense, self.offset], rate, decay=1e-4)
        for done, part in batches_of(len(y), batch, steps, seed):
            adam.rate = rate * (1 - done) + rate / 20
            adam.step(self.gradients([texts[i] for i in part], y[part]))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss by emb, filters, bias, dense and offset."""
        feats, data, spans, owner, response, hidden, start, per = self.features(texts)
        slope = ((sigmoid(feats @ self.dense + self.offset[0]) - y) / len(y)).astype(self.dense.dtype)
        g_feats = slope[:, None] * self.dense
        g = (g_feats[:, :FILTERS] / per[:, None])[owner]
        best_chunk = np.stack([hidden[s : s + n].argmax(0) + s for s, n in zip(start, per, strict=True)])
        np.add.at(g, (best_chunk, np.arange(FILTERS)[None]), g_feats[:, FILTERS:])
        g *= hidden > 0
        best = np.stack([response[a:b].argmax(0) + a for a, b in spans])
        g_emb, g_filters = np.zeros((257, DIM)), np.zeros_like(self.filters)
        for j in range(STEPS):
            chosen = data[((best + j) * STEP)[:, :, None] + np.arange(STEP)]
            inputs = self.emb[chosen].reshape(*best.shape, STEP * DIM)
            g_filters[j] = np.einsum("cfd,cf->df", inputs, g)
            for i in range(STEP):
                places, own = chosen[:, :, i].reshape(-1), self.filters[j, i * DIM : (i + 1) * DIM]
                for d in range(DIM):
                    g_emb[:, d] += np.bincount(places, (g * own[d]).reshape(-1), 257)
        g_emb[PAD] = 0
        return [g_emb.astype(np.float32), g_filters, g.sum(0), slope @ feats, np.array([slope.sum()], np.float32)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = MAX_LABELLED) -> ByteNet:
    """Fits on the driver, on `most` whole documents at most, or stretches of longer ones."""
    order = ("doc_id", "key", "place")
    rows = training_sample(docs, labels, label, folds, held_out, most).select(*order, "label", "text").toArrow().sort_by([(x, "ascending") for x in order])
    texts, y = byte_texts(rows["text"].combine_chunks()), rows["label"].to_numpy().astype(np.float32)
    net = ByteNet()
    if len(y):
        net.offset[0] = np.log((y.mean() + 0.01) / (1.01 - y.mean()))
        net.fit(texts, y)
    return net


def quality(docs: DataFrame, net: ByteNet, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, from its whole text.

    Null and empty texts are scored as padding alone. Rows are scored alone: repeated rows are returned as often as
    they come, a null doc_id stays null and counts to fold 0. Empty tables give no rows; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            score = net.scores(byte_texts(batch["text"]))
            apart = [fold(d, folds) == held_out for d in batch["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(apart), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
