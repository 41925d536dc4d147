"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of digits, letters and characters from U+0080 on, A-Z lower-cased) are hashed to BUCKETS numbers; those in
MIN_DOCS training documents or more have an embedding, the others share one. Filters of one, two and three words run over the whole text, each filter's largest response is kept, and a dense layer gives the logit. Embeddings start from
the log-odds of their words; embeddings, filters and the dense layer are then trained together by Adam.

A threshold is chosen for each language on training documents kept apart, and the score is the probability moved so
that the threshold becomes 0.5. The language is guessed from the text's function words, never read from a column, so
the score depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Flat, byte_texts, fold, slices, word_hashes
from leafmill.llm.decontamination import WORD_BYTES
from leafmill.llm.labelled import Adam, batches_of, sigmoid, training_sample

FOLDS, HELD_OUT = 5, 0
#: At most so many labelled documents are learned from.
MAX_LABELLED = 12_000
BUCKETS = 1 << 22
MIN_DOCS = 3
#: Of 100 labelled documents so many are kept apart to choose the thresholds by.
APART = 15
#: Optimizer steps and documents a step, whatever the number of documents.
TRAINING_STEPS, BATCH = 640, 64
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
#: Frequent function words, which tell these languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with he be by this are at from",
    "de": "der die und das ist nicht ein zu von mit sich des auf dem eine als im für",
    "fr": "le les des et du une dans est pour que qui au sur pas ne ce par avec",
    "es": "el los las y en del se por con una para no su como más pero al lo",
}
LANGUAGES = sorted(FUNCTION_WORDS)


class Words:
    """Hashed words of many texts, with two places of nothing after each text."""

    def __init__(self, texts: list[bytes]):
        flat = Flat([x.translate(WORD_BYTES) for x in texts])
        self.hashed = (word_hashes(flat.words)[0] % np.uint64(BUCKETS)).astype(np.int64)
        self.counts, self.first = flat.counts, flat.first


def _word_numbers(words: str) -> np.ndarray:
    return Words([words.encode()]).hashed


class Toxicity:
    """kept: sorted word numbers that have an embedding, row 1 on; row 0 is for the others and for nothing."""

    def __init__(self, kept: np.ndarray, odds: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.kept = kept
        self.emb = rng.normal(0, 0.1, (len(kept) + 1, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.emb[1:, 0] = odds
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        n = len(WIDTHS) * FILTERS
        self.dense, self.offset = np.full(n, 2.0 / n, np.float32), np.array([-2.0], np.float32)
        self.thresholds: dict[str, float] = {}
        self.speech = {k: _word_numbers(v) for k, v in FUNCTION_WORDS.items()}

    def rows(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.kept):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.kept, hashed), len(self.kept) - 1)
        return np.where(self.kept[at] == hashed, at + 1, 0)

    @staticmethod
    def padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with two of nothing after each text and one before an empty one, and where each text starts."""
        room = np.maximum(counts, 1) + 2
        starts = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64) if len(room) else np.zeros(0, np.int64)
        out = np.zeros(int(room.sum()), np.int64)
        out[np.arange(len(rows)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = rows
        return out, starts

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each text, and the responses."""
        ends = np.concatenate([starts[1:], [len(rows)]]) - 2
        cuts = np.stack([starts, ends], 1).reshape(-1)
        tops, all_responses, column = [], [], 0
        each = self.emb.take(rows, axis=0) @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1)
        for w in WIDTHS:
            response = each[:, column : column + FILTERS].copy()
            for j in range(1, w):
                response[: len(rows) - j] += each[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += w * FILTERS
            all_responses.append(response)
            tops.append(np.maximum.reduceat(response, cuts, axis=0)[::2])
        return np.concatenate(tops, 1), all_responses

    def logits(self, hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        rows, starts = self.padded(self.rows(hashed), counts)
        top, _ = self.pooled(rows, starts)
        return (np.maximum(top + self.bias.reshape(-1), 0) @ self.dense + self.offset[0]).astype(np.float64)

    def fit(self, words: list[np.ndarray], y: np.ndarray, steps: int = TRAINING_STEPS, batch: int = BATCH, rate: float = 0.004, seed: int = 2) -> None:
        """words: the word numbers of each text."""
        arrays = [self.emb, *self.filters, self.bias, self.dense, self.offset]
        adam, known = Adam(arrays, rate), [self.rows(x).astype(np.int32) for x in words]
        for _, part in batches_of(len(y), batch, steps, seed):
            counts = np.array([len(known[i]) for i in part], np.int64)
            rows, starts = self.padded(np.concatenate([known[i] for i in part]), counts)
            top, responses = self.pooled(rows, starts)
            hidden = np.maximum(top + self.bias.reshape(-1), 0)
            slope = (sigmoid(hidden @ self.dense + self.offset[0]) - y[part]).astype(np.float32) / len(part)
            adam.step(self.gradients(rows, starts, np.maximum(counts, 1), responses, hidden, slope))

    def gradients(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, responses: list[np.ndarray], hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of the loss by emb, each of filters, bias, dense and offset. slope: of the loss by each text's logit."""
        grads = [np.zeros_like(a) for a in (self.emb, *self.filters, self.bias, self.dense, self.offset)]
        grads[-1][0], grads[-2][:] = slope.sum(), slope @ hidden
        back = (slope[:, None] * self.dense) * (hidden > 0)
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[-3][k] = g.sum(0)
            best = np.stack([responses[k][s : s + n].argmax(0) + s for s, n in zip(starts, lengths, strict=True)])
            for j in range(w):
                r = rows[best + j]
                np.add.at(grads[0], r, g[:, :, None] * self.filters[k][j].T[None])
                grads[1 + k][j] = np.einsum("bfd,bf->df", self.emb[r], g)
        grads[0][0] = 0
        return grads

    def language(self, hashed: np.ndarray, counts: np.ndarray) -> list[str]:
        """The language whose function words are the most of each text; the first by name on ties, "" without any."""
        edge = np.concatenate([[0], np.cumsum(counts)])
        votes = [np.diff(np.concatenate([[0], np.cumsum(np.isin(hashed, self.speech[k]))])[edge]) for k in LANGUAGES]
        best = np.argmax(votes, 0) if len(counts) else []
        return [LANGUAGES[b] if max(v) else "" for b, v in zip(best, np.array(votes).T, strict=True)]

    def calibrate(self, logits: np.ndarray, languages: list[str], y: np.ndarray, least: int = 15) -> None:
        """The logit that gives the best F1 for each language with `least` toxic documents or more, and for all others
        together; without any toxic document 0 stays, a probability of a half."""

        def best(x: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(-x, kind="stable")
            x, t = x[order], t[order]
            right = np.cumsum(t)
            f1 = 2 * right / (np.arange(1, len(t) + 1) + t.sum())
            i = int(np.argmax(f1))
            return float((x[i] + x[i + 1]) / 2 if i + 1 < len(x) else x[i] - 1e-3)

        if y.sum():
            self.thresholds[""] = best(logits, y)
        for k in LANGUAGES:
            mine = np.array([z == k for z in languages], bool)
            if y[mine].sum() >= least and "" in self.thresholds:
                self.thresholds[k] = best(logits[mine], y[mine])

    def scores(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        cut = np.array([self.thresholds.get(k, self.thresholds.get("", 0.0)) for k in languages])
        return sigmoid(logits - cut)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = MAX_LABELLED) -> Toxicity:
    """Fits on the driver. Words are hashed on the executors, so that the driver gets numbers of `most` texts at most, or of
    stretches of longer ones. One rule holds at all sizes; of few documents few words have an embedding."""
    names = ("doc_id", "key", "place", "label", "part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(byte_texts(batch["text"]))
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hashed.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), lists], names=[*names, "words"])

    rows = training_sample(docs, labels, label, folds, held_out, most).mapInArrow(task, "doc_id long, key long, place int, label int, part long, words array<int>").toArrow().sort_by([(x, "ascending") for x in names[:3]])
    y, part = rows["label"].to_numpy().astype(np.float64), rows["part"].to_numpy()
    lists = [x.values.to_numpy() for x in rows["words"]]
    learn = np.flatnonzero(part >= APART)
    distinct = [np.unique(lists[i]) for i in learn]
    numbers, seen = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    kept = numbers[seen >= MIN_DOCS].astype(np.int64)
    toxic = [d for d, i in zip(distinct, learn, strict=True) if y[i]]
    bad = np.zeros(len(kept))
    if toxic and len(kept):
        hit, n = np.unique(np.concatenate(toxic), return_counts=True)
        at = np.minimum(np.searchsorted(hit, kept), len(hit) - 1)
        bad = np.where(hit[at] == kept, n[at], 0)
    total = seen[seen >= MIN_DOCS]
    base = max(1, len(toxic)) / max(2, len(learn))
    share = (bad + 4 * base) / (total + 4)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    model = Toxicity(kept, np.clip(odds, -4, 4).astype(np.float32))
    if len(learn) and len(kept):
        model.fit([lists[i] for i in learn], y[learn])
    apart = np.flatnonzero(part < APART)
    found: list[tuple[np.ndarray, list[str]]] = []
    for at in range(0, len(apart), BATCH):  # few texts at a time, as all their responses are held
        part = apart[at : at + BATCH]
        hashed, counts = np.concatenate([lists[i] for i in part]).astype(np.int64), np.array([len(lists[i]) for i in part], np.int64)
        found.append((model.logits(hashed, counts), model.language(hashed, counts)))
    if found:
        model.calibrate(np.concatenate([x for x, _ in found]), [k for _, ks in found for k in ks], y[apart])
    return model


def toxicity(docs: DataFrame, model: Toxicity, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted, guessed (language) of each row of docs, from its whole text.

    Null and empty texts have the score of a text without known words. Rows are scored alone: repeated rows are
    returned as often as they come, a null doc_id stays null (and is not held out unless held_out is fold 0). Empty
    tables give no rows; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            words = Words(byte_texts(batch["text"]))
            languages = model.language(words.hashed, words.counts)
            score = model.scores(model.logits(words.hashed, words.counts), languages)
            apart = [fold(d, folds) == held_out for d in batch["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(apart), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(languages)], names=["doc_id", "held_out", "score", "predicted", "guessed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int, guessed string")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
