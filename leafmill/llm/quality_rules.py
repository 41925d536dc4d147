"""Line-first quality rules: lines are judged one by one, failures go, and a text that loses too much is rejected.

A line with a word fails if
- punctuation: over a tenth of its characters are symbols, or over a third of its words (three or more) end in a run
  of marks such as !! or ..., or over six tenths of its letters (20 or more) are capitals;
- navigation: a fifth or more of its words (three or more) are lone separators, or it has four words or fewer and ends
  without a mark that ends a sentence;
- boilerplate: it equals an earlier line of the text, or names a notice that pages repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Flat, byte_texts, map_rows, slices, window_hashes, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text that loses more than this share of its words with the lines that fail is rejected.
MAX_LOST_PERCENT = 40
SYMBOLS = b"#*$%&|<>"
SEPARATORS = "| » › · • / > - – —".split()
RUNS = ("!!", "??", "...", "…", "***", "---")
_SEPARATORS, _RUNS = frozenset(x.encode() for x in SEPARATORS), tuple(x.encode() for x in RUNS)
ENDS = ".!?:;\"'”»)…。！？"
NOTICE = "all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|click here|subscribe to our|skip to content"
NOTICES = re.compile(NOTICE, re.I)
_LETTER, _CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost long, clean_text string"


def line_failure(line: str) -> str | None:
    """The rule that a line, looked at alone, fails."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    if 10 * sum(map(line.count, SYMBOLS.decode())) > len(line):
        return "symbols"
    if n >= 3 and 3 * sum(w.endswith(_RUNS) for w in words) > n:
        return "punctuation"
    capitals = len(_CAPITAL.findall(line))
    if capitals > 12:  # 20 letters have at least as many capitals if six tenths of them do
        letters = len(_LETTER.findall(line))
        if letters >= 20 and 10 * capitals > 6 * letters:
            return "capitals"
    if n >= 3 and 5 * sum(w in _SEPARATORS for w in words) >= n:
        return "navigation"
    if n <= 4 and words[-1].decode()[-1] not in ENDS:
        return "navigation"
    if NOTICES.search(line):
        return "boilerplate"
    return None


def _lines(text: bytes) -> tuple[int, int, bytes]:
    """Lines with a word that equal an earlier one, words lost with lines that fail, and the text of the others."""
    seen: set[bytes] = set()
    dup = lost = 0
    kept = []
    for line in text.split(b"\n"):
        if not line or line.isspace():
            kept.append(line)
        elif line in seen:
            dup += 1
            lost += len(line.split())
        else:
            seen.add(line)
            if line_failure(line.decode()):
                lost += len(line.split())
            else:
                kept.append(line)
    return dup, lost, b"\n".join(kept)


def _repeated(flat: Flat, width: int = 3) -> np.ndarray:
    """For each text, the words that are in a window found twice or more in it."""
    n = len(flat.start)
    at = np.flatnonzero(np.arange(n) + width <= flat.stop)
    gone = np.zeros(n + 1, np.int64)
    if len(at):
        key = window_hashes(word_hashes(flat.words)[0], at, width, 5)
        order = np.lexsort((key, flat.owner[at]))
        same = (key[order][1:] == key[order][:-1]) & (flat.owner[at][order][1:] == flat.owner[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(gone, at[twice], 1)
        np.add.at(gone, at[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(gone[:n]) > 0)])
    return covered[flat.first[1:]] - covered[flat.first[:-1]]


def judge(texts: list[bytes], min_words: int, max_repeat_percent: float, max_lost_percent: float) -> dict[str, object]:
    """The columns of quality_rules for some texts."""
    flat = Flat(texts)
    chars = np.concatenate([[0], np.cumsum(((flat.data & 0xC0) != 0x80) & (flat.data != 32))])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[flat.data])])
    edge = np.concatenate([flat.start, [len(flat.data)]])[np.minimum(flat.first, len(flat.start))]
    words, repeats = flat.counts, _repeated(flat)
    failed = (words < min_words) | (100 * repeats > max_repeat_percent * words)
    lines = [_lines(x) for x in texts]
    lost = np.array([x[1] for x in lines], np.int64)
    return {
        "n_words": words,
        "word_chars": np.diff(chars[edge]),
        "n_symbols": np.diff(symbols[edge]),
        "n_dup_lines": np.array([x[0] for x in lines], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & (100 * lost <= max_lost_percent * words),
        "n_lost": lost,
        "clean_text": pa.array([x[2].decode() for x in lines], pa.string()),
    }


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: float = MAX_REPEAT_PERCENT, max_lost_percent: float = MAX_LOST_PERCENT) -> DataFrame:
    """Counts, verdict and cleaned text of each row of docs.

    n_lost: words in the lines that fail; clean_text: the other lines. A null text has no words and is rejected, as
    are empty and blank ones. Each row is judged alone, so repeated rows are returned as often as they come and a null
    doc_id stays null. Empty tables give no rows; columns besides doc_id and text are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = judge(byte_texts(batch["text"]), min_words, max_repeat_percent, max_lost_percent)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, OUT)


def keep_clean(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: float = MAX_REPEAT_PERCENT, max_lost_percent: float = MAX_LOST_PERCENT) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns as they are but for `text`, which is the cleaned one.

    Null, empty and blank texts are rejected; each row is judged alone, so repeated rows share one fate and a null
    doc_id stays. Other columns may have any type and name; empty tables give no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = judge(byte_texts(batch["text"]), min_words, max_repeat_percent, max_lost_percent)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", found["clean_text"]).filter(pa.array(found["kept"]))

    return map_rows(docs, task)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")
