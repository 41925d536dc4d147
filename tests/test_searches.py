"""Titles in pages by automata, and clusters of lines that are alike, with the pairs that were compared."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from leafmill.operators import document as D


@pytest.mark.parametrize("most", [2, 100_000])
def test_contained(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pages = [(i, word(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, "")]
    titles = sorted({word(rng.randint(2, 7)) for _ in range(40)})
    want = {(i, t) for i, text in pages for t in titles if text and 4 <= len(t) <= 6 and t in text}
    got = D.contained(spark.createDataFrame(pages, "page long, t string"), spark.createDataFrame([(t,) for t in titles * 2], "title string"), 6, most).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    assert D.contained(spark.createDataFrame(pages, "page long, t string"), spark.createDataFrame([], "title string"), 6).count() == 0


def plain(lines, ratio):
    found = []
    for norm, n in lines:
        best = max(found, key=lambda c: SequenceMatcher(None, norm, c[0]).ratio(), default=None)
        if best and SequenceMatcher(None, norm, best[0]).ratio() >= ratio:
            best[1] += n
            best[2].append(norm)
        else:
            found.append([norm, n, [norm]])
    return [tuple(c) for c in found]


def test_clusters():
    rng = random.Random(1)
    heads = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 40))) for _ in range(30)]
    lines = {}
    for _ in range(250):
        text = list(rng.choice(heads))
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice("abcdefghü#")
        lines["".join(text)] = rng.randint(1, 3)
    lines = list(lines.items())
    assert D.clusters(lines, 0.82)[0] == plain(lines, 0.82)


def test_few_pairs_are_compared():
    """Of 10,000 distinct lines, whose pairs are fifty million."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    lines = list({" ".join(rng.choice(words) for _ in range(rng.randint(3, 8))): 1 for _ in range(10_000)}.items())
    found, compared = D.clusters(lines, 0.82)
    assert len(lines) > 9_900 and len(found) > 9_000 and compared < 1_000_000


@pytest.mark.parametrize("most", [1, 2, 100])
def test_titles_held(spark, most):
    """Titles of a page's own book, as often as they come; without a list of all titles beside each page."""
    pages = [("a", 1, "onetwothreefour"), ("a", 2, "threethree"), ("b", 1, "onetwothreefour"), ("b", 2, None), (None, 1, "three"), ("c", 1, "three")]
    titles = [("a", "three"), ("a", "three"), ("a", "four"), ("a", "one"), ("a", "twothree"), ("b", "three"), ("b", None), (None, "three")]
    got = D.titles_held(spark.createDataFrame(pages, "book string, page long, t string"), spark.createDataFrame(titles, "book string, title string"), most).collect()
    assert {(r.book, r.page): r.held for r in got} == {("a", 1): 4, ("a", 2): 2, ("b", 1): 1, ("b", 2): 0, (None, 1): 0, ("c", 1): 0}


def test_pairs_leave_in_parts(spark, monkeypatch):
    """A batch's pairs of pages and titles are not held at once: no batch that leaves a task has more than a page's over the limit."""
    monkeypatch.setattr(D, "SOME_PAIRS", 10)
    titles = spark.range(40).selectExpr("concat('t', 100 + id, 'x') AS title")
    every = "".join(f"t{100 + i}x" for i in range(40))
    pages = spark.range(300).selectExpr("id AS page", f"'{every}' AS t").coalesce(1)
    assert D.contained(pages, titles, 6).count() == 300 * 40


def test_long_lines_of_prose_are_told_apart():
    """Lines of one vocabulary share most letters, and those of 200 characters or more have frequent ones, which begin no match."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["ß", "λόγος", "#"]
    heads = [" ".join(rng.choice(words) for _ in range(n)) for n in [*range(1, 80), 400, 1200]]
    lines = dict.fromkeys(heads, 1)
    for _ in range(80):
        text = list(rng.choice(heads))
        for _ in range(rng.randint(0, 1 + len(text) // 6)):
            text[rng.randrange(len(text))] = rng.choice("etaoinzq ")
        lines["".join(text)] = 2
    lines = list(lines.items())
    assert D.clusters(lines, 0.82)[0] == plain(lines, 0.82)
    prose = [(" ".join(rng.choice(words) for _ in range(40)), 1) for _ in range(300)]
    assert D.clusters(prose, 0.82)[1] < 300


def test_common_lengths(monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    line, others = word(130), [word(n) for n in (0, 1, 63, 64, 65, 128, 200)]
    codes = lambda x: np.frombuffer(x.encode("utf-32-le"), "<u4")
    size = np.array([len(x) for x in others])
    got = D.common_lengths(codes(line), codes("".join(others)), np.cumsum(size) - size, size)
    rows = []
    for other in others:
        row = [0] * (len(other) + 1)
        for a in line:
            row = [0, *(0 for _ in other)] if not other else [0, *_next(row, a, other)]
        rows.append(row[-1])
    assert got.tolist() == rows
    lines = [(word(rng.randint(20, 40)), 1) for _ in range(300)]
    first = D.clusters(lines, 0.82)[0]
    monkeypatch.setattr(D, "MANY_NEAR", 0)
    assert D.clusters(lines, 0.82)[0] == first == plain(lines, 0.82)


def _next(row, a, other):
    out = [0]
    for j, b in enumerate(other):
        out.append(row[j] + 1 if a == b else max(row[j + 1], out[-1]))
    return out[1:]
