"""Operators 2, 4, 5 and 7 against plain versions, and their edge cases."""

import brute
import pytest

from leafmill.llm import decontamination as dc
from leafmill.llm import quality_rules as qr
from leafmill.llm import simhash as sh
from leafmill.llm.common import SpanHash, shared_folder
from leafmill.llm.shingle_dedup import keep_first_similar
from leafmill.llm.substring_dedup import removed_words
from leafmill.llm.tables import components


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_simhash(spark, docs, texts):
    got = by_id(sh.near_duplicates(docs, spark), "fingerprint", "component_id")
    assert got == brute.simhash(texts)
    assert got[2] == got[3] == got[4] == ("0" * 16, 2)


def test_simhash_many_near_copies(spark, monkeypatch):
    """A block that more fingerprints share than are joined is linked by way of neighbours."""
    rng = __import__("random").Random(4)
    prints = sorted({0x1234567800000000 ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))) for _ in range(300)})
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    for large in (8, 10_000):
        monkeypatch.setattr(sh, "LARGE", large)
        folder = f"file:///tmp/leafmill-shared/test-{large}"
        roots = {r.node: r.root for r in components(sh.links(classes, spark, folder), spark, folder).collect()}
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(prints):
            for b in prints[:i]:
                if (a ^ b).bit_count() <= 2:
                    root[max(find(a), find(b))] = min(find(a), find(b))
        assert {p: roots.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(edges, spark, "file:///tmp/leafmill-shared/test-chain").collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 501: 500}


def test_simhash_odd(spark, odd, none):
    assert sh.near_duplicates(odd, spark).count() == 5
    assert sh.near_duplicates(none, spark).count() == 0
    assert sorted(r.doc_id or 0 for r in sh.keep_first(odd, spark).collect()) == [0, 0, 1, 2]


def test_substring(spark, docs, texts):
    got = by_id(removed_words(docs, spark, carry=("key", "rest")), "n_words", "n_removed", "kept_sha256")
    assert got == brute.removed(texts)
    assert got[8][1] == got[8][0]


@pytest.mark.parametrize(("words", "gram"), [(3, 1), (4, 4), (6, 2)])
def test_substring_lengths(spark, texts, words, gram):
    few = {i: t for i, t in texts.items() if i not in (5,)}
    df = spark.createDataFrame(list(few.items()), "doc_id long, text string")
    assert by_id(removed_words(df, spark, words, gram), "n_words", "n_removed", "kept_sha256") == brute.removed(few, words)


def test_substring_spans_and_text(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, p), (2, f"a  b {p}\n c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in removed_words(df, spark).collect()}
    assert rows[1].text == p and rows[1].spans == []
    assert rows[2].text == "a  b\n c" and [tuple(s) for s in rows[2].spans] == [(2, 22)]


def test_substring_odd(spark, odd, none):
    rows = removed_words(odd, spark).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 0, 0), (0, 100, 0), (1, 100, 100), (1, 100, 100), (2, 0, 0)]
    assert removed_words(none, spark).count() == 0


def thue_morse(n, flip=False):
    """Two words of this kind collide under any polynomial hash modulo 2^64."""
    word = "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
    return word


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    one, two, rest = thue_morse(n), thue_morse(n, True), [f"w{i}" for i in range(60)]
    few = {1: " ".join(rest[:6] + [one] + rest[6:]), 2: " ".join(rest[10:16] + [two] + rest[16:22]), 3: " ".join(rest[:6] + [two] + rest[6:12]), 4: " ".join([one, "x", "y", two, "x", "y"] * 2 + rest)}
    df = spark.createDataFrame(list(few.items()), "doc_id long, text string")
    assert by_id(removed_words(df, spark), "n_words", "n_removed", "kept_sha256") == brute.removed(few)
    assert by_id(qr.quality_rules(df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.rules(few)


def test_rows_that_share_an_id(spark):
    """Rows with one doc_id and other texts are none of each other's near duplicates, whatever other columns hold."""
    a, b, c = ("".join(f" {x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, {"k": 1}), (1, b, {"k": 2}), (2, c, {"k": 3}), (2, c, {"k": 3}), (3, a, {"k": 4}), (None, a, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `my col` map<string, int>")
    for kept in (sh.keep_first(df, spark), keep_first_similar(df, spark)):
        assert kept.columns == df.columns
        assert sorted(((r[0] or 0, r[1], r[2]) for r in kept.collect()), key=str) == sorted([(1, a, {"k": 1}), (1, b, {"k": 2}), (2, c, {"k": 3}), (0, a, None)], key=str)


def test_rules(docs, texts):
    got = by_id(qr.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == brute.rules(texts)


def test_rules_verdict(spark, docs, odd, none):
    rows = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[6].kept
    assert rows[45].kept and "Contact" not in rows[45].clean_text and "Line one here" in rows[45].clean_text
    assert qr.quality_rules(odd).count() == 5 and qr.quality_rules(none).count() == 0
    assert {r.doc_id for r in qr.keep_clean(docs).collect()} == {i for i, r in rows.items() if r.kept}
    assert qr.keep_clean(docs).columns == docs.columns


@pytest.mark.parametrize(
    ("line", "rule"),
    [("A plain line that says something.", None), ("buy### now*** here$$$ win%%%", "symbols"), ("WOW!! SUCH!! GREAT!!", "punctuation"), ("THIS IS ALL IN CAPITALS AND SHOUTS.", "capitals"), ("Home / About / Contact", "navigation"), ("Next page", "navigation"), ("We set cookies; see our cookie policy.", "boilerplate")],
)
def test_line_failure(line, rule):
    assert qr.line_failure(line) == rule


def test_decontamination(spark, docs, texts):
    items = [(1, texts[1]), (2, None), (3, "---"), (4, "zeta, ZETA"), (5, texts[30]), (11, "one"), (7, "x1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(dc.decontamination(docs, bench, spark), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.hits(texts, items)
    kept = {r.doc_id for r in dc.uncontaminated(docs, bench, spark).collect()}
    assert kept == {i for i, v in got.items() if not v[4]}


@pytest.mark.parametrize("held", [0, 4])
def test_decontamination_in_several_files(spark, docs, texts, monkeypatch, held):
    items = [(i, texts[i]) for i in (1, 10, 12, 30)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    folder = shared_folder(spark, "test-strings")
    assert len(dc.string_files(bench, spark, folder, file_words=100)) == 4
    monkeypatch.setattr(dc, "HELD_FILES", held)
    got = dc.decontamination(docs, bench, spark, file_words=100)
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.hits(texts, items)


def test_search_strings_are_listed_once():
    """The work of building a table is in proportion to its strings."""

    class Counting(dict):
        listed = 0

        def items(self):
            Counting.listed += 1
            return super().items()

    tests = Counting({" ".join(f"w{i + k}" for k in range(13)).encode(): [i] for i in range(20_000)})
    table = dc.ShiftTable(13, tests, SpanHash.of(dc.HASH_SEED))
    assert Counting.listed == 1 and len(table.tests) == 20_000 and (table.keys[1:] >= table.keys[:-1]).all()


def test_decontamination_odd(spark, docs, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in dc.decontamination(docs, bench, spark).collect()} == {0}
    assert dc.decontamination(odd, bench, spark).count() == 5 and dc.decontamination(none, bench, spark).count() == 0
