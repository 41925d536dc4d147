"""Rules on small hand-made inputs."""

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import document as D
from leafmill.operators import layout
from leafmill.sources.html import page_items
from leafmill.streaming.intake import watch


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_callouts(spark):
    got = spark.createDataFrame([("Note: mind the gap",), ("KEY POINT. x",), ("Notebook: x",)], "t string").select(*(c.alias(k) for k, c in T.callout(F.col("t")).items())).collect()
    assert [tuple(r) for r in got] == [("Note", "mind the gap", "note"), ("KEY POINT", "x", "important"), (None, None, None)]
    assert values(spark, T.callout_type(F.col("t")), "Theorem 3.2", "Odd") == ["theorem", "info"]


def test_citations_expand(spark):
    assert values(spark, T.expanded(F.col("t")), "1, 3", "1-4", "4-2") == [[1, 3], [1, 2, 3, 4], []]


def test_math(spark):
    assert values(spark, T.symbol_density(F.col("t")), "plain", "αβγ", "∀x", "") == [0.0, 0.0, 0.5, 0.0]
    assert values(spark, T.inline_math(F.col("t")), "the value of α, is 3", "no math  here") == ["the value of $α$, is 3", "no math  here"]


def test_titles_and_sizes(spark):
    assert values(spark, T.clean_title(F.col("t"), F.lit("stem")), "A Book - PDFDrive.com", "a%20b", "draft.indd", "Real", None) == ["A Book", "stem", "stem", "Real", "stem"]
    assert values(spark, T.file_size(F.col("t").cast("long")), "512", "1280", "1048576", "1073741824") == ["512 B", "1.2 KB", "1.0 MB", "1.00 GB"]


def test_letters_terms_files(spark):
    assert values(spark, T.letter_divider(F.col("t")), "— B —", "[C]", "Letter d", "Bee") == ["B", "C", "D", None]
    got = spark.createDataFrame([("Term : what it is",), ("If so then : no",)], "t string").select(*(c.alias(k) for k, c in T.term_definition(F.col("t")).items())).collect()
    assert [tuple(r) for r in got] == [("Term", "what it is"), (None, None)]
    assert values(spark, T.file_name(F.col("t")), 'a/b: "c"?', "  ") == ["ab c", "Untitled"]
    assert values(spark, T.figure_number(F.col("t")), "Figure 3.2: x", "Plate IV", "Fig: y") == ["3.2", "IV", None]


def test_hyphens(spark):
    rows = spark.createDataFrame([(["well-", "known fact", "A-", "B"],)], "t array<string>")
    assert rows.select(T.joined(F.col("t"))).first()[0] == "wellknown fact A- B"


def test_lines_joined_as_they_are(spark):
    rows = spark.createDataFrame([([" a- ", "", "b", "-", "c "],), (["", " "],), ([],), ([" -", "d"],)], "t array<string>")
    assert [r[0] for r in rows.select(T.joined(F.col("t"))).collect()] == ["ab c", "", "", "d"]
    assert [r[0] for r in rows.select(T.joined(F.col("t"), as_they_are=True)).collect()] == [" a-   b c ", " ", "", " d"]


def test_as_of(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, at int")
    marks = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, at int, v string")
    assert {tuple(r) for r in layout.as_of(rows, marks, "k", "at", "v").collect()} == {("a", 1, None), ("a", 5, "y"), ("b", 2, None)}


def test_titles_beyond_the_bound(spark):
    pages = spark.createDataFrame([(1, "xxalphayybetazz"), (2, "none")], "page int, t string")
    titles = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "title string")
    few, many = D.contained(pages, titles, 12), D.contained(pages, titles, 12, most=1)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == {(1, "alpha"), (1, "beta")}


def test_html():
    rows = page_items('<body><!-- no --><h1>A <i>B</i></h1><p>one<p>two <a href="u">l</a><ul><li>x<li>y</ul><script>"</p>"</script><div>tail</div><h2>C</h2><img src="i.png?x" alt="d"></body>')
    got = [(r["section_title"], r["section_level"], r.get("kind"), r.get("text")) for r in rows]
    assert got == [("A B", 1, "paragraph", "one"), ("A B", 1, "paragraph", "two [l](u)"), ("A B", 1, "list", None), ("A B", 1, "paragraph", "tail"), ("C", 2, "image", None)]
    assert [p["text"] for p in rows[2]["points"]] == ["x", "y"] and rows[4]["image"] == "i.png?x" and rows[4]["caption"] == "d"


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(b"x")
    seen = []
    watch(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.length for r in df.select("length").collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert seen == [1]


def test_sequential(spark):
    from leafmill.operators import pages as P
    from leafmill.operators.glossary import glossary

    shape = "book string, page long, seq int, kind string, text string, bold boolean, x0 double, y0 double, x1 double, y1 double"
    rows = [
        ("b", 1, 0, "text", "Same", False, 0.0, 0.0, 10.0, 10.0), ("b", 1, 1, "text", "same ", False, 2.0, 0.0, 12.0, 10.0), ("b", 1, 2, "text", "same", False, 4.0, 0.0, 14.0, 10.0),
        ("b", 2, 0, "image", "", False, 0.0, 0.0, 10.0, 10.0), ("b", 2, 1, "text", "Figure 1. x", False, 0.0, 15.0, 10.0, 20.0), ("b", 2, 2, "image", "", False, 0.0, 22.0, 10.0, 30.0), ("b", 2, 3, "text", "Fig. 2", False, 0.0, 45.0, 10.0, 50.0),
        ("b", 3, 0, "text", "A", False, 0.0, 0.0, 1.0, 1.0), ("b", 3, 1, "text", "Ape: an animal", False, 0.0, 0.0, 1.0, 1.0), ("b", 3, 2, "text", "with: hands", False, 9.0, 0.0, 1.0, 1.0), ("b", 3, 3, "text", "Axe", True, 0.0, 0.0, 1.0, 1.0), ("b", 3, 4, "text", "a tool", False, 9.0, 0.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, shape)
    assert sorted(r.seq for r in P.without_layers(df.filter("page = 1")).collect()) == [0, 2]
    assert sorted((r.image, r.caption) for r in P.captioned(df.filter("page = 2 AND kind = 'image'"), df.filter("page = 2 AND kind = 'text'")).collect()) == [(0, 1), (2, 3)]
    entries, rest = glossary(df.filter("page = 3").selectExpr("*", "1L AS section", "10.0D AS size"))
    assert rest.count() == 0 and [(r.letter, r.term, r.definition) for r in entries.orderBy("entry").collect()] == [("A", "Ape", "an animal with: hands"), ("A", "Axe", "a tool")]
