"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from leafmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got or name == "fuzzy_headers"
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_titles_that_letters_of_numerals_make(spark, tmp_path):
    """Lines that tell a numeral from any letters of one, and words before a number, are judged as the SQL does."""
    second = ["Cimi.", "XIV", "iix", "DIM.", "Novi", "Section 3", "No. 4", "Part 7.", "chapter lcd", "12.", " Mild ", "\tvi", "vi\t", "A Name", "vi ", "", "12\u0085"]
    rows = [(page, f"label\n{second[page // 60]}\nthe rest of the page, which is longer than its head is", f"s{page % 2}") for page in range(60 * len(second))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ("book", "page", "seq", "title", "taken")
    got = sorted((tuple(r[c] for c in columns) for r in registry.QUERIES["chapter_titles"](spark, str(tmp_path)).collect()), key=repr)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL['chapter_titles']})").fetchall()
    assert got == sorted(want, key=repr) and sum(r[4] is not None for r in got) > 20


def test_lines_of_odd_ends(spark, tmp_path):
    """Empty documents and lines, and white space at the ends of lines, are kept as the SQL keeps them."""
    texts = ["", "\n", " a\nb ", "one-\n\ntwo", "\n\n x-\ny\n\n", "-\nb\n-\nc", "e -\nf", "--\ng- \nh-\t\ni", "a-\r\nb\r\n", "a-\u2028\nb \u0085\nc", "ß-\nß\nßß-\nÉ-\né", None, "the end"]
    rows = [(page, texts[page // 20], f"s{page % 2}") for page in range(20 * len(texts))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r["page"], r["text"]) for r in registry.QUERIES["hyphen_rejoin"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"SELECT page, text FROM ({registry.ORACLE_SQL['hyphen_rejoin']})").fetchall()) and len(got) == 240


@pytest.mark.parametrize("name", ["html_flow", "html_markdown"])
def test_references_that_titles_cut(spark, tmp_path, name):
    """What is left of a reference at the end of a title is text, as the SQL has it."""
    cut = ["A &amp;&amp", "B &quot", "C &am", "D &amp;", "E &copy", "F &", "G &amp;amp;lt", "H &ampx;", "I &#38", "J &lt;&lt K &lt;"]
    page = '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/a">x &amp; &amp y</a></li></ul></nav><div class="ad">Ad &gt</div><article><h1>{0}</h1><p>first &amp; last &copy</p><p><b>{0}<br> end</article><footer>&copy; foot &middot</footer></body></html>'
    rows = [(i, page.format(x)) for i, x in enumerate(cut)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall(), key=repr) and len(got) >= len(cut)
