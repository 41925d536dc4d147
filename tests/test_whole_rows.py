"""Queries look at whole lines and at all rows."""

from leafmill.plans import registry


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_verse_runs_judges_whole_lines(spark, tmp_path):
    verse = "The moon is low\nThe wind is high\nAnd all the stars\nGo slowly by"
    prose = "\n".join(f"Line {w} of a long paragraph that goes on far beyond the width of any verse at all" for w in "abcd")
    sf = table(spark, tmp_path, "documents", [(7, verse, "s"), (8, prose, "s")], "doc_id long, text string, source string")
    rows = registry.QUERIES["verse_runs"](spark, sf).collect()
    assert any(r.is_verse for r in rows if r.page == 7) and not any(r.is_verse for r in rows if r.page == 8)


def test_catalog_takes_all_parts(spark, tmp_path):
    sf = table(spark, tmp_path, "part", [(1, "a"), (1 << 20, "b"), (5 << 20, "c")], "p_partkey long, p_name string")
    rows = {r.p_partkey: r.size for r in registry.QUERIES["catalog_clean_title"](spark, sf).collect()}
    assert rows == {1: "977 B", 1 << 20: "977.0 MB", 5 << 20: "4.77 GB"}
