"""What moves between tasks, and letters that engines change differently."""

import duckdb
from pyspark.sql import functions as F

from leafmill.operators import document as D
from leafmill.operators import rendering as R
from leafmill.plans import layout_queries, rendering_queries, semantic_queries

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regions_without_a_call_for_each_page(spark):
    boxes = spark.range(3000).selectExpr("id % 2 AS book", "id div 4 AS page", "CAST(id % 4 * 30 AS DOUBLE) AS x0", "CAST(0 AS DOUBLE) AS y0", "CAST(id % 4 * 30 + 25 AS DOUBLE) AS x1", "CAST(60 AS DOUBLE) AS y1")
    found = D.regions(boxes, gap=70.0)
    assert "FlatMapGroups" not in optimized(found)
    assert sorted((r.book, r.page, r.n, r.x0, r.x1) for r in found.collect()) == sorted((b, p, 2, 30.0 * int(b), 30.0 * int(b) + 85) for p in range(750) for b in "01")


def test_texts_are_not_dealt_by_book(spark):
    """The only join of pages with their numbers is by page: no task gets the text of a book."""
    assert optimized(semantic_queries.numbered_lines(spark, SF)).count("Join ") == 1


def test_rows_move_as_lines(spark):
    """Above the windows of part_lines there is what is shown of an item, not what it is made of."""
    plan = optimized(rendering_queries.render_chapters(spark, SF))
    assert "Window [" in plan and not any(x in plan[: plan.index("Window [")] for x in ("Second line", "cells", "Bare"))


def test_letters_as_in_sql(spark):
    letters = ["ß", "ŉ", "é", "a", " ", "İ", "Σ", "ΑΣ", "ﬁ", ""]
    rows = spark.createDataFrame([(x,) for x in letters], "x string")
    got = rows.select(layout_queries._capital(F.col("x")), layout_queries._small(F.col("x"))).collect()
    said = [duckdb.sql(f"SELECT upper('{x}'), lower('{x}')").fetchall()[0] for x in letters]
    assert [(a, b) for x, (a, b) in zip(letters, got) if len(x) == 1] == [s for x, s in zip(letters, said) if len(x) == 1]
    assert [b for _, b in got] == [b for _, b in said]
