"""Queries of pages and of the way from blocks to books, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import assembly, document, layout, pages, semantic
from leafmill.plans import books
from leafmill.plans.layout_queries import _BOX_SQL, _CHAPTER_SQL, _HEADING_SQL, _SIZE_SQL, boxes
from leafmill.plans.tables import BLOCKS_SQL, LINES_SQL, PAGE_HEIGHT, blocks, lines, read
from leafmill.plans.text_queries import _COLLAPSE, _STRIP, _WORDS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _plain(name: str = "plain") -> str:
    return BLOCKS_SQL.replace("blocks AS", f"{name} AS")


#: Both engines, over number (of a page in its book): labels of matter on lines, and the number at a page's foot.
_ZONED = "CASE WHEN seq = 0 AND number % 50 < 3 THEN 'Preface' WHEN seq = 0 AND number % 50 > 46 THEN 'Bibliography' WHEN seq = 1 AND number % 50 = 1 THEN 'Copyright 2020' ELSE text END"
_FOOT = "CASE WHEN number % 9 = 5 THEN NULL WHEN number < 2 THEN 'ii' ELSE CAST(number AS STRING) END"
_NUM_SQL = f"""{LINES_SQL}, ranked AS (SELECT source AS book, doc_id AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, count(*) OVER (PARTITION BY source) AS total FROM documents),
  zoned AS (SELECT l.book, number, total, lower(regexp_replace({_ZONED.replace('text', 'l.text')}, '^[ \\t]+|[ \\t]+$', '', 'g')) AS line FROM lines l JOIN ranked r ON l.book = r.book AND l.page = r.page),
  signs AS (SELECT book, number, any_value(total) AS total, bool_or((words <= 6 AND regexp_matches(line, '^({document.FRONT})( |:|$)|(^| )({document.FRONT})$')) OR (words <= 12 AND regexp_matches(line, '{document.FRONT_DATA}'))) AS front,
    bool_or(words <= 6 AND regexp_matches(line, '^({document.BACK})( |:|$)|(^| )({document.BACK})$|^appendix\\s+[a-z0-9]')) AS back FROM (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> '')) AS words FROM zoned) GROUP BY book, number),
  labeled AS (SELECT *, {_FOOT.replace('STRING', 'VARCHAR')} AS label FROM signs),
  early AS (SELECT *, max(CAST(regexp_matches(label, '(?i)^[ivxlcdm]+$') AS INTEGER)) OVER (PARTITION BY book ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS roman FROM labeled WHERE number <= least(greatest(floor(total * 0.15), 1), total)),
  f AS (SELECT book, greatest(coalesce(min(number) FILTER (roman = 1 AND regexp_matches(label, '^[0-9]+$')) - 1, 0), coalesce(max(number) FILTER (front), 0)) AS front_end FROM early GROUP BY book),
  b AS (SELECT f.book, any_value(front_end) AS front_end, any_value(total) AS total, min(number) FILTER (back AND number > greatest(front_end, floor(total * (1 - 0.2)))) AS back_start FROM f JOIN labeled USING (book) GROUP BY f.book)"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    number = F.row_number().over(Window.partitionBy("book").orderBy("page"))
    total = F.count("*").over(Window.partitionBy("book"))
    numbers = docs.select("book", "page").withColumn("number", number).withColumn("total", total)  # numbers first, lines after
    rows = docs.join(numbers, ["book", "page"]).select("book", "page", "number", "total", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    return rows.withColumn("text", F.expr(_ZONED))


@query(f"""WITH {_NUM_SQL} SELECT book, CAST(1 AS BIGINT) AS start_page, CAST(front_end AS BIGINT) AS end_page, 'front' AS zone FROM b WHERE front_end > 0
    UNION ALL SELECT book, CAST(front_end + 1 AS BIGINT), CAST(coalesce(back_start - 1, total) AS BIGINT), 'body' FROM b WHERE coalesce(back_start - 1, total) >= front_end + 1
    UNION ALL SELECT book, CAST(back_start AS BIGINT), CAST(total AS BIGINT), 'back' FROM b WHERE back_start IS NOT NULL""")
def zone_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, body and back matter of each book, by labels and by the numbers at the foot of pages."""
    signs = semantic.matter_signals(numbered_lines(spark, sf_dir))
    return semantic.zone_entries(signs.withColumn("label", F.expr(_FOOT)))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT book, page, seq, {_STRIP.format("CASE WHEN seq % 3 = 0 THEN CAST(page AS VARCHAR) || ' ' ELSE text END")} AS t, y0 FROM blocks) SELECT book, page, arg_min(t, seq) AS label FROM t WHERE y0 > 0.85 * {PAGE_HEIGHT} AND length(t) BETWEEN 1 AND 6 GROUP BY book, page""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers printed at the foot of pages (here every third line is one)."""
    rows = blocks(spark, sf_dir).withColumn("text", F.expr("CASE WHEN seq % 3 = 0 THEN concat(page, ' ') ELSE text END"))
    return semantic.page_labels(rows, PAGE_HEIGHT)


_SIGNED = "CASE (page + seq) % 17 WHEN 0 THEN concat('2.1 ', text) WHEN 1 THEN concat('import ', text) WHEN 2 THEN concat('∑ ', text) WHEN 3 THEN concat('Table 3: ', text) WHEN 4 THEN concat('lemma: ', text) ELSE text END"
_SOME = "length(book) % 2 = 0 AND page % 40 < 20"


@query(
    rf"""WITH {_plain()}, l AS (SELECT book, page, seq, CASE WHEN {_SOME} THEN {_SIGNED} ELSE text END AS t, CASE WHEN {_SOME} THEN font ELSE 'Times-Roman' END AS font FROM plain),
    p AS (SELECT DISTINCT book, page FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY book) AS total FROM p),
    g AS (SELECT *, CASE WHEN total > 3 THEN 1 ELSE 0 END AS s FROM r), c AS (SELECT *, least(25, total - s) AS n FROM g),
    k AS (SELECT book, page, CASE WHEN total <= 25 THEN total ELSE n END AS n FROM c WHERE total <= 25 OR i IN (SELECT CAST(trunc(c.s + x * (c.total - 1 - c.s) / greatest(c.n - 1, 1)) AS BIGINT) FROM range(25) q(x) WHERE x < c.n)),
    m AS (SELECT l.*, k.n FROM l JOIN k USING (book, page) WHERE {_STRIP.format("t")} <> ''), f AS (SELECT *, {_STRIP.format("t")} AS u FROM m),
    a AS (SELECT book, count(*) FILTER (regexp_matches(u, '^[0-9]+[.][0-9]+([.][0-9]+)*[.]?\s+\S')) AS numbered, sum(CAST(font = 'Courier New' AND length(u) > 3 AS INTEGER) + CAST(regexp_matches(u, '^(def |class |import |from \S+ import |function\s*\(|const |let |var |public\s+class|#include\s*<)') AS INTEGER)) AS code,
      count(*) FILTER (regexp_matches(u, '[\x{{2100}}-\x{{214F}}\x{{2200}}-\x{{22FF}}\x{{2070}}-\x{{209F}}\x{{1D400}}-\x{{1D7FF}}¹²³]') OR regexp_matches(u, '(?i)^({T.THEOREMS})\s*([0-9]+([.][0-9]+)*)?\s*[.:]')) AS math, count(*) FILTER (regexp_matches(u, '(?i)^(Figure|Fig[.]|Table|Listing|Algorithm)\s+[0-9]+([.][0-9]+)?\s*[:.]')) AS captions, max(n) AS n FROM f GROUP BY book),
    t AS (SELECT k.book, count(*) AS tables FROM k JOIN documents d ON d.source = k.book AND d.doc_id = k.page WHERE contains(d.text, '|') GROUP BY k.book),
    z AS (SELECT book, numbered + CASE WHEN length(book) % 3 = 0 THEN 1 ELSE 0 END AS numbered, CAST(code AS BIGINT) AS code, math, coalesce(tables, 0) AS tables, captions, n FROM a LEFT JOIN t USING (book)),
    q AS (SELECT *, CASE WHEN numbered >= 2 THEN 3 WHEN numbered >= 1 THEN 1 ELSE 0 END + CASE WHEN code >= 3 THEN 3 WHEN code >= 1 THEN 1 ELSE 0 END + CASE WHEN math >= 3 THEN 3 WHEN math >= 1 THEN 1 ELSE 0 END
      + CASE WHEN tables >= 2 OR tables / n >= 0.05 THEN 2 WHEN tables = 1 THEN 1 ELSE 0 END + CASE WHEN captions >= 2 THEN 2 WHEN captions >= 1 THEN 1 ELSE 0 END AS score FROM z)
    SELECT book, numbered, code, math, tables, captions, CAST(score AS INTEGER) AS score, CASE WHEN score >= 3 THEN 'technical' ELSE 'literature' END AS profile FROM q"""
)
def profile_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of technical books on 25 pages spread over each, and what they make of it."""
    some = F.expr(_SOME)
    rows = blocks(spark, sf_dir).withColumn("text", F.when(some, F.expr(_SIGNED)).otherwise(F.col("text"))).withColumn("font", F.when(some, F.col("font")).otherwise("Times-Roman"))
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    marks = docs.select("book").distinct().filter(F.length("book") % 3 == 0).select("book", F.lit("1.2 Inner").alias("title"))
    return semantic.profile_signals(rows, docs.filter(F.contains("text", F.lit("|"))), marks)


@query(
    rf"""WITH {LINES_SQL}, p AS (SELECT DISTINCT book, page FROM lines), b AS (SELECT book, page, seq, CASE page % 7 WHEN 0 THEN '' WHEN 1 THEN '�#' ELSE text END AS text FROM lines),
    s AS (SELECT book, page, string_agg(text, '' ORDER BY seq) AS t FROM b GROUP BY book, page), v AS (SELECT book, page, avg(CAST((page + seq) % 3 > 0 AND page % 2 = 0 AS INTEGER)) > 0.5 AS is_vertical FROM lines GROUP BY book, page),
    q AS (SELECT *, length(t) AS n, {_WORDS.format("t")} AS w FROM s), c AS (SELECT book, page, t, 0.4 * least(n / 20.0, 1.0) + 0.3 * CASE WHEN n = 0 THEN 0.0 ELSE greatest(1.0 - 10.0 * len(regexp_extract_all(t, '[\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]')) / n, 0.0) END
      + 0.3 * CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '^[.,;:!?"''()\[\]{{}}“”‘’—\-*]+|[.,;:!?"''()\[\]{{}}“”‘’—\-*]+$', '', 'g'), '^[A-Za-z]{{2,20}}$'))) / len(w) END AS score FROM q)
    SELECT book, page, round(score + 1e-9, 6) AS score, score < 0.5 AND length({_STRIP.format("t")}) <= 5 AND page % 5 > 0 AS is_blank, is_vertical, score < 0.5 AND NOT (length({_STRIP.format("t")}) <= 5 AND page % 5 > 0) AS needs_ocr FROM c JOIN v USING (book, page)"""
)
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are blank, to be recognised, or written from top to bottom."""
    rows = lines(spark, sf_dir)
    text = F.when(F.col("page") % 7 == 0, "").when(F.col("page") % 7 == 1, "�#").otherwise(F.col("text"))
    upright = rows.select("book", "page", ((F.col("page") + F.col("seq")) % 3 > 0).alias("a"), (F.col("page") % 2 == 0).alias("b")).select("book", "page", (F.col("a") & F.col("b")).alias("vertical"))
    every = rows.select("book", "page").distinct()
    found = pages.page_states(every, rows.withColumn("text", text), upright, every.filter("page % 5 = 0"))
    return found.withColumn("score", F.round(F.col("score") + 1e-9, 6))  # off the ties of halves


@query(
    f"""WITH {BLOCKS_SQL}, g AS (SELECT DISTINCT book, page, 60.0 AS x0, 80.0 AS y0, 200.0 + page % 90 AS x1, 240.0 AS y1 FROM blocks WHERE page % 3 = 0)
    SELECT b.book, b.page, b.seq FROM blocks b LEFT JOIN g ON g.book = b.book AND g.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN g.x0 AND g.x1 AND (b.y0 + b.y1) / 2 BETWEEN g.y0 AND g.y1 WHERE g.book IS NULL"""
)
def outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose centre is in no table of their page."""
    rows = blocks(spark, sf_dir)
    grids = rows.filter("page % 3 = 0").select("book", "page").distinct().select("book", "page", F.lit(60.0).alias("x0"), F.lit(80.0).alias("y0"), (F.col("page") % 90 + 200.0).alias("x1"), F.lit(240.0).alias("y1"))
    return pages.outside_tables(rows, grids).select("book", "page", "seq")


@query(f"WITH {BLOCKS_SQL}, c AS (SELECT book, page, CASE WHEN page % 3 = 0 THEN [] ELSE list_transform(range(page % 4), lambda i: list_transform(range(CASE WHEN page % 5 = 0 THEN i ELSE 1 + page % 3 END), lambda k: concat('c', k))) END AS cells FROM (SELECT DISTINCT book, page FROM blocks)) SELECT book, page, CAST(len(cells) AS INTEGER) AS n_rows FROM c WHERE len(cells) >= 2 AND len(list_filter(cells, lambda r: len(r) < 2)) = 0")
def tables_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that are tables: two rows of two cells at least."""
    rows = blocks(spark, sf_dir).select("book", "page").distinct()
    cells = F.expr("CASE WHEN page % 3 = 0 OR page % 4 = 0 THEN CAST(array() AS array<array<string>>) ELSE transform(sequence(0, CAST(page % 4 AS INT) - 1), i -> CASE WHEN page % 5 = 0 THEN CASE WHEN i = 0 THEN CAST(array() AS array<string>) ELSE transform(sequence(0, i - 1), k -> concat('c', k)) END ELSE transform(sequence(0, CAST(page % 3 AS INT)), k -> concat('c', k)) END) END")
    return document.tables_found(rows.withColumn("cells", cells)).select("book", "page", F.size("cells").alias("n_rows"))


@query(
    f"""WITH RECURSIVE {_BOX_SQL}, x AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'table' END AS kind FROM boxes),
    f AS (SELECT book, page, struct_pack(kind := kind, seq := seq, y0 := y0) AS r, row_number() OVER (PARTITION BY book, page ORDER BY kind, seq) AS k FROM x WHERE kind <> 'text'),
    walk AS (SELECT book, page, 0 AS k, list(struct_pack(kind := kind, seq := seq, y0 := y0) ORDER BY seq) FILTER (kind = 'text') AS done FROM x GROUP BY book, page
      UNION ALL SELECT w.book, w.page, w.k + 1, coalesce(list_filter(w.done, lambda y, i: i < coalesce(nullif(list_position(list_transform(w.done, lambda z: z.y0 > f.r.y0), true), 0), 1000)), []) || [f.r] || coalesce(list_filter(w.done, lambda y, i: i >= coalesce(nullif(list_position(list_transform(w.done, lambda z: z.y0 > f.r.y0), true), 0), 1000)), []) FROM walk w JOIN f ON f.book = w.book AND f.page = w.page AND f.k = w.k + 1),
    whole AS (SELECT book, page, arg_max(done, k) AS done FROM walk GROUP BY book, page), each AS (SELECT book, page, unnest(done) AS r, generate_subscripts(done, 1) - 1 AS place FROM whole)
    SELECT book, page, CAST(place AS INTEGER) AS place, r.kind AS kind, r.seq AS seq FROM each"""
)
def inserted_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a page's blocks with its images and tables put in by where they begin."""
    rows = boxes(spark, sf_dir)
    kind = F.expr("CASE seq % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'table' END")
    return pages.inserted(rows.filter(kind == "text"), rows.withColumn("kind", kind).filter("kind <> 'text'"))


@query(
    f"""WITH RECURSIVE {_BOX_SQL}, s AS (SELECT *, seq // 4 AS line, CASE WHEN seq % 5 = 0 THEN '' ELSE concat('w', seq % 2) END AS t, row_number() OVER (PARTITION BY book, page, seq // 4 ORDER BY seq) AS k FROM boxes),
    near AS (SELECT b.book, b.page, b.line, b.seq, list(a.seq) AS earlier FROM s a JOIN s b USING (book, page, line) WHERE a.seq < b.seq AND a.t = b.t AND b.t <> ''
      AND ((least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.7)
        OR (abs(a.x0 - b.x0) <= 2 AND abs(a.y0 - b.y0) <= 2 AND abs(a.x1 - b.x1) <= 2 AND abs(a.y1 - b.y1) <= 2)) GROUP BY ALL),
    n AS (SELECT s.book, s.page, s.line, s.seq, s.k, coalesce(earlier, []) AS earlier FROM s LEFT JOIN near USING (book, page, line, seq)),
    walk AS (SELECT DISTINCT book, page, line, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM n
      UNION ALL SELECT w.book, w.page, w.line, n.k, CASE WHEN list_has_any(w.kept, n.earlier) THEN w.kept ELSE list_append(w.kept, n.seq) END FROM walk w JOIN n ON n.book = w.book AND n.page = w.page AND n.line = w.line AND n.k = w.k + 1),
    whole AS (SELECT book, page, line, arg_max(kept, k) AS kept FROM walk GROUP BY book, page, line)
    SELECT book, page, line, unnest(kept) AS seq FROM whole"""
)
def distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without shadows; two items of an order are of one line here, and of one text if their parts end alike."""
    rows = boxes(spark, sf_dir).withColumn("line", F.expr("seq div 4")).withColumn("text", F.expr("CASE WHEN seq % 5 = 0 THEN ' ' ELSE concat('w', seq % 2) END"))
    return pages.distinct_spans(rows).select("book", "page", "line", "seq")


@query(
    rf"""WITH {BLOCKS_SQL}, {_CHAPTER_SQL}, b AS (SELECT book, page, seq, CASE WHEN page % 10 = 3 THEN concat(string_split(text, ' ')[1], 'abc .... ', seq) ELSE text END AS text FROM blocks),
    p AS (SELECT book, page, count(*) FILTER (regexp_matches({_STRIP.format("text")}, '^.{{3,80}}?[.\s]{{2,}}[0-9]{{1,4}}$')) AS leaders, regexp_replace(lower(string_agg(text, '' ORDER BY seq)), '[^a-z0-9]', '', 'g') AS said FROM b GROUP BY book, page),
    t AS (SELECT book, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM chapters), h AS (SELECT p.book, p.page, any_value(leaders) AS leaders, count(*) FILTER (length(t) >= 4 AND contains(said, t)) AS held FROM p LEFT JOIN t USING (book) GROUP BY p.book, p.page)
    SELECT book, page FROM h WHERE leaders >= 3 OR held >= 3"""
)
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed tables of contents, by leaders or by the titles of chapters."""
    rows = blocks(spark, sf_dir)
    heads = layout.heading_candidates(rows, PAGE_HEIGHT).filter("level = 1")
    chapters = layout.chapters(layout.best_on_page(heads), rows.select("book", "page"))
    text = F.expr("CASE WHEN page % 10 = 3 THEN concat(split(text, ' ')[0], 'abc .... ', seq) ELSE text END")
    return semantic.toc_pages(rows.withColumn("text", text), chapters)


@query(
    f"""WITH {BLOCKS_SQL}, {_HEADING_SQL}, h1 AS (SELECT * FROM headings WHERE level = 1 AND length(book) % 2 = 0), parts AS (SELECT book, page, text FROM headings WHERE level = 2 AND page % 4 = 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY length(text) DESC, seq) AS n FROM h1) WHERE n = 1), last AS (SELECT book, min(page) AS lo, max(page) AS hi FROM blocks GROUP BY book),
    c AS (SELECT book, CAST(row_number() OVER w AS INTEGER) AS number, text AS title, page AS start_page, coalesce(lead(page) OVER w - 1, hi) AS end_page, seq FROM best JOIN last USING (book) WINDOW w AS (PARTITION BY book ORDER BY page, seq)
      UNION ALL SELECT book, 1, 'Untitled', lo, hi, NULL FROM last WHERE book NOT IN (SELECT book FROM best))
    SELECT c.*, (SELECT arg_max(p.text, p.page) FROM (SELECT book, page, max(text) AS text FROM parts GROUP BY book, page) p WHERE p.book = c.book AND p.page <= c.start_page) AS part_title FROM c"""
)
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with their parts' titles; a book without headings (here every second) is one chapter."""
    rows = blocks(spark, sf_dir)
    heads = layout.heading_candidates(rows, PAGE_HEIGHT)
    parts = heads.filter("level = 2 AND page % 4 = 0").groupBy("book", "page").agg(F.max("text").alias("text"))
    return semantic.chapters_of(heads.filter("level = 1").filter(F.length("book") % 2 == 0), rows.select("book", "page").distinct(), parts)


_ITALIC = "CASE WHEN seq = 2 AND page % 3 = 0 THEN concat('— ', 'A. Writer') WHEN seq < 3 THEN substring_index(text, ' ', 6) ELSE text END"


@query(
    rf"""WITH {_plain()}, b AS (SELECT book, page, seq, CASE WHEN seq = 2 AND page % 3 = 0 THEN '— A. Writer' WHEN seq < 3 THEN array_to_string(string_split(text, ' ')[1:6], ' ') ELSE text END AS text, seq < 4 - page % 3 AS italic FROM plain),
    w AS (SELECT *, regexp_extract({_STRIP.format("text")}, '^[—–-]+\s*(\S.*)$', 1) <> '' AND len({_WORDS.format("text")}) <= 15 AS by_, row_number() OVER (PARTITION BY book, page ORDER BY seq) AS n, len({_WORDS.format("text")}) AS words FROM b),
    f AS (SELECT *, bool_and(italic OR (by_ AND n > 1)) OVER u AS ok, sum(CASE WHEN by_ THEN 0 ELSE words END) OVER u AS total, coalesce(bool_or(by_) OVER (PARTITION BY book, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM w WINDOW u AS (PARTITION BY book, page ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT book, page, seq, CASE WHEN by_ AND n > 1 THEN regexp_extract({_STRIP.format("text")}, '^[—–-]+\s*(\S.*)$', 1) END AS attribution FROM f WHERE ok AND total <= 40 AND NOT ended"""
)
def epigraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open a run (here a page) in italics, and whom they are by."""
    rows = blocks(spark, sf_dir).withColumn("text", F.expr(_ITALIC)).withColumn("italic", F.expr("seq < 4 - page % 3")).withColumn("run", F.col("page"))
    return semantic.epigraphs(rows).select("book", "page", "seq", "attribution")


@query(
    f"""WITH {_plain()}, b AS (SELECT book, page, seq, CASE WHEN seq % 9 = 4 THEN CASE page % 3 WHEN 0 THEN 'Glossary:' WHEN 1 THEN ' Works Cited' ELSE 'notes of many more words' END ELSE text END AS text, seq % 7 = 6 AS pictured FROM plain),
    z AS (SELECT source AS book, max(doc_id) - 40 AS lo, max(doc_id) AS hi FROM documents GROUP BY source), m AS (SELECT b.* FROM b JOIN z USING (book) WHERE page BETWEEN lo AND hi AND page % 20 <> 11),
    l AS (SELECT *, CASE WHEN NOT pictured AND rtrim({_COLLAPSE.format("text")}, '.:') IN ('glossary', 'works cited') THEN {_STRIP.format("text")} END AS label FROM m),
    s AS (SELECT *, count(label) OVER w AS section, last_value(label IGNORE NULLS) OVER w AS section_title FROM l WINDOW w AS (PARTITION BY book ORDER BY page, seq ROWS UNBOUNDED PRECEDING))
    SELECT book, page, seq, section, section_title FROM s WHERE label IS NULL"""
)
def matter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of back matter that no chapter has claimed, by the label before them."""
    text = F.expr("CASE WHEN seq % 9 = 4 THEN CASE page % 3 WHEN 0 THEN 'Glossary:' WHEN 1 THEN ' Works Cited' ELSE 'notes of many more words' END ELSE text END")
    rows = blocks(spark, sf_dir).withColumn("text", text).withColumn("kind", F.when(F.col("seq") % 7 == 6, "image").otherwise("text"))
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id")
    zones = docs.groupBy("book").agg((F.max("doc_id") - 40).alias("start_page"), F.max("doc_id").alias("end_page")).withColumn("zone", F.lit("back"))
    claimed = docs.filter("doc_id % 20 = 11").select("book", F.col("doc_id").alias("start_page"), F.col("doc_id").alias("end_page"))
    return semantic.matter(rows, zones, claimed, "back", document.BACK_LABELS).select("book", "page", "seq", "section", "section_title")


@query(
    """WITH n AS (SELECT source AS book, doc_id AS page, 0 AS seq, CAST(doc_id % 9 AS VARCHAR) AS marker FROM documents), c AS (SELECT DISTINCT source AS book, doc_id AS number, doc_id AS a, doc_id + 25 AS b FROM documents WHERE doc_id % 50 < 20)
    SELECT n.book, c.number AS part, n.page, n.seq, n.marker FROM n JOIN c ON n.book = c.book AND n.page BETWEEN a AND b"""
)
def chapter_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes by the chapters that hold their pages."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    notes = docs.withColumn("seq", F.lit(0)).withColumn("marker", (F.col("page") % 9).cast("string")).withColumn("text", F.lit("x"))
    chapters = docs.filter("page % 50 < 20").select("book", F.col("page").alias("number"), F.col("page").alias("start_page"), (F.col("page") + 25).alias("end_page"))
    return semantic.chapter_notes(notes, chapters).drop("text")


@query(
    f"""WITH {BLOCKS_SQL}, {_HEADING_SQL}, marks AS (SELECT book, page, seq AS mark, 1 + seq % 5 AS level, text AS title FROM blocks WHERE seq % 4 = 1 AND (length(book) % 2 = 0 OR page % 97 = 1)),
    ok AS (SELECT book FROM marks GROUP BY book HAVING count(*) >= 3)
    SELECT book, page, CASE WHEN mark % 8 = 1 THEN mark END AS seq, CAST(least(level, 3) AS INTEGER) AS level, title AS text FROM marks WHERE book IN (SELECT book FROM ok)
    UNION ALL SELECT book, page, seq, level, text FROM headings WHERE book NOT IN (SELECT book FROM ok)"""
)
def heading_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings from bookmarks, of books that have three, and from sizes of the others."""
    rows = blocks(spark, sf_dir)
    marks = rows.filter("seq % 4 = 1 AND (length(book) % 2 = 0 OR page % 97 = 1)").select("book", "page", F.col("seq").alias("mark"), F.expr("1 + seq % 5").alias("level"), F.col("text").alias("title"))
    matched = marks.filter("mark % 8 = 1").select("book", "mark", F.col("mark").alias("seq")).distinct()
    return layout.headings_of(marks, matched, layout.heading_candidates(rows, PAGE_HEIGHT))


@query(f"WITH {BLOCKS_SQL}, t AS (SELECT book, page, seq, CASE seq % 5 WHEN 0 THEN '— ' || text WHEN 1 THEN '(A. Writer, 1999)' WHEN 2 THEN '--- x' ELSE text END AS text FROM blocks), s AS (SELECT *, {_STRIP.format('text')} AS t, len({_WORDS.format('text')}) AS n FROM t), a AS (SELECT book, page, seq, CASE WHEN n <= 15 THEN coalesce(nullif(trim(regexp_extract(t, '^[\\s—–~·•-]{{1,3}}\\s*([A-Za-z0-9(\\[\"''].*)$', 1)), ''), nullif(trim(regexp_extract(t, '^[(]([A-Za-z0-9\\s.,''\"—–-]+)[)]$', 1)), '')) END AS attribution FROM s) SELECT * FROM a WHERE attribution IS NOT NULL")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name whom a poem or a quotation is by."""
    text = F.expr("CASE seq % 5 WHEN 0 THEN concat('— ', text) WHEN 1 THEN '(A. Writer, 1999)' WHEN 2 THEN '--- x' ELSE text END")
    return blocks(spark, sf_dir).select("book", "page", "seq", T.attribution(text).alias("attribution")).filter("attribution IS NOT NULL")


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Figure ', p_partkey, '.2: x') WHEN 1 THEN 'Plate IV' WHEN 2 THEN 'Fig: none' END AS caption FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('fig-', p_partkey, '-2') WHEN 1 THEN 'fig-IV' ELSE concat('fig-1-', p_partkey) END AS figure FROM f""")
def figure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of figures, from their captions or by their place."""
    caption = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Figure ', p_partkey, '.2: x') WHEN 1 THEN 'Plate IV' WHEN 2 THEN 'Fig: none' END")
    return read(spark, sf_dir, "part").select("p_partkey", T.figure_id(caption, F.concat(F.lit("fig-1-"), "p_partkey")).alias("figure"))


@query(f"WITH {BLOCKS_SQL}, {_SIZE_SQL}, t AS (SELECT book, page, seq, CASE seq % 4 WHEN 0 THEN 'Definitions:' WHEN 1 THEN 'LIST  OF terms.' WHEN 2 THEN 'Glossary of birds' ELSE text END AS text FROM blocks) SELECT book, page, seq FROM t WHERE rtrim({_COLLAPSE.format('text')}, '.:') IN ({', '.join(repr(x) for x in T.GLOSSARY_TITLES)})")
def glossary_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of sections that are glossaries."""
    text = F.expr("CASE seq % 4 WHEN 0 THEN 'Definitions:' WHEN 1 THEN 'LIST  OF terms.' WHEN 2 THEN 'Glossary of birds' ELSE text END")
    return blocks(spark, sf_dir).filter(T.is_glossary_title(text)).select("book", "page", "seq")


@query("SELECT CAST(array_to_string(list_sort(list_distinct(list(concat(user_id % 7, '-', event_id % 5)))), ',') AS VARCHAR) AS names FROM events")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without repeats, in order."""
    names = F.array_sort(F.collect_set(F.expr("concat(user_id % 7, '-', event_id % 5)")))
    return read(spark, sf_dir, "events").agg(F.array_join(names, ",").alias("names"))


@query("""SELECT p_partkey, to_json({'name': p_name, 'size': p_size, 'type': CASE WHEN p_partkey % 2 = 0 THEN p_type END}) AS json FROM (SELECT p_partkey, p_name, p_partkey % 50 AS p_size, p_brand AS p_type FROM part WHERE p_partkey % 2 = 0)
    UNION ALL SELECT p_partkey, to_json({'name': p_name, 'size': p_partkey % 50}) FROM part WHERE p_partkey % 2 = 1""")
def catalog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, without what is null."""
    row = F.struct(F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.to_json(row).alias("json"))


def _whole(spark: SparkSession, sf_dir: str) -> books.Tree:
    """Books of sources, pages of documents, with images, tables and notes made of some lines."""
    rows = blocks(spark, sf_dir).withColumn("superscript", F.lit(False)).withColumn("ocrd", F.lit(False)).withColumn("vertical", F.lit(False))
    kind = F.when(F.col("seq") % 23 == 11, "image").when(F.col("seq") % 29 == 17, "table").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("cells", F.when(kind == "table", F.array(F.array("text", F.lit("b")), F.array(F.lit("c"), F.lit("d"))))).withColumn("image", F.when(kind == "image", F.concat(F.lit("p"), "page", F.lit("-"), "seq", F.lit(".png")))).withColumn("caption", F.lit(None).cast("string"))
    zones = zone_entries(spark, sf_dir)
    ranked = rows.select("book", "page").distinct().withColumn("number", F.row_number().over(Window.partitionBy("book").orderBy("page")).cast("long"))
    rows = rows.join(ranked, ["book", "page"]).drop("page").withColumnRenamed("number", "page")
    named = ranked.select("book").distinct().select("book", F.col("book").alias("title"), F.lit("Unknown").alias("author"), F.lit("2020-01-01").alias("converted"))
    return books.semantic(spark, named, rows, zones, page_width=500.0, page_height=PAGE_HEIGHT)


@query()
def book_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of whole books: kinds of items by chapter and section."""
    return _whole(spark, sf_dir).items.groupBy("book", "division", "part", "section", "kind").agg(F.count("*").alias("n"))
