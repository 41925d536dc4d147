"""Queries of the layout rules over lines of documents with derived geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import layout
from leafmill.plans.tables import BLOCKS_SQL, PAGE_HEIGHT, PAGE_WIDTH, blocks, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _mode_sql(value: str, name: str) -> str:
    return f"""(SELECT book, {name} FROM (SELECT book, {value} AS {name}, row_number() OVER (PARTITION BY book ORDER BY sum(greatest(length(text), 1)) DESC, min(page * 100000 + seq)) AS n
      FROM blocks GROUP BY book, {value}) WHERE n = 1)"""


_SIZE_SQL = f"body AS {_mode_sql('round(size, 1)', 'body_size')}"
_MARGIN_SQL = f"margins AS (SELECT * FROM {_mode_sql('round_even(x0, 0)', 'left_margin')} JOIN {_mode_sql('round_even(x1, 0)', 'right_margin')} USING (book))"
_TIER_SQL = f"""{_SIZE_SQL}, sizes AS (SELECT book, list_sort(list(DISTINCT round(size, 1)), 'DESC') AS s FROM blocks JOIN body USING (book) WHERE round(size, 1) > body_size + 0.5 GROUP BY book),
  folded AS (SELECT book, list_reduce(list_prepend(CAST([] AS DOUBLE[]), list_transform(s, lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 OR a[-1] - x[1] >= 1.5 THEN list_concat(a, x) ELSE a END)[1:3] AS t FROM sizes),
  tiers AS (SELECT book, CAST(unnest(range(1, len(t) + 1)) AS INTEGER) AS level, unnest(t) AS tier FROM folded)"""


@query(f"WITH {BLOCKS_SQL}, {_SIZE_SQL} SELECT * FROM body")
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_size(blocks(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL}, {_MARGIN_SQL} SELECT * FROM margins")
def body_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_margins(blocks(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL}, {_TIER_SQL} SELECT * FROM tiers")
def heading_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_tiers(blocks(spark, sf_dir))


_HEADING_SQL = rf"""{_TIER_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY seq) = 1 AS is_first FROM blocks),
  near AS (SELECT book, page, seq, text, y0, bold, is_first, min(level) AS level FROM firsts JOIN tiers USING (book) WHERE abs(size - tier) <= 1.0 GROUP BY ALL),
  headings AS (SELECT * FROM (SELECT book, page, seq, level, CAST(y0 <= {0.3 * PAGE_HEIGHT} AS INTEGER) + CAST(is_first AS INTEGER) + CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) <= 15 AS INTEGER)
    + CAST(bold OR (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}')) AS INTEGER) AS signs, text FROM near) WHERE signs >= 2)"""


@query(f"WITH {BLOCKS_SQL}, {_HEADING_SQL} SELECT * FROM headings")
def heading_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a heading's size that two signs of four confirm."""
    return layout.heading_candidates(blocks(spark, sf_dir), PAGE_HEIGHT)


_OCRD = "(page % 2 = 0)"
_SHOUT = "CASE WHEN seq % 4 = 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyzäöüéèêàñíóúáç', 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÑÍÓÚÁÇ') WHEN seq % 4 = 2 AND page % 4 = 0 THEN 'אבג דהו' ELSE text END"


@query(
    rf"""WITH {BLOCKS_SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT * REPLACE ({_SHOUT} AS text), {_OCRD} AS ocrd FROM plain), {_TIER_SQL},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY seq) = 1 AS is_first, regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS capitals,
      len(regexp_extract_all(text, '[\x{{0590}}-\x{{05ff}}]')) >= 0.5 * len(regexp_extract_all(text, '\p{{L}}')) AND regexp_matches(text, '\p{{L}}') AS caseless FROM blocks),
    near AS (SELECT book, page, seq, text, y0, bold, is_first, capitals, caseless, ocrd, min(level) AS level FROM firsts JOIN tiers USING (book) WHERE abs(size - tier) <= 1.0 GROUP BY ALL)
    SELECT * FROM (SELECT book, page, seq, level, CAST(y0 <= {0.3 * PAGE_HEIGHT} AS INTEGER) + CAST(is_first AS INTEGER) + CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) <= 15 AS INTEGER)
      + CAST(bold OR capitals AS INTEGER) AS signs, text FROM near WHERE NOT ocrd OR capitals OR caseless) WHERE signs >= 2"""
)
def heading_confirm_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On recognised pages (here every second one) only capitals, or a script without case, make a heading."""
    rows = blocks(spark, sf_dir).withColumn("text", F.expr(_SHOUT)).withColumn("ocrd", F.expr(_OCRD))
    return layout.heading_candidates(rows, PAGE_HEIGHT)


_NUMBERED = "CASE WHEN (page + seq) % 11 < 6 THEN concat(repeat('3.', CAST((page + seq) % 11 AS INT)), '1 ', text) ELSE text END"


@query(
    rf"""WITH {BLOCKS_SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT * REPLACE ({_NUMBERED} AS text) FROM plain), {_TIER_SQL},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY seq) = 1 AS is_first, len(string_split(regexp_extract(ltrim(text), '^([0-9]+([.][0-9]+)*)[.]? +[^ ]', 1), '.')) AS depth,
      regexp_matches(ltrim(text), '^[0-9]+([.][0-9]+){{0,3}}[.]?\s+\S') AS numbered FROM blocks),
    near AS (SELECT f.*, min(level) FILTER (abs(size - tier) <= 1.0) AS level FROM firsts f LEFT JOIN tiers USING (book) GROUP BY ALL)
    SELECT book, page, seq, CASE WHEN numbered THEN least(CAST(depth AS INTEGER), 4) ELSE level END AS level, CASE WHEN NOT numbered THEN signs END AS signs, text
    FROM (SELECT *, CAST(y0 <= {0.3 * PAGE_HEIGHT} AS INTEGER) + CAST(is_first AS INTEGER) + CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) <= 15 AS INTEGER)
      + CAST(bold OR (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}')) AS INTEGER) AS signs FROM near) WHERE numbered OR (level IS NOT NULL AND signs >= 2)"""
)
def numbered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of technical books: a dotted number of up to four parts comes before sizes and signs."""
    return layout.heading_candidates(blocks(spark, sf_dir).withColumn("text", F.expr(_NUMBERED)), PAGE_HEIGHT, technical=True)


_CHAPTER_SQL = f"""{_HEADING_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY length(text) DESC, seq) AS n FROM headings WHERE level = 1) WHERE n = 1),
  chapters AS (SELECT book, CAST(row_number() OVER w AS INTEGER) AS number, text AS title, page AS start_page, coalesce(lead(page) OVER w - 1, max_page) AS end_page
    FROM best JOIN (SELECT book, max(page) AS max_page FROM blocks GROUP BY book) USING (book) WINDOW w AS (PARTITION BY book ORDER BY page, seq))"""


@query(f"WITH {BLOCKS_SQL}, {_CHAPTER_SQL} SELECT * FROM chapters")
def chapter_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters from the headings of the first tier, one a page, each up to the next."""
    rows = blocks(spark, sf_dir)
    heads = layout.best_on_page(layout.heading_candidates(rows, PAGE_HEIGHT).filter("level = 1"))
    return layout.chapters(heads, rows.select("book", "page"))


@query(
    f"""WITH {BLOCKS_SQL}, {_HEADING_SQL}, counts AS (SELECT book, level, count(*) AS n, avg(CASE WHEN regexp_matches(lower(text), '^(part|book|volume)') THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_part FROM headings GROUP BY ALL)
    SELECT book, CAST(coalesce(min(CASE WHEN n >= 2 AND NOT is_part THEN level END), 1) AS INTEGER) AS chapter_level FROM counts GROUP BY book"""
)
def chapter_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of a book's chapters: the first with two headings that aren't parts."""
    return layout.chapter_and_part_levels(layout.heading_candidates(blocks(spark, sf_dir), PAGE_HEIGHT)).select("book", "chapter_level")


_PARTS = "CASE WHEN level = 1 AND seq % 3 <> 0 THEN concat('Part ', text) ELSE text END"


@query(
    f"""WITH {BLOCKS_SQL}, {_HEADING_SQL}, named AS (SELECT * REPLACE ({_PARTS} AS text) FROM headings),
    counts AS (SELECT book, level, count(*) AS n, avg(CASE WHEN regexp_matches(lower(text), '^(part|book|volume)') THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_part FROM named GROUP BY ALL),
    chapter AS (SELECT book, coalesce(min(level) FILTER (n >= 2 AND NOT is_part), 1) AS chapter_level FROM counts GROUP BY book)
    SELECT book, CAST(chapter_level AS INTEGER) AS chapter_level, CAST(min(level) FILTER (level < chapter_level AND n >= 2 AND is_part) AS INTEGER) AS part_level FROM counts JOIN chapter USING (book) GROUP BY book, chapter_level"""
)
def part_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a book's chapters and of the parts above them."""
    heads = layout.heading_candidates(blocks(spark, sf_dir), PAGE_HEIGHT).withColumn("text", F.expr(_PARTS))
    return layout.chapter_and_part_levels(heads)


@query(
    """WITH marks AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS part FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
    SELECT o.o_orderkey, m.part FROM orders o ASOF LEFT JOIN marks m ON o.o_custkey = m.o_custkey AND o.o_orderdate >= m.o_orderdate"""
)
def part_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the customer's last marked order at or before it, as chapters take the last part's title."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    marks = orders.filter("o_orderkey % 3 = 0").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("part"))
    return layout.as_of(orders, marks, "o_custkey", "o_orderdate", "part").select("o_orderkey", "part")


_STRIPPED = r"regexp_replace({0}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
_MARKED = "CASE WHEN (page + seq) % 23 = 5 THEN 'footnote' WHEN (page + seq) % 29 = 7 THEN 'endnote' END"
_MARK_TEXT = f"CASE WHEN {_MARKED} IS NOT NULL THEN concat(' ', seq % 9 + 1, ' ') ELSE text END"
_RS, _LS = r"regexp_replace({0}, '[ \t\n\x0b\f\r]+$', '')", r"regexp_replace({0}, '^[ \t\n\x0b\f\r]+', '')"


def _para_sql(mark: str, text: str) -> str:
    return rf"""noted AS (SELECT * REPLACE ({text} AS text), {mark} AS mark, min(page * 100000 + seq) OVER (PARTITION BY book) AS origin FROM blocks),
  marks AS (SELECT * REPLACE (CASE WHEN page * 100000 + seq > origin THEN mark END AS mark) FROM noted),
  compared AS (SELECT *, lag(page) OVER w AS p, lag(font) OVER w AS f, lag(size) OVER w AS z, lag(bold) OVER w AS b, lag(italic) OVER w AS i, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(text) OVER w AS said
    FROM marks WHERE mark IS NULL WINDOW w AS (PARTITION BY book ORDER BY page, seq)),
  fresh AS (SELECT book, page, seq, text, mark, x0, CASE WHEN f IS NULL OR f <> font OR abs(z - size) >= 0.5 OR b <> bold OR i <> italic THEN 1 WHEN p <> page THEN CAST(regexp_matches(said, '[.!?:][ \t\n\x0b\f\r]*$') AS INTEGER)
    ELSE CAST(y0 - py1 > z * 1.3 * 1.5 OR (y0 > py0 AND x0 - px0 > 0.8 * z) AS INTEGER) END AS new FROM compared UNION ALL SELECT book, page, seq, text, mark, x0, 0 FROM marks WHERE mark IS NOT NULL),
  numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY book ORDER BY page, seq) AS BIGINT) AS paragraph,
    CASE mark WHEN 'footnote' THEN concat(chr(57344), trim(text), chr(57344)) WHEN 'endnote' THEN concat(chr(57345), trim(text), chr(57345)) ELSE text END AS shown FROM fresh),
  paragraphs AS (SELECT book, paragraph, min(page) AS page, {_STRIPPED.format(rf"list_reduce(list(shown ORDER BY page, seq), lambda a, x: CASE WHEN starts_with(x, chr(57344)) OR starts_with(x, chr(57345)) THEN concat({_RS.format('a')}, x) WHEN ends_with({_RS.format('a')}, '-') AND regexp_matches({_LS.format('x')}, '^\p{{Ll}}') THEN concat(substr({_RS.format('a')}, 1, length({_RS.format('a')}) - 1), {_LS.format('x')}) ELSE concat({_RS.format('a')}, ' ', {_LS.format('x')}) END)")} AS text,
    count(*) FILTER (mark IS NULL) AS n_lines, arg_min(x0, page * 100000 + seq) AS x0 FROM numbered GROUP BY book, paragraph)"""


@query(f"WITH {BLOCKS_SQL}, {_para_sql(_MARKED, _MARK_TEXT)} SELECT * FROM paragraphs")
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs over page breaks, with markers (here some of the lines) spliced in."""
    rows = blocks(spark, sf_dir).withColumn("mark", F.expr(_MARKED)).withColumn("text", F.expr(_MARK_TEXT))
    return layout.paragraphs(rows)


@query(
    rf"""WITH {BLOCKS_SQL}, {_para_sql("CAST(NULL AS VARCHAR)", "text")}, {_SIZE_SQL}, {_MARGIN_SQL} SELECT p.* FROM paragraphs p JOIN body USING (book) JOIN margins USING (book)
    WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) >= 4 AND x0 - left_margin > 1.5 * body_size AND x0 - left_margin <= 6.0 * body_size"""
)
def block_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    return layout.block_quotes(layout.paragraphs(rows), layout.body_margins(rows), layout.body_size(rows))


@query(
    f"""WITH {BLOCKS_SQL}, k AS (SELECT *, font = 'Courier New' AS code FROM blocks), f AS (SELECT *, CASE WHEN lag(code) OVER w IS DISTINCT FROM code THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY book, page ORDER BY seq)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY book, page ORDER BY seq) AS run FROM f) SELECT book, page, CAST(run AS BIGINT) AS run, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY seq) AS code FROM r WHERE code GROUP BY book, page, run"""
)
def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a font of one width, in runs."""
    rows = blocks(spark, sf_dir).withColumn("code", T.is_monospace(F.col("font")))
    runs = layout.islands(rows, F.col("code"), layout.page_order()).filter("code")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return runs.groupBy("book", "page", "run").agg(F.count("*").alias("n_lines"), F.array_join(lines, "\n").alias("code"))


#: Verse is set in short lines; where documents have none, some of their lines are broken into halves by their words.
_VERSED = "CASE WHEN length(text) > 60 AND seq % 2 = 0 THEN concat(upper(substring_index(text, ' ', 1)), ' ', substring_index(text, ' ', -3)) ELSE text END"
_VERSED_SQL = "CASE WHEN length(text) > 60 AND seq % 2 = 0 THEN concat(upper(string_split(text, ' ')[1]), ' ', array_to_string(string_split(text, ' ')[-3:], ' ')) ELSE text END"
_LAID = {"y0": "CAST(40 + 14 * seq + 12 * (seq // 4) AS DOUBLE)", "y1": "CAST(50 + 14 * seq + 12 * (seq // 4) AS DOUBLE)", "size": "CAST(10 AS DOUBLE)", "font": "'Times-Roman'", "bold": "false", "italic": "false"}
_VERSE_BLOCKS = f"""{BLOCKS_SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT * REPLACE ({_VERSED_SQL} AS text, {", ".join(f"{v} AS {k}" for k, v in _LAID.items())}) FROM plain)"""


def verse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("text", F.expr(_VERSED))
    return rows.withColumns({k: F.expr(v.replace("seq // 4", "seq div 4")) for k, v in _LAID.items()})


_VERSE_SQL = rf"""{_VERSE_BLOCKS}, {_SIZE_SQL}, {_MARGIN_SQL}, f AS (SELECT *, CASE WHEN lag(font) OVER w IS NULL OR lag(font) OVER w <> font OR abs(lag(size) OVER w - size) >= 0.5 OR lag(bold) OVER w <> bold OR lag(italic) OVER w <> italic OR y0 - lag(y1) OVER w > 1.4 * 1.3 * lag(size) OVER w THEN 1 ELSE 0 END AS fresh
      FROM blocks WINDOW w AS (PARTITION BY book, page ORDER BY seq)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY book, page ORDER BY seq) AS stanza, regexp_replace(text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS t FROM f),
    a AS (SELECT book, page, CAST(stanza AS BIGINT) AS stanza, count(*) AS lines, count(*) FILTER (t <> '') AS n, max(length(t)) AS longest, avg(length(t)) FILTER (t <> '') AS mean,
      bool_or(regexp_matches(t, '^["''“”‘’«»]|["''“”‘’«»]$') AND regexp_matches(t, '(?i)\b({T.SPEECH})\b')) AS dialogue, count(*) FILTER (regexp_matches(t, '^[^:]{{1,30}}:\s+\S')) AS defined,
      avg(CAST(regexp_matches(t, '^\p{{Lu}}') AS DOUBLE)) FILTER (t <> '') AS capital, count(*) FILTER (regexp_matches(t, '[.?!]$')) AS ended, max(x0) - min(x0) AS spread, avg(x0) AS lefts,
      count(*) FILTER (x1 >= right_margin - 20.0) AS reaching, any_value(left_margin) AS left_margin, any_value(body_size) AS body_size FROM g JOIN margins USING (book) JOIN body USING (book) GROUP BY book, page, stanza),
    i AS (SELECT *, lefts > left_margin + 1.2 * body_size AS indented FROM a),
    found AS (SELECT book, page, stanza, lines AS n_lines, coalesce(n >= 2 AND NOT dialogue AND defined < 2 AND longest <= 65 AND mean <= 52 AND CASE WHEN n >= 3 THEN ended / n <= 0.5 ELSE indented OR ended < 2 END
      AND CASE WHEN n >= 3 THEN capital >= CASE WHEN indented THEN 0.45 ELSE 0.6 END ELSE (indented OR capital >= 1.0) AND longest <= 55 END
      AND reaching <= 1 AND (lines < 3 OR reaching / lines <= 0.3) AND spread <= 60, false) AS is_verse FROM i)"""


@query(f"WITH {_VERSE_SQL} SELECT * FROM found")
def verse_stanza(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stanzas of a page and whether they are verse."""
    rows = verse_blocks(spark, sf_dir)
    return layout.stanzas(rows, layout.body_size(rows), layout.body_margins(rows))


@query(
    rf"""WITH {BLOCKS_SQL}, w AS (SELECT book, page, seq, text, italic, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) AS n FROM blocks),
    r AS (SELECT *, sum(n) OVER p AS total, bool_and(italic) OVER p AS lead_in FROM w WINDOW p AS (PARTITION BY book, page ORDER BY seq))
    SELECT book, page, count(*) AS n_lines, string_agg(text, ' ' ORDER BY seq) AS text FROM r WHERE lead_in AND total <= 40 GROUP BY book, page"""
)
def epigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Italic lines at the head of a page, of 40 words in all at most."""
    upto = layout.page_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks(spark, sf_dir).withColumn("total", F.sum(T.n_words(F.col("text"))).over(upto)).withColumn("lead_in", F.min("italic").over(upto)).filter("lead_in AND total <= 40")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return rows.groupBy("book", "page").agg(F.count("*").alias("n_lines"), F.array_join(lines, " ").alias("text"))


_NOTED = "CASE WHEN size = 8 THEN concat(page % 4 + 1, '. ', text) ELSE text END"
_NOTE_SQL = rf"""noted AS (SELECT * REPLACE ({_NOTED} AS text, y0 + 300 AS y0) FROM blocks), sized AS (SELECT book, round(size, 1) AS body_size FROM (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY sum(greatest(length(text), 1)) DESC, min(page * 100000 + seq)) AS n FROM noted GROUP BY book, size) WHERE n = 1),
  notes AS (SELECT book, page, seq, regexp_extract(text, '^\s*([0-9]{{1,3}}|[*†‡§¶])[.):]?\s+', 1) AS marker, regexp_replace(regexp_replace(text, '^\s*([0-9]{{1,3}}|[*†‡§¶])[.):]?\s+', ''), '[ \t\n\x0b\f\r]+$', '') AS text FROM noted JOIN sized USING (book)
    WHERE y0 >= {0.75 * PAGE_HEIGHT} AND size < body_size - 0.5 AND regexp_matches(text, '^\s*([0-9]{{1,3}}|[*†‡§¶])[.):]?\s+'))"""


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("text", F.expr(_NOTED)).withColumn("y0", F.col("y0") + 300)


@query(f"WITH {BLOCKS_SQL}, {_NOTE_SQL} SELECT * FROM notes")
def footnote_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.notes_by_page(_noted(spark, sf_dir), PAGE_HEIGHT)


@query(
    f"""WITH {BLOCKS_SQL}, {_NOTE_SQL}, markers AS (SELECT book, page, seq, CAST(1 + (page + seq) % 5 AS VARCHAR) AS marker FROM blocks WHERE seq % 2 = 0)
    SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM notes n WHERE n.book = m.book AND n.page = m.page AND n.marker = m.marker) THEN 'footnote' WHEN EXISTS (SELECT 1 FROM notes n WHERE n.book = m.book AND n.marker = m.marker AND n.page % 2 = 0) THEN 'endnote' ELSE 'none' END AS kind FROM markers m"""
)
def footnote_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in the text with the note of their page, or else an endnote of the book."""
    notes = layout.notes_by_page(_noted(spark, sf_dir), PAGE_HEIGHT)
    markers = blocks(spark, sf_dir).filter("seq % 2 = 0").select("book", "page", "seq", F.expr("CAST(1 + (page + seq) % 5 AS STRING)").alias("marker"))
    return layout.correlated(markers, notes, notes.filter("page % 2 = 0"))


_TIGHT = {"text": "CASE WHEN seq % 3 = 1 THEN CAST(1 + (page + seq) % 12 AS STRING) ELSE text END", "x0": "CASE WHEN seq % 3 = 1 THEN 100.0 + page % 5 ELSE 50.0 END", "x1": "CASE WHEN seq % 3 = 1 THEN 104.0 ELSE 100.0 END", "y0": "CAST(40 + 16 * (seq // 3) + 5 * (seq % 3) AS DOUBLE)", "y1": "CAST(48 + 16 * (seq // 3) + 5 * (seq % 3) AS DOUBLE)"}


@query(
    rf"""WITH {BLOCKS_SQL.replace("blocks AS", "plain AS")}, tight AS (SELECT * REPLACE ({", ".join(f"{v.replace('AS STRING', 'AS VARCHAR')} AS {k}" for k, v in _TIGHT.items())}), (page + seq) % 10 = 0 AS superscript FROM plain),
    p AS (SELECT *, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM tight WINDOW w AS (PARTITION BY book, page ORDER BY seq))
    SELECT book, page, seq, trim(text) AS marker FROM p WHERE regexp_matches(trim(text), '^[0-9*†‡§¶]{{1,3}}$') AND (superscript OR coalesce(y0 < py1 AND y1 > py0 AND x0 - px1 BETWEEN -2.0 AND 3.0, false))"""
)
def inline_marker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are markers of notes, by their text and by where they are."""
    rows = blocks(spark, sf_dir).withColumn("superscript", F.expr("(page + seq) % 10 = 0")).withColumns({k: F.expr(v.replace("seq // 3", "seq div 3")) for k, v in _TIGHT.items()})
    return layout.inline_markers(rows)


_WIDE = {"x0": "CAST(CASE WHEN seq % 7 = 6 THEN 30 WHEN (page + seq) % 2 = 0 THEN 40 ELSE 290 END AS DOUBLE)", "x1": "CAST(CASE WHEN seq % 7 = 6 THEN 470 WHEN (page + seq) % 2 = 0 THEN 200 + seq % 5 ELSE 450 + seq % 5 END AS DOUBLE)"}
_COLUMN_SQL = f"""two AS (SELECT * REPLACE ({_WIDE['x0']} AS x0, {_WIDE['x1']} AS x1) FROM blocks), c AS (SELECT *, max(x1) OVER (PARTITION BY book, page ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM two WHERE x1 - x0 < {0.8 * PAGE_WIDTH}),
  b AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR x0 - reach > {0.04 * PAGE_WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY x0, x1, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM c),
  g AS (SELECT book, page, band, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM b GROUP BY book, page, band),
  bands AS (SELECT book, page, band, x0, x1, n FROM (SELECT *, sum(n) OVER p AS total, count(*) OVER p AS k, min(n) OVER p AS least FROM g WINDOW p AS (PARTITION BY book, page)) WHERE total >= 6 AND k >= 2 AND least >= 2)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _WIDE.items()})


@query(f"WITH {BLOCKS_SQL}, {_COLUMN_SQL} SELECT * FROM bands")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_bands(_two(spark, sf_dir), PAGE_WIDTH)


@query(
    f"""WITH {BLOCKS_SQL}, {_COLUMN_SQL}, paged AS (SELECT book, page, list({{'x0': x0, 'x1': x1}} ORDER BY x0, x1) AS bs FROM bands GROUP BY ALL),
    s AS (SELECT t.*, bs, x1 - x0 >= {0.8 * PAGE_WIDTH} AS spans FROM two t LEFT JOIN paged USING (book, page)),
    o AS (SELECT *, sum(CAST(spans AS INTEGER)) OVER (PARTITION BY book, page ORDER BY y0 RANGE UNBOUNDED PRECEDING) AS segment,
      CASE WHEN spans THEN -1 ELSE list_position(bs, list_sort(list_transform(bs, lambda b, i: {{'d': abs((b.x0 + b.x1) / 2 - (x0 + x1) / 2), 'i': i, 'b': b}}))[1].b) END AS col FROM s)
    SELECT book, page, seq, CAST(CASE WHEN bs IS NULL THEN row_number() OVER (PARTITION BY book, page ORDER BY seq) ELSE row_number() OVER (PARTITION BY book, page ORDER BY segment, col, y0, seq) END AS INTEGER) AS new_seq FROM o"""
)
def column_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_order(_two(spark, sf_dir), PAGE_WIDTH)


_RIGHT = "CASE WHEN page % 2 = 1 THEN concat('אבגדהוזחטיכלמנסעפצקרשתאבגדהוזחטיכלמנסעפצקרשת', seq) ELSE text END"
_KINDS = "CASE WHEN seq % 11 = 10 THEN 'image' ELSE 'text' END"


@query(
    rf"""WITH {BLOCKS_SQL}, {_COLUMN_SQL.replace("FROM blocks)", "FROM (SELECT *, " + _KINDS + " AS kind, page % 7 = 3 AS vertical FROM blocks))", 1).replace("FROM two WHERE", "FROM two WHERE kind = 'text' AND NOT vertical AND")},
    paged AS (SELECT book, page, list({{'x0': x0, 'x1': x1}} ORDER BY x0, x1) AS bs FROM bands WHERE book IN (SELECT b.book FROM (SELECT book, count(DISTINCT page) AS k FROM bands GROUP BY book) b JOIN (SELECT book, count(DISTINCT page) AS n FROM blocks GROUP BY book) p USING (book) WHERE k / n > 0.1) GROUP BY ALL),
    letters AS (SELECT book, page, sum(len(regexp_extract_all(t, '[\x{{0590}}-\x{{05ff}}]'))) / sum(len(regexp_extract_all(t, '\p{{L}}'))) >= 0.5 AS rtl FROM (SELECT book, page, {_RIGHT} AS t FROM two WHERE kind = 'text') GROUP BY book, page),
    s AS (SELECT t.*, bs, kind <> 'text' OR x1 - x0 >= {0.8 * PAGE_WIDTH} AS spans, coalesce(rtl, false) AS rtl FROM two t LEFT JOIN paged USING (book, page) LEFT JOIN letters USING (book, page)),
    n AS (SELECT *, sum(CAST(spans AS INTEGER)) OVER (PARTITION BY book, page ORDER BY y0 RANGE UNBOUNDED PRECEDING) AS segment,
      list_position(bs, list_sort(list_transform(bs, lambda b, i: {{'d': abs((b.x0 + b.x1) / 2 - (x0 + x1) / 2), 'i': i, 'b': b}}))[1].b) AS near FROM s),
    o AS (SELECT *, CASE WHEN spans THEN -1 WHEN rtl THEN len(bs) - near ELSE near END AS col FROM n)
    SELECT book, page, seq, CAST(CASE WHEN bs IS NULL THEN row_number() OVER (PARTITION BY book, page ORDER BY seq) ELSE row_number() OVER (PARTITION BY book, page ORDER BY segment, col, y0, seq) END AS INTEGER) AS new_seq FROM o"""
)
def column_reorder_rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of literature: pages from right to left, vertical pages, and images that span all columns."""
    rows = _two(spark, sf_dir).withColumn("text", F.expr(_RIGHT)).withColumn("kind", F.expr(_KINDS)).withColumn("vertical", F.expr("page % 7 = 3"))
    return layout.column_order(rows, PAGE_WIDTH, literature=True)


def _capital(c: Column) -> Column:
    """The one capital of a letter, as in the SQL: upper makes two letters of ß, and more of others."""
    return F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)


def _small(c: Column) -> Column:
    """Letter by letter, as in the SQL: lower makes two of İ, and looks at what is around Σ."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


@query(
    f"""WITH {BLOCKS_SQL}, {_SIZE_SQL}, capped AS (SELECT * REPLACE (CASE WHEN size = 18 THEN upper(substr(text, 1, 1)) WHEN size = 10 THEN lower(text) ELSE text END AS text, CASE WHEN size = 18 THEN 30.0 ELSE size END AS size) FROM blocks),
    bs AS (SELECT book, round(size, 1) AS body_size FROM (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY sum(greatest(length(text), 1)) DESC, min(page * 100000 + seq)) AS n FROM capped GROUP BY book, size) WHERE n = 1),
    c AS (SELECT *, coalesce(length(text) = 1 AND size >= 2 * body_size AND regexp_matches(lead(text) OVER w, '^\\p{{Ll}}'), false) AS cap, lead(text) OVER w AS nxt FROM capped JOIN bs USING (book) WINDOW w AS (PARTITION BY book, page ORDER BY seq)),
    d AS (SELECT *, coalesce(lag(cap) OVER (PARTITION BY book, page ORDER BY seq), false) AS eaten FROM c)
    SELECT book, page, seq, CASE WHEN cap THEN concat(text, nxt) ELSE text END AS text, cap AS fused FROM d WHERE NOT eaten"""
)
def drop_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large initials, here the first letters of the lines of the largest size, fused with the lines after them."""
    rows = blocks(spark, sf_dir)
    text = F.when(F.col("size") == 18, _capital(F.substring("text", 1, 1))).when(F.col("size") == 10, _small(F.col("text"))).otherwise(F.col("text"))
    return layout.drop_caps(rows.withColumn("text", text).withColumn("size", F.when(F.col("size") == 18, 30.0).otherwise(F.col("size")))).select("book", "page", "seq", "text", "fused")


_BOX = {"x0": "CAST(l_quantity % 40 * 10 AS DOUBLE)", "x1": "CAST(l_quantity % 40 * 10 + 15 + l_suppkey % 30 AS DOUBLE)", "y0": "CAST(l_partkey % 50 * 4 AS DOUBLE)", "y1": "CAST(l_partkey % 50 * 4 + 10 + l_suppkey % 20 AS DOUBLE)"}
_BOX_SQL = f"boxes AS (SELECT CAST(l_orderkey % 3 AS VARCHAR) AS book, l_orderkey // 3 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, {', '.join(f'{v} AS {k}' for k, v in _BOX.items())} FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item, on the page of its order; every third order is of one book."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(F.expr("CAST(l_orderkey % 3 AS STRING)").alias("book"), F.expr("l_orderkey div 3").alias("page"), F.row_number().over(order).alias("seq"), *(F.expr(v).alias(k) for k, v in _BOX.items()))
    return rows


@query(
    f"""WITH {_BOX_SQL}, p AS (SELECT a.book, a.page, a.seq AS a_seq, b.seq AS b_seq, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS shared,
      least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM boxes a JOIN boxes b ON a.book = b.book AND a.page = b.page AND a.seq < b.seq AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
    SELECT book, page, CAST(a_seq AS INTEGER) AS a_seq, CAST(b_seq AS INTEGER) AS b_seq, round(shared / small, 6) AS share, shared / small >= 0.7 AS duplicate FROM p"""
)
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that overlap, and by how much of the smaller one."""
    rows = boxes(spark, sf_dir)
    on = "a.book = b.book AND a.page = b.page AND a.seq < b.seq AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
    share = layout.overlap_share("a", "b")
    pairs = rows.alias("a").join(rows.alias("b"), F.expr(on))
    return pairs.select("a.book", "a.page", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), F.round(share, 6).alias("share"), (share >= 0.7).alias("duplicate"))


@query(
    f"""WITH {_BOX_SQL}, near AS (SELECT a.book, a.page, a.seq AS image, b.seq AS caption, CASE WHEN b.y0 >= a.y1 THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END AS gap FROM boxes a JOIN boxes b ON a.book = b.book AND a.page = b.page AND a.seq % 2 = 1 AND b.seq % 2 = 0
      AND ((b.y0 >= a.y1 AND b.y0 - a.y1 <= 30) OR (a.y0 >= b.y1 AND a.y0 - b.y1 <= 30)))
    SELECT book, page, CAST(image AS INTEGER) AS image, CAST(caption AS INTEGER) AS caption, gap FROM (SELECT *, row_number() OVER (PARTITION BY book, page, image ORDER BY gap, caption) AS n FROM near) WHERE n = 1"""
)
def caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image (a box with an odd number) the nearest caption above or below within 30 points."""
    rows = boxes(spark, sf_dir)
    near = rows.filter("seq % 2 = 1").alias("a").join(rows.filter("seq % 2 = 0").alias("b"), F.expr("a.book = b.book AND a.page = b.page AND ((b.y0 >= a.y1 AND b.y0 - a.y1 <= 30) OR (a.y0 >= b.y1 AND a.y0 - b.y1 <= 30))"))
    gap = F.expr("CASE WHEN b.y0 >= a.y1 THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END")
    found = near.select("a.book", "a.page", F.col("a.seq").alias("image"), F.col("b.seq").alias("caption"), gap.alias("gap"))
    order = Window.partitionBy("book", "page", "image").orderBy("gap", "caption")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
