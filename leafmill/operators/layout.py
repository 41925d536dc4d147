"""Rules over positioned blocks: DataFrame in, DataFrame out.

blocks: book, page, seq (order within the page), text, font, size, bold, italic, x0, y0, x1, y1. Rules that look at one
page partition by (book, page), so that one very large book is dealt to many tasks; rules over a whole book aggregate
first and join the few values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import text as T


def page_order() -> WindowSpec:
    """Blocks of a page in order; a window needs a session, so it is made where it is used."""
    return Window.partitionBy("book", "page").orderBy("seq")


def weighted_mode(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """book, name: the value that most characters have; the one seen first wins ties."""
    weight = F.greatest(F.length("text"), F.lit(1))
    sums = blocks.groupBy("book", value.alias(name)).agg(F.sum(weight).alias("w"), F.min(F.struct("page", "seq")).alias("at"))
    order = Window.partitionBy("book").orderBy(F.desc("w"), "at")
    return sums.withColumn("n", F.row_number().over(order)).filter("n = 1").select("book", name)


def body_size(blocks: DataFrame) -> DataFrame:
    return weighted_mode(blocks, F.round("size", 1), "body_size")


def body_margins(blocks: DataFrame) -> DataFrame:
    left = weighted_mode(blocks, F.bround("x0", 0), "left_margin")
    return left.join(weighted_mode(blocks, F.bround("x1", 0), "right_margin"), "book")


def heading_tiers(blocks: DataFrame, most: int = 3, gap: float = 1.5) -> DataFrame:
    """book, level, tier: sizes above the body's, largest first, each at least `gap` below the one before."""
    sizes = blocks.join(body_size(blocks), "book").filter(F.round("size", 1) > F.col("body_size") + 0.5)
    sizes = sizes.groupBy("book").agg(F.reverse(F.array_sort(F.collect_set(F.round("size", 1)))).alias("sizes"))  # a font has few sizes
    keep = F.aggregate("sizes", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1)) - x >= gap), F.array_append(a, x)).otherwise(a))
    return sizes.select("book", F.posexplode(F.slice(keep, 1, most)).alias("level", "tier")).withColumn("level", F.col("level") + 1)


def heading_candidates(blocks: DataFrame, page_height: float, tolerance: float = 1.0, technical: bool = False) -> DataFrame:
    """book, page, seq, level, signs, text: blocks of a tier's size that two signs of four confirm.

    Signs: high on the page, first on it, short, bold or capitals. On recognised pages (a true `ocrd`, where blocks have
    it) sizes jitter, so only capitals, or a script without case, are believed. In technical books a dotted number makes
    a heading of any block, whatever its size; signs are null then.
    """
    t = F.col("text")
    capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    signs = [F.col("y0") <= 0.3 * page_height, F.col("first"), T.n_words(t) <= 15, F.col("bold") | capitals]
    score = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    believed = ~F.coalesce(F.col("ocrd"), F.lit(False)) | capitals | T.is_caseless(t) if "ocrd" in blocks.columns else F.lit(True)
    numbered = numbered_level(T.stripped(t)) if technical else F.lit(None).cast("int")
    tiers = heading_tiers(blocks).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("level", "tier"))).alias("tiers"))
    of_tier = F.try_element_at(F.filter("tiers", lambda x: F.abs(F.col("size") - x["tier"]) <= tolerance), F.lit(1))["level"]
    rows = blocks.withColumn("first", F.row_number().over(page_order()) == 1).join(tiers, "book", "left").withColumn("_numbered", numbered)
    rows = rows.withColumn("level", F.coalesce("_numbered", of_tier)).withColumn("signs", F.when(F.col("_numbered").isNull(), score))
    return rows.filter(F.col("_numbered").isNotNull() | (F.col("level").isNotNull() & (F.col("signs") >= 2) & believed)).select("book", "page", "seq", "level", "signs", "text")


def headings_of(bookmarks: DataFrame, matched: DataFrame, candidates: DataFrame, least: int = 3) -> DataFrame:
    """book, page, seq, level, text: of books with `least` bookmarks or more their bookmarks, of others the candidates.

    bookmarks: book, mark, level, title, page; matched: book, mark, seq of the block that each has (see bookmark_blocks).
    Bookmarks go three levels deep at most.
    """
    trusted = bookmarks.groupBy("book").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("book")
    marks = bookmarks.join(trusted, "book", "left_semi").join(matched.select("book", "mark", "seq"), ["book", "mark"], "left")
    from_marks = marks.select("book", "page", "seq", F.least("level", F.lit(3)).alias("level"), F.col("title").alias("text"))
    return from_marks.unionByName(candidates.join(trusted, "book", "left_anti").select("book", "page", "seq", "level", "text"))


def numbered_level(t: Column) -> Column:
    """Level of a heading that begins with a dotted number, as its depth; null without one."""
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+){0,3})\.?\s+\S", 1)  # fixed value
    return F.when(number != "", F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(4)))


def chapter_and_part_levels(headings: DataFrame) -> DataFrame:
    """book, chapter_level, part_level: the first level with two headings that aren't parts (1 without one), and the
    first above it with two headings of which half or more are called part, book or volume (null without one)."""
    part = F.avg(F.lower("text").rlike("^(part|book|volume)").cast("int")) >= 0.5
    counts = headings.groupBy("book", "level").agg(F.count("*").alias("n"), part.alias("is_part"))  # few levels a book
    chapter = counts.groupBy("book").agg(F.coalesce(F.min(F.when((F.col("n") >= 2) & ~F.col("is_part"), F.col("level"))), F.lit(1)).alias("chapter_level"))
    above = (F.col("level") < F.col("chapter_level")) & (F.col("n") >= 2) & F.col("is_part")
    return counts.join(chapter, "book").groupBy("book", "chapter_level").agg(F.min(F.when(above, F.col("level"))).alias("part_level"))


def best_on_page(headings: DataFrame) -> DataFrame:
    """The longest title of each page, the first on ties."""
    order = Window.partitionBy("book", "page").orderBy(F.desc(F.length("text")), "seq")
    return headings.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def chapters(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """book, number, title, start_page, end_page; pages: book, page. A chapter ends before the next, the last with the book."""
    order = Window.partitionBy("book").orderBy("page", "seq")
    last = pages.groupBy("book").agg(F.max("page").alias("last_page"))
    out = headings.withColumn("number", F.row_number().over(order)).withColumn("next", F.lead("page").over(order))
    return out.join(last, "book").select("book", "number", F.col("text").alias("title"), F.col("page").alias("start_page"), F.coalesce(F.col("next") - 1, "last_page").alias("end_page"))


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before theirs: one sort of both, no join of all pairs."""
    both = rows.select(key, at, F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_value")).unionByName(
        marks.select(key, at, F.lit(0).alias("_kind"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_value"))
    )
    order = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_value", F.last("_value", True).over(order)).filter("_kind = 1").select("_row.*", F.col("_value").alias(value))


def islands(rows: DataFrame, kind: Column, by: WindowSpec, name: str = "run") -> DataFrame:
    """rows with the number of the run of equal kinds that each is in."""
    before = F.lag(kind).over(by)
    new = (before.isNull() | (before != kind)).cast("int")
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: What stands around a marker of a footnote and of an endnote until it is rendered.
FOOTNOTE_MARK, ENDNOTE_MARK, CITATION_MARK = "\ue000", "\ue001", "\ue002"


def paragraphs(blocks: DataFrame) -> DataFrame:
    """book, paragraph, page, text, n_lines, x0: blocks of one style merged until a gap or an indent, over page breaks too.

    Over a break they merge unless the text before ends a sentence. Where blocks have a column `mark` (footnote or
    endnote, else null), such blocks are markers: they go into the text before them between two marks, and don't count
    for what comes after; a marker that is a book's first block is text. Blocks are compared within their page; of the
    rest of the book only a row a page is looked at, so a very large book is no task's alone. Where blocks have a column
    `run`, whose values are in a row, paragraphs stay within one, and run and the first block's seq are returned too.
    """
    runs = "run" in blocks.columns
    run = F.col("run") if runs else F.lit(0)
    first = blocks.groupBy("book").agg(F.min(F.struct("page", "seq")).alias("_first"))
    mark = F.when(F.struct("page", "seq") > F.col("_first"), F.col("mark")) if "mark" in blocks.columns else F.lit(None).cast("string")
    rows = blocks.join(first, "book").withColumn("_mark", mark)
    texts = rows.filter("_mark IS NULL")
    before = {c: F.lag(c).over(page_order()) for c in ("font", "size", "bold", "italic", "x0", "y0", "y1")}
    style = (before["font"] == F.col("font")) & (F.abs(before["size"] - F.col("size")) < 0.5) & (before["bold"] == F.col("bold")) & (before["italic"] == F.col("italic"))
    gap = F.col("y0") - before["y1"] > before["size"] * 1.3 * 1.5
    indent = (F.col("y0") > before["y0"]) & (F.col("x0") - before["x0"] > 0.8 * before["size"])
    other = F.lag(run).over(page_order()) != run
    new = (before["font"].isNull() | other | ~style | gap | indent).cast("int")
    marked = texts.withColumn("_new", new).unionByName(rows.filter("_mark IS NOT NULL").withColumn("_new", F.lit(0)))
    marked = marked.withColumn("_k", F.sum("_new").over(page_order().rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.struct("font", "size", "bold", "italic", T.ends_sentence(F.col("text")).alias("ends"), run.alias("run"))
    text_row = F.col("_mark").isNull()
    pages = marked.groupBy("book", "page").agg(
        F.max("_k").alias("_n"), F.min_by(edge, F.when(text_row, F.col("seq"))).alias("_head"), F.max_by(edge, F.when(text_row, F.col("seq"))).alias("_tail")
    )
    book = Window.partitionBy("book").orderBy("page")
    tail = F.last(F.when(F.col("_n") > 0, F.col("_tail")), True).over(book.rowsBetween(Window.unboundedPreceding, -1))
    h = F.col("_head")
    goes_on = (F.col("_n") > 0) & (tail["run"] == h["run"]) & (tail["font"] == h["font"]) & (F.abs(tail["size"] - h["size"]) < 0.5) & (tail["bold"] == h["bold"]) & (tail["italic"] == h["italic"]) & ~tail["ends"]
    pages = pages.withColumn("_on", F.coalesce(goes_on, F.lit(False)).cast("int"))
    pages = pages.withColumn("_before", F.coalesce(F.sum(F.col("_n") - F.col("_on")).over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = marked.join(pages.select("book", "page", "_on", "_before"), ["book", "page"]).withColumn("paragraph", F.col("_before") + F.when(F.col("_k") > 0, F.col("_k") - F.col("_on")).otherwise(0))
    lines = F.array_sort(F.collect_list(F.struct("page", "seq", "text", F.col("_mark").alias("mark"))))
    at = F.struct("page", "seq")
    grouped = numbered.groupBy("book", "paragraph").agg(F.min("page").alias("page"), lines.alias("_lines"), F.count_if(F.col("_mark").isNull()).alias("n_lines"), F.min_by("x0", at).alias("x0"), F.min_by(run, at).alias("run"), F.min_by("seq", at).alias("seq"))
    return grouped.select("book", "paragraph", "page", spliced(F.col("_lines")).alias("text"), "n_lines", "x0", *(["run", "seq"] if runs else []))


def spliced(lines: Column) -> Column:
    """The text of lines (text, mark) in a row: markers between marks after what is before them, other lines joined."""

    def step(text: Column, x: Column) -> Column:
        sign = F.when(x["mark"] == "footnote", F.lit(FOOTNOTE_MARK)).otherwise(F.lit(ENDNOTE_MARK))
        return F.when(x["mark"].isNotNull(), F.concat(F.regexp_replace(text, f"{T.SPACES}+$", ""), sign, T.stripped(x["text"]), sign)).otherwise(T.joined_pair(text, x["text"]))

    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return T.stripped(F.aggregate(rest, lines[0]["text"], step))


def theorems(paragraphs: DataFrame, order: WindowSpec, keys: list[str]) -> DataFrame:
    """The paragraphs of environments: env, label and body. Each that a theorem's label opens is one; a proof takes those
    after it in, up to one that says that it is done or to the next label."""
    t = T.stripped(F.col("text"))
    opens, word = t.rlike(T.THEOREM), F.regexp_extract(t, T.THEOREM, 1)
    number = F.nullif(F.regexp_extract(t, T.THEOREM, 2), F.lit(""))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = paragraphs.withColumn("_opens", opens).withColumn("env", F.sum(opens.cast("int")).over(running)).filter("env > 0")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    label = F.when(F.col("_opens"), F.concat_ws(" ", F.initcap(word), number))
    rows = rows.withColumn("label", F.last(label, True).over(running)).withColumn("_proof", F.last(F.when(F.col("_opens"), F.lower(word) == "proof"), True).over(running))
    closed = F.when(~F.col("_opens") & t.rlike(T.QED), F.col("env"))
    rows = rows.withColumn("_closed", F.last(closed, True).over(within))
    inside = F.col("_opens") | (F.col("_proof") & ~F.coalesce(F.col("_closed") == F.col("env"), F.lit(False)))
    body = F.when(F.col("_opens"), F.nullif(T.stripped(F.regexp_replace(t, T.THEOREM, "")), F.lit(""))).otherwise(F.col("text"))
    return rows.filter(inside).withColumn("body", body).drop("_opens", "_proof", "_closed")


def block_quotes(paragraphs: DataFrame, margins: DataFrame, sizes: DataFrame) -> DataFrame:
    """Paragraphs of four words or more set in by 1.5 to 6 times the body's size."""
    indent = F.col("x0") - F.col("left_margin")
    both = paragraphs.join(margins, "book").join(sizes, "book")
    return both.filter((T.n_words(F.col("text")) >= 4) & (indent > 1.5 * F.col("body_size")) & (indent <= 6.0 * F.col("body_size"))).select(*paragraphs.columns)


def column_bands(blocks: DataFrame, page_width: float) -> DataFrame:
    """book, page, band, x0, x1, n: columns of a page with six candidates in two bands of two blocks or more."""
    candidates = blocks.filter(F.col("x1") - F.col("x0") < 0.8 * page_width)
    order = Window.partitionBy("book", "page").orderBy("x0", "x1", "seq")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    banded = candidates.withColumn("_new", (reach.isNull() | (F.col("x0") - reach > 0.04 * page_width)).cast("int")).withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = banded.groupBy("book", "page", "band").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))
    page = Window.partitionBy("book", "page")
    good = (F.sum("n").over(page) >= 6) & (F.count("*").over(page) >= 2) & (F.min("n").over(page) >= 2)
    return bands.withColumn("_good", good).filter("_good").drop("_good")


def column_order(blocks: DataFrame, page_width: float, literature: bool = False, least_pages: float = 0.1) -> DataFrame:
    """book, page, seq, new_seq: on pages with columns, down one column after the other between spanning blocks.

    Blocks may have `kind` (text, or what spans all columns) and `vertical` (pages written from top to bottom, which stay
    as they are). Where most letters of a page are of a script from right to left, its last column comes first. In
    literature a book is left as it is unless more than least_pages of its pages have columns.
    """
    is_text = F.col("kind") == "text" if "kind" in blocks.columns else F.lit(True)
    upright = F.coalesce(F.col("vertical"), F.lit(False)) if "vertical" in blocks.columns else F.lit(False)
    bands = column_bands(blocks.filter(is_text & ~upright), page_width).groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("bands"))
    if literature:
        pages = blocks.groupBy("book").agg(F.count_distinct("page").alias("n"))
        with_columns = bands.groupBy("book").agg(F.count("*").alias("k"))
        bands = bands.join(pages.join(with_columns, "book").filter(F.col("k") / F.col("n") > least_pages).select("book"), "book", "left_semi")
    rows = blocks.withColumn("_text", is_text).join(bands, ["book", "page"], "left")
    spans = ~F.col("_text") | ((F.col("x1") - F.col("x0")) >= 0.8 * page_width)
    by_y = Window.partitionBy("book", "page").orderBy("y0")
    rows = rows.withColumn("spans", spans.cast("int")).withColumn("segment", F.sum("spans").over(by_y.rangeBetween(Window.unboundedPreceding, 0)))
    letters = [F.sum(F.when(F.col("_text"), T.count_of(F.col("text"), c)).otherwise(0)).over(Window.partitionBy("book", "page")) for c in (f"(?=\\p{{L}})[{T.RTL}]", r"\p{L}")]
    rows = rows.withColumn("_rtl", T.ratio(letters[0], letters[1]) >= 0.5)
    centre = (F.col("x0") + F.col("x1")) / 2
    away = F.transform("bands", lambda b, i: F.struct(F.abs((b["x0"] + b["x1"]) / 2 - centre).alias("d"), i.alias("i")))
    nearest = F.array_min(away)["i"]
    column = F.when(F.col("spans") == 1, -1).when(F.col("_rtl"), F.size("bands") - nearest).otherwise(nearest)
    order = Window.partitionBy("book", "page").orderBy("segment", "column", "y0", "seq")
    rows = rows.withColumn("column", F.when(F.col("bands").isNull(), F.lit(None)).otherwise(column))
    return rows.select("book", "page", "seq", F.when(F.col("bands").isNull(), F.row_number().over(page_order())).otherwise(F.row_number().over(order)).alias("new_seq"))


def overlap_share(a: str, b: str) -> Column:
    """Shared area of two boxes over the smaller one's area."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    small = F.least(area(a), area(b))
    return F.when((w <= 0) | (h <= 0) | (small <= 0), 0.0).otherwise(w * h / small)


def drop_caps(blocks: DataFrame) -> DataFrame:
    """blocks with `fused`: a large initial takes the text of the block after it, which begins in lower case, and keeps its own box."""
    sizes = body_size(blocks)
    rows = blocks.join(sizes, "book")
    is_cap = (F.length(T.stripped(F.col("text"))) == 1) & (F.col("size") >= 2 * F.col("body_size")) & F.lead("text").over(page_order()).rlike(r"^\p{Ll}")
    rows = rows.withColumn("cap", is_cap).withColumn("after", F.coalesce(F.lag("cap").over(page_order()), F.lit(False)))
    fused = rows.withColumn("text", F.when(F.col("cap"), F.concat(T.stripped(F.col("text")), F.lead("text").over(page_order()))).otherwise(F.col("text")))
    return fused.filter("NOT after").select(*blocks.columns, F.coalesce("cap", F.lit(False)).alias("fused"))


def stanza_lines(lines: DataFrame) -> DataFrame:
    """lines with the number of the stanza of their page: a new one begins at another style, a gap over 1.4 line heights, or another `run`, where lines have it."""
    before = {c: F.lag(c).over(page_order()) for c in ("font", "size", "bold", "italic", "y1")}
    style = (before["font"] == F.col("font")) & (F.abs(before["size"] - F.col("size")) < 0.5) & (before["bold"] == F.col("bold")) & (before["italic"] == F.col("italic"))
    gap = F.col("y0") - before["y1"] > 1.4 * 1.3 * before["size"]
    other = F.lag("run").over(page_order()) != F.col("run") if "run" in lines.columns else F.lit(False)
    new = (before["font"].isNull() | other | ~style | gap).cast("int")
    return lines.withColumn("_new", new).withColumn("stanza", F.sum("_new").over(page_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stanzas(lines: DataFrame, sizes: DataFrame, margins: DataFrame) -> DataFrame:
    """book, page, stanza, n_lines, is_verse: the tests of a stanza; sizes and margins are the books' (body_size, body_margins)."""
    t = T.stripped(F.col("text"))
    quoted, full = T.is_dialogue(t), t != ""
    share = lambda c: F.avg(F.when(full, c.cast("double")))
    near_right = (F.col("x1") >= F.col("right_margin") - 20.0).cast("int")
    grouped = stanza_lines(lines).join(margins, "book").groupBy("book", "page", "stanza").agg(
        F.count("*").alias("n_lines"), F.count_if(full).alias("n"), F.max(F.length(t)).alias("longest"), F.avg(F.when(full, F.length(t))).alias("mean"),
        F.max(quoted).alias("dialogue"), F.count_if(t.rlike(r"^[^:]{1,30}:\s+\S")).alias("defined"),
        share(t.rlike(r"^\p{Lu}")).alias("capital"), F.count_if(t.rlike("[.?!]$")).alias("ended"),
        (F.max("x0") - F.min("x0")).alias("spread"), F.avg("x0").alias("left"), F.sum(near_right).alias("reaching"), F.first("left_margin").alias("left_margin"),
        F.sum(T.count_of(t, f"(?=\\p{{L}})[{T.CASELESS}]")).alias("caseless"), F.sum(T.count_of(t, r"\p{L}")).alias("letters"),
    )
    rows = grouped.join(sizes, "book").withColumn("indented", F.col("left") > F.col("left_margin") + 1.2 * F.col("body_size"))
    n, indented = F.col("n"), F.col("indented")
    sentences = F.when(n >= 3, F.col("ended") / n <= 0.5).otherwise(indented | (F.col("ended") < 2))
    cased = F.when(n >= 3, F.col("capital") >= F.when(indented, 0.45).otherwise(0.6)).otherwise((indented | (F.col("capital") >= 1.0)) & (F.col("longest") <= 55))
    capitals = (T.ratio(F.col("caseless"), F.col("letters")) >= 0.5) | cased
    right = (F.col("reaching") <= 1) & ((F.col("n_lines") < 3) | (F.col("reaching") / F.col("n_lines") <= 0.3))
    verse = (n >= 2) & ~F.col("dialogue") & (F.col("defined") < 2) & (F.col("longest") <= 65) & (F.col("mean") <= 52) & sentences & capitals & right & (F.col("spread") <= 60)
    return rows.select("book", "page", "stanza", "n_lines", F.coalesce(verse, F.lit(False)).alias("is_verse"))


#: Fixed value: how a note begins.
NOTE_START = r"^\s*(\d{1,3}|[*†‡§¶])[.):]?\s+"


def notes_by_page(blocks: DataFrame, page_height: float) -> DataFrame:
    """book, page, seq, marker, text: footnotes at the foot of a page, smaller than the body, that begin with a marker."""
    t = F.col("text")
    marker = F.regexp_extract(t, NOTE_START, 1)
    rows = blocks.join(body_size(blocks), "book")
    low = (F.col("y0") >= 0.75 * page_height) & (F.col("size") < F.col("body_size") - 0.5)
    return rows.filter(low & (marker != "")).select("book", "page", "seq", marker.alias("marker"), T.stripped(F.regexp_replace(t, NOTE_START, "")).alias("text"))


def without_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """The blocks that aren't definitions of footnotes."""
    return blocks.join(notes.select("book", "page", "seq"), ["book", "page", "seq"], "left_anti")


def inline_markers(blocks: DataFrame) -> DataFrame:
    """book, page, seq, marker: blocks that are a note's marker, set high or right behind the block before them."""
    text = T.stripped(F.col("text"))
    before = {c: F.lag(c).over(page_order()) for c in ("x1", "y0", "y1")}
    behind = (F.col("y0") < before["y1"]) & (F.col("y1") > before["y0"]) & (F.col("x0") - before["x1"]).between(-2.0, 3.0)
    high = F.coalesce(F.col("superscript"), F.lit(False)) if "superscript" in blocks.columns else F.lit(False)
    rows = blocks.withColumn("_placed", high | F.coalesce(behind, F.lit(False)))
    return rows.filter(F.col("_placed") & text.rlike(r"^[0-9*†‡§¶]{1,3}$")).select("book", "page", "seq", text.alias("marker"))


def correlated(markers: DataFrame, notes: DataFrame, endnotes: DataFrame) -> DataFrame:
    """markers (book, page, seq, marker) with kind footnote, endnote or none; a note of the page comes first."""
    on_page = notes.select("book", "page", "marker").distinct().withColumn("_page", F.lit(True))
    in_book = endnotes.select("book", "marker").distinct().withColumn("_book", F.lit(True))
    both = markers.join(on_page, ["book", "page", "marker"], "left").join(in_book, ["book", "marker"], "left")
    return both.select("book", "page", "seq", "marker", F.when(F.col("_page"), "footnote").when(F.col("_book"), "endnote").otherwise("none").alias("kind"))
