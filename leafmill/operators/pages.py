"""Pages from what a decoder gives: spans, grids, images and recognised words, as blocks in reading order.

spans: book, page, line, seq, text, font, size, flags, box; lines: book, page, line, vertical; grids: book, page, cells and
box; images: book, page, image, box, w, h; words: see assembly.ocr_lines. A box is x0, y0, x1, y1 in points. What is
compared with each other is of one line or one page, so the arrays below are as short as those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import assembly, document

_BOX = ("x0", "y0", "x1", "y1")


def overlap(a: Column, b: Column) -> Column:
    """Shared area of two structs with boxes over the smaller one's area."""
    w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    small = F.least(area(a), area(b))
    return F.when((w <= 0) | (h <= 0) | (small <= 0), 0.0).otherwise(w * h / small)


def _kept(rows: Column, kind: str, repeats) -> Column:
    """Of an array of structs, in order, those for which repeats(earlier kept one, it) holds for none."""
    return F.aggregate(rows, F.array().cast(kind), lambda done, x: F.when(F.exists(done, lambda y: repeats(y, x)), done).otherwise(F.array_append(done, x)))


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Spans without those that repeat an earlier one of their line, as shadows do: one text, and boxes that overlap by
    seven tenths or are within two points on all sides. Blank spans stay."""
    own = F.struct("seq", F.trim("text").alias("t"), *_BOX)
    near = lambda a, b: (F.abs(a["x0"] - b["x0"]) <= 2) & (F.abs(a["y0"] - b["y0"]) <= 2) & (F.abs(a["x1"] - b["x1"]) <= 2) & (F.abs(a["y1"] - b["y1"]) <= 2)
    shape = "array<struct<seq: bigint, t: string, x0: double, y0: double, x1: double, y1: double>>"
    of_line = spans.withColumn("seq", F.col("seq").cast("long")).groupBy("book", "page", "line").agg(F.array_sort(F.collect_list(own)).alias("x"))
    kept = _kept(F.col("x").cast(shape), shape, lambda y, x: (x["t"] != "") & (y["t"] == x["t"]) & ((overlap(x, y) >= 0.7) | near(x, y)))
    return spans.join(of_line.select("book", "page", "line", F.explode(kept).alias("k")).select("book", "page", "line", F.col("k.seq").alias("seq")), ["book", "page", "line", "seq"], "left_semi")


def without_layers(blocks: DataFrame, least: float = 0.7) -> DataFrame:
    """book, page, seq of the blocks that stay: one goes if an earlier one that stays has its text and most of its box.

    Blocks of a page are compared if their texts are equal but for case and white space."""
    shape = "array<struct<seq: bigint, x0: double, y0: double, x1: double, y1: double>>"
    same = blocks.groupBy("book", "page", T.collapsed(F.coalesce("text", F.lit(""))).alias("said")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), *_BOX))).alias("x"))
    kept = _kept(F.col("x").cast(shape), shape, lambda y, x: overlap(x, y) >= least)
    return same.select("book", "page", F.explode(kept).alias("k")).select("book", "page", F.col("k.seq").cast("int").alias("seq"))


def outside_tables(blocks: DataFrame, grids: DataFrame) -> DataFrame:
    """Blocks whose centre is in no table of their page."""
    x, y = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    inside = (F.col("a.book") == F.col("b.book")) & (F.col("a.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    return blocks.alias("a").join(grids.select("book", "page", *_BOX).alias("b"), inside, "left_anti")


def native_blocks(spans: DataFrame, grids: DataFrame) -> DataFrame:
    """Blocks of the text layer: spans without shadows, grouped by style, none of a table's or of a second layer's."""
    groups = assembly.span_groups(distinct_spans(spans))
    order = Window.partitionBy("book", "page").orderBy("line", "run")
    rows = outside_tables(groups, grids).withColumn("seq", F.row_number().over(order) - 1)
    return rows.join(without_layers(rows), ["book", "page", "seq"], "left_semi").drop("line", "run")


def page_states(pages: DataFrame, blocks: DataFrame, lines: DataFrame, images: DataFrame, most_chars: int = 5) -> DataFrame:
    """book, page, score, is_blank, is_vertical, needs_ocr of pages (book, page).

    score: how far the page's text is usable. A page that isn't is blank if it has no more than most_chars characters and
    no image, and is to be recognised otherwise. More than half of the lines of a vertical page are.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    said = blocks.groupBy("book", "page").agg(F.array_join(parts, "").alias("said"))
    upright = lines.groupBy("book", "page").agg((F.avg(F.col("vertical").cast("double")) > 0.5).alias("is_vertical"))
    pictured = images.groupBy("book", "page").agg(F.count("*").alias("n_images"))
    rows = pages.join(said, ["book", "page"], "left").join(upright, ["book", "page"], "left").join(pictured, ["book", "page"], "left")
    rows = rows.withColumn("said", F.coalesce("said", F.lit("")))
    q = T.quality_parts(F.col("said"))
    rows = rows.withColumn("score", 0.4 * q["char_score"] + 0.3 * q["validity"] + 0.3 * q["word_likeness"])
    poor = F.col("score") < 0.5
    blank = poor & (F.length(T.stripped(F.col("said"))) <= most_chars) & F.col("n_images").isNull()
    return rows.select("book", "page", "score", blank.alias("is_blank"), F.coalesce("is_vertical", F.lit(False)).alias("is_vertical"), (poor & ~blank).alias("needs_ocr"))


def recognised_blocks(blocks: DataFrame, states: DataFrame, words: DataFrame, grids: DataFrame) -> DataFrame:
    """blocks with `ocrd`: on pages that are to be recognised, lines of words (see assembly.ocr_lines) outside of tables take
    their place; where recognition gave nothing the blocks stay."""
    wanted = states.filter("needs_ocr").select("book", "page")
    found = outside_tables(assembly.ocr_lines(words.join(wanted, ["book", "page"], "left_semi")), grids)
    pages = found.select("book", "page").distinct()
    order = Window.partitionBy("book", "page").orderBy("seq")
    new = found.select("book", "page", (F.row_number().over(order) - 1).alias("seq"), "text", F.lit("").alias("font"), "size", *(F.lit(False).alias(x) for x in ("superscript", "italic", "bold")), *_BOX, F.lit(True).alias("ocrd"))
    old = blocks.join(pages, ["book", "page"], "left_anti").withColumn("ocrd", F.lit(False))
    return old.select(*new.columns).unionByName(new)


def captioned(images: DataFrame, blocks: DataFrame, gap: float = 30.0, most_words: int = 40) -> DataFrame:
    """book, page, image, seq, caption: images (seq, box) in order take the nearest caption (a block) above or below, within
    `gap` points, that is still free; of equally near ones the first."""
    is_caption = T.stripped(F.col("text")).rlike(T.CAPTION) & (T.n_words(F.col("text")) <= most_words)
    shape = "array<struct<seq: bigint, x0: double, y0: double, x1: double, y1: double>>"
    of_page = lambda rows, name: rows.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), *_BOX))).cast(shape).alias(name))
    both = of_page(images, "pictures").join(of_page(blocks.filter(is_caption), "texts"), ["book", "page"])

    def take(state: Column, image: Column) -> Column:
        free = F.filter("texts", lambda t: ~F.exists(state, lambda s: s["caption"] == t["seq"]))
        away = F.transform(free, lambda t: F.struct(F.when(t["y0"] >= image["y1"], t["y0"] - image["y1"]).when(image["y0"] >= t["y1"], image["y0"] - t["y1"]).alias("d"), t["seq"].alias("seq")))
        best = F.array_min(F.filter(away, lambda a: a["d"] <= gap))
        return F.when(best.isNull(), state).otherwise(F.array_append(state, F.struct(image["seq"].alias("image"), best["seq"].alias("caption"))))

    pairs = F.aggregate("pictures", F.array().cast("array<struct<image: bigint, caption: bigint>>"), take)
    return both.select("book", "page", F.explode(pairs).alias("p")).select("book", "page", F.col("p.image").cast("int").alias("image"), F.col("p.caption").cast("int").alias("caption"))


def inserted(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """book, page, place, kind, seq: a page's blocks (seq, y0) in order, with figures (kind, seq, y0; images before tables)
    each before the first that begins lower on the page."""
    shape = "struct<kind: string, seq: bigint, y0: double>"
    one = lambda rows, kind: rows.select("book", "page", F.struct(kind.alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("y0").cast("double").alias("y0")).cast(shape).alias("r"))
    texts = one(blocks, F.lit("text")).groupBy("book", "page").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("texts"))
    more = one(figures, F.col("kind")).groupBy("book", "page").agg(F.array_sort(F.collect_list("r")).alias("figures"))  # by kind, then number
    both = texts.join(more, ["book", "page"], "full")

    def put(done: Column, x: Column) -> Column:
        at = F.array_position(F.transform(done, lambda y: y["y0"] > x["y0"]), True)
        return F.when(at > 0, F.concat(F.slice(done, F.lit(1), at.cast("int") - 1), F.array(x), F.slice(done, at.cast("int"), F.size(done)))).otherwise(F.array_append(done, x))

    none = F.array().cast(f"array<{shape}>")
    whole = F.aggregate(F.coalesce("figures", none), F.coalesce("texts", none), put)
    return both.select("book", "page", F.posexplode(whole).alias("place", "r")).select("book", "page", "place", "r.kind", "r.seq")


def extracted(pages: DataFrame, spans: DataFrame, lines: DataFrame, grids: DataFrame, images: DataFrame, words: DataFrame | Callable[[DataFrame], DataFrame], page_area: float, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """blocks (text, image and table, with their new seq) and the states of pages, from all that a decoder gives.

    Tables need two rows of two cells; images are neither the page nor specks; captions leave the text for their image.
    words: those recognised, or a function of the states that gives them. keep(df, name) saves a table and reads it again.
    """
    keep = keep or (lambda df, name: df)
    numbered = Window.partitionBy("book", "page").orderBy("y0", "x0")
    tables = document.tables_found(grids).withColumn("seq", F.row_number().over(numbered) - 1)
    pictures = assembly.placed_images(images, page_area).withColumn("seq", F.row_number().over(Window.partitionBy("book", "page").orderBy("image")) - 1)
    native = keep(native_blocks(spans, tables), "native")
    states = keep(page_states(pages, native, lines, images), "states")
    texts = keep(recognised_blocks(native, states, words(states) if callable(words) else words, tables), "texts")
    taken = captioned(pictures, texts)
    said = texts.join(taken.select("book", "page", F.col("caption").alias("seq")), ["book", "page", "seq"], "left_anti")
    captions = taken.join(texts.select("book", "page", F.col("seq").alias("caption"), F.col("text").alias("_caption")), ["book", "page", "caption"]).select("book", "page", F.col("image").alias("seq"), "_caption")
    figures = pictures.select("book", "page", "seq", "y0", F.lit("image").alias("kind")).unionByName(tables.select("book", "page", "seq", "y0", F.lit("table").alias("kind")))
    order = inserted(said, figures)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    text_rows = said.select("book", "page", "seq", F.lit("text").alias("kind"), "text", "font", "size", "bold", "italic", "superscript", "ocrd", *_BOX, none("array<array<string>>", "cells"), none("string", "image"), none("string", "caption"))
    image_rows = pictures.join(captions, ["book", "page", "seq"], "left").select("book", "page", "seq", F.lit("image").alias("kind"), *(none(t, n) for t, n in (("string", "text"), ("string", "font"), ("double", "size"), ("boolean", "bold"), ("boolean", "italic"), ("boolean", "superscript"), ("boolean", "ocrd"))), *_BOX, none("array<array<string>>", "cells"), "image", F.col("_caption").alias("caption"))
    table_rows = tables.select("book", "page", "seq", F.lit("table").alias("kind"), *(none(t, n) for t, n in (("string", "text"), ("string", "font"), ("double", "size"), ("boolean", "bold"), ("boolean", "italic"), ("boolean", "superscript"), ("boolean", "ocrd"))), *_BOX, "cells", none("string", "image"), none("string", "caption"))
    rows = text_rows.unionByName(image_rows).unionByName(table_rows).join(order, ["book", "page", "kind", "seq"])
    return rows.drop("seq").withColumnRenamed("place", "seq").join(states.select("book", "page", F.col("is_vertical").alias("vertical")), ["book", "page"], "left"), states
