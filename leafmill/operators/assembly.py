"""Rules that build blocks from spans and words, match headings, and put books together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.functions import text as T
from leafmill.operators.spans import in_spans


def ocr_lines(words: DataFrame, scale: float = 72 / 300) -> DataFrame:
    """Lines from recognised words (book, page, seq, text, conf, block, par, line, left, top, width, height): text and box in points.

    Words without text or confidence are structure and don't count; a line's size is its height, one point at least.
    """
    shown = words.filter((F.col("conf") >= 0) & (T.stripped(F.col("text")) != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    box = {"x0": F.min("left"), "y0": F.min("top"), "x1": F.max(F.col("left") + F.col("width")), "y1": F.max(F.col("top") + F.col("height"))}
    lines = shown.groupBy("book", "page", "block", "par", "line").agg(F.min("seq").alias("seq"), F.array_join(parts, " ").alias("text"), *((c * scale).alias(k) for k, c in box.items()))
    return lines.withColumn("size", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))


def span_groups(spans: DataFrame) -> DataFrame:
    """Blocks from the spans (book, page, line, seq, text, font, size, flags, x0, y0, x1, y1) of lines, one for each run of a style.

    Flags are equal and sizes nearly, in a run; the font's name doesn't count. A gap over a fifth of the size becomes a
    space unless there is one. Bits 0, 1 and 4 of the flags are superscript, italic and bold.
    """
    order = Window.partitionBy("book", "page", "line").orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("flags", "size", "x1", "text")}
    small, large = F.least("size", before["size"]), F.greatest("size", before["size"])
    marker = F.when(F.col("size") <= before["size"], F.col("text")).otherwise(before["text"]).rlike(r"^[\d*†‡§¶]{1,3}$")
    same = (before["flags"] == F.col("flags")) & ((F.abs(F.col("size") - before["size"]) < 0.1) | ((small / large >= 0.5) & ~marker))
    gap = same & (F.col("x0") - before["x1"] > 0.2 * F.col("size")) & ~F.col("text").rlike("^[  ]") & ~before["text"].rlike("[  ]$")
    rows = spans.filter("text <> ''").withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_part", F.when(gap, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_part"))), lambda x: x["_part"])
    bit = lambda i: F.min_by("flags", "seq").bitwiseAND(F.lit(1 << i)) != 0
    return rows.groupBy("book", "page", "line", "run").agg(
        F.array_join(parts, "").alias("text"), F.min_by("font", "seq").alias("font"), F.round(F.min_by("size", "seq"), 2).alias("size"),
        bit(0).alias("superscript"), bit(1).alias("italic"), bit(4).alias("bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def placed_images(images: DataFrame, page_area: float) -> DataFrame:
    """Images (x0, y0, x1, y1 in points, w, h in pixels) that are neither the page itself nor specks."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.filter((w * h < 0.9 * page_area) & (w >= 15) & (h >= 15) & (w * h >= 225) & (F.col("w") >= 20) & (F.col("h") >= 20) & (F.col("w") * F.col("h") >= 400))


def bookmark_blocks(bookmarks: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each bookmark (book, page, mark, title) the shortest block of its page that contains it or is contained in it; the first on ties."""
    a, b = bookmarks.withColumn("_t", T.collapsed(F.col("title"))), blocks.select("book", "page", "seq", "text", T.collapsed(F.col("text")).alias("_b"))
    near = a.join(b, ["book", "page"]).filter((F.col("_t") != "") & (F.col("_b") != "") & (F.contains("_b", "_t") | F.contains("_t", "_b")))
    order = Window.partitionBy("book", "page", "mark").orderBy(F.length("text"), "seq")
    return near.withColumn("n", F.row_number().over(order)).filter("n = 1").select("book", "page", "mark", "title", "seq", "text")


#: What may stand before the number of a chapter.
LABEL_WORDS = ["chapter", "ch", "part", "section", "book", "no", "number"]
#: Fixed value: a number in Roman numerals.
ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def is_chapter_label(c: Column) -> Column:
    """A number in digits or Roman numerals, with one of LABEL_WORDS before it or alone, and a full stop or none."""
    t = F.upper(F.regexp_replace(T.stripped(c), "[.]$", ""))
    named = F.regexp_replace(t, rf"^({'|'.join(w.upper() for w in LABEL_WORDS)})[.]?{T.SPACES}*", "")
    is_number = lambda x: (x != "") & (x.rlike("^[0-9]+$") | x.rlike(ROMAN))
    return is_number(named) | is_number(t)


def titled(headings: DataFrame, blocks: DataFrame, sizes: DataFrame, is_label=is_chapter_label) -> DataFrame:
    """headings (book, page, seq, text) with title and taken: a bare chapter's label takes the next block's text as its title.

    That block begins below the label by four of its sizes at most, has one to twelve words, is no label itself (as
    is_label tells of its text), and is bold or larger than the body (sizes: book, body_size); taken is its seq.
    """
    order = Window.partitionBy("book", "page").orderBy("seq")
    after = F.struct(*(F.lead(c).over(order).alias(c) for c in ("seq", "text", "size", "bold", "y0")), F.col("y1").alias("end"), F.col("size").alias("own"))
    following = blocks.select("book", "page", "seq", after.alias("after"))
    both = headings.join(following, ["book", "page", "seq"], "left").join(sizes, "book", "left")
    a, gap = F.col("after"), F.col("after.y0") - F.col("after.end")
    use = is_chapter_label(F.col("text")) & a["text"].isNotNull() & gap.between(0, 4 * a["own"]) & T.n_words(a["text"]).between(1, 12) & ~is_label(a["text"])
    use = use & (F.col("body_size").isNull() | (a["size"] > F.col("body_size") + 0.5) | a["bold"])
    title = F.when(use, F.concat_ws(" ", T.stripped(F.col("text")), T.stripped(a["text"]))).otherwise(F.col("text"))
    return both.select("book", "page", "seq", title.alias("title"), F.when(use, a["seq"]).alias("taken"))


def entry_markers(blocks: DataFrame, labels: list[str], pattern: str) -> DataFrame:
    """book, marker: numbers that begin blocks after a label of the section; the section doesn't end.

    Only where a book's first label is comes from all its blocks, by an aggregate; no book is sorted.
    """
    is_label = F.regexp_replace(T.collapsed(F.col("text")), "[.:]+$", "").isin(labels)
    opens = blocks.filter(is_label).groupBy("book").agg(F.min(F.struct("page", "seq")).alias("_open"))
    rows = blocks.withColumn("marker", F.regexp_extract("text", pattern, 1)).filter((F.col("marker") != "") & ~is_label)
    return rows.join(opens, "book").filter(F.struct("page", "seq") > F.col("_open")).select("book", "marker").distinct()


def _with_ancestors(key: Column) -> Column:
    """A name and what is left of it without the numbers at its end, one after another."""
    words = F.split(key, " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("name"), F.slice(words, i + 1, F.size(words)).alias("rest")))
    fit = F.filter(cuts, lambda c: F.forall(c["rest"], lambda w: w.rlike(r"^[1-9][0-9]*\z")))
    return F.when(key.rlike(r" [1-9][0-9]*\z"), F.transform(fit, lambda c: c["name"])).otherwise(F.array(key))


def _choose(batches):
    """Names in order, batch by batch: the first of name, name 2, name 3 and so on that its kin have not taken."""
    kin, taken, following = None, set(), {}
    for batch in batches:
        stems = []
        for book, root, key, name in zip(*(batch.column(c).to_pylist() for c in ("book", "_root", "_key", "_name"))):
            if (book, root) != kin:
                kin, taken, following = (book, root), set(), {}
            n = following.get(key, 1)
            while (key if n == 1 else f"{key} {n}") in taken:
                n += 1
            following[key] = n + 1
            taken.add(key if n == 1 else f"{key} {n}")
            stems.append(name if n == 1 else f"{name} {n}")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stems, pa.string())], names=[*batch.schema.names, "stem"])


def unique_names(rows: DataFrame, name: Column, order: str) -> DataFrame:
    """rows (book, order and others) with stem: name, with 2, 3 and so on after those that are taken in the book, upper
    and lower case alike, in order.

    Names that repeat are numbered by windows over equal ones. Only where a book also has a name that numbering may give
    ("Notes 2" beside two of "Notes") do those that can meet, its kin, go through one task in order. Null names stay null.
    """
    at, same = ("book", "_key"), lambda a, b, *on: [a[x].eqNullSafe(b[y]) for x, y in on]
    rows = rows.withColumn("_name", name).withColumn("_key", F.lower("_name"))
    keys = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    repeated = keys.filter("_n > 1").select(F.col("book").alias("_b"), F.col("_key").alias("_root"))
    below = keys.filter(F.col("_key").rlike(r" [1-9][0-9]*\z")).select(*at, F.explode(_with_ancestors(F.col("_key"))).alias("_up")).filter("_up <> _key")
    below = below.join(repeated, same(below, repeated, ("book", "_b"), ("_up", "_root"))).groupBy(*at).agg(F.min_by("_root", F.length("_root")).alias("_root"))
    kin = below.unionByName(below.select("book", F.col("_root").alias("_key"), "_root").distinct())
    kin = kin.groupBy(*at).agg(F.min_by("_root", F.length("_root")).alias("_root")).select(F.col("book").alias("_b"), F.col("_key").alias("_k"), "_root")
    rows = rows.join(kin, same(rows, kin, ("book", "_b"), ("_key", "_k")), "left").drop("_b", "_k")
    number = F.row_number().over(Window.partitionBy(*at).orderBy(order, "_name"))
    alone = rows.filter("_root IS NULL").withColumn("_n", number).withColumn("stem", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit(" "), "_n"))).drop("_n")
    met = rows.filter("_root IS NOT NULL").repartition("book", "_root").sortWithinPartitions("book", "_root", order, "_name")
    met = met.mapInArrow(_choose, StructType([*met.schema, StructField("stem", StringType())]))
    return alone.unionByName(met).drop("_name", "_key", "_root")


def unique_stems(titles: DataFrame) -> DataFrame:
    """book, number, stem: names for the files of a book."""
    return unique_names(titles.select("book", "number", "title"), T.file_name(F.col("title")), "number").select("book", "number", "stem")


def skeleton(headings: DataFrame, blocks: DataFrame, snippet: int = 80) -> DataFrame:
    """book, outline: a line for each heading, set in by level, with the beginning of the block after it; a longer one is
    cut to `snippet` characters, the last three of them full stops."""
    after = F.lead("text").over(Window.partitionBy("book", "page").orderBy("seq"))
    rows = headings.join(blocks.select("book", "page", "seq", after.alias("after")), ["book", "page", "seq"], "left")
    number = F.row_number().over(Window.partitionBy("book").orderBy("page", "seq"))
    rows = rows.withColumn("id", number).withColumn("after", T.stripped(F.regexp_replace("after", "\n", " ")))
    cut = F.when(F.length("after") > snippet, F.concat(F.substring("after", 1, snippet - 3), F.lit("..."))).otherwise(F.col("after"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("["), "id", F.lit("] p"), "page", F.lit(" "), "text", F.when(F.col("after").isNull(), "").otherwise(F.concat(F.lit(" | "), cut)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("book").agg(F.array_join(parts, "\n").alias("outline"))


def reviewed(headings: DataFrame, corrections: DataFrame) -> DataFrame:
    """headings (book, id, level, title) after corrections (book, id, action, new_level); demotions of all are not followed."""
    n = headings.groupBy("book").agg(F.count("*").alias("n"))
    gone = corrections.groupBy("book").agg(F.count_if(F.col("action") == "demote").alias("gone"))
    use = corrections.join(n, "book").join(gone, "book").filter("NOT (action = 'demote' AND gone >= n)").drop("n", "gone")
    both = headings.join(use, ["book", "id"], "left").filter("action IS NULL OR action <> 'demote'")
    return both.select("book", "id", F.when(F.col("action") == "set_level", F.col("new_level")).otherwise(F.col("level")).alias("level"), "title", F.coalesce(F.col("action") == "set_part", F.lit(False)).alias("is_part"))


def in_zones(pages: DataFrame, zones: DataFrame) -> DataFrame:
    """pages (book, page) with the zone (book, start_page, end_page, zone) that holds them, body if none does."""
    hit = in_spans(pages, zones).groupBy("book", "page").agg(F.min("zone").alias("zone"))
    return pages.join(hit, ["book", "page"], "left").select("book", "page", F.coalesce("zone", F.lit("body")).alias("zone"))
