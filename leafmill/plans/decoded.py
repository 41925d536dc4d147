"""From files of pages, by decoders that the caller gives, to Markdown files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import pages as P
from leafmill.operators import rendering
from leafmill.operators import semantic as S
from leafmill.plans import books as plan
from leafmill.plans import convert
from leafmill.sources import books
from leafmill.sources import decoded as D
from leafmill.sources.shared import Told, keeper

#: The page that rules see, in points; others are scaled to its width.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def _scaled(table: DataFrame, scales: DataFrame, *columns: str) -> DataFrame:
    return table.join(scales, "book").withColumns({c: F.col(c) * F.col("_scale") for c in columns}).drop("_scale")


def zones_of(pages: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """book, start_page, end_page, zone of decoded pages (book, page): by labels of matter in their lines and their printed
    numbers (book, page, title), those of the decoder before those at the foot of the page."""
    totals = Window.partitionBy("book")
    every = pages.select("book", F.col("page").alias("number")).distinct().withColumn("total", F.max("number").over(totals))
    texts = blocks.filter("kind = 'text'")
    said = texts.select("book", F.col("page").alias("number"), "text").join(every, ["book", "number"])
    signals = S.matter_signals(said)
    printed = S.page_labels(texts, PAGE_HEIGHT).select("book", F.col("page").alias("number"), F.col("label").alias("_foot"))
    given = labels.groupBy("book", F.col("page").alias("number")).agg(F.min("title").alias("_given"))
    rows = every.join(signals.drop("total"), ["book", "number"], "left").join(printed, ["book", "number"], "left").join(given, ["book", "number"], "left")
    return S.zone_entries(rows.select("book", "number", "total", F.coalesce("front", F.lit(False)).alias("front"), F.coalesce("back", F.lit(False)).alias("back"), F.coalesce("_given", "_foot").alias("label")))


def tree(spark: SparkSession, tables: dict[str, DataFrame], day: str, profile: str = "auto", recogniser: Callable | None = None, resources: ResourceProfile | None = None, review: Callable | None = None, told: Told | None = None) -> plan.Tree:
    """The books of decoded tables (see sources.decoded.split), as rendering takes them."""
    keep = keeper(spark, "decoded", told)
    sizes = tables["page"].groupBy("book", "width").agg(F.count("*").alias("n")).groupBy("book").agg(F.max_by("width", F.struct("n", "width")).alias("width"))
    scales = sizes.select("book", (F.lit(PAGE_WIDTH) / F.col("width")).alias("_scale"))
    box = ("x0", "y0", "x1", "y1")
    spans, grids, images = _scaled(tables["span"], scales, "size", *box), _scaled(tables["grid"], scales, *box), _scaled(tables["image"].drop("content"), scales, *box)

    def words(states: DataFrame) -> DataFrame:
        given = tables["word"]
        if recogniser is None:
            return given
        asked = states.join(given.select("book", "page").distinct(), ["book", "page"], "left_anti")
        return given.unionByName(keep(D.recognised(tables["raster"], asked, recogniser, resources), "words"))

    blocks, states = P.extracted(tables["page"].select("book", "page"), spans, tables["line"], grids, images, words, PAGE_WIDTH * PAGE_HEIGHT, keep)
    blocks = keep(blocks, "blocks")
    zones = keep(zones_of(tables["page"], blocks, tables["label"]), "zones")
    stem = F.regexp_replace(F.element_at(F.split("book", "/"), -1), r"\.[^.]+$", "")
    known = tables["page"].select("book").distinct().join(tables["book"].groupBy("book").agg(F.min("title").alias("title"), F.min("author").alias("author")), "book", "left")
    named = known.select("book", T.clean_title(F.col("title"), stem).alias("title"), F.coalesce(F.nullif(T.stripped(F.col("author")), F.lit("")), F.lit("Unknown")).alias("author"), F.lit(day).alias("converted"))
    marks = tables["bookmark"].select("book", F.col("seq").alias("mark"), "level", "title", "page")
    return plan.semantic(spark, named, blocks, zones, marks, profile, PAGE_WIDTH, PAGE_HEIGHT, review, told)


def convert_decoded(spark: SparkSession, folder: str, out: str, decoders: dict[str, D.Decoder], recursive: bool = False, single_file: bool = False, core_only: bool = False, profile: str = "auto", converted: str | None = None, recogniser: Callable | None = None, resources: ResourceProfile | None = None, review: Callable | None = None, told: Told | None = None) -> DataFrame:
    """Converts the files of a folder that decoders know; returns what convert_books does.

    Each file is decoded once; each page that has no usable text is recognised once, if there is a recogniser and a
    picture of it. Encrypted, corrupt and unsupported files are rows with an error. told is called with the name of each
    stage and its numbers of rows, the first one's of books, pages and errors too; a stage's jobs have a tag.
    """
    files = books._files(spark, folder, recursive).filter(F.col("format").isin(*decoders))
    rows = convert.staged(D.decoded(files, decoders), spark, "decoded", told)
    tables, day = D.split(rows), converted or convert.today(spark)
    made = tree(spark, tables, day, profile, recogniser, resources, review, told)
    whole = made.documents(core_only) if single_file else made.files()
    shown = made.items.filter("kind = 'image'").select("book", "image", rendering.attachment_name(F.col("label"), F.col("image")).alias("name"))
    one = shown.groupBy("book", "name").agg(F.min("image").alias("image"))
    contents = tables["image"].filter("content IS NOT NULL").select("book", "image", "content").dropDuplicates(["book", "image"])
    pictures = one.join(contents, ["book", "image"]).select("book", F.concat(F.lit("attachments/"), "name").alias("file"), "content")
    places = convert.folders(made.books)
    texts = whole.select("book", "file", F.encode("body", "utf-8").alias("content"))
    written = convert.write_files(texts.unionByName(pictures).join(places.select("book", "folder"), "book"), out)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    failed = tables["errors"].select("path", none("folder", "string"), none("file", "string"), none("size", "long"), "error")
    return written.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
