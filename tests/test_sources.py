"""Books as a source, through a stream, and what is parsed how often."""

import zipfile
from types import SimpleNamespace

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import StructType
from test_books import docx, epub, folder  # noqa: F401

from leafmill.plans.convert import convert_books
from leafmill.sources import books, datasource
from leafmill.sources.html import items, page_items
from leafmill.streaming.conversion import convert_new_books, manifest
from leafmill.streaming.tables import into_table

NAMES = books.ROWS_DDL


def in_process(spark, monkeypatch, path, filters=(), ddl=NAMES, **options):
    """Rows of a reader in this process, and the files that it has opened."""
    opened = []
    local = pafs.LocalFileSystem()

    def system(uri, real=datasource.opened):
        fs, place, before = real(uri)
        return SimpleNamespace(get_file_info=local.get_file_info, open_input_stream=lambda p: opened.append(p.rsplit("/", 1)[-1]) or local.open_input_stream(p)), place, before

    monkeypatch.setattr(datasource, "opened", system)
    reader = datasource.BooksReader(StructType.fromDDL(ddl), {"path": path, "recursive": "true"} | options)
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, opened, left, len(reader.partitions())


def test_filters_and_columns(spark, monkeypatch, folder):  # noqa: F811
    rows, opened, left, _ = in_process(spark, monkeypatch, folder, [EqualTo(("format",), "epub"), EqualTo(("kind",), "list")])
    assert sorted(opened) == ["b.epub", "bad.epub", "e.epub"] and left == [EqualTo(("kind",), "list")]
    assert {r["row"] for r in rows} == {"book", "chapter", "item", "note", "bookmark", "image", "error"}
    monkeypatch.undo()
    rows, opened, left, _ = in_process(spark, monkeypatch, folder, [StringStartsWith(("path",), f"file://{folder}/sub"), EqualTo(("row",), "image")])
    assert opened == ["e.epub"] and not left and [(r["row"], r["content"]) for r in rows] == [("image", b"PNG")]
    monkeypatch.undo()
    read = []
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, real=zipfile.ZipFile.read: read.append(name) or real(self, name))
    rows, _, _, n = in_process(spark, monkeypatch, folder, ddl="path string, row string, text string", bytes="1")
    assert rows and not any(name.endswith(".png") for name in read) and n == 5


def test_format(spark, folder):  # noqa: F811
    datasource.register(spark)
    found = spark.read.format("books").option("recursive", "true").load(f"file://{folder}")
    want = books.read_books(spark, folder, recursive=True)
    columns = [c for c in found.columns if c not in ("meta", "content")]
    key = F.xxhash64(*(F.regexp_replace(F.col(c).cast("string"), "^file:/+", "/") if c == "path" else F.to_json(F.struct(c)) for c in columns)).alias("k")
    assert sorted(r.k for r in found.select(key).collect()) == sorted(r.k for r in want.select(key).collect())
    few = found.filter("format = 'docx' AND row = 'image'").select("path", "content")
    assert [r.content for r in few.collect()] == [b"IMG"]
    with pytest.raises(Exception, match="load"):
        spark.read.format("books").load().count()


def test_stream_of_rows(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(epub())
    rows = spark.readStream.format("books").option("settle", "0").load(f"file://{tmp_path}/in").filter("row = 'book'")

    def run():
        rows.select("path").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["a.epub"]
    (tmp_path / "in" / "b.docx").write_bytes(docx())
    assert run() == ["a.epub", "b.docx"]


def test_each_file_is_parsed_once(spark, tmp_path):
    shelf = tmp_path / "in"
    shelf.mkdir()
    for name in ("a.pdf", "b.pdf"):
        (shelf / name).write_bytes(name.encode())
    calls = spark.sparkContext.accumulator(0)

    def reader(data, stem, profile):
        calls.add(1)
        return [{"row": "book", "meta": [("title", stem), ("author", "A"), ("profile", "literature")]}, {"row": "chapter", "part": 1, "section_title": "One"}, {"row": "item", "division": "body", "part": 1, "section": 0, "item": 0, "section_level": 1, "page": 1, "kind": "paragraph", "text": data.decode()}]

    rows = convert_books(spark, str(shelf), f"file://{tmp_path}/out", converted="2020-01-01", readers={"pdf": reader}).collect()
    assert len(rows) == 4 and calls.value == 2


def files_of(out):
    return {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and "_books" not in str(p)}


def test_a_batch_that_ends_before_its_commit(spark, tmp_path):
    """The job is killed between the files and the manifest; the next one finds each book once."""
    shelf, out = tmp_path / "in", tmp_path / "out"
    shelf.mkdir()
    target = f"file://{out}"
    run = lambda **more: convert_new_books(spark, str(shelf), target, f"{tmp_path}/cp", once=True, converted="2020-01-01", **more).awaitTermination()

    def killed(batch):
        raise RuntimeError("killed")

    (shelf / "a.epub").write_bytes(epub())
    (shelf / "bad.epub").write_bytes(b"none")
    with pytest.raises(Exception, match="killed"):
        run(before_commit=killed)
    before = files_of(out)
    assert before and manifest(spark, target).count() == 0
    run()
    assert files_of(out) == before
    (shelf / "b.epub").write_bytes(epub())  # a second book of the same title, in a batch of its own
    (shelf / "c.docx").write_bytes(docx())
    with pytest.raises(Exception, match="killed"):
        run(before_commit=killed)
    run()
    run()
    rows = manifest(spark, target).collect()
    told = sorted((r.batch, r.book.rsplit("/", 1)[-1], r.folder) for r in rows if r.folder)
    assert told == [(0, "a.epub", "The Book"), (1, "b.epub", "The Book (2)"), (1, "c.docx", "Script")]
    assert [(r.book.rsplit("/", 1)[-1], r.error.split(":")[0]) for r in rows if r.error] == [("bad.epub", "corrupt")]
    assert {p.split("/")[0] for p in files_of(out)} == {"The Book", "The Book (2)", "Script"}
    assert all(r.files == sum(p.startswith(f"{r.folder}/") for p in files_of(out)) for r in rows if r.folder)


@pytest.mark.parametrize("tag", ["div", "b", "li", "section", "ol><li"])
def test_pages_of_any_depth(spark, tag):
    page = f"<body><p>before</p>{f'<{tag}>' * 100_000}deep<p>after</p>"
    told = " ".join(str(x.get("text") or x.get("points") or "") for x in page_items(page))
    assert "before" in told and "after" in told


def test_faulty_pages(spark):
    deep = "<blockquote><div>" * 20_000 + "x"
    rows = items(spark.createDataFrame([(1, deep), (2, "<p>fine</p>"), (3, None), (4, "text <!-- not closed <p>gone</p>"), (5, "<!doctype html><p>a</p><!-- b --><p>c</p>")], "id long, html string"), "id", "html").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.section or 0, r.item or 0)):
        got.setdefault(r.id, []).append(r.error.split(":")[0] if r.error else r.text)
    assert got == {1: ["corrupt"], 2: ["fine"], 4: ["text"], 5: ["a", "c"]}


def test_a_table_has_each_batch_once(spark, tmp_path):
    """The first run ends after the batch is written, before the stream knows of it."""
    (tmp_path / "in").mkdir()
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    rows = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    run = lambda rule: into_table(rows(), rule, f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    doubled = lambda df: df.selectExpr("id * 2 AS id")

    def killed(df):
        doubled(df).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed).awaitTermination()
    for _ in range(2):
        run(doubled).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8]


def test_references_without_semicolons():
    from leafmill.sources.html import closed_references, page_items

    text = "a &amp b &ampx; &amp; &#38; &#38 &nosuch; &"
    assert page_items(f"<p>{text}</p>")[0]["text"] == "a & b &x; & & & &nosuch; &"
    assert page_items(closed_references(f"<p>{text}</p>"))[0]["text"] == "a &amp b &ampx; & & &#38 &nosuch; &"
