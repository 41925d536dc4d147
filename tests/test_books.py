"""Books from packages made here: what is read, and what is written."""

import io
import zipfile

import pytest

from leafmill.plans.convert import convert_books
from leafmill.sources import books, markup

NOTE = '<a epub:type="noteref" href="#fn1">1</a>'
CHAPTER = f"""<html><head><title>x</title></head><body epub:type="bodymatter"><section epub:type="chapter"><hgroup><h1>Chapter I</h1><p>The Start</p></hgroup>
<p>Some <b>bold</b>, <i>slanted</i>, <code>code</code>, <del>gone</del>, H<sub>2</sub>O and a<sup>2</sup> with a <a href="http://u/">link</a>{NOTE}.</p>
<blockquote><p>To be.</p><cite>Someone</cite></blockquote>
<ol><li>one</li><li>two</li></ol>
<h2>1.1 Tables</h2><table><tr><th>a</th><th>b</th></tr><tr><td colspan="2">c</td></tr></table>
<pre><code>x = 1
y = 2</code></pre>
<figure><img src="img/pic%201.png" alt="alt"/><figcaption>A picture.</figcaption></figure>
<aside class="warning"><p>Mind.</p></aside><math display="block">x^2</math>
<aside id="fn1" epub:type="footnote"><p>1. The note. <a href="#r1">↩</a></p></aside></section></body></html>"""


def epub(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr(
            "o/c.opf",
            """<package xmlns:dc="d"><metadata><dc:title>The Book</dc:title><dc:creator>A. Writer</dc:creator><dc:date>2001-05-06</dc:date><dc:identifier>uuid:1</dc:identifier><dc:identifier>9780000000002</dc:identifier><dc:publisher>House</dc:publisher></metadata>
            <manifest><item id="f" href="preface.xhtml" media-type="application/xhtml+xml"/><item id="a" href="ch1.xhtml" media-type="application/xhtml+xml"/><item id="z" href="appendix-1.xhtml" media-type="application/xhtml+xml"/>
            <item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="p" href="img/pic%201.png" media-type="image/png"/></manifest><spine><itemref idref="n"/><itemref idref="f"/><itemref idref="a"/><itemref idref="z"/></spine></package>""",
        )
        z.writestr("o/preface.xhtml", "<html><body><h1>Preface</h1><p>Before.</p></body></html>")
        z.writestr("o/ch1.xhtml", CHAPTER)
        z.writestr("o/appendix-1.xhtml", "<html><body><p>After.</p></body></html>")
        z.writestr("o/nav.xhtml", '<nav epub:type="toc"><ol><li><a href="a">One</a><ol><li><a href="b">1.1 Inner</a></li></ol></li></ol></nav>')
        z.writestr("o/img/pic 1.png", b"PNG")
        for name, text in more.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    out = io.BytesIO()
    p = lambda style, inner: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>'
    r = lambda text, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    cell = lambda text: f"<w:tc>{p('Normal', r(text))}</w:tc>"
    body = [
        p("Heading1", r("Preface")), p("Normal", r("Hello.")), p("Heading1", r("One")),
        p("Normal", r("Text", "<w:b/>") + r(" and ", '<w:b w:val="0"/>') + r("x", '<w:vertAlign w:val="superscript"/>') + '<w:hyperlink r:id="h">' + r("site") + '</w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r>'),
        p("Quote", r("Said.")), p("ListNumber", r("first")), p("Normal", r("code()", '<w:rFonts w:ascii="Courier New"/>')), p("Heading2", r("1.1 Sub")),
        f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>", p("Normal", '<w:r><w:drawing><a:blip r:embed="i"/></w:drawing></w:r>'), p("Heading1", r("Glossary")), p("Normal", r("late")),
    ]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="h" Target="http://s/"/><Relationship Id="i" Target="media/image1.png"/></Relationships>')
        z.writestr("word/footnotes.xml", '<w:footnotes xmlns:w="w"><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="2"><w:p><w:r><w:t>2. A note.</w:t></w:r></w:p></w:footnote></w:footnotes>')
        z.writestr("word/media/image1.png", b"IMG")
        z.writestr("docProps/core.xml", '<c xmlns:dc="d" xmlns:dcterms="t"><dc:title>Script</dc:title><dc:creator>B</dc:creator><dcterms:created>1999-01-01T00:00:00Z</dcterms:created></c>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    shelf = tmp_path / "in"
    (shelf / "sub" / ".git").mkdir(parents=True)
    for name, data in {"b.epub": epub(), "d.docx": docx(), "bad.epub": b"no zip", "scan.pdf": b"%PDF", "~$x.docx": b"", "sub/e.epub": epub(), "sub/.git/f.epub": epub()}.items():
        (shelf / name).write_bytes(data)
    return str(shelf)


def test_catalog(spark, folder):
    assert [r.filename for r in books.catalog(spark, folder).collect()] == ["b.epub", "bad.epub", "d.docx", "scan.pdf"]
    found = books.catalog(spark, folder, recursive=True)
    assert [r.filename for r in found.collect()] == ["b.epub", "bad.epub", "d.docx", "e.epub", "scan.pdf"]
    total = books.total_size(found).first()
    assert total.n_books == 5 and total.total.endswith("KB")
    assert '"format":"epub"' in books.as_json(found).first().json
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.author) for r in books.sniffed(spark, folder).collect()}
    assert got == {"b.epub": ("The Book", "A. Writer"), "bad.epub": ("bad", "Unknown"), "d.docx": ("Script", "B"), "scan.pdf": ("scan", "Unknown")}
    pdf = books.sniffed(spark, folder, sniffers={"pdf": lambda data: ("A Scan - Libgen", " ")}).filter("format = 'pdf'").first()
    assert (pdf.title, pdf.author) == ("A Scan", "Unknown")


def test_epub_rows():
    rows = books.epub_book(epub(), "b")
    meta = dict(rows[0]["meta"])
    assert meta == {"title": "The Book", "author": "A. Writer", "profile": "technical", "isbn": "9780000000002", "publisher": "House", "year": "2001"}
    items = [r for r in rows if r["row"] == "item"]
    assert [(r["division"], r["kind"]) for r in items] == [("front", "paragraph"), *[("body", k) for k in ("paragraph", "quote", "list", "table", "code", "image", "callout", "math")], ("back", "paragraph")]
    text = items[1]["text"]
    assert text == "Some **bold**, *slanted*, `code`, ~~gone~~, H~2~O and a^2^ with a [link](http://u/)\ue0001\ue000."
    assert items[2]["lines"] == ["To be."] and items[2]["attribution"] == "Someone"
    assert items[4]["complex"] and items[4]["cells"] == [["a", "b"], ["c"]] and items[4]["section_title"] == "1.1 Tables"
    assert (items[6]["image"], items[6]["caption"], items[6]["label"]) == ("pic 1.png", "A picture.", "pic 1")
    assert items[7]["label"] == "Warning" and items[8]["display"] and items[9]["section_title"] == "Appendix 1"
    assert [(r["part"], r["section_title"]) for r in rows if r["row"] == "chapter"] == [(1, "Chapter I: The Start")]
    assert [(r["label"], r["text"]) for r in rows if r["row"] == "note"] == [("1", "The note.")]
    assert [(r["section_level"], r["section_title"]) for r in rows if r["row"] == "bookmark"] == [(1, "One"), (2, "1.1 Inner")]
    assert dict(books.epub_book(epub(), "b", "literature")[0]["meta"])["profile"] == "literature"


def test_docx_rows():
    rows = books.docx_book(docx(), "d")
    assert dict(rows[0]["meta"]) == {"title": "Script", "author": "B", "profile": "technical", "year": "1999"}
    items = [r for r in rows if r["row"] == "item"]
    assert [(r["division"], r["kind"]) for r in items] == [("front", "paragraph"), ("body", "paragraph"), ("body", "quote"), ("body", "list"), ("body", "code"), ("body", "table"), ("body", "image"), ("back", "paragraph")]
    assert items[1]["text"] == "**Text** and ^x^[site](http://s/)\ue0002\ue000"
    assert items[3]["points"][0]["marker"] == "1" and items[4]["lines"] == ["code()"] and items[5]["cells"] == [["a", "b"], ["c", "d"]] and not items[5]["complex"]
    assert items[6]["label"] == "image1" and items[0]["section_title"] == "Preface" and items[7]["section_title"] == "Glossary"
    assert [(r["label"], r["text"]) for r in rows if r["row"] == "note"] == [("2", "A note.")]


def test_markup():
    root = markup.tree("<body><div><span>only text</span></div><div class='note box'>boxed</div><p>a<br/>b</p><p>one<p>two</body>")
    made, notes, numbered = markup.sections(root, "", {}, {})
    assert [x["kind"] for x in made[0]["items"]] == ["callout", "paragraph", "paragraph", "paragraph"] and not notes and not numbered
    assert markup.document_title(markup.tree("<body></body>"), "x/my_first-part.xhtml", None) == "My First Part"
    assert markup.division(markup.tree("<body></body>"), "cover.xhtml", "x") == "front"
    assert markup.division(markup.tree('<body epub:type="chapter"></body>'), "preface.xhtml", "Preface") == "body"
    assert books.docx_division("Appendix B") == "back" and books.docx_division("Indexing") == "body"


def test_convert(spark, folder, tmp_path):
    rows = convert_books(spark, folder, f"file://{tmp_path}/out", recursive=True, converted="2020-01-01").collect()
    errors = {r.path.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in rows if r.error}
    assert errors == {"bad.epub": "corrupt", "scan.pdf": "unsupported"}
    assert {r.folder for r in rows if r.folder} == {"The Book", "The Book (2)", "Script"}
    one = sorted(r.file for r in rows if r.folder == "The Book")
    assert one == ["00 - Front Matter.md", "01 - Chapter I The Start.md", "Appendix 1.md", "The Book - Index.md", "attachments/pic 1.png"]
    text = (tmp_path / "out" / "The Book" / "01 - Chapter I The Start.md").read_text()
    assert text.startswith("# Chapter I: The Start\n\n> [!quote]- p. 1 · The Book, Ch. 1\n\nSome **bold**")
    assert "[^1].\n\n> *To be.*\n> — Someone\n\n1. one\n2. two\n\n### 1.1 Tables\n\n<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>\n\n```\nx = 1\ny = 2\n```\n\n![[pic 1.png]]\n*A picture.*\n\n> [!warning] Warning\n> Mind.\n\n$$\nx^2\n$$\n\n[^1]: The note.\n" in text
    assert (tmp_path / "out" / "The Book" / "attachments" / "pic 1.png").read_bytes() == b"PNG"
    assert "- [[00 - Front Matter|Front Matter]]\n- [[01 - Chapter I The Start|Chapter I: The Start]]\n\n## Back Matter\n- [[Appendix 1|Appendix 1]]\n" in (tmp_path / "out" / "The Book" / "The Book - Index.md").read_text()
    assert "> *Said.*" in (tmp_path / "out" / "Script" / "01 - One.md").read_text()
    again = convert_books(spark, folder, f"file://{tmp_path}/one", single_file=True, core_only=True, converted="2020-01-01").collect()
    assert {r.file for r in again if r.file} == {"The Book.md", "Script.md", "attachments/pic 1.png", "attachments/image1.png"}
    whole = (tmp_path / "one" / "The Book" / "The Book.md").read_text()
    assert "scope: core_chapters" in whole and "Preface" not in whole and whole.endswith("---\n\n## Footnotes\n\n[^1]: The note.\n")
