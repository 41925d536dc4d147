"""Files of books against a plain renderer, an item at a time."""

import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import rendering as R
from leafmill.operators.layout import ENDNOTE_MARK, FOOTNOTE_MARK
from leafmill.plans import rendering_queries as Q

SF = "/root/testdata/sf0.001"


def references(text, notes, works, mapping=None):
    text = re.sub("(.+?)", lambda m: f"[^{(mapping or {}).get(m[1], m[1])}]", text)
    for mark, stem, prefix in (("", notes, "note"), ("", works if works is not None else notes, "ref")):
        text = re.sub(f"{mark}(.+?){mark}", lambda m, s=stem, p=prefix: m[1] if s is None else f"[[{s}#^{p}-{m[1]}|{m[1]}]]", text)
    return text


def item(r, notes, works, anchor, mapping=None, single=False):
    show = lambda x: references(x, notes, works, mapping)
    k = r["kind"]
    if k == "paragraph":
        return [show(r["text"])]
    if k == "quote":
        return [f"> *{show(x)}*" if r["italic"] else f"> {show(x)}" for x in r["lines"]] + ([f"> — {r['attribution']}"] if r["attribution"] else [])
    if k == "image":
        base = r["image"].split("/")[-1]
        name = (r["label"] or base.rsplit(".", 1)[0]) + ("." + base.rsplit(".", 1)[1] if "." in base else ".png")
        return [f"![{r['caption'] or name}](attachments/{name})" if single else f"![[{name}]]"] + ([f"*{r['caption']}*"] if r["caption"] else [])
    if k == "table":
        if r["complex"]:
            return ["<table>" + "".join("<tr>" + "".join(f"<td>{show(c)}</td>" for c in row) + "</tr>" for row in r["cells"]) + "</table>"]
        lines = ["| " + " | ".join(show(c) for c in row) + " |" for row in r["cells"]]
        return [lines[0], "|" + "|".join("---" for _ in r["cells"][0]) + "|", *lines[1:]]
    if k == "list":
        out = []
        for p in r["points"]:
            numbered = p["ordered"] and p["marker"]
            out.append("    " * p["level"] + (p["marker"] + "." if numbered else "-") + " " + show(p["text"]) + (f" ^{anchor}-{p['marker']}" if anchor and numbered else ""))
        return out
    if k == "code":
        return ["```", *r["lines"], "```"]
    if k == "callout":
        kind = {"Key Point": "important", "Theorem 2": "theorem"}.get(r["label"], "info")
        return [f"> [!{kind}] {r['label']}"] + [f"> {show(x)}" for x in r["lines"] if x]
    if k == "math":
        return ["$$", r["text"], "$$"] + ([f"({r['numbering']})"] if r["numbering"] else []) if r["display"] else [f"${r['text']}$"]
    if k == "verse":
        lead = "> " if r["quoted"] else ""
        return [lead.rstrip() if not x else f"{lead}{show(x)}  " for x in r["lines"]] + ([f"{lead}— {r['attribution']}"] if r["attribution"] else [])
    return "\n\n".join(f"**{e['term']}**" + (f" — {show(e['definition'])}" if e["definition"] else "") for e in r["entries"]).split("\n")


def sections_of(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["section"], r["item"])):
        out[r["section"]].append(r)
    return [out[k] for k in sorted(out)]


def body(rows, notes, works, label, notes_by_page, anchors, skip=False):
    lines, page = [], None
    for i, section in enumerate(sections_of(rows)):
        title, level = section[0]["section_title"], section[0]["section_level"]
        if title and not (skip and i == 0):
            lines += ["#" * (max(level, 2) if skip else level + 1) + " " + title, ""]
        for r in section:
            if r["page"] is not None and r["page"] != page:
                if page is not None:
                    lines += notes_by_page.get(page, [])
                lines += [f"> [!quote]- {label(r['page'])}", ""]
                page = r["page"]
            lines += [*item(r, notes, works, anchors), ""]
    return lines + (notes_by_page.get(page, []) if page is not None else [])


@pytest.fixture(scope="module")
def tree(spark):
    items = [r.asDict(recursive=True) for r in Q.whole_items(spark, SF).collect()]
    notes = [r.asDict() for r in Q.footnotes(spark, SF).collect()]
    chapters = [r.asDict() for r in Q._chapters(spark, SF).collect()]
    return items, notes, chapters


def divisions(rows):
    """(title, stem, rows) of the sections of back matter of a book."""
    out, used = [], set()
    for section in sections_of(rows):
        if section[0]["section_level"] == 1 or not out:
            title = section[0]["section_title"] or "Back Matter"
            stem, n = title, 2
            while stem.lower() in used:
                stem, n = f"{title} {n}", n + 1
            used.add(stem.lower())
            out.append((title, stem, []))
        out[-1][2].extend(section)
    return out


def stem_of(parts, names):
    return next((s for t, s, _ in parts if t.lower().rstrip(".:") in names), None) or next((s for t, s, _ in parts if t.lower() in ("back matter", "untitled")), None)


def test_library(spark, tree):
    items, notes, chapters = tree
    got = {(r.book, r.file): r.body for r in Q.render_whole_library(spark, SF).filter("kind <> 'index'").collect()}
    want = {}
    for book in {r["book"] for r in items}:
        mine = [r for r in items if r["book"] == book]
        parts = divisions([r for r in mine if r["division"] == "back"])
        to = (stem_of(parts, R.NOTE_TITLES), stem_of(parts, R.WORK_TITLES))
        front = [r for r in mine if r["division"] == "front"]
        if front:
            want[book, "00 - Front Matter.md"] = ["# Front Matter", "", *body(front, *to, lambda p, b=book: f"p. {p} · Book: {b}", {}, None)]
        for c in chapters:
            if c["book"] != book:
                continue
            n, by_page = c["number"], defaultdict(list)
            for x in sorted((x for x in notes if x["book"] == book and x["part"] == n), key=lambda x: x["seq"]):
                by_page[x["page"]].append(f"[^{x['marker']}]: {x['text']}")
            told = {p: [*x, ""] for p, x in by_page.items()}
            rows = [r for r in mine if r["division"] == "body" and r["part"] == n]
            want[book, f"{n:02d} - {c['title']}.md"] = [f"# {c['title']}", "", *body(rows, *to, lambda p, b=book, n=n: f"p. {p} · Book: {b}, Ch. {n}", told, None)]
        for title, stem, rows in parts:
            anchor = {"notes": "note", "endnotes": "note", "references": "ref"}.get(title.lower())
            want[book, f"{stem}.md"] = [f"# {title}", "", *body(rows, *to, lambda p, b=book: f"p. {p} · Book: {b}", {}, anchor, skip=True)]
    assert got == {k: "\n".join(v).rstrip() + "\n" for k, v in want.items()}


@pytest.mark.parametrize("core_only", [False, True])
def test_single_documents(spark, tree, core_only):
    items, notes, chapters = tree
    made = R.single_documents(Q._books(spark, SF), Q._chapters(spark, SF), Q.whole_items(spark, SF), Q.footnotes(spark, SF).drop("division"), core_only)
    got = {r.book: r.body for r in made.collect()}
    want = {}
    for book in {r["book"] for r in items}:
        mine = [r for r in items if r["book"] == book]
        front, back = ([r for r in mine if r["division"] == d and not core_only] for d in ("front", "back"))
        titles = {(r["section_title"] or "").lower() for r in back}
        to = ("" if titles & set(R.NOTE_TITLES) else None, "" if titles & set(R.WORK_TITLES) else None)
        own = sorted((x for x in notes if x["book"] == book), key=lambda x: (x["part"], x["page"], x["seq"]))
        markers = [x["marker"] for x in own]
        mapping, ends = defaultdict(dict), []
        for i, x in enumerate(own, 1):
            new = x["marker"] if len(set(markers)) == len(markers) else str(i) if all(m.isdigit() for m in markers) else f"{x['part']}-{x['marker']}"
            mapping[x["part"]][x["marker"]] = new
            ends.append(f"[^{new}]: {x['text']}")
        lines = ["---", f"title: Book: {book}", "author: An Author", "profile: literature", "output_mode: single_document", *(["scope: core_chapters"] if core_only else []), "converted: 2020-01-01", "---", "", f"# Book: {book}", ""]

        def told(rows, base, anchor=None, maps=None, skip=False):
            for i, section in enumerate(sections_of(rows)):
                title, level = section[0]["section_title"], section[0]["section_level"]
                if title and not (skip and i == 0):
                    lines.extend(["#" * (max(level, 2) if skip else base + level - 1) + " " + title, ""])
                for r in section:
                    lines.extend([*item(r, *to, anchor, maps, single=True), ""])

        if front:
            lines += ["## Front Matter", ""]
            told(front, 3)
        part = None
        for c in sorted((c for c in chapters if c["book"] == book), key=lambda c: c["number"]):
            if c["part_title"] and c["part_title"] != part:
                part = c["part_title"]
                lines += [f"## {part}", ""]
            level = 3 if part else 2
            lines += ["#" * level + " " + c["title"], ""]
            told([r for r in mine if r["division"] == "body" and r["part"] == c["number"]], level + 1, maps=mapping[c["number"]])
        if back:
            lines += ["## Back Matter", ""]
            for title, _, rows in divisions(back):
                lines += [f"### {title}", ""]
                told(rows, 4, {"notes": "note", "references": "ref"}.get(title.lower()), skip=rows[0]["section_title"] == title)
        if ends:
            lines += ["---", "", "## Footnotes", "", *ends, ""]
        want[book] = re.sub(r"\n{3,}", "\n\n", "\n".join(lines).rstrip() + "\n")
    assert got == want


def test_odd_marks(spark):
    """A mark without another stays, empty lists and tables give no lines."""
    rows = spark.createDataFrame([("a1b2",), ("none",), ("",)], "t string")
    assert [r[0] for r in rows.select(R.footnote_references(rows.t)).collect()] == ["a[^1]b2", "none", ""]


def test_lines_of_a_book_are_not_sorted_in_one_task(spark):
    """Single documents: the lines of a part become text before anything is partitioned by the book alone."""
    plan = Q.render_single_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan
    assert not re.search(r"windowspecdefinition\(book#\d+L?, part#\d+L? ASC NULLS FIRST, specifiedwindowframe\(RangeFrame", plan)


def test_references_do_not_repeat_the_text(spark):
    """Plans stay small: the text is named once however many marks are looked for, and lines are read four times at most
    (chapters, back matter, and notes twice)."""
    c = R.references(F.col("said"), F.lit("Notes"), F.lit("Works"), F.create_map(F.lit("1"), F.lit("2")))
    assert str(c).count("said") == 1 and str(R.references(F.col("said"), F.lit("Notes"), F.lit("Works"))).count("said") == 1
    plan = Q.render_whole_library(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Generate posexplode") <= 4


@pytest.mark.parametrize("stem", ["A $1 \\ note", "", None])
def test_stems_are_taken_as_they_are(spark, stem):
    mark, other = ENDNOTE_MARK, FOOTNOTE_MARK
    rows = spark.createDataFrame([(f"a{mark}7{mark}{mark}\n{mark} $1 \\ b{mark}9", stem), (None, stem), (f"{other}{other}{other}1", stem)], "t string, stem string")
    show = lambda x: x if stem is None else f"[[{stem}#^note-{x}|{x}]]"
    got = [r[0] for r in rows.select(R.references(rows.t, rows.stem, F.lit(None).cast("string"))).collect()]
    assert got == [f"a{show('7')}{show(chr(10))} $1 \\ b{mark}9", None, f"[^]{other}1"]
    mapped = R.references(rows.t, rows.stem, F.lit(None).cast("string"), F.create_map(F.lit("1"), F.lit("5")))
    assert [r[0] for r in rows.select(mapped).collect()] == got


def test_no_group_has_the_text_of_a_book(spark):
    """Single documents: no aggregate or window of the JVM by the book alone has its lines; they come in order, part by part."""
    plan = Q.render_single_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    by_book = [x for x in plan.splitlines() if re.search(r"Aggregate \[book#\d+L?\], ", x) or re.search(r"Window \[.*\], \[book#\d+L?\]", x)]
    assert by_book and not any("collect_list" in x or "_text" in x for x in by_book)


def test_pieces_put_together():
    """Line feeds meet over pieces, heads without text stand alone, and pieces of books that have no head are left out."""
    rows = [("a", -1, "a.md", "# A\n"), ("a", 1, None, "x\n\n\n\ny\n"), ("a", 1, None, "\n\n"), ("a", 1, None, ""), ("a", 1, None, "\n z \n"), ("a", 4, None, " \t\n"), ("b", 1, None, "lost"), ("c", -1, None, "# C\n"), (None, -1, "n.md", "é")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("book", "rank", "file", "line"), x)) for x in rows], schema=pa.schema([("book", pa.string()), ("rank", pa.int32()), ("file", pa.string()), ("line", pa.string())]))
    got = [tuple(r.values()) for n in (1, 9) for x in R._put_together(batch.slice(i, n) for i in range(0, 9, n)) for r in x.to_pylist()]
    assert got == 2 * [("a", "a.md", "# A\n\nx\n\ny\n\n z\n"), ("c", None, "# C\n"), (None, "n.md", "é\n")]
    text = "\n".join(x[3] for x in rows if x[0] == "a")
    assert got[0][2] == re.sub(r"\n{3,}", "\n\n", text.rstrip(" \t\n\x0b\f\r") + "\n")
