"""From bytes by a decoder, and a recogniser of flagged pages, to files."""

import json

import pytest

from leafmill.plans.decoded import convert_decoded
from leafmill.sources.books import EncryptedError

BODY = "This is a line of prose that runs on to the margin and has enough characters in it"


def span(page, line, text, size=10.0, y=100.0, x0=72.0, x1=400.0, flags=0):
    return {"row": "span", "page": page, "line": line, "seq": 0, "text": text, "font": "Times", "size": size, "flags": flags, "x0": x0, "y0": y, "x1": x1, "y1": y + size}


def book(title):
    rows = [{"row": "book", "title": title, "author": "A. Writer"}]
    rows.append({"row": "image", "page": 3, "image": "scan.png", "x0": 0.0, "y0": 0.0, "x1": 612.0, "y1": 792.0, "w": 1200, "h": 1600})
    for page in range(1, 6):
        rows += [{"row": "page", "page": page, "width": 612.0, "height": 792.0}, {"row": "line", "page": page, "line": 0, "vertical": False}, {"row": "raster", "page": page, "content": f"{title} {page}"}]
    rows += [span(1, 0, "Preface"), span(1, 1, "Before all this the author thanks everyone.", y=130.0), {"row": "label", "page": 1, "title": "i"}]
    rows += [span(2, 0, "Chapter I", 24.0, flags=16), span(2, 1, "The Sea", 18.0, 130.0, flags=16), span(2, 2, BODY, y=160.0), span(2, 3, "and on to its end here.", y=174.0), {"row": "label", "page": 2, "title": "1"}]
    rows += [{"row": "image", "page": 2, "image": "boat.png", "x0": 72.0, "y0": 300.0, "x1": 200.0, "y1": 400.0, "w": 200, "h": 200, "content": "PNG"}, span(2, 4, "Figure 1. A boat", y=404.0, x1=160.0)]
    rows += [{"row": "grid", "page": 4, "cells": [["h", "i"], ["j", "k"]], "x0": 72.0, "y0": 200.0, "x1": 300.0, "y1": 250.0}, span(4, 0, "The last page has a table and some more words.", y=100.0)]
    return rows


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("decoded")
    (top / "in").mkdir()
    for name, data in {"a.pdf": json.dumps(book("The Tide")).encode(), "locked.pdf": b"%LOCKED", "none.pdf": b"no json", "half.pdf": json.dumps([*book("Half"), {"row": "stop"}]).encode()}.items():
        (top / "in" / name).write_bytes(data)
    stages = {}
    decoded, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    asked = str(top / "asked")

    def decoder(data):
        decoded.add(1)
        if data.startswith(b"%LOCKED"):
            raise EncryptedError("password")
        for row in json.loads(data):
            if row["row"] == "stop":
                raise ValueError("damaged")
            yield {k: v.encode() if k == "content" else v for k, v in row.items()}

    def recogniser(picture):
        seen.add(1)
        with open(asked, "ab") as f:
            f.write(picture + b"\n")
        return [{"text": t, "conf": 90, "left": 300.0 + 100 * i, "top": 500.0, "width": 80.0, "height": 40.0} for i, t in enumerate(["Read", "by", "machine", "alone"])]

    rows = convert_decoded(spark, str(top / "in"), f"file://{top}/out", {"pdf": decoder}, profile="literature", converted="2020-01-01", recogniser=recogniser, told=stages.__setitem__).collect()
    return top, rows, decoded.value, seen.value, (top / "asked").read_bytes(), stages


def test_files(made):
    top, rows, *_ = made
    files = {r.file for r in rows if r.file}
    assert files == {"00 - Front Matter.md", "01 - Chapter I The Sea.md", "The Tide - Index.md", "attachments/fig-1.png"} and {r.folder for r in rows if r.folder} == {"The Tide"}
    text = (top / "out" / "The Tide" / "01 - Chapter I The Sea.md").read_text()
    assert f"{BODY} and on to its end here." in text and "Read by machine alone" in text and "| h | i |" in text and "![[fig-1.png]]\n*Figure 1. A boat*" in text
    assert (top / "out" / "The Tide" / "attachments" / "fig-1.png").read_bytes() == b"PNG"
    assert "Before all this the author thanks everyone." in (top / "out" / "The Tide" / "00 - Front Matter.md").read_text()


def test_errors_are_rows(made):
    rows = made[1]
    assert {r.path.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in rows if r.error} == {"locked.pdf": "encrypted", "none.pdf": "corrupt", "half.pdf": "corrupt"}


def test_each_file_and_page_once(made):
    _, _, decoded, seen, asked, stages = made
    assert {k: stages["rows"][k] for k in ("books", "pages", "errors")} == {"books": 2, "pages": 10, "errors": 3} and stages["words"] == {"rows": 4}
    assert decoded == 4 and seen == 1 and asked == b"The Tide 3\n"
